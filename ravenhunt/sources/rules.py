"""Sigma-style rule files -> rule table (RULE_SCHEMA).

Files are read as whole texts by Spark (``wholetext``); decoding the YAML is
the one step that needs Python on the workers and runs in ``mapInArrow``.
A bad file yields a row with ``error`` set; only that rule is skipped. As one
bad document spoils its file, a file's rules are held until all are decoded:
in Arrow form, of which ``DECODED_AT_ONCE`` are Python objects at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ravenhunt.schemas import RULE_SCHEMA

try:  # PyYAML is optional; without it only pre-decoded rules can be used.
    import yaml
except ImportError:  # pragma: no cover
    yaml = None


def _value_text(v) -> str | None:
    if v is None or isinstance(v, bool):
        return None
    text = v if isinstance(v, str) else str(v)
    # Leading/trailing wildcards are implied by the operator; inner ones stay.
    return text.strip("*")


def decode_rule(doc, path: str | None = None) -> dict:
    """Decoded rule document -> RULE_SCHEMA record (plain Python)."""
    row = {
        "id": None,
        "title": None,
        "description": None,
        "level": None,
        "tags": [],
        "selections": [],
        "condition": None,
        "logsource": {},
        "path": path,
        "error": None,
    }
    if not isinstance(doc, dict):
        row["error"] = "rule document is not a mapping"
        return row
    row["id"] = None if doc.get("id") is None else str(doc.get("id"))
    row["title"] = None if doc.get("title") is None else str(doc.get("title"))
    row["description"] = None if doc.get("description") is None else str(doc.get("description"))
    row["level"] = None if doc.get("level") is None else str(doc.get("level"))
    tags = doc.get("tags") or []
    row["tags"] = [str(t) for t in (tags if isinstance(tags, list) else [tags])]
    logsource = doc.get("logsource") or {}
    if isinstance(logsource, dict):
        row["logsource"] = {str(k): str(v) for k, v in logsource.items() if v is not None}
    detection = doc.get("detection")
    if not isinstance(detection, dict):
        row["error"] = "missing detection"
        return row
    errors = []
    for name, body in detection.items():
        if name == "condition":
            continue
        if isinstance(body, dict):
            items = []
            for key, raw in body.items():
                parts = str(key).split("|")
                field = parts[0]
                op = parts[1] if len(parts) > 1 else "equals"
                values = raw if isinstance(raw, list) else [raw]
                texts = [t for t in (_value_text(v) for v in values) if t is not None]
                if texts:
                    items.append({"field": field, "op": op, "values": texts})
            if items:
                row["selections"].append({"name": str(name), "items": items})
        elif isinstance(body, list) and body and all(isinstance(b, dict) for b in body):
            # A list of maps (OR of maps) is not evaluated: the selection is
            # left undefined, so conditions using it do not fire.
            continue
        else:
            errors.append(f"keyword selection '{name}' is not supported")
    condition = detection.get("condition")
    if isinstance(condition, list):
        condition = " ".join(str(c) for c in condition)
    row["condition"] = None if condition is None else str(condition)
    if errors:
        row["error"] = "; ".join(errors)
    return row


def _decoded(text: str, path: str | None) -> Iterator[dict]:
    """The rules of one file ('---'-separated YAML documents), one by one; in a
    bad file the last has ``yaml: ...`` as its error, and those before it are void."""
    if yaml is None:  # pragma: no cover
        yield decode_rule(None, path) | {"error": "PyYAML is not installed"}
        return
    docs = yaml.safe_load_all(text)
    while True:
        try:
            doc = next(docs)
        except StopIteration:
            return
        except Exception as exc:  # noqa: BLE001 - any parse failure marks the file
            yield decode_rule(None, path) | {"error": f"yaml: {type(exc).__name__}", "bad_file": True}
            return
        if doc is not None:
            yield decode_rule(doc, path)


def decode_rule_texts(text: str, path: str | None = None) -> list[dict]:
    """All rule documents of one file ('---'-separated YAML documents)."""
    rows = list(_decoded(text, path))
    return [{k: v for k, v in rows[-1].items() if k != "bad_file"}] if rows and "bad_file" in rows[-1] else rows


def decode_rule_text(text: str, path: str | None = None) -> dict:
    rows = decode_rule_texts(text, path)
    return rows[0] if rows else decode_rule(None, path) | {"error": "empty rule file"}


DECODED_AT_ONCE = 1000
_RULE_ARROW = to_arrow_schema(RULE_SCHEMA)


def _arrow(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([r | {"logsource": list(r["logsource"].items())} for r in rows], _RULE_ARROW)


def _decoded_file(text: str, path: str | None) -> list[pa.RecordBatch]:
    held, rows = [], []
    for row in _decoded(text, path):
        if row.pop("bad_file", False):
            return [_arrow([row])]
        rows.append(row)
        if len(rows) == DECODED_AT_ONCE:
            held.append(_arrow(rows))
            rows = []
    return [*held, _arrow(rows)]


def _decode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text, path in zip(batch.column("value"), batch.column("path"), strict=True):
            yield from _decoded_file(text.as_py(), path.as_py())


def read_rules(spark: SparkSession, path: str, glob: str | None = "*.{yml,yaml}") -> DataFrame:
    """Every ``.yml``/``.yaml`` below ``path`` -> one rule row per YAML
    document (files are read whole; one file may hold several documents)."""
    from ravenhunt.session import ensure_on_workers

    ensure_on_workers(spark)
    texts = (
        spark.read.option("recursiveFileLookup", True)
        .options(**({"pathGlobFilter": glob} if glob else {}))
        .text(path, wholetext=True)
        .select("value", F.col("_metadata.file_path").alias("path"))
    )
    return texts.mapInArrow(_decode_batches, RULE_SCHEMA)


def rules_from_documents(spark: SparkSession, docs: list[dict]) -> DataFrame:
    """Rule table from already-decoded documents (e.g. rules kept in code)."""
    rows = [decode_rule(d, None) for d in docs]
    return spark.createDataFrame(rows, RULE_SCHEMA)
