"""Read CSV / JSON Lines / JSON security logs into LOG_SCHEMA.

Every reader returns a lazy DataFrame; files split across tasks (CSV and
JSON Lines), the column map is a rename, missing columns become typed nulls,
extra columns are pruned before anything is read past the scan, and casts
are the ``try_`` forms (bad values -> null per value, never a failed task).
"""

from __future__ import annotations

import csv
import os
import re
import warnings
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravenhunt.schemas import LOG_SCHEMA
from ravenhunt.sources.files import json_documents

# --- fixed values (must equal the reference's behaviour) -------------------
CSV_COLUMN_MAP = {
    "TimeCreated": "timestamp",
    "ComputerName": "hostname",
    "UserName": "username",
    "ProcessName": "process_name",
    "EventID": "event_id",
    "SourceIpAddress": "source_ip",
    "DestinationIpAddress": "destination_ip",
    "EventData": "message",
    "Action": "action",
}
JSON_COLUMN_MAP = {
    "@timestamp": "timestamp",
    "host": "hostname",
    "user": "username",
    "process": "process_name",
    "event_id": "event_id",
    "message": "message",
    "src_ip": "source_ip",
    "dst_ip": "destination_ip",
}
# Cell texts pandas reads as missing by default (its documented NA list).
PANDAS_NA_VALUES = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
SUPPORTED_EXTENSIONS = {".csv": "csv", ".json": "json", ".jsonl": "jsonl"}
# ----------------------------------------------------------------------------

CORRUPT = "_corrupt_record"


def safe_cast(c: Column, dtype: T.DataType) -> Column:
    """Per-value safe conversion; failures become null."""
    if isinstance(dtype, T.TimestampType):
        return F.coalesce(
            c.try_cast(T.TimestampType()),
            F.try_to_timestamp(c.cast("string")),
        )
    if isinstance(dtype, T.StringType):
        return c.cast("string")
    if isinstance(dtype, (T.LongType, T.IntegerType)):
        # '4688.0' (a float-typed text) still yields 4688.
        as_long = c.try_cast(dtype)
        as_double = c.try_cast(T.DoubleType())
        whole = F.when(as_double == F.floor(as_double), as_double.try_cast(dtype))
        return F.coalesce(as_long, whole)
    return c.try_cast(dtype)


def normalize(df: DataFrame, column_map: dict[str, str], na_values: list[str] | None = None) -> DataFrame:
    """Rename by the map, add missing columns as null, drop the rest,
    convert types safely; ``na_values`` texts become null first (D3)."""
    renamed = df.withColumnsRenamed({k: v for k, v in column_map.items() if k in df.columns})
    cols = []
    for field in LOG_SCHEMA.fields:
        if field.name in renamed.columns:
            c = F.col(f"`{field.name}`")
            if na_values is not None and isinstance(renamed.schema[field.name].dataType, T.StringType):
                c = F.when(c.isin(na_values), F.lit(None)).otherwise(c)
            cols.append(safe_cast(c, field.dataType).alias(field.name))
        else:
            cols.append(F.lit(None).cast(field.dataType).alias(field.name))
    return renamed.select(*cols)


def _field_count(line: Column) -> Column:
    """Fields of a CSV line: commas outside double quotes + 1."""
    unquoted = F.regexp_replace(line, '"[^"]*"', "")
    return F.size(F.split(unquoted, ","))


def _keep_lines(raw: DataFrame, header: list[str]) -> DataFrame:
    """Drop lines with more fields than the header; keep short ones.

    The condition references every header column: with CSV column pruning
    the parser only tokenises the columns a query needs and would not see
    that a line is too long."""
    width = len(header)
    # (size(array(...)) would be folded to a constant and pruned.)
    all_cols = F.length(F.concat_ws(",", *[F.col(f"`{c}`") for c in header])) >= 0
    ok = F.col(CORRUPT).isNull() | (_field_count(F.col(CORRUPT)) <= width)
    return raw.where(ok & all_cols).drop(CORRUPT)


def _first_lines(spark: SparkSession, path: str, ext: str | None) -> DataFrame:
    """(file, line, odd): each file's first line with text, and how many lines
    have an odd number of quotes. The first line comes from the split that
    begins the file, which one task reads in order."""
    lines = _reader(spark, ext).text(path)
    begins = F.input_file_block_start() == 0
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return lines.select(
        F.input_file_name().alias("file"), F.when(begins & (F.trim("value") != ""), F.col("value")).alias("line"), (quotes % 2).alias("odd"),
    ).groupBy("file").agg(F.first("line", ignorenulls=True).alias("line"), F.sum("odd").alias("odd"))


def _file_groups(files: DataFrame, path: str, *by: str) -> list[tuple]:
    """(*by, paths): the files of each kind (only names reach the driver), or the
    topmost folders below which all are of it: Spark looks each path up that it
    is given. A pattern may leave files of a folder out, so it gives files."""
    groups = files.groupBy(*by).agg(F.collect_list("file").alias("files")).collect()
    kinds: dict[str, set[int]] = {}  # folder -> kinds of the files below it
    for i, g in enumerate([] if re.search(r"[*?{}\[\]]", path) else groups):
        for folder in {f.rpartition("/")[0] for f in g["files"]}:
            while folder and i not in kinds.setdefault(folder, set()):
                kinds[folder].add(i)
                folder = folder.rpartition("/")[0]
    return [(*[g[c] for c in by], sorted(unquote(x) for x in {_topmost(f, kinds) for f in g["files"]})) for g in groups]


def _topmost(file: str, kinds: dict[str, set[int]]) -> str:
    """The highest folder with files of one kind that holds the file; else the file."""
    out, folder = file, file.rpartition("/")[0]
    while len(kinds.get(folder, ())) == 1:
        out, folder = folder, folder.rpartition("/")[0]
    return out


def _header_names(line: str) -> list[str]:
    """Column names of a header line; a repeated name gets its place."""
    names = next(csv.reader([line.removeprefix("\ufeff")]))
    return [n if n and names.index(n) == i else f"{n}_{i}" for i, n in enumerate(names)]


def read_csv_logs(
    spark: SparkSession,
    path: str,
    column_map: dict[str, str] | None = None,
    na_values: list[str] | None = PANDAS_NA_VALUES,
    max_rows: int | None = None,
    multi_line: bool | None = None,
    ext: str | None = None,
) -> DataFrame:
    """Header CSV; columns go by the name in their own file's header, so
    files of one folder may differ in order and choice of columns. Lines with
    too many fields are skipped, short lines are padded with nulls; quoted
    fields may hold commas.

    ``multi_line`` says whether quoted fields hold line breaks; such files are
    read by one task each. None: a file is read so if one of its lines has an
    odd number of quotes, and a warning names how many do."""
    files = _first_lines(spark, path, ext).where("line is not null")
    broken = F.lit(multi_line) if multi_line is not None else F.col("odd") > 0
    groups = _file_groups(files.withColumn("broken", broken), path, "line", "broken")
    if multi_line is None and any(g[1] for g in groups):
        warnings.warn(f"{sum(len(g[2]) for g in groups if g[1])} CSV files below {path} have quoted line breaks", stacklevel=2)
    out = None
    for line, broken, paths in groups:
        header = _header_names(line)
        schema = T.StructType([T.StructField(c, T.StringType()) for c in header] + [T.StructField(CORRUPT, T.StringType())])
        raw = (
            _reader(spark, ext).schema(schema)
            .option("header", True)
            .option("escape", '"')
            .option("multiLine", broken)
            .option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT)
            .csv(path if len(groups) == 1 else paths)
        )
        part = normalize(_keep_lines(raw, header), CSV_COLUMN_MAP if column_map is None else column_map, na_values)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], LOG_SCHEMA)
    return out.limit(max_rows) if max_rows else out


def _json_source_schema(column_map: dict[str, str]) -> T.StructType:
    return T.StructType([T.StructField(k, T.StringType()) for k in column_map])


def read_jsonl_logs(
    spark: SparkSession, path: str, column_map: dict[str, str] | None = None, max_rows: int | None = None
) -> DataFrame:
    """One JSON object per line; malformed lines dropped, blank lines skipped."""
    cmap = JSON_COLUMN_MAP if column_map is None else column_map
    raw = spark.read.schema(_json_source_schema(cmap)).option("recursiveFileLookup", True).option("mode", "DROPMALFORMED").json(path)
    out = normalize(raw, cmap)
    return out.limit(max_rows) if max_rows else out


def read_json_logs(
    spark: SparkSession, path: str, column_map: dict[str, str] | None = None, max_rows: int | None = None
) -> DataFrame:
    """S3: a JSON document holding a list of objects or a single object.

    A whole document is one record to the parser, so each file is read by
    one task; prefer JSON Lines for large logs.
    """
    cmap = JSON_COLUMN_MAP if column_map is None else column_map
    raw = json_documents(spark.read.schema(_json_source_schema(cmap)).option("recursiveFileLookup", True).option("mode", "DROPMALFORMED"), path)
    out = normalize(raw, cmap)
    return out.limit(max_rows) if max_rows else out


def log_format(path: str) -> str:
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext not in SUPPORTED_EXTENSIONS:
        raise ValueError(f"Unsupported log file format: {ext or path}")
    return SUPPORTED_EXTENSIONS[ext]


def read_logs(spark: SparkSession, path: str, fmt: str | None = None, **kwargs) -> DataFrame:
    """Dispatch by extension (or ``fmt``); other extensions are an error.
    For a directory without a format, every supported extension below it is
    read (``.json``/``.jsonl`` line by line) and the parts are unioned."""
    readers = {"csv": read_csv_logs, "jsonl": read_jsonl_logs, "json": read_json_logs}
    if fmt is not None:
        return readers[fmt](spark, path, **kwargs)
    if not os.path.splitext(path.rstrip("/"))[1]:
        parts = []
        for ext, kind in SUPPORTED_EXTENSIONS.items():
            if _has_files(spark, path, ext):
                parts.append(_read_glob(spark, path, ext, kind, **kwargs))
        if not parts:
            raise ValueError(f"No supported log files in {path}")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out
    return readers[log_format(path)](spark, path, **kwargs)


def _has_files(spark: SparkSession, path: str, ext: str) -> bool:
    """Any file with this extension below ``path`` (listing only, works on
    any Hadoop file system; file contents are not read)."""
    listing = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", f"*{ext}")
        .option("recursiveFileLookup", True)
        .load(path)
        .select("path")
    )
    return len(listing.take(1)) > 0


def _reader(spark: SparkSession, ext: str | None):
    r = spark.read.option("recursiveFileLookup", True)
    return r if ext is None else r.option("pathGlobFilter", f"*{ext}")


def _read_glob(spark, path, ext, kind, column_map=None, na_values=PANDAS_NA_VALUES, max_rows=None):
    """Read one format below a directory (files picked by extension)."""
    if kind == "csv":
        return read_csv_logs(spark, path, column_map, na_values, max_rows, ext=ext)
    cmap = JSON_COLUMN_MAP if column_map is None else column_map
    schema = _json_source_schema(cmap)
    # A file whose first line is a whole JSON value is read line by line (JSON
    # Lines and one-line documents; such files split across tasks), any other
    # as one document.
    groups = [(False, [])]
    if kind == "json":
        whole = F.try_parse_json("line").isNotNull()
        groups = _file_groups(_first_lines(spark, path, ext).withColumn("document", ~whole & F.col("line").isNotNull()), path, "document")
    out = None
    for document, paths in groups:
        r = _reader(spark, ext).schema(schema).option("mode", "DROPMALFORMED")
        where = path if len(groups) == 1 else paths
        part = normalize(json_documents(r, where) if document else r.json(where), cmap)
        out = part if out is None else out.unionByName(part)
    return out.limit(max_rows) if max_rows else out


# A record ends at a line break outside quotes; a field at a comma outside quotes.
_RECORDS = r'(?:[^"\n]++|"(?:[^"]|"")*+")++'
_FIELDS = r'(?:^|,)("(?:[^"]|"")*+"|[^,]*+)'


def csv_rows(texts: DataFrame, names: list[str], text_col: str = "value") -> DataFrame:
    """Rows of whole CSV texts (one file each), with the columns ``names``
    found by each text's own header; the rules for long and short lines are
    those of ``read_csv_logs``."""
    def fields(record: Column) -> Column:
        return F.transform(F.regexp_extract_all(record, F.lit(_FIELDS), 1), lambda f: F.when(
            f.startswith('"'), F.replace(F.substr(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f))

    text = F.replace(F.regexp_replace(text_col, "^\ufeff", ""), F.lit("\r\n"), F.lit("\n"))
    records = F.filter(F.regexp_extract_all(text, F.lit(_RECORDS), 0), lambda x: F.trim(x) != "")
    rows = texts.select(records.alias("records")).where(F.size("records") > 1)
    # the header goes into each element, so that no exploded row drags the whole text along
    header = F.array_repeat(fields(F.get("records", F.lit(0))), F.size("records") - 1).alias("header")
    rows = rows.select(F.explode(F.arrays_zip(header, F.slice("records", 2, F.size("records")).alias("record"))).alias("r"))
    rows = rows.select("r.header", fields(F.col("r.record")).alias("fields")).where(F.size("fields") <= F.size("header"))
    place = {n: F.array_position("header", n).cast("int") for n in names}
    return rows.select(*[F.when(p > 0, F.get("fields", p - 1)).alias(n) for n, p in place.items()])


def read_log_stream(spark: SparkSession, path: str, fmt: str = "csv", max_files_per_trigger: int | None = None,
                    column_map: dict[str, str] | None = None, header: list[str] | None = None,
                    multi_line: bool = False) -> DataFrame:
    """S5 / ST1: the same scan as a file stream (micro-batches of files).

    CSV columns go by each file's own header; for that a file is one row of a
    task. Where all files are known to have one header, pass it as ``header``:
    then large files are split. Quoted line breaks need ``multi_line`` there: a
    file is read by one task, record by record."""
    reader = spark.readStream
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if fmt == "csv":
        cmap = CSV_COLUMN_MAP if column_map is None else column_map
        if header is None:
            texts = reader.text(path, wholetext=True)
            return normalize(csv_rows(texts, list(cmap)), cmap, PANDAS_NA_VALUES)
        schema = T.StructType([T.StructField(k, T.StringType()) for k in [*header, CORRUPT]])
        raw = reader.schema(schema).option("header", True).option("escape", '"').option("multiLine", multi_line)
        raw = raw.option("columnNameOfCorruptRecord", CORRUPT).csv(path)
        return normalize(_keep_lines(raw, header), cmap, PANDAS_NA_VALUES)
    cmap = JSON_COLUMN_MAP if column_map is None else column_map
    raw = reader.schema(_json_source_schema(cmap)).option("mode", "DROPMALFORMED").json(path)
    return normalize(raw, cmap)


def read_findings_csv(spark: SparkSession, path: str, null_token: str = "nan") -> DataFrame:
    """Findings written by ``sinks.exports.write_findings_csv`` read back
    with FINDING_SCHEMA (``nan`` texts become null again)."""
    from ravenhunt.schemas import FINDING_SCHEMA

    text_schema = T.StructType([T.StructField(f.name, T.StringType()) for f in FINDING_SCHEMA.fields])
    raw = (
        spark.read.schema(text_schema).option("header", True).option("escape", '"')
        .option("recursiveFileLookup", True).csv(path)
    )
    cols = []
    for f in FINDING_SCHEMA.fields:
        c = F.when(F.col(f.name) == null_token, F.lit(None)).otherwise(F.col(f.name))
        cols.append(safe_cast(c, f.dataType).alias(f.name))
    return raw.select(*cols)
