"""``text_view``: every text of ``pages.html``, ``documents.text`` and
``conversations.text`` (whole texts), plus a few literal edge rows for the
pattern branches the generated tables never hit. Spark and DuckDB forms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravenhunt.session import read_table

# Edge rows (ours): each exercises one branch of the sanitiser/redactor.
EDGE_TEXTS = [
    ("e01", "<script>alert('xss')</script>Hello"),
    ("e02", '<img src="x" onerror="alert(1)">'),
    ("e03", "metadata:x data:image/png DATA:text/html Data:Image/gif"),
    ("e04", "config=1 connection = 2 on_load\t= 3"),
    ("e05", "password=hunter2 and API-KEY: abc123, token:xyz secret= s3cr3t Auth:bearer"),
    ("e06", "javascript:void(0) vbscript:msgbox expression (alert) import os; import  sys eval (x) exec( y) __import__ getattr"),
    ("e07", "ctrl\x01a\x7fb\tc\x0bd\re"),
    ("e08", "<" * 10_000),
    ("e09", '<SCRIPT type="x">bad()</SCRIPT>tail <script>unterminated'),
    ("e10", "<scripts>x</script> onclick=go() apikey=zzz"),
    ("e11", "a" * 10_050 + "<script>x</script>"),
]


def text_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select(
        F.lit("page").alias("src"), F.col("page_id").cast("string").alias("id"), F.col("html").alias("text")
    )
    docs = read_table(spark, sf_dir, "documents").select(
        F.lit("doc").alias("src"), F.col("doc_id").cast("string").alias("id"), F.col("text")
    )
    conv = read_table(spark, sf_dir, "conversations").select(
        F.lit("conv").alias("src"),
        F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")).alias("id"),
        F.col("text"),
    )
    edges = spark.createDataFrame([("edge", i, t) for i, t in EDGE_TEXTS], "src string, id string, text string")
    return pages.unionByName(docs).unionByName(conv).unionByName(edges)


# ------------------------------------------------------------------ SQL side
def sql_str(s: str) -> str:
    """A DuckDB expression for a Python string (control chars, long runs)."""
    parts, buf, i = [], [], 0
    while i < len(s):
        ch = s[i]
        j = i
        while j < len(s) and s[j] == ch:
            j += 1
        run = j - i
        if run > 50 or ord(ch) < 32 or ord(ch) == 127:
            if buf:
                parts.append("'" + "".join(buf).replace("'", "''") + "'")
                buf = []
            piece = f"chr({ord(ch)})" if (ord(ch) < 32 or ord(ch) == 127) else "'" + ch.replace("'", "''") + "'"
            parts.append(f"repeat({piece}, {run})" if run > 1 else piece)
        else:
            buf.append(ch * run)
        i = j
    if buf:
        parts.append("'" + "".join(buf).replace("'", "''") + "'")
    return " || ".join(parts) if parts else "''"


TEXT_VIEW_SQL = (
    "SELECT 'page' AS src, CAST(page_id AS VARCHAR) AS id, html AS text FROM pages\n"
    "UNION ALL SELECT 'doc', CAST(doc_id AS VARCHAR), text FROM documents\n"
    "UNION ALL SELECT 'conv', CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR), text FROM conversations\n"
    + "".join(f"UNION ALL SELECT 'edge', '{i}', {sql_str(t)}\n" for i, t in EDGE_TEXTS)
)


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


# The oracle's own patterns (RE2): fixed values, written out here so that a
# wrong pattern in the library shows.
_WORD, _NOT_WORD = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]"
_BLANKS = r"\t\n\x{0b}\f\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_SPACE, _NOT_SPACE = f"[{_BLANKS}]", f"[^{_BLANKS}]"
SQL_PATTERNS = {
    "script_tag": f"(?is)<script(?:{_NOT_WORD}.*?)?</script>",
    "javascript_url": "(?i)javascript:",
    "data_url": "(?i)data:",
    "vbscript_url": "(?i)vbscript:",
    "event_handler": f"(?i)on{_WORD}+{_SPACE}*=",
    "css_expression": rf"(?i)expression{_SPACE}*\(",
    "python_import": f"(?i)import{_SPACE}+(?:os|subprocess|sys)",
    "python_eval": rf"(?i)(?:eval|exec){_SPACE}*\(",
    "python_introspection": "(?i)__import__|getattr|setattr|delattr",
}
SQL_CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
SQL_SECRET = f"(?i)(password|key|token|secret|auth)[=:]{_SPACE}*{_NOT_SPACE}+"
SQL_API_KEY = f"(?i)api[_-]?key[=:]{_SPACE}*{_NOT_SPACE}+"


def sql_remove_dangerous(x: str) -> str:
    """X1 in RE2; the one lookahead is done by protecting ``data:image/`` with
    a \\x01 that X2 removes afterwards."""
    for name, pattern in SQL_PATTERNS.items():
        if name == "data_url":
            x = f"regexp_replace({x}, '(?i)(data)(:image/)', '\\1' || chr(1) || '\\2', 'g')"
        x = f"regexp_replace({x}, '{_q(pattern)}', '[REMOVED]', 'g')"
    return x


def sql_sanitize(x: str) -> str:
    x = sql_remove_dangerous(x)
    x = f"regexp_replace({x}, '{SQL_CONTROL}', '', 'g')"
    for raw, esc in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = f"replace({x}, '{_q(raw)}', '{_q(esc)}')"
    return x


def sql_redact(x: str) -> str:
    x = f"regexp_replace({x}, '{_q(SQL_SECRET)}', '\\1=***REDACTED***', 'g')"
    return f"regexp_replace({x}, '{_q(SQL_API_KEY)}', 'api_key=***REDACTED***', 'g')"


def sql_dangerous_hits(x: str) -> list[tuple[str, str]]:
    out = []
    for name, pattern in SQL_PATTERNS.items():
        cond = f"regexp_matches({x}, '{_q(pattern)}')"
        if name == "data_url":
            cond = f"len(regexp_extract_all({x}, '(?i)data:')) > len(regexp_extract_all({x}, '(?i)data:image/'))"
        out.append((name, cond))
    return out
