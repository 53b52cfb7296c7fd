"""Sanitiser, cleaner, redaction and dangerous-content classes on texts whose
expected results were worked out by hand."""

import html
import re

import pytest
from pyspark.sql import functions as F

from ravenhunt.functions import text as tx

# The patterns that make a text dangerous.
ORIGINAL_PATTERNS = [
    r"<script\b[^<]*(?:(?!<\/script>)<[^<]*)*<\/script>",
    r"javascript:",
    r"data:(?!image/)",
    r"vbscript:",
    r"on\w+\s*=",
    r"expression\s*\(",
    r"import\s+os|import\s+subprocess|import\s+sys",
    r"eval\s*\(|exec\s*\(",
    r"__import__|getattr|setattr|delattr",
]

SAMPLES = [
    "<script>alert('xss')</script>Hello",
    '<img src="x" onerror="alert(1)">',
    "metadata:x data:image/png DATA:text/html Data:Image/gif",
    "config=1 connection = 2 on_load\t= 3 onéa= 4",
    "password=hunter2 and API-KEY: abc123, token:xyz secret= s3cr3t Auth:bearer apikey=zz",
    "javascript:void(0) JAVASCRİPT: vbscript:msgbox expression (alert) import os; import  sys eval (x) exec( y)",
    "__import__('x') getattr setattr delattr",
    "ctrl\x01a\x7fb\tc\x0bd\re",
    "<SCRIPT type='x'>bad()</SCRIPT>tail <script>unterminated",
    "<scripts>x</script> onclick=go() <script\n>multi\nline</script>after",
    "Évite l'import os — naïve café, ſecret=1, Kelvin KEY=2",
    "",
]


# What the sanitiser and the redaction make of the samples, in order.
SANITIZED = [
    "[REMOVED]Hello",
    "&lt;img src=&quot;x&quot; [REMOVED]&quot;alert(1)&quot;&gt;",
    "meta[REMOVED]x data:image/png [REMOVED]text/html Data:Image/gif",
    "c[REMOVED]1 c[REMOVED] 2 [REMOVED] 3 [REMOVED] 4",
    SAMPLES[4],
    "[REMOVED]void(0) [REMOVED] [REMOVED]msgbox [REMOVED]alert) [REMOVED]; [REMOVED] [REMOVED]x) [REMOVED] y)",
    "[REMOVED](&#x27;x&#x27;) [REMOVED] [REMOVED] [REMOVED]",
    "ctrlab\tcd\re",
    "[REMOVED]tail &lt;script&gt;unterminated",
    "&lt;scripts&gt;x&lt;/script&gt; [REMOVED]go() [REMOVED]after",
    SAMPLES[10].replace("'import\xa0os", "&#x27;[REMOVED]").replace("'import os", "&#x27;[REMOVED]"),
    "",
]
REDACTED = {
    4: "password=***REDACTED*** and api_key=***REDACTED*** token=***REDACTED*** secret=***REDACTED*** Auth=***REDACTED*** api_key=***REDACTED***",
    10: SAMPLES[10].replace("ſecret=1,", "ſecret=***REDACTED***").replace("KEY=2", "KEY=***REDACTED***"),
}


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, s) for i, s in enumerate(SAMPLES)], "id int, text string")


def test_sanitize_column_and_frame_as_expected(texts):
    col_rows = {r.id: r.o for r in texts.select("id", tx.sanitize(F.col("text")).alias("o")).collect()}
    frame_rows = {r.id: r.o for r in tx.sanitize_frame(texts, "text", "o").select("id", "o").collect()}
    for i, s in enumerate(SAMPLES):
        assert col_rows[i] == SANITIZED[i], s
        assert frame_rows[i] == SANITIZED[i], s


def test_redact_as_expected(texts):
    col_rows = {r.id: r.o for r in texts.select("id", tx.redact_secrets(F.col("text")).alias("o")).collect()}
    frame_rows = {r.id: r.o for r in tx.redact_frame(texts, "text", "o").select("id", "o").collect()}
    for i, s in enumerate(SAMPLES):
        assert col_rows[i] == REDACTED.get(i, s), s
        assert frame_rows[i] == REDACTED.get(i, s), s


def test_dangerous_classes_as_expected(texts):
    names = [n for n, _ in tx.DANGEROUS_PATTERNS]
    got = {}
    for r in tx.dangerous_frame(texts, "text").collect():
        got.setdefault(r.id, set()).add(r.pattern_class)
    col = {r.id: set(r.c) for r in texts.select("id", tx.dangerous_classes(F.col("text")).alias("c")).collect()}
    for i, s in enumerate(SAMPLES):
        want = {n for n, p in zip(names, ORIGINAL_PATTERNS) if re.search(p, s, re.IGNORECASE)}
        assert got.get(i, set()) == want, s
        assert col[i] == want, s


def test_reference_sanitiser_cases(spark):
    df = spark.createDataFrame(
        [("<script>alert('xss')</script>Hello",), ("A" * 20_000,), ('<img src="x" onerror="alert(1)">',), ("<" * 10_000,)],
        "t string",
    )
    out = [r.o for r in df.select(tx.sanitize(F.col("t")).alias("o")).collect()]
    assert "<script>" not in out[0] and "Hello" in out[0]
    limited = df.select(tx.sanitize(F.col("t"), 1000).alias("o")).collect()[1].o
    assert len(limited) <= 1000
    assert "<img" not in out[2] and "&lt;" in out[2]
    assert out[3] == "&lt;" * 10_000  # long input, no stack overflow


def test_clean_log_entry(spark):
    df = spark.createDataFrame([("<b>\"hi\" 'x'</b>" + "z" * 2000,)], "t string")
    whole, cut = df.select(tx.clean_log_entry(F.col("t")), tx.clean_log_entry(F.col("t"), 1000)).first()
    assert whole == "bhi x/b" + "z" * 2000 and cut == whole[:1000]


def test_no_text_is_cut_unasked(spark):
    df = spark.createDataFrame([("a" * 30_000 + "javascript:",)], "t string")
    assert df.select(tx.sanitize(F.col("t"))).first()[0] == "a" * 30_000 + "[REMOVED]"


def test_html_escape_matches_stdlib(spark):
    s = "a & b < c > d \" e ' f"
    o = spark.createDataFrame([(s,)], "t string").select(tx.html_escape(F.col("t")).alias("o")).first().o
    assert o == html.escape(s, quote=True).replace("&#x27;", "&#x27;")
