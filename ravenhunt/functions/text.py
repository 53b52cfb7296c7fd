"""Text operators as pure Column expressions (no UDF): sanitiser, cleaner,
secret redaction and dangerous-content classes.

Every function maps Column -> Column, so it stays inside whole-stage codegen
and can be applied to any text column of a batch or streaming DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (must equal the reference's behaviour) -------------------
REMOVED_TOKEN = "[REMOVED]"

# Python's str-regex classes spelled out, so that Java (Spark) and RE2 (the
# SQL oracle) read them the same way: word = letter/number/underscore,
# space = Python's Unicode whitespace set.
WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"
SPACE = r"[\t\n\x{0b}\f\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_SPACE = r"[^\t\n\x{0b}\f\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

# Dangerous patterns, in the order they are applied, case-insensitive:
#   <script\b[^<]*(?:(?!<\/script>)<[^<]*)*<\/script>
#   javascript:
#   data:(?!image/)
#   vbscript:
#   on\w+\s*=
#   expression\s*\(
#   import\s+os|import\s+subprocess|import\s+sys
#   eval\s*\(|exec\s*\(
#   __import__|getattr|setattr|delattr
# The first overflows the JVM regex stack on long inputs; the lazy form below
# stops at the same first closing tag. \w and \s are spelled out as above.
DANGEROUS_PATTERNS = [
    ("script_tag", r"<script(?:" + NOT_WORD + r".*?)?</script>"),
    ("javascript_url", r"javascript:"),
    ("data_url", r"data:(?!image/)"),
    ("vbscript_url", r"vbscript:"),
    ("event_handler", r"on" + WORD + r"+" + SPACE + r"*="),
    ("css_expression", r"expression" + SPACE + r"*\("),
    (
        "python_import",
        r"import" + SPACE + r"+os|import" + SPACE + r"+subprocess|import" + SPACE + r"+sys",
    ),
    ("python_eval", r"eval" + SPACE + r"*\(|exec" + SPACE + r"*\("),
    ("python_introspection", r"__import__|getattr|setattr|delattr"),
]

# Control characters removed (tab, LF and CR are kept).
CONTROL_CHARS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"

# HTML escapes, '&' first.
HTML_ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")]

# Secret redaction, applied in this order, case-insensitive:
#   (password|key|token|secret|auth)[=:]\s*\S+  ->  \1=***REDACTED***
#   api[_-]?key[=:]\s*\S+                       ->  api_key=***REDACTED***
SECRET_PATTERN = r"(password|key|token|secret|auth)[=:]" + SPACE + r"*" + NOT_SPACE + r"+"
SECRET_REPLACEMENT = "$1=***REDACTED***"
API_KEY_PATTERN = r"api[_-]?key[=:]" + SPACE + r"*" + NOT_SPACE + r"+"
API_KEY_REPLACEMENT = "api_key=***REDACTED***"

# Literal prefilters (ours, exact): a pattern can only match where all
# substrings of one of its alternatives occur in the ASCII-lower-cased text.
PATTERN_GUARDS = {
    "script_tag": [["<script", "</script>"]],
    "javascript_url": [["javascript:"]],
    "data_url": [["data:"]],
    "vbscript_url": [["vbscript:"]],
    "event_handler": [["on", "="]],
    "css_expression": [["expression", "("]],
    "python_import": [["import"]],
    "python_eval": [["eval", "("], ["exec", "("]],
    "python_introspection": [["__import__"], ["getattr"], ["setattr"], ["delattr"]],
    "secret": [["password"], ["key"], ["token"], ["secret"], ["auth"]],
    "api_key": [["api", "key"]],
}
# Non-ASCII characters whose simple case folding is an ASCII letter
# (dotted I, dotless i, long s, Kelvin sign): texts holding one skip the
# prefilter and always run the full pattern.
FOLDS_TO_ASCII = ["\u0130", "\u0131", "\u017f", "\u212a"]

# Characters deleted by the simple cleaner.
CLEAN_ENTRY_CHARS = "[<>\"']"
# ----------------------------------------------------------------------------

# Java regex flags: i + u = case-insensitive with Unicode folding (Python's
# str regexes fold Unicode), s = dot matches newline (only for the script
# pattern, whose character classes cross lines in the reference).
_FLAGS = "(?iu)"


def _java_pattern(name: str, pattern: str) -> str:
    if name == "script_tag":
        return "(?isu)" + pattern
    return _FLAGS + pattern


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def may_match(name: str, low: Column, fold: Column) -> Column:
    """Exact prefilter: false only when pattern ``name`` cannot match a text
    whose lower-cased form is ``low`` (``fold``: the text holds a character
    that case-folds to ASCII, or lower-casing is locale-dependent here, so
    no shortcut is taken).

    Replacing matches by ``[REMOVED]`` never creates a required literal, so
    the test may be done once on the text before any replacement."""
    alts = []
    for words in PATTERN_GUARDS[name]:
        cond = None
        for w in words:
            hit = low.contains(F.lit(w))
            cond = hit if cond is None else cond & hit
        alts.append(cond)
    if name in ("secret", "api_key"):
        sep = low.contains(F.lit(":")) | low.contains(F.lit("="))
        alts = [a & sep for a in alts]
    out = alts[0]
    for a in alts[1:]:
        out = out | a
    return F.coalesce(out | fold, F.lit(False))


def remove_dangerous(c) -> Column:
    """Replace the nine dangerous patterns by ``[REMOVED]`` in order."""
    out = _as_col(c)
    for name, pattern in DANGEROUS_PATTERNS:
        out = F.regexp_replace(out, _java_pattern(name, pattern), REMOVED_TOKEN)
    return out


def strip_control(c) -> Column:
    """Drop control characters except tab, LF, CR."""
    return F.regexp_replace(_as_col(c), CONTROL_CHARS, "")


def html_escape(c) -> Column:
    """Escape & < > " ' (ampersand first)."""
    out = _as_col(c)
    for raw, escaped in HTML_ESCAPES:
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    return out


def truncate(c, max_length: int | None = None) -> Column:
    """Cut to ``max_length`` characters (done before X1-X3); None: whole text."""
    return _as_col(c) if max_length is None else F.left(_as_col(c), F.lit(int(max_length)))


def sanitize(c, max_length: int | None = None, passes: int = 1) -> Column:
    """P5: truncate, remove dangerous patterns, strip control chars, escape HTML.

    ``passes`` > 1 reproduces repeated sanitising (escaping is not idempotent).
    Null stays null.
    """
    out = _as_col(c)
    for _ in range(max(1, passes)):
        out = html_escape(strip_control(remove_dangerous(truncate(out, max_length))))
    return out


def sanitize_columns(columns, max_length: int | None = None, passes: int = 1):
    """DataFrame transform: sanitise the named text columns in place."""

    def _apply(df):
        out = df
        for c in [c for c in columns if c in df.columns]:
            out = sanitize_frame(out, c, "__tx_out", max_length, passes)
            out = out.withColumn(c, F.col("__tx_out")).drop("__tx_out")
        return out

    return _apply


def clean_log_entry(c, max_length: int | None = None) -> Column:
    """Delete < > " ' and, if asked, cut to ``max_length`` characters."""
    return truncate(F.regexp_replace(_as_col(c), CLEAN_ENTRY_CHARS, ""), max_length)


def redact_secrets(c) -> Column:
    """Mask ``password=...``-style secrets, then ``api_key=...``."""
    out = F.regexp_replace(_as_col(c), _FLAGS + SECRET_PATTERN, SECRET_REPLACEMENT)
    return F.regexp_replace(out, _FLAGS + API_KEY_PATTERN, API_KEY_REPLACEMENT)


def dangerous_classes(c) -> Column:
    """array of the pattern classes the text hits (order as the patterns)."""
    col = _as_col(c)
    flags = [F.when(col.rlike(_java_pattern(n, p)), F.lit(n)) for n, p in DANGEROUS_PATTERNS]
    return F.filter(F.array(*flags), lambda x: x.isNotNull())


# --------------------------------------------------------------------------
# DataFrame-level forms for whole texts: each regex step is its own
# projection (so no step's expression is copied into the next), and each
# regex runs only on rows its exact literal prefilter admits. The
# prefilter inputs (ASCII-lower-cased text, fold flag) are computed once.
_LOW, _FOLD, _TMP = "__tx_low", "__tx_fold", "__tx_val"


def _fold_flag(text: Column) -> Column:
    """True when the literal prefilter may not be trusted for this text: it
    holds a character folding to ASCII, or the executor's default locale
    lower-cases 'I' to something else (Spark's ``lower`` uses it for
    non-ASCII strings). The probe is not constant-folded, so it runs on the
    executor that evaluates the row."""
    probe = F.lower(F.concat(F.lit("I\u00e9"), F.substring(text, 1, 0))) != F.lit("i\u00e9")
    out = probe
    for ch in FOLDS_TO_ASCII:
        out = out | text.contains(F.lit(ch))
    return out


def _with_guard_inputs(df, text: Column):
    return df.withColumn(_LOW, F.lower(text)).withColumn(_FOLD, _fold_flag(text))


def _guarded_replace(df, name: str, pattern: str, replacement: str):
    guard = may_match(name, F.col(_LOW), F.col(_FOLD))
    return df.withColumn(
        _TMP, F.when(guard, F.regexp_replace(F.col(_TMP), pattern, replacement)).otherwise(F.col(_TMP))
    )


def sanitize_frame(df, text_col: str, out_col: str, max_length: int | None = None, passes: int = 1):
    """``sanitize`` of a whole-text column as staged, prefiltered steps."""
    out = df.withColumn(_TMP, truncate(F.col(text_col), max_length))
    for i in range(max(1, passes)):
        if i:
            out = out.withColumn(_TMP, truncate(F.col(_TMP), max_length))
        out = _with_guard_inputs(out, F.col(_TMP))
        for name, pattern in DANGEROUS_PATTERNS:
            out = _guarded_replace(out, name, _java_pattern(name, pattern), REMOVED_TOKEN)
        out = out.withColumn(_TMP, html_escape(strip_control(F.col(_TMP))))
    return out.drop(_LOW, _FOLD).withColumnRenamed(_TMP, out_col)


def redact_frame(df, text_col: str, out_col: str):
    """``redact_secrets`` of a whole-text column as staged, prefiltered steps.
    The first step writes "key=***REDACTED***"; "api" + "key" in the original
    text is still required for the second pattern, so one prefilter input
    serves both."""
    out = _with_guard_inputs(df.withColumn(_TMP, F.col(text_col)), F.col(text_col))
    out = _guarded_replace(out, "secret", _FLAGS + SECRET_PATTERN, SECRET_REPLACEMENT)
    out = _guarded_replace(out, "api_key", _FLAGS + API_KEY_PATTERN, API_KEY_REPLACEMENT)
    return out.drop(_LOW, _FOLD).withColumnRenamed(_TMP, out_col)


def dangerous_frame(df, text_col: str, class_col: str = "pattern_class"):
    """F23 in long form: one row per (input row, pattern class it hits)."""
    g = _with_guard_inputs(df, F.col(text_col))
    args = []
    for name, pattern in DANGEROUS_PATTERNS:
        hit = F.when(may_match(name, F.col(_LOW), F.col(_FOLD)), F.col(text_col).rlike(_java_pattern(name, pattern)))
        args += [F.coalesce(hit, F.lit(False)), F.lit(name)]
    keep = [c for c in df.columns]
    return (
        g.select(*keep, F.stack(F.lit(len(DANGEROUS_PATTERNS)), *args).alias("__hit", class_col))
        .where(F.col("__hit"))
        .drop("__hit")
    )
