"""IOC validation (F10-F14) and feed-URL safety (F19) as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (must equal the reference's behaviour) -------------------
# Minimum IOC length; IPv4 = four dot-separated decimal parts 0-255 (leading
# zeros accepted); per-type patterns below; any other type is valid.
MIN_IOC_LENGTH = 3
DOMAIN_PATTERN = (
    r"^[a-zA-Z0-9]([a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?"
    r"(\.[a-zA-Z0-9]([a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?)*$"
)
URL_PATTERN = r"^https?://"
HASH_LENGTHS = {"md5": 32, "sha1": 40, "sha256": 64}
# Feed URLs: scheme must be https; the authority must not contain any of:
UNSAFE_HOST_PARTS = ["localhost", "127.0.0.1", "0.0.0.0", "10.", "192.168.", "172.16."]
# ----------------------------------------------------------------------------

_OCTET = r"0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
# \z: no trailing newline allowed (the reference splits on '.' and needs
# every part to be all digits).
IPV4_PATTERN = "^" + _OCTET + r"(\." + _OCTET + r"){3}\z"


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def valid_ip(c) -> Column:
    v = _as_col(c)
    return F.coalesce((F.length(v) >= MIN_IOC_LENGTH) & v.rlike(IPV4_PATTERN), F.lit(False))


def valid_domain(c) -> Column:
    v = _as_col(c)
    # (?d): '$' may precede one trailing '\n' only, as in Python's re.
    return F.coalesce((F.length(v) >= MIN_IOC_LENGTH) & v.rlike("(?d)" + DOMAIN_PATTERN), F.lit(False))


def valid_url(c) -> Column:
    v = _as_col(c)
    return F.coalesce((F.length(v) >= MIN_IOC_LENGTH) & v.rlike(URL_PATTERN), F.lit(False))


def valid_hash(c, kind: str) -> Column:
    v = _as_col(c)
    n = HASH_LENGTHS[kind]
    return F.coalesce(v.rlike(f"(?d)^[a-fA-F0-9]{{{n}}}$"), F.lit(False))


def valid_ioc(value, ioc_type) -> Column:
    """F10-F14 in one CASE on the type; null/short value -> false."""
    v = _as_col(value)
    t = _as_col(ioc_type)
    long_enough = F.coalesce(F.length(v) >= MIN_IOC_LENGTH, F.lit(False))
    by_type = (
        F.when(t == "ip", valid_ip(v))
        .when(t == "domain", valid_domain(v))
        .when(t == "url", valid_url(v))
        .when(t == "md5", valid_hash(v, "md5"))
        .when(t == "sha1", valid_hash(v, "sha1"))
        .when(t == "sha256", valid_hash(v, "sha256"))
        .otherwise(F.lit(True))
    )
    return long_enough & by_type


def url_scheme(c) -> Column:
    """Scheme as urllib parses it: letters/digits/+-. before ':', lower-cased."""
    return F.lower(F.regexp_extract(_as_col(c), r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def url_netloc(c) -> Column:
    """Authority part after ``scheme://`` up to the first / ? or #."""
    return F.regexp_extract(_as_col(c), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def url_is_safe(c) -> Column:
    """https only, and no private/loopback marker inside the authority."""
    netloc = url_netloc(c)
    unsafe = reduce(lambda a, b: a | b, [netloc.contains(p) for p in UNSAFE_HOST_PARTS])
    return F.coalesce((url_scheme(c) == "https") & ~unsafe, F.lit(False))
