"""Whole JSON documents of any size."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Documents from this size on may be too large for a variant (128 MB, encoded).
LARGE = 16 << 20


def large_unparsed(text: Column) -> Column:
    """A document that a variant cannot hold, or that is no JSON: ``text_items`` tells."""
    return (F.octet_length(text) >= LARGE) & F.try_parse_json(text).isNull()


def readable(text: Column) -> Column:
    """Is a feed document JSON, of whatever size?"""
    as_text = F.from_json(text, "array<string>").isNotNull() | F.from_json(text, "map<string,string>").isNotNull()
    return F.try_parse_json(text).isNotNull() | ((F.octet_length(text) >= LARGE) & as_text)
