"""Canonical JSON: one text for all texts of a document, by way of VARIANT, whose objects are sorted by name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(text: Column) -> Column:
    """The document without white space, its objects' names in order; null for null and for what isn't JSON."""
    return F.to_json(F.try_parse_json(text))


def content_id(text: Column, prefix: str = "") -> Column:
    """A name that equal documents share: a digest of the canonical text."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(canonical_json(text), 256), 1, 24))
