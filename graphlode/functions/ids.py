"""Identities.  SHA-256 stands where other systems use hashes that Spark lacks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefixes of typed ids (fixed values).
PREFIXES = ("file", "sym", "sql", "page", "control", "table", "column", "state")


def typed_id(prefix: str, *parts: Column) -> Column:
    assert prefix in PREFIXES
    return F.concat_ws(":", F.lit(prefix), *parts)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def chunk_id(path: Column, start: Column, end: Column, content: Column) -> Column:
    return F.sha2(F.concat_ws("\u0000", path, start.cast("string"), end.cast("string"), content_hash(content)), 256)


def fingerprint(members: Column) -> Column:
    """A set's hash, whatever the order of its members."""
    return F.sha2(F.concat_ws("\u0000", F.array_sort(members)), 256)
