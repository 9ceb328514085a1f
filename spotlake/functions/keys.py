"""Expressions that make values cheap to compare, group and split on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def compact_text(c: Column) -> Column:
    """SHA-256 digest of a string: equal for equal strings, NULL for NULL."""
    return F.sha2(c, 256)


def short_text(c: Column) -> Column:
    """A string of less than 64 bytes as it is, a longer one as its digest of 64: equal for equal strings only, NULL for NULL."""
    return F.when(F.octet_length(c) < 64, c).otherwise(compact_text(c))


def compact_columns(df: DataFrame, columns: list[str] | None = None) -> list[Column]:
    """The named columns, long strings as digests; short ones, which a digest would make longer, and other types unchanged."""
    chosen = columns or df.columns
    types = {f.name: f.dataType for f in df.schema.fields}
    return [
        (short_text(F.col(f"`{c}`")) if isinstance(types[c], T.StringType) else F.col(f"`{c}`")).alias(c)
        for c in chosen
    ]


def bucket_of(key: Column | str, buckets: int = 100) -> Column:
    """Stable bucket number of a key, from the first 32 bits of its MD5."""
    c = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.conv(F.substring(F.md5(c.cast("string")), 1, 8), 16, 10).cast("bigint"), F.lit(buckets)).cast("int")
