"""Unions and sorts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotlake.operators.columns import quoted


def union_files(parts: list[DataFrame]) -> DataFrame:
    """All rows of the files of one family, matched by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def outer_union(first: DataFrame, second: DataFrame) -> DataFrame:
    """All rows of both; columns of `first`, then those only `second` has; absent cells are NULL."""
    return first.unionByName(second, allowMissingColumns=True)


def sort_nulls_last(df: DataFrame, keys: list[str], tie_break: list[str] | None = None) -> DataFrame:
    """Ascending sort with NULLs last.

    Equal sort keys cannot be cut by range partitioning, so on large data name
    further columns in `tie_break`: a key that holds a large share of the rows
    is then spread over many sort tasks, and the order becomes total.
    """
    return df.orderBy(*[F.asc_nulls_last(quoted(k)) for k in [*keys, *(tie_break or [])]])
