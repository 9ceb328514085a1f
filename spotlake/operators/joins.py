"""Keyed joins, counted matches, removals and appends.

Joins are plain: Spark broadcasts a side it estimates or measures to be small,
and adaptive execution cuts skewed shuffle partitions on either side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotlake.operators.columns import quoted


def join_spots(airings: DataFrame, spots: DataFrame, airing_key: str = "MATERIAL", spot_key: str = "titulo") -> DataFrame:
    """Airings with the columns of their spot. NULL keys drop; a repeated spot key fans out."""
    keyed = spots.withColumnRenamed(spot_key, "_spot")
    joined = airings.withColumn("_spot", quoted(airing_key)).join(keyed, "_spot")
    return joined.withColumnRenamed("_spot", spot_key)


def _text_keys(df: DataFrame, names: list[str]) -> list[Column]:
    return [quoted(n).cast("string").alias(f"_k{i}") for i, n in enumerate(names)]


def cross_duplicates(first: DataFrame, second: DataFrame, first_keys: list[str], second_keys: list[str]) -> DataFrame:
    """One row: matching pairs, and the rows of each side that have a match.

    Keys are compared as text and NULL matches NULL. Each side is counted per key
    before the join, so no pair is ever produced and no key can be hot.
    """
    names = [f"_k{i}" for i in range(len(first_keys))]
    a = first.select(*_text_keys(first, first_keys)).groupBy(*names).agg(F.count(F.lit(1)).alias("_a")).alias("a")
    b = second.select(*_text_keys(second, second_keys)).groupBy(*names).agg(F.count(F.lit(1)).alias("_b")).alias("b")
    same = reduce(lambda x, y: x & y, [F.col(f"a.{n}").eqNullSafe(F.col(f"b.{n}")) for n in names])
    # Pairs are counted but never formed, so their number may exceed a long.
    wide = "decimal(38,0)"
    zero = F.lit(0).cast(wide)
    return a.join(b, same, "inner").agg(*[
        F.coalesce(F.sum(n).cast(wide), zero).alias(name)
        for name, n in (
            ("pairs", F.col("_a").cast("decimal(19,0)") * F.col("_b").cast("decimal(19,0)")),
            ("first_rows", F.col("_a")), ("second_rows", F.col("_b")))
    ])


def remove_cross_duplicates(
    first: DataFrame, second: DataFrame, first_keys: list[str], second_keys: list[str]
) -> DataFrame:
    """Rows of `second` without a key match in `first`. A NULL key never matches, so its row stays."""
    names = [f"_k{i}" for i in range(len(second_keys))]
    taken = first.select(*_text_keys(first, first_keys)).dropna().distinct()
    keyed = second.select("*", *_text_keys(second, second_keys))
    return keyed.join(taken, names, "left_anti").drop(*names)


def keep_groups(df: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among `groups`, a table the caller has limited to k rows."""
    return df.join(F.broadcast(groups.select(quoted(key))), key, "left_semi")


def lookup_enrich(rows: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """Rows that have a lookup entry, with its columns added; lookup keys are unique."""
    return rows.join(lookup, key)


def pending(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Work rows whose key is not in the table of finished work."""
    return work.join(done.select(quoted(key)).distinct(), key, "left_anti")


def append_new(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Existing rows and the new rows whose key they lack."""
    return existing.unionByName(pending(new, existing, key), allowMissingColumns=True)


def append_all(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Existing rows and all new rows; repeated runs repeat rows."""
    return existing.unionByName(new, allowMissingColumns=True)
