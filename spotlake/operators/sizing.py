"""Spreading of inputs over the cores."""

from __future__ import annotations

from pyspark.sql import DataFrame

from spotlake.operators.columns import quoted

# Below this estimate per core a table cannot keep all cores busy for long enough
# to matter, and moving it once costs next to nothing.
SMALL_PER_CORE = 16 << 20

# Estimated bytes of the texts of one part: their words, counted per text, fit a task's memory without spilling.
PART_BYTES = 8 << 20
# Estimates of joins multiply and may be far too high; tables that are no files have none, which shows as a size beyond any.
MOST_PARTS = 4096
UNKNOWN = 1 << 50


def estimate(df: DataFrame) -> int:
    """Spark's estimate of the bytes of `df`; the size of the files if it reads whole ones."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def parts_by_key(df: DataFrame) -> int:
    """Number of parts for `by_key`."""
    spark, size = df.sparkSession, estimate(df)
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions")) if size >= UNKNOWN else min(MOST_PARTS, -(-size // PART_BYTES))
    return max(spark.sparkContext.defaultParallelism, wanted)


def by_key(df: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """Rows hashed by key into `parts` parts, for work that makes many rows of one and groups them by key again.

    What is grouped by the key, or by the key and more, stays in its part: the texts
    move once, and the rows made of them, which are many times larger, do not. Rows of
    one key share a part.
    """
    return df.repartition(parts, *[quoted(k) for k in keys])


def over_all_cores(df: DataFrame, keys: list[str]) -> DataFrame:
    """Small inputs hashed over all cores by key; larger ones as they were scanned.

    A small file is one scan task however many cores there are. Work that spends
    long on each row, such as splitting texts, is worth one tiny shuffle first;
    an input of many splits is already spread and is not moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if estimate(df) > SMALL_PER_CORE * cores:
        return df
    return df.repartition(cores, *[quoted(k) for k in keys])
