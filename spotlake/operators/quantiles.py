"""Exact quantiles and box-plot figures for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spotlake.operators.columns import quoted
from spotlake.sources.scratch import materialise

# Relative rank error of the approximate variants is 1 / SKETCH.
SKETCH = 10000


def _cells(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, _x, _c, _part): how often each value occurs in each group, cut into ranges of value and written once.

    NULL groups and values are left out.
    """
    x = quoted(value).cast("double")
    counted = df.where(quoted(group).isNotNull() & x.isNotNull()).groupBy(quoted(group), x.alias("_x")).agg(F.count(F.lit(1)).alias("_c"))
    return materialise(counted.repartitionByRange(quoted(group), "_x").withColumn("_part", F.spark_partition_id()), "cells")


def _placed(cells: DataFrame, group: str) -> DataFrame:
    """Cells with `_n`, the rows of their group, and `_cum`, those up to and including the cell.

    Each range of cells is summed on its own, and the totals of the ranges before it
    are added: no task sees more than one range of a group.
    """
    whole = W.partitionBy(quoted(group))
    before = whole.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = cells.groupBy(quoted(group), "_part").agg(F.sum("_c").alias("_t")).select(
        quoted(group), "_part", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_start"), F.sum("_t").over(whole).alias("_n"))
    within = W.partitionBy(quoted(group), "_part").orderBy("_x").rowsBetween(W.unboundedPreceding, W.currentRow)
    return cells.join(starts, [group, "_part"]).withColumn("_cum", F.col("_start") + F.sum("_c").over(within))


def _quantiles(cells: DataFrame, group: str, probs: list[float]) -> DataFrame:
    def order_statistic(rank: Column) -> Column:
        return F.min(F.when(F.col("_cum") > rank, F.col("_x")))

    picks = []
    for j, p in enumerate(probs):
        place = F.lit(p) * (F.col("_n") - 1)
        picks += [order_statistic(F.floor(place)).alias(f"_a{j}"), order_statistic(F.ceil(place)).alias(f"_b{j}")]
    found = _placed(cells, group).groupBy(quoted(group)).agg(F.first("_n").alias("n"), *picks)
    return found.select(quoted(group), "n", *[
        (F.col(f"_a{j}") + (F.col(f"_b{j}") - F.col(f"_a{j}")) * (F.lit(p) * (F.col("n") - 1) % 1)).alias(f"q{j}")
        for j, p in enumerate(probs)
    ])


def exact_quantiles(df: DataFrame, group: str, value: str, probs: list[float]) -> DataFrame:
    """Per group: n and one column `q0, q1, ...` per probability, linearly interpolated.

    Equal values are counted before the shuffle; the counts are summed up in
    ranges, so a group may be as large as it likes.
    """
    return _quantiles(_cells(df, group, value), group, probs)


def approximate_quantiles(df: DataFrame, group: str, value: str, probs: list[float]) -> DataFrame:
    """Like `exact_quantiles`, from a sketch: one pass, values from the data."""
    x = quoted(value).cast("double")
    sketch = df.where(quoted(group).isNotNull() & x.isNotNull()).groupBy(quoted(group)).agg(
        F.count(F.lit(1)).alias("n"), F.percentile_approx(x, probs, SKETCH).alias("_q"))
    return sketch.select(quoted(group), "n", *[F.col("_q")[j].alias(f"q{j}") for j in range(len(probs))])


def _fences(quartiles: DataFrame, group: str) -> DataFrame:
    """Quartiles and the fences 1.5 IQR beyond them, one row per group, written once."""
    named = quartiles.select(quoted(group), "n", F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3"))
    reach = F.lit(1.5) * (F.col("q3") - F.col("q1"))
    return materialise(named.withColumns({"_low": F.col("q1") - reach, "_high": F.col("q3") + reach}), "fences")


_QUARTERS = [0.25, 0.5, 0.75]


def box_plot(df: DataFrame, group: str, value: str, approximate: bool = False) -> DataFrame:
    """Per group: n, q1, median, q3, whiskers at the last points within 1.5 IQR, number of outliers."""
    cells = _cells(df, group, value)
    quartiles = approximate_quantiles(df, group, value, _QUARTERS) if approximate else _quantiles(cells, group, _QUARTERS)
    x = F.col("_x")
    within = x.between(F.col("_low"), F.col("_high"))
    stats = ["n", "q1", "median", "q3"]
    return cells.join(_fences(quartiles, group), group).groupBy(quoted(group)).agg(
        *[F.first(c).alias(c) for c in stats],
        F.least(F.min(F.when(within, x)), F.first("q1")).alias("whisker_low"),
        F.greatest(F.max(F.when(within, x)), F.first("q3")).alias("whisker_high"),
        F.sum(F.when(within, F.lit(0)).otherwise(F.col("_c"))).alias("n_outliers"),
    )


def outliers(df: DataFrame, group: str, value: str, approximate: bool = False) -> DataFrame:
    """Rows beyond the 1.5 IQR fences of their group."""
    quartiles = (approximate_quantiles if approximate else exact_quantiles)(df, group, value, _QUARTERS)
    fences = _fences(quartiles, group).select(quoted(group), "_low", "_high")
    joined = df.where(quoted(value).isNotNull()).join(fences, group)
    return joined.where(~quoted(value).between(F.col("_low"), F.col("_high"))).select(*[quoted(c) for c in df.columns])
