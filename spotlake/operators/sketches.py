"""Profiles and quantiles that go on with new data: small mergeable sketches, stored with every load.

A load adds its own rows to the store and reads nothing that was loaded before; a profile merges the
stored rows. Loads are told apart by a name, and a load that is written again replaces itself.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spotlake.operators.columns import quoted, string_columns
from spotlake.sources.readers import read_if_present

# Registers of a distinct sketch are 2 to this; relative standard error about 1.04 / 2^(LG / 2).
LG_REGISTERS = 12
# Accuracy parameter of a quantile sketch, and its rank error for one quantile at 99 % confidence.
KLL_K = 800
KLL_RANK_ERROR = 2.296 / KLL_K ** 0.9021


def distinct_error(lg: int = LG_REGISTERS, deviations: float = 3.0) -> float:
    """Relative error of a distinct count that is exceeded with the chance of that many standard deviations."""
    return deviations * 1.04 / math.sqrt(1 << lg)


def column_sketches(df: DataFrame, columns: list[str] | None = None, lg: int = LG_REGISTERS) -> DataFrame:
    """(column, n_rows, n_null, sketch) of the string columns, from one pass; one row a column."""
    chosen = columns or string_columns(df)
    parts = []
    for i, c in enumerate(chosen):
        parts += [F.count_if(quoted(c).isNull()).alias(f"_n{i}"), F.hll_sketch_agg(quoted(c).cast("string"), F.lit(lg)).alias(f"_s{i}")]
    one = df.agg(F.count(F.lit(1)).alias("_rows"), *parts)
    rows = [F.struct(F.lit(c).alias("column"), F.col("_rows").alias("n_rows"), F.col(f"_n{i}").alias("n_null"), F.col(f"_s{i}").alias("sketch"))
            for i, c in enumerate(chosen)]
    return one.select(F.inline(F.array(*rows)))


def merged_profile(sketches: DataFrame) -> DataFrame:
    """(column, n_rows, null_pct, n_distinct) over all loads; NULL counts as one value, as in `distinct_profile`."""
    merged = sketches.groupBy("column").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_null").alias("n_null"), F.hll_union_agg("sketch").alias("sketch"))
    distinct = F.hll_sketch_estimate("sketch") + F.when(F.col("n_null") > 0, 1).otherwise(0)
    return merged.select("column", "n_rows", F.try_divide(F.lit(100.0) * F.col("n_null"), F.col("n_rows")).alias("null_pct"),
                         distinct.cast("bigint").alias("n_distinct"))


def quantile_sketches(df: DataFrame, groups: list[str | Column], value: str, k: int = KLL_K) -> DataFrame:
    """(groups, n, low, high, sketch) per group, of the rows that have a value."""
    keys = [quoted(g) if isinstance(g, str) else g for g in groups]
    x = quoted(value).cast("double")
    return df.where(x.isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(x).alias("low"), F.max(x).alias("high"), F.kll_sketch_agg_double(x, F.lit(k)).alias("sketch"))


def merged_quantiles(sketches: DataFrame, groups: list[str], probs: list[float], k: int = KLL_K) -> DataFrame:
    """(groups, n, low, high, q0, q1, ...) over all stored sketches; each quantile is a value of the data."""
    merged = sketches.groupBy(*[quoted(g) for g in groups]).agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))
    picks = [F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias(f"q{i}") for i, p in enumerate(probs)]
    return merged.select(*[quoted(g) for g in groups], "n", "low", "high", *picks)


def merged_box_plot(sketches: DataFrame, group: str, k: int = KLL_K) -> DataFrame:
    """Box-plot figures from stored sketches: n, quartiles, and fences 1.5 IQR beyond them, cut to the range of the data."""
    q = merged_quantiles(sketches, [group], [0.25, 0.5, 0.75], k)
    reach = F.lit(1.5) * (F.col("q2") - F.col("q0"))
    return q.select(quoted(group), "n", F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3"),
                    F.greatest("low", F.col("q0") - reach).alias("fence_low"), F.least("high", F.col("q2") + reach).alias("fence_high"))


@dataclass(frozen=True)
class SketchStore:
    """Sketch rows below `base`, one folder a load; `schema` is that of the rows."""

    spark: SparkSession
    base: str
    schema: T.StructType

    def add(self, load: str, sketches: DataFrame) -> None:
        """Store the sketches of one load, replacing those it stored before."""
        sketches.select(*[quoted(f) for f in self.schema.fieldNames()]).write.mode("overwrite").parquet(f"{self.base}/load={load}")

    def rows(self) -> DataFrame:
        """The sketches of all loads, with the name of the load."""
        return read_if_present(self.spark, self.base, T.StructType([*self.schema.fields, T.StructField("load", T.StringType())]))
