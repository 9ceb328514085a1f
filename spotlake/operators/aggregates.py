"""Counts, shares, pivots, histograms and latest values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotlake.functions.text import is_content_word, word_tokens
from spotlake.operators.columns import quoted
from spotlake.operators.joins import keep_groups


def group_count(df: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    return df.groupBy(*[quoted(k) for k in keys]).agg(F.count(F.lit(1)).alias(name))


def joined_group_count(
    airings: DataFrame, spots: DataFrame, airing_key: str, spot_key: str,
    airing_groups: list[str], spot_groups: list[str], name: str = "n",
) -> DataFrame:
    """Group count over the inner join of airings and spots.

    Spots are counted per key and group, so that no pair is formed; airings meet
    these counts as they are, without a shuffle where the counts can be broadcast, and
    are summed per group before the one small shuffle.
    """
    left = airings.select(quoted(airing_key).alias("_key"), *[quoted(g) for g in airing_groups]).where("_key IS NOT NULL")
    right = group_count(spots.withColumnRenamed(spot_key, "_key").where("_key IS NOT NULL"), ["_key", *spot_groups], "_r")
    return left.join(right, "_key").groupBy(*[quoted(k) for k in [*airing_groups, *spot_groups]]).agg(F.sum("_r").alias(name))


def count_with_nonnull(df: DataFrame, keys: list[str], counted: str) -> DataFrame:
    """Rows per group and rows whose `counted` is not NULL, largest non-NULL count first."""
    return (
        df.groupBy(*[quoted(k) for k in keys])
        .agg(F.count(F.lit(1)).alias("n"), F.count(quoted(counted)).alias("n_nonnull"))
        .orderBy(F.desc("n_nonnull"), *[quoted(k) for k in keys])
    )


def with_share(counts: DataFrame, count_col: str = "n", name: str = "share_pct", digits: int = 1) -> DataFrame:
    """Share of the grand total in percent. The total is a scalar subquery over the counts."""
    total = counts.agg(F.sum(quoted(count_col)).alias("_t")).select("_t").scalar()
    return counts.withColumn(name, F.round(F.lit(100.0) * quoted(count_col) / total, digits))


def pivot_counts(
    counts: DataFrame, index: str, category: str, values: list[str], count_col: str = "n"
) -> DataFrame:
    """Counts as a matrix with one column per listed category; an absent cell is NULL."""
    return counts.groupBy(quoted(index)).pivot(category, values).agg(F.sum(quoted(count_col)))


def matrix_by_total(counts: DataFrame, index: str, category: str, values: list[str], count_col: str = "n") -> DataFrame:
    """Matrix rows by their total over all categories, listed or not, largest first; an absent cell is NULL.

    Cells and total come from one aggregate, so the counts are computed once;
    ranking first and joining back would compute them twice.
    """
    return _with_total(counts, index, category, values, count_col).orderBy(F.desc("_total"), quoted(index)).drop("_total")


def top_matrix(counts: DataFrame, index: str, category: str, values: list[str], k: int, count_col: str = "n") -> DataFrame:
    """The first k rows of `matrix_by_total`, without a NULL index."""
    ranked = _with_total(counts.where(quoted(index).isNotNull()), index, category, values, count_col)
    return ranked.orderBy(F.desc("_total"), quoted(index)).limit(k).drop("_total")


def _with_total(counts: DataFrame, index: str, category: str, values: list[str], count_col: str) -> DataFrame:
    n = quoted(count_col)
    cells = [F.sum(F.when(quoted(category) == v, n)).alias(str(v)) for v in values]
    return counts.groupBy(quoted(index)).agg(F.sum(n).alias("_total"), *cells)


def category_values(counts: DataFrame, category: str) -> list[str]:
    """Pivot columns of an aggregated table.

    Spark refuses beyond `spark.sql.pivotMaxValues`; the counts themselves, one
    row per cell, are the form for more categories.
    """
    limit = int(counts.sparkSession.conf.get("spark.sql.pivotMaxValues", "10000"))
    rows = counts.select(quoted(category)).where(quoted(category).isNotNull()).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{category} has more than {limit} values; too many for a matrix")
    return sorted(r[0] for r in rows)


def top_groups(counts: DataFrame, key: str, k: int, count_col: str = "n") -> DataFrame:
    """The k groups with the largest total; NULL groups are left out and ties go by key."""
    return (
        counts.where(quoted(key).isNotNull())
        .groupBy(quoted(key)).agg(F.sum(quoted(count_col)).alias(count_col))
        .orderBy(F.desc(count_col), quoted(key)).limit(k)
    )


def within_top_groups(counts: DataFrame, key: str, k: int, count_col: str = "n") -> DataFrame:
    """Rows of an aggregated table that belong to its k largest groups."""
    return keep_groups(counts, top_groups(counts, key, k, count_col), key)


def histogram(df: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """Equal-width bins between minimum and maximum; the last bin is closed, empty bins are kept.

    A constant column is widened by 0.5 on both sides. NULLs are left out.
    """
    x = quoted(value)
    bounds = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).select(
        F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    lo, hi = bounds.select("lo").scalar(), bounds.select("hi").scalar()
    width = (hi - lo) / F.lit(bins)
    bin_no = F.least(F.floor((x - lo) / width), F.lit(bins - 1)).cast("int")
    filled = df.where(x.isNotNull()).select(bin_no.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    edges = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    # `filled` has at most `bins` rows.
    return edges.join(F.broadcast(filled), "bin", "left").select(
        "bin",
        (lo + F.col("bin") * width).alias("lower"),
        (lo + (F.col("bin") + 1) * width).alias("upper"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
    )


def accuracy(predictions: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row: share of rows whose prediction equals the label."""
    hit = (quoted(label) == quoted(prediction)).cast("int")
    return predictions.agg(F.avg(hit).alias("accuracy"))


def confusion_matrix(predictions: DataFrame, label: str, prediction: str, classes: list) -> DataFrame:
    """Rows are labels, columns predicted classes, in the given class order; absent cells are 0."""
    return (
        predictions.groupBy(quoted(label).alias("label"))
        .pivot(prediction, classes).agg(F.count(F.lit(1)))
        .na.fill(0).orderBy("label")
    )


def last_value(df: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """Value of the last row of each key. Partial maxima are taken before the shuffle."""
    rank = F.struct(*[quoted(c) for c in order])
    return df.groupBy(quoted(key)).agg(F.max_by(quoted(value), rank).alias(value))


def merge_latest(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """State after an update: keys of both, new values win."""
    both = old.select(quoted(key), quoted(value), F.lit(0).alias("_age")).unionByName(
        new.select(quoted(key), quoted(value), F.lit(1).alias("_age")))
    return both.groupBy(quoted(key)).agg(F.max_by(quoted(value), F.col("_age")).alias(value))


def latest_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by `order`, kept whole."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[quoted(c) for c in order])
    row: Column = F.max_by(F.struct(*[quoted(c) for c in rest]), rank).alias("_row")
    latest = df.groupBy(*[quoted(k) for k in keys]).agg(row)
    return latest.select(*[quoted(k) for k in keys], *[F.col("_row").getField(c).alias(c) for c in rest]).select(
        *[quoted(c) for c in df.columns])


def word_frequencies(df: DataFrame, text: str, words_out: list[str] | None = None, unicode_words: bool = False) -> DataFrame:
    """Word counts over the distinct texts, without the words in `words_out`.

    A task drops its own copies first; each text left moves once, as it takes
    fewer bytes than its words with their counts would.
    """
    words = df.select(quoted(text)).distinct().select(F.explode(word_tokens(quoted(text), unicode_words)).alias("word"))
    if words_out:
        words = words.where(is_content_word("word", words_out))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def top_words(frequencies: DataFrame, k: int) -> DataFrame:
    return frequencies.orderBy(F.desc("n"), "word").limit(k)
