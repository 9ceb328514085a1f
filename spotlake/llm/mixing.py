"""Mixing sources to target weights by capped water-filling.

Every source asks for a share of all words by weight. A source's target stops
at `max_epochs` times its own words; what it cannot take goes to the others by
weight, again and again until no target is above its cap. A source then takes
each of its documents a whole number of times, and once more those that come
first in a seeded order, until its target is met within half a document.

Nulls and edge cases: a null text has no words; a null source is a source of
its own, last in order; empty sources get target 0. An empty document is taken
as often as every document of its source, and not at all if the source has no
words. Rows without an id are drawn by their text. Rows that share an id, or
have none and share a text, are rows of their own next to each other in the
order. A very long text is one document like any other: only its words are
counted, and it is taken if its middle lies within the target. An empty table gives an empty
result. Extra columns are ignored. Reruns agree, whatever the partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotlake.llm.common import WORD, row_number_column, text_of
from spotlake.sources.scratch import materialise

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def _in_order(sources: DataFrame) -> DataFrame:
    """Adds `place`, the 0-based place by code point, null last, without gathering the sources in one task."""
    spread = materialise(
        sources.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
        .withColumn("n", F.monotonically_increasing_id())
        .withColumn("part", F.shiftright("n", 33)).withColumn("n", F.col("n").bitwiseAND(F.lit((1 << 33) - 1))), "sources")
    # One row per partition.
    starts = spread.groupBy("part").count().withColumn(
        "start", F.sum("count").over(Window.orderBy("part")) - F.col("count"))
    return spread.join(starts, "part").select("key", "source", "source_size", (F.col("start") + F.col("n")).alias("place"))


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Sources (`key`, `source`, `source_size`) with their `target` in words."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long")
    asked = materialise(_in_order(sources).select(
        "key", "source_size", weight.alias("weight"), (max_epochs * F.col("source_size")).alias("cap")), "asked")
    total = asked.agg(F.sum("source_size")).first()[0] or 0
    level, clamped = 0.0, -1
    while True:
        # Words per unit of weight, for the sources that are not at their cap.
        full = F.col("cap") <= F.lit(level) * F.col("weight")
        s = asked.agg(F.count_if(full).alias("n"), F.sum(F.when(full, F.col("cap"))).alias("cap"),
                      F.sum(F.when(~full, F.col("weight"))).alias("weight")).first()
        if s["n"] == clamped or not s["weight"]:
            break
        clamped, level = s["n"], (total - (s["cap"] or 0)) / s["weight"]
    return asked.select("key", "source_size", F.least(
        F.col("cap").cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED,
        row_col: str | None = None) -> DataFrame:
    """Every document with how often the mix takes it.

    Returns `row`, `doc_id`, `size`, `source_size`, `target`, `copies`, `taken`.
    """
    source = F.col(f"`{source_col}`").cast("string")
    sized = materialise(docs.select(
        row_number_column(row_col).alias("row"), F.col(f"`{id_col}`").alias("id"), source.alias("source"),
        F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source)).alias("key"),
        word_count(text_of(text_col)).alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(
            F.col(f"`{id_col}`").cast("string"), F.concat(F.lit("null:"), F.md5(text_of(text_col)))))).alias("draw"),
    ).withColumns({"b1": F.substring("draw", 1, 3), "b2": F.substring("draw", 4, 3)}), "sizes")

    # A source's documents are counted by the first bits of their draw: no source is summed up row by row in one task.
    bins = materialise(sized.groupBy("key", "source", "b1").agg(F.sum("size").alias("words")), "bins")
    sources = bins.groupBy("key", "source").agg(F.sum("words").alias("source_size"))
    targets = source_targets(sources, weights, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = materialise(targets.withColumn("whole", whole).withColumn(
        "rest", F.col("target") - F.col("whole") * F.col("source_size")), "targets")

    before = F.sum("words").over(Window.partitionBy("key").orderBy("b1")) - F.col("words")
    bins = materialise(bins.withColumn("before", before).join(targets, "key").select(
        "key", "b1", "words", "before", "source_size", "target", "whole", "rest"), "placed-bins")
    ends = F.col("before") + F.col("words")
    placed = sized.join(bins, ["key", "b1"])
    clear = placed.where((ends <= F.col("rest")) | (F.col("before") > F.col("rest"))).withColumn(
        "extra", (ends <= F.col("rest")).cast("long"))

    # The one bin of each source in which its rest ends, counted again by the next bits, then document by document.
    split = placed.where((ends > F.col("rest")) & (F.col("before") <= F.col("rest"))).drop("words")
    small = split.groupBy("key", "b1", "b2").agg(F.sum("size").alias("words")).withColumn(
        "inside", F.sum("words").over(Window.partitionBy("key", "b1").orderBy("b2")) - F.col("words")).drop("words")
    place = F.col("before") + F.col("inside") + F.sum("size").over(
        Window.partitionBy("key", "b1", "b2").orderBy("draw", "size", "row")) - F.col("size")
    split = split.join(small, ["key", "b1", "b2"]).withColumn("extra", (place + F.col("size") / 2 <= F.col("rest")).cast("long"))

    columns = ["row", "id", "size", "source_size", "target", "whole", "extra"]
    # An empty document fills nothing of the rest.
    copies = F.col("whole") + F.when(F.col("size") > 0, F.col("extra")).otherwise(0)
    return clear.select(columns).unionByName(split.select(columns)).select(
        "row", F.col("id").alias("doc_id"), "size", "source_size", "target", copies.alias("copies"),
        (copies * F.col("size")).alias("taken"))
