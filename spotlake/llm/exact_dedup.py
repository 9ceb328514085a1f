"""Exact duplicates by deterministic block naming.

Texts are cut into fixed-size byte blocks. The distinct blocks are sorted inside
hash partitions and numbered; a block's partition and number are its name. Adjacent names are paired and the
distinct pairs named in turn, until each document has a single name. Equal
names of equally many blocks mean equal bytes: names come from comparing
contents, never from trusting a hash.

Only the distinct blocks travel with their contents, once. Rows find a block's
name through a 128-bit key; the distinct blocks prove that no two of them share
a key, and another key is drawn if they do.

Nulls and edge cases: a null text is an empty text and empty texts are equal.
A null id sorts below all others; `keep_id` is null where a group has only null
ids. Of rows with the same id and text exactly one stays. A very long text is
many blocks, named and paired in many tasks. An empty table gives an empty
result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotlake.llm.common import row_number_column, text_of
from spotlake.sources.scratch import materialise

BLOCK_BYTES = 4096


def _blocks(text: Column, size: int) -> Column:
    """The text's bytes in blocks of `size`; an empty text is one empty block."""
    last = F.greatest(F.lit(0), (F.octet_length(text) - 1) / size).cast("int")
    # The outer array binds the bytes once, so that a block costs its own length only.
    return F.element_at(F.transform(F.array(text.cast("binary")), lambda body: F.transform(
        F.sequence(F.lit(0), last), lambda i: F.substring(body, i * size + 1, F.lit(size)))), 1)


def _key(block: Column, draw: int) -> Column:
    """128 bits of a block; every draw gives an unrelated key."""
    return F.struct(F.xxhash64(F.lit(2 * draw), block).alias("a"), F.xxhash64(F.lit(2 * draw + 1), block).alias("b"))


def _named(values: DataFrame, columns: list[str], name: str = "name") -> DataFrame:
    """Distinct values, sorted inside each partition and numbered: different values never share a number."""
    return values.select(*columns).distinct().sortWithinPartitions(*columns).withColumn(name, F.monotonically_increasing_id())


def _level_zero(docs: DataFrame, id_col: str, text_col: str, size: int, row_col: str | None) -> tuple[DataFrame, DataFrame]:
    """Rows with the keys of their blocks, and the name of every key."""
    text = text_of(text_col)
    draw = 0
    while True:
        rows = materialise(docs.select(
            row_number_column(row_col).alias("row"), F.col(f"`{id_col}`").alias("id"), F.sha2(text, 256).alias("sha"),
            F.transform(_blocks(text, size), lambda b: _key(b, draw)).alias("keys")), "block-keys")
        blocks = docs.select(F.explode(_blocks(text, size)).alias("block"))
        names = materialise(
            _named(blocks, ["block"]).select(_key(F.col("block"), draw).alias("key"), "name").select("key.*", "name"), "block-names")
        if names.groupBy("a", "b").count().where("count > 1").isEmpty():
            return rows, names
        draw += 1


def document_names(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES,
                   row_col: str | None = None) -> DataFrame:
    """One row per document: `row`, `id`, `sha`, and `n_blocks`, `name`, which are equal exactly for equal texts."""
    rows, names = _level_zero(docs, id_col, text_col, block_bytes, row_col)
    pieces = rows.select("row", F.size("keys").alias("n_blocks"), F.posexplode("keys").alias("pos", "key"))
    level = materialise(
        pieces.select("row", "n_blocks", "pos", "key.*").join(names, ["a", "b"]).select("row", "n_blocks", "pos", "name"), "level-0")
    longest = rows.agg(F.max(F.size("keys"))).first()[0] or 1
    done, width = level.where("n_blocks = 1"), 1
    while width < longest:
        # A document of n blocks has ceil(n / width) names at this level.
        open_rows = level.where(F.col("n_blocks") > width)
        pairs = open_rows.groupBy("row", "n_blocks", F.floor(F.col("pos") / 2).cast("int").alias("half")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"))
        pairs = materialise(pairs, "pairs")
        level = materialise(
            pairs.join(_named(pairs, ["left", "right"]), ["left", "right"]).select(
                "row", "n_blocks", F.col("half").alias("pos"), "name"), "level")
        width *= 2
        done = done.unionByName(level.where((F.col("n_blocks") <= width)))
    return rows.select("row", "id", "sha").join(done.select("row", "n_blocks", "name"), "row")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES,
                     row_col: str | None = None) -> DataFrame:
    """Every document with the one of its group that stays: the largest id.

    Returns `row`, `doc_id`, `keep_id`, `group_size`, `kept`, `text_sha256`.
    """
    named = materialise(document_names(docs, id_col, text_col, block_bytes, row_col), "document-names")
    groups = materialise(named.groupBy("n_blocks", "name").agg(
        F.max(F.struct("id", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size")), "groups")
    return named.join(groups, ["n_blocks", "name"]).select(
        "row", F.col("id").alias("doc_id"), F.col("keep.id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("keep.row")).alias("kept"), F.col("sha").alias("text_sha256"))
