"""The most frequent words, without a shuffle of the whole vocabulary.

Every task keeps a summary of at most `counters` words after Misra and Gries: when
there are more, the count of the first word that has no place is taken off all of
them. The sum of what was taken off, over all tasks, bounds by how much any word's
summed count falls short, also that of a word in no summary (Agarwal et al.,
"Mergeable summaries", PODS 2012). The k-th largest summed count is therefore a
proven lower bound of the k-th largest count, and words that cannot reach it are
out. Only the rest are counted, exactly, in a second pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotlake.functions.text import is_content_word, word_tokens
from spotlake.operators.aggregates import top_words, word_frequencies
from spotlake.operators.columns import quoted
from spotlake.shipping import ship
from spotlake.sources.scratch import materialise

COUNTERS = 8192
MOST_COUNTERS = 1 << 20

ship(__name__)


def reduced(words: pa.Array, counts: np.ndarray, counters: int) -> tuple[pa.Array, np.ndarray, int]:
    """At most `counters` words with what is left of their counts, and how much was taken off."""
    if len(counts) <= counters:
        return words, counts, 0
    taken = int(np.partition(counts, len(counts) - counters - 1)[len(counts) - counters - 1])
    left = counts > taken
    return words.filter(pa.array(left)), counts[left] - taken, taken


def summaries(tokens: DataFrame, counters: int) -> DataFrame:
    """`word`, `c` of each task's summary of an array column `words`; the row without a word holds what was taken off."""
    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, off = pa.table({"word": pa.array([], pa.string()), "c": pa.array([], pa.int64())}), 0
        for batch in batches:
            found = pc.value_counts(batch.column(0).flatten())
            if not len(found):
                continue
            fresh = pa.table({"word": found.field("values"), "c": found.field("counts")})
            both = pa.concat_tables([held, fresh]).group_by("word", use_threads=False).aggregate([("c", "sum")])
            words, counts, taken = reduced(both["word"].combine_chunks(), both["c_sum"].to_numpy(), counters)
            held, off = pa.table({"word": words, "c": pa.array(counts, pa.int64())}), off + taken
        held = pa.concat_tables([held, pa.table({"word": pa.array([None], pa.string()), "c": pa.array([off], pa.int64())})])
        yield from held.to_batches()

    return tokens.select("words").mapInArrow(summarise, "word string, c long")


def frequent_words(
    df: DataFrame, text: str, k: int, words_out: list[str] | None = None, counters: int = COUNTERS, unicode_words: bool = False
) -> DataFrame:
    """The `k` most frequent words over the distinct texts with their counts: the rows of `top_words`.

    What is shuffled for it are `counters` words a task and the counts of the
    candidates. Where words are so evenly spread that the summaries prove nothing,
    they are built anew with more counters, and beyond `MOST_COUNTERS` all words are counted.
    """
    texts = df.select(quoted(text).alias("text")).where(quoted(text).isNotNull()).distinct()
    words = F.filter(word_tokens("text", unicode_words), lambda w: is_content_word(w, words_out)) if words_out else word_tokens("text", unicode_words)
    tokens = materialise(texts.select(words.alias("words")), "tokens")
    while counters <= MOST_COUNTERS:
        sums = materialise(summaries(tokens, counters).groupBy("word").agg(F.sum("c").alias("c")), "summaries")
        short = sums.where("word IS NULL").agg(F.sum("c")).first()[0] or 0
        best = sums.where("word IS NOT NULL").orderBy(F.desc("c")).limit(k).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least")).first()
        if short == 0:
            return top_words(sums.where("word IS NOT NULL").select("word", F.col("c").alias("n")), k)
        if best["n"] == k and short < best["least"]:
            candidates = materialise(sums.where(F.col("word").isNotNull() & (F.col("c") + short >= best["least"])).select("word"), "candidates")
            counted = tokens.select(F.explode("words").alias("word")).join(candidates, "word", "left_semi")
            return top_words(counted.groupBy("word").agg(F.count(F.lit(1)).alias("n")), k)
        counters *= 4
    return top_words(word_frequencies(df, text, words_out, unicode_words), k)
