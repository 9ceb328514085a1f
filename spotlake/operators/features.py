"""Term counts, document frequencies and TF-IDF as relational aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spotlake.functions.keys import bucket_of
from spotlake.functions.text import is_content_word, word_tokens
from spotlake.operators.columns import quoted
from spotlake.operators.sizing import by_key, parts_by_key
from spotlake.sources.scratch import materialise

# Frequent terms whose facts are broadcast: so many units of cost at most, and no term of more bytes.
FREQUENT = 1 << 17
FREQUENT_BYTES = 64


def term_counts(
    df: DataFrame, key: str, text: str, words_out: list[str] | None = None, unicode_words: bool = False, width: int | None = None,
    parts: int | None = None,
) -> DataFrame:
    """(key, term, tf). Texts are shuffled once, by key; their words are counted where they are.

    The result is hashed by key into `parts` parts, so that grouping it by key moves nothing.
    With `width` terms are the numbers of that many hash buckets, so that whatever is
    kept per term has a bound. Counts stay positive, as a Naive Bayes model needs.
    """
    narrow = df.select(quoted(key), quoted(text))
    texts = by_key(narrow, [key], parts or parts_by_key(narrow))
    words = texts.select(quoted(key), F.explode(word_tokens(quoted(text), unicode_words)).alias("term"))
    if words_out:
        words = words.where(is_content_word("term", words_out))
    if width:
        words = words.withColumn("term", bucket_of("term", width).cast("string"))
    return words.groupBy(quoted(key), "term").agg(F.count(F.lit(1)).alias("tf"))


def hashed_features(terms: DataFrame, key: str, width: int = 1 << 18) -> DataFrame:
    """(key, bucket, value): term counts hashed to a fixed width, half of the terms with a negative sign.

    Bucket and sign come from parts of the term's MD5 that do not overlap. Terms that
    share a bucket add up or cancel, so that inner products are right on average;
    buckets whose terms cancel are left out. No vocabulary is needed at any size.
    """
    digest = F.md5("term")
    sign = F.when(F.conv(F.substring(digest, 9, 1), 16, 10).cast("int") < 8, 1).otherwise(-1)
    hashed = terms.select(quoted(key), bucket_of("term", width).alias("bucket"), (F.col("tf") * sign).alias("value"))
    return hashed.groupBy(quoted(key), "bucket").agg(F.sum("value").alias("value")).where("value <> 0")


def document_frequencies(terms: DataFrame) -> DataFrame:
    """(term, df): texts that hold each term."""
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def with_facts(terms: DataFrame, facts: DataFrame, idf: Column, cost: Column | None = None) -> DataFrame:
    """`terms` with the columns of `facts`, a written table of unique terms; terms it lacks drop.

    The facts of frequent terms are broadcast, so most rows stay where they are, next to
    the others of their text; only rows of rarer terms are shuffled to theirs. Which terms
    are frequent follows from a histogram of `idf` in powers of two and has a bound.
    """
    # One bin for each halving of the texts that hold a term, the most frequent terms first.
    rarity = F.floor(idf / math.log(2))
    short = F.octet_length("term") <= FREQUENT_BYTES
    bins = facts.where(short).groupBy(rarity.alias("bin")).agg(
        F.sum(F.lit(1) if cost is None else cost).alias("n")).orderBy("bin").collect()
    room, last = FREQUENT, None
    for r in bins:
        room -= r["n"]
        if room < 0:
            break
        last = r["bin"]
    if last is None:
        return terms.join(facts, "term")
    near = short & (rarity <= last)
    often = terms.join(F.broadcast(facts.where(near)), "term")
    if facts.where(~near).isEmpty():
        return often
    # Always dealt by term, so the parts of the union are not taken for parts by key.
    seldom = terms.join(F.broadcast(facts.where(near).select("term")), "term", "left_anti").join(facts.where(~near).hint("merge"), "term")
    return often.unionByName(seldom)


def tfidf(df: DataFrame, key: str, text: str, words_out: list[str] | None = None) -> DataFrame:
    """(key, term, tf, df, tfidf) with idf = ln((N + 1) / (df + 1)).

    The frequency table is written once. Term counts, many times as large as the
    texts, are not: they are counted again where they meet it.
    """
    terms = term_counts(df, key, text, words_out)
    frequencies = materialise(document_frequencies(terms), "frequencies")
    texts = df.agg(F.count(F.lit(1))).first()[0]
    idf = F.log((F.lit(texts) + F.lit(1)) / (F.col("df") + F.lit(1)))
    joined = with_facts(terms, frequencies, idf)
    return joined.select(quoted(key), "term", "tf", "df", (F.col("tf") * idf).alias("tfidf"))


def top_terms(scores: DataFrame, key: str, k: int) -> DataFrame:
    """The k terms of each text with the largest score; ties go by term."""
    order = W.partitionBy(quoted(key)).orderBy(F.desc("tfidf"), "term")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
