"""The corpus pipeline: five stages over documents, each on all that the one before it kept.

Every stage but the last returns the columns of documents. A stage numbers its
rows, calls its operator on them, and applies the decisions by row number, so
null or repeated ids and further columns do no harm; rows that tie in all an
operator reads are told apart by their content, so reruns agree. Null texts are
rejected by the first stage. Very long texts pass whole. An empty table passes
through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotlake.llm import exact_dedup, mixing, packing, quality, simhash
from spotlake.llm.common import numbered, table
from spotlake.sources.scratch import materialise


def _kept(docs: DataFrame, operator) -> DataFrame:
    """The documents whose row the operator keeps."""
    rows, number = numbered(docs)
    verdict = operator(rows, row_col=number).where("kept").select(F.col("row").alias(number))
    return rows.join(verdict, number, "left_semi").select(*(f"`{c}`" for c in docs.columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are not depleted by lines their host repeats."""
    return _kept(docs, quality.judged)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: the largest id."""
    return _kept(docs, exact_dedup.exact_duplicates)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: the smallest id."""
    return _kept(docs, simhash.near_duplicates)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a document may come several times or not at all."""
    rows, number = numbered(docs)
    copies = mixing.mix(rows, row_col=number).where("copies > 0").select(F.col("row").alias(number), "copies")
    times = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    joined = rows.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)), F.col(number).alias("number"))
    repeated = joined.join(copies.withColumnRenamed(number, "number"), "number").withColumn("time", times)
    return repeated.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a training sequence."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_copies),
    ("SimHash near-dedup", near_copies),
    ("mixing", mixed_sources),
    ("packing", packed_sequences),
]

# SQL can neither fingerprint shingles nor tokenise; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again before the next stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
