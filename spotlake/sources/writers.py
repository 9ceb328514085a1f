"""Writers: CSV, JSON, catalogue tables, versioned paths and state tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spotlake.operators.columns import quoted
from spotlake.operators.joins import pending
from spotlake.sources.readers import path_exists
from spotlake.sources.scratch import materialise


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header in every part file."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_external_table(df: DataFrame, table: str, path: str, partition_by: list[str] | None = None) -> None:
    """Catalogue table with its files at `path`; column names with blanks are kept.

    Partitioned writes are rebalanced first: rows of a large partition value are
    spread over several tasks, small ones share a task.
    """
    if partition_by:
        df = df.hint("rebalance", *[F.col(c) for c in partition_by])
    writer = df.write.format("parquet").option("path", path)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.mode("overwrite").saveAsTable(table)


def overwrite_table(df: DataFrame, table: str, path: str | None = None) -> None:
    """Replace a catalogue table and its schema; its files are at `path` or in the warehouse."""
    writer = df.write.format("parquet").mode("overwrite")
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)


def convert_reports(df: DataFrame, path: str, family: str) -> None:
    """Report rows as Parquet under `family=<name>`, one folder per family."""
    df.withColumn("family", F.lit(family)).write.mode("append").partitionBy("family").parquet(path)


def versions(spark: SparkSession, base: str) -> list[int]:
    """Numbers of the completely written versions below `base`, ascending."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/v=*/_SUCCESS")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    return sorted(int(status.getPath().getParent().getName()[2:]) for status in (found or []))


def version_path(base: str, number: int) -> str:
    return f"{base.rstrip('/')}/v={number}"


def read_version(spark: SparkSession, base: str, schema: T.StructType) -> DataFrame:
    """Latest complete version, or an empty table before the first one."""
    done = versions(spark, base)
    if not done:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(version_path(base, done[-1]))


def write_version(df: DataFrame, base: str) -> str:
    """Write the next version and return its path.

    A table can thus be replaced by a result computed from itself: readers of the
    old version are untouched, and a failed write is never picked up.
    """
    done = versions(df.sparkSession, base)
    path = version_path(base, done[-1] + 1 if done else 0)
    df.write.mode("overwrite").parquet(path)
    return path


def append_json(df: DataFrame, path: str) -> None:
    """Append records to a JSON dataset; repeated runs repeat records."""
    df.write.mode("append").json(path)


def append_new_json(df: DataFrame, path: str, key: str) -> None:
    """Append only the records whose key the dataset lacks."""
    spark = df.sparkSession
    if path_exists(spark, path):
        existing = spark.read.schema(df.schema).json(path)
        df = pending(df, existing, key)
    df.write.mode("append").json(path)


# Bits of the index of stored keys: a key's hash picks one.
INDEX_BITS = 1 << 30
_KEY = "_key"


def _indexed(df: DataFrame, key: str) -> DataFrame:
    """The rows with the bitmap block and the bit their key falls on; NULL keys have none."""
    bit = F.pmod(F.xxhash64(quoted(key)), F.lit(INDEX_BITS)) + 1
    known = quoted(key).isNotNull()
    return df.withColumns({"_block": F.when(known, F.bitmap_bucket_number(bit)), "_bit": F.when(known, F.bitmap_bit_position(bit))})


def _write_index(rows: DataFrame, key: str, index: str) -> None:
    """Add the keys of `rows` to the index: the keys by block, then their bitmaps, which make the part complete."""
    keys = _indexed(rows.select(quoted(key)), key).where(quoted(key).isNotNull())
    number = len(versions(rows.sparkSession, f"{index}/bits"))
    keys.select(quoted(key).alias(_KEY), "_block").distinct().repartitionByRange("_block").sortWithinPartitions("_block").write.mode(
        "overwrite").parquet(f"{index}/keys/v={number}")
    keys.groupBy("_block").agg(F.bitmap_construct_agg("_bit").alias("_bits")).write.mode("overwrite").parquet(f"{index}/bits/v={number}")


def append_indexed_json(df: DataFrame, path: str, key: str) -> None:
    """Append only the records whose key the dataset lacks, without reading the stored records.

    Next to the dataset, in `<path>.index`, every append leaves a bitmap over hashed
    keys and the keys themselves, sorted by bitmap block. A record whose bit is not
    set is new; only for the others are the stored keys of their blocks read, as two
    keys may share a bit. Of several new records of one key one is written. Records
    without a key are always new, as in `append_new_json`. An append that breaks off
    before its index is complete is found by its mark, and the next one builds the
    index anew from the records.
    """
    spark, index = df.sparkSession, f"{path.rstrip('/')}.index"
    done, begun = versions(spark, f"{index}/bits"), versions(spark, f"{index}/begun")
    if path_exists(spark, path) and (not done or len(begun) != len(done)):
        index_json(spark, path, df.schema, key)
        done = versions(spark, f"{index}/bits")
    # One mark more than complete parts, until this append's part is complete.
    for _ in range(len(begun), len(done) + 1):
        write_version(spark.range(1), f"{index}/begun")
    rows = df.withColumn("_one", F.monotonically_increasing_id())
    first = rows.where(quoted(key).isNotNull()).groupBy(quoted(key)).agg(F.min("_one").alias("_one")).select("_one")
    rows = _indexed(rows.where(quoted(key).isNull()).unionByName(rows.join(first, "_one", "left_semi")), key)
    if done:
        folders = [f"{index}/bits/v={n}" for n in done]
        bits = spark.read.parquet(*folders).groupBy("_block").agg(F.bitmap_or_agg("_bits").alias("_bits"))
        byte = F.conv(F.hex(F.expr("substring(_bits, cast(_bit div 8 AS int) + 1, 1)")), 16, 10).cast("bigint")
        is_set = F.coalesce(F.getbit(byte, (F.col("_bit") % 8).cast("int")) == 1, F.lit(False))
        rows = materialise(rows.join(bits, "_block", "left").withColumn("_set", is_set).drop("_bits"), "appended")
        suspects = rows.where("_set")
        if not suspects.isEmpty():
            keys = spark.read.parquet(*[f"{index}/keys/v={n}" for n in done])
            # Blocks are in the statistics of the files, so a block that is not asked for is not read.
            blocks = [r["_block"] for r in suspects.select("_block").distinct().limit(BLOCKS_IN_FILTER + 1).collect()]
            keys = keys.where(F.col("_block").isin(blocks)) if len(blocks) <= BLOCKS_IN_FILTER else keys
            stored = keys.select(F.col(_KEY).alias(key)).distinct()
            rows = rows.where("NOT _set").unionByName(suspects.join(stored, key, "left_anti").select(*rows.columns))
    fresh = materialise(rows.select(*[quoted(c) for c in df.columns]), "fresh")
    fresh.write.mode("append").json(path)
    _write_index(fresh, key, index)


# So many blocks are named in a filter that Parquet files are pruned by; with more, all stored keys are read.
BLOCKS_IN_FILTER = 1000


def index_json(spark: SparkSession, path: str, schema: T.StructType, key: str) -> None:
    """Index all records that are stored, in one part more; for a dataset that has no index, or whose index broke off."""
    _write_index(spark.read.schema(schema).json(path), key, f"{path.rstrip('/')}.index")


def load_state(spark: SparkSession, base: str, schema: T.StructType) -> DataFrame:
    """Key/value state; empty before the first save."""
    return read_version(spark, base, schema)


def save_state(df: DataFrame, base: str) -> str:
    return write_version(df, base)
