"""A table that follows a folder of Parquet files, also where files are rewritten or removed.

A manifest holds path, length, time and a digest of the rows of every source file, and the version
under which its rows were loaded. A load compares it with a new listing: files that are new, or
differ in length or time and then in their digest, are read again, and rows of files that were
rewritten or removed leave the table. Files that were only touched are not loaded again.

Layout of a target: `<base>/data/load_version=<n>/file_id=<id>` for rows, `<base>/manifest/v=<n>`. A load
writes its rows first and the manifest last, so a load that fails is never seen and can be repeated.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spotlake.operators.columns import quoted
from spotlake.sources import writers
from spotlake.sources.readers import any_file
from spotlake.sources.scratch import materialise

MANIFEST = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("length", T.LongType()), T.StructField("modified", T.TimestampType()),
    T.StructField("rows", T.LongType()), T.StructField("digest", T.StringType()), T.StructField("file_id", T.LongType()),
    T.StructField("version", T.IntegerType()),
])
FILE, VERSION = "file_id", "load_version"


def listing(spark: SparkSession, folder: str, glob: str = "*.parquet") -> DataFrame:
    """`path`, `length`, `modified` of the files in a folder and below; contents are not read."""
    if not any_file(spark, folder):
        return spark.createDataFrame([], T.StructType(MANIFEST.fields[:3]))
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
        .select("path", "length", F.col("modificationTime").alias("modified"))
    )


def file_of() -> Column:
    """The path of the file a row is read from, spelled as in a listing."""
    return F.replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), F.lit("file:///"), F.lit("file:/"))


def digests(rows: DataFrame, file: Column) -> DataFrame:
    """`path`, `rows`, `digest` per source file, whatever the order of rows: sums of two hashes over all columns.

    Rows are summed where they are read, so only one row a file and task is moved.
    """
    columns = [quoted(f.name) if not isinstance(f.dataType, T.MapType) else F.array_sort(F.map_entries(quoted(f.name)))
               for f in rows.schema.fields]
    # Which columns are NULL is hashed too: hashes pass over NULLs.
    nulls = F.concat(*[c.isNull().cast("int").cast("string") for c in columns])
    wide = "decimal(38,0)"
    found = rows.select(file.alias("path"), F.xxhash64(*columns, nulls).cast(wide).alias("one"), F.hash(*columns, nulls).cast(wide).alias("two"))
    sums = found.groupBy("path").agg(F.count(F.lit(1)).alias("rows"), F.sum("one").alias("one"), F.sum("two").alias("two"))
    return sums.select("path", "rows", F.concat_ws(":", "rows", "one", "two").alias("digest"))


def differences(old: DataFrame, new: DataFrame) -> DataFrame:
    """`path`, `state` (`added`, `removed`, `suspect`, `same`) of the files of two listings.

    `suspect` files differ in length or time; only their digest tells whether they changed.
    """
    o = old.select("path", F.col("length").alias("old_length"), F.col("modified").alias("old_modified"))
    both = o.join(new.select("path", "length", "modified"), "path", "full")
    state = (
        F.when(F.col("old_length").isNull(), "added").when(F.col("length").isNull(), "removed")
        .when((F.col("length") != F.col("old_length")) | (F.col("modified") != F.col("old_modified")), "suspect").otherwise("same"))
    return both.select("path", "length", "modified", state.alias("state"))


@dataclass(frozen=True)
class FollowedFolder:
    """Target table of a folder that changes.

    `verify` compares the digests of all files, which reads everything; without it a
    file that was rewritten with the same length and time stays as it was loaded.
    """

    spark: SparkSession
    folder: str
    base: str
    schema: T.StructType
    glob: str = "*.parquet"
    verify: bool = False

    def __post_init__(self):
        clash = {FILE, VERSION} & {f.lower() for f in self.schema.fieldNames()}
        if clash:
            raise ValueError(f"the schema must not hold {sorted(clash)}")

    def manifest(self) -> DataFrame:
        return writers.read_version(self.spark, f"{self.base}/manifest", MANIFEST)

    def load(self) -> dict[str, int]:
        """Bring the table up to date; the number of files that were added, changed, removed, touched and left alone."""
        spark, old = self.spark, self.manifest()
        states = materialise(differences(old, listing(spark, self.folder, self.glob)), "differences")
        suspects = ["added", "suspect", "same"] if self.verify else ["added", "suspect"]
        # Spark takes the files of a scan as a list; it is no longer than the listing Spark itself keeps.
        paths = [r["path"] for r in states.where(F.col("state").isin(suspects)).select("path").collect()]
        fresh = spark.createDataFrame([], "path string, rows long, digest string")
        if paths:
            fresh = digests(spark.read.schema(self.schema).parquet(*paths), file_of())
        known = old.select("path", F.col("rows").alias("old_rows"), F.col("digest").alias("old_digest"), "file_id", "version")
        judged = states.join(fresh, "path", "left").join(known, "path", "left")
        # A file without a row has no digest of its own.
        digest = F.coalesce("digest", F.lit("0"))
        looked_at = F.col("state").isin(suspects)
        result = (
            F.when(F.col("state").isin("added", "removed"), F.col("state")).when(~looked_at, "same")
            .when(digest != F.col("old_digest"), "changed").when(F.col("state") == "suspect", "touched").otherwise("same"))
        judged = materialise(judged.withColumn("result", result).withColumn("digest", F.when(looked_at, digest).otherwise(F.col("old_digest")))
                             .withColumn("rows", F.when(looked_at, F.coalesce("rows", F.lit(0))).otherwise(F.col("old_rows"))), "judged")
        counts = {r["result"]: r["count"] for r in judged.groupBy("result").count().collect()}
        if set(counts) <= {"same"} and writers.versions(spark, f"{self.base}/manifest"):
            return counts
        done = writers.versions(spark, f"{self.base}/manifest")
        version = done[-1] + 1 if done else 0
        reread = F.col("result").isin("added", "changed")
        current = materialise(judged.where("result <> 'removed'").select(
            "path", "length", "modified", "rows", "digest", F.coalesce("file_id", F.xxhash64("path")).alias("file_id"),
            F.when(reread, version).otherwise(F.col("version")).alias("version")), "manifest")
        if current.select("file_id").distinct().count() != current.count():
            raise ValueError("two source files share a number")
        stale = [r["path"] for r in current.where(F.col("version") == version).select("path").collect()]
        if stale:
            rows = spark.read.schema(self.schema).parquet(*stale).select("*", F.xxhash64(file_of()).alias(FILE))
            rows.write.mode("overwrite").partitionBy(FILE).parquet(f"{self.base}/data/{VERSION}={version}")
        writers.write_version(current.select(*[f.name for f in MANIFEST.fields]), f"{self.base}/manifest")
        return counts

    def table(self) -> DataFrame:
        """Rows of the files as they were last loaded; folders of rows that were replaced are pruned."""
        schema = T.StructType([*self.schema.fields, T.StructField(VERSION, T.IntegerType()), T.StructField(FILE, T.LongType())])
        if not any_file(self.spark, f"{self.base}/data"):
            return self.spark.createDataFrame([], self.schema)
        current = self.manifest().where("rows > 0").select(F.col("version").alias(VERSION), F.col("file_id").alias(FILE))
        return self.spark.read.schema(schema).parquet(f"{self.base}/data").join(current, [VERSION, FILE], "left_semi").drop(VERSION, FILE)
