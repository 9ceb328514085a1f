"""A table of the latest row of each key, kept up to date by merging into the key buckets a batch touches.

Layout of a target: `<base>/run=<k>/checkpoint` for the stream, `<base>/run=<k>/data/v=<n>/bucket=<b>`
for rows, and `<base>/run=<k>/manifest/v=<n>`, which names the version that holds each bucket. A merge
reads the buckets of its batch, writes them anew under the next version, and then writes the next
manifest. Until that is complete, readers see the old rows; a merge that fails is never seen.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from spotlake.operators.aggregates import latest_rows
from spotlake.sources import writers
from spotlake.streaming.loader import BATCH, read_table_stream, run_path, runs

BUCKET = "bucket"
MANIFEST = T.StructType([T.StructField(name, T.IntegerType()) for name in ("bucket", "version", "buckets")])


@dataclass(frozen=True)
class UpsertTarget:
    """Target of a keyed load.

    `order` columns say which row of a key is the latest, NULLs first; of equal ones
    the row of the later batch. A batch that is merged again changes nothing.
    `deleted` may name a boolean column: a key whose latest row has it true is not
    in the table, but its row is kept, so that an older row that comes late stays
    out. NULL is a key like any other.

    The number of buckets is fixed when a run starts. A merge rewrites the touched
    buckets, so choose it such that one bucket is what a task handles well.
    """

    spark: SparkSession
    base: str
    schema: T.StructType
    keys: list[str]
    order: list[str]
    buckets: int = 64
    deleted: str | None = None
    stored: T.StructType = field(init=False)

    def __post_init__(self):
        clash = {BATCH, BUCKET} & {f.lower() for f in self.schema.fieldNames()}
        if clash:
            raise ValueError(f"the schema must not hold {sorted(clash)}")
        stored = T.StructType([*self.schema.fields, T.StructField(BATCH, T.LongType())])
        object.__setattr__(self, "stored", stored)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in self.keys]), F.lit(self.buckets)).cast("int")

    def _path(self, run: int | None = None) -> str | None:
        done = runs(self.spark, self.base)
        number = run if run is not None else done[-1] if done else None
        return None if number is None else run_path(self.base, number)

    def versions(self, path: str | None = None) -> dict[int, int]:
        """The version that holds each bucket; at most one entry a bucket."""
        path = path or self._path()
        if path is None:
            return {}
        rows = writers.read_version(self.spark, f"{path}/manifest", MANIFEST).collect()
        if any(r["buckets"] != self.buckets for r in rows):
            raise ValueError(f"the run has {rows[0]['buckets']} buckets, not {self.buckets}")
        return {r["bucket"]: r["version"] for r in rows}

    def _read(self, path: str, held: dict[int, int]) -> DataFrame:
        if not held:
            return self.spark.createDataFrame([], self.stored)
        folders = [f"{path}/data/v={version}/{BUCKET}={bucket}" for bucket, version in sorted(held.items())]
        return self.spark.read.schema(self.stored).parquet(*folders)

    def merge(self, batch: DataFrame, batch_id: int, path: str) -> list[int]:
        """Merge one batch and return the buckets it rewrote."""
        rows = batch.select(*[f"`{f}`" for f in self.schema.fieldNames()]).withColumn(BATCH, F.lit(batch_id).cast("long"))
        fresh = latest_rows(rows, self.keys, [*self.order, BATCH]).persist()
        try:
            touched = [r[BUCKET] for r in fresh.select(self._bucket().alias(BUCKET)).distinct().collect()]
            if not touched:
                return []
            held = self.versions(path)
            old = self._read(path, {b: held[b] for b in touched if b in held})
            merged = latest_rows(old.unionByName(fresh), self.keys, [*self.order, BATCH]).withColumn(BUCKET, self._bucket())
            version = 1 + max([*held.values(), *writers.versions(self.spark, f"{path}/data")], default=-1)
            # Rows of a bucket come together in one file, or in several if it is large.
            merged.hint("rebalance", F.col(BUCKET)).write.mode("overwrite").partitionBy(BUCKET).parquet(
                writers.version_path(f"{path}/data", version))
            held |= {b: version for b in touched}
        finally:
            fresh.unpersist()
        manifest = self.spark.createDataFrame([(b, v, self.buckets) for b, v in sorted(held.items())], MANIFEST)
        writers.write_version(manifest.coalesce(1), f"{path}/manifest")
        return sorted(touched)

    def load(self, stream: DataFrame, full_reload: bool = False) -> StreamingQuery:
        """Start merging everything available now; await the returned query. A full reload starts a new run."""
        done = runs(self.spark, self.base)
        path = run_path(self.base, 0 if not done else done[-1] + 1 if full_reload else done[-1])
        return (
            stream.writeStream.foreachBatch(lambda batch, batch_id: self.merge(batch, batch_id, path) and None)
            .option("checkpointLocation", f"{path}/checkpoint")
            .trigger(availableNow=True).start()
        )

    def table(self) -> DataFrame:
        """The latest row of each key of the latest run."""
        path = self._path()
        rows = self._read(path, self.versions(path)) if path else self.spark.createDataFrame([], self.stored)
        if self.deleted:
            rows = rows.where(~F.coalesce(F.col(f"`{self.deleted}`"), F.lit(False)))
        return rows.drop(BATCH)


def upsert_folder(target: UpsertTarget, folder: str, glob: str | None = None, max_files: int | None = None,
                  full_reload: bool = False) -> DataFrame:
    """Merge all files not merged yet and return the target table."""
    stream = read_table_stream(target.spark, folder, target.schema, glob, max_files)
    target.load(stream, full_reload).awaitTermination()
    return target.table()
