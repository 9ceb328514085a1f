"""Stream a table folder into a target table.

Layout of a target: `<base>/run=<k>/checkpoint` and `<base>/run=<k>/data`. A full
reload starts the next run with a fresh checkpoint and leaves the old one alone;
an incremental load goes on with the latest run. `upsert` keeps the latest row
of each key instead of all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from spotlake.operators.aggregates import latest_rows
from spotlake.operators.columns import LOAD_TIME, with_load_time
from spotlake.sources import writers
from spotlake.sources.readers import read_if_present

BATCH = "batch_id"


def runs(spark: SparkSession, base: str) -> list[int]:
    """Numbers of the runs below `base`, ascending."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/run=*")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    return sorted(int(status.getPath().getName()[4:]) for status in (found or []))


def run_path(base: str, number: int) -> str:
    return f"{base}/run={number}"


def read_table_stream(
    spark: SparkSession, folder: str, schema: T.StructType, glob: str | None = None, max_files: int | None = None
) -> DataFrame:
    """Stream of the Parquet files in a folder; files that appear later are picked up."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


@dataclass(frozen=True)
class StreamTarget:
    """Target table of a load; `mode` is `append` or `overwrite`.

    `append` writes each batch to its own folder, so a batch that is run again
    replaces itself and no batch is lost. `overwrite` replaces the table with
    every batch, so after several batches only the last one is left; each batch is
    written next to the one before it, which readers see until it is complete. Rows
    carry the time they were loaded unless `load_time` is off.
    """

    spark: SparkSession
    base: str
    schema: T.StructType
    mode: str = "append"
    load_time: bool = True

    def runs(self) -> list[int]:
        return runs(self.spark, self.base)

    def _run_path(self, number: int) -> str:
        return run_path(self.base, number)

    def _data_path(self) -> str | None:
        """Where the rows of the latest run are; none before the first complete batch of an overwriting load."""
        data = f"{self._run_path(self.runs()[-1])}/data"
        if self.mode == "append":
            return data
        done = writers.versions(self.spark, data)
        return writers.version_path(data, done[-1]) if done else None

    def load(self, stream: DataFrame, full_reload: bool = False) -> StreamingQuery:
        """Start a load of everything available now; await the returned query."""
        done = self.runs()
        number = 0 if not done else done[-1] + 1 if full_reload else done[-1]
        path = self._run_path(number)
        data, mode = f"{path}/data", self.mode
        fields = self.schema.fieldNames()

        def write(batch: DataFrame, batch_id: int) -> None:
            batch = batch.select(*fields, *[c for c in batch.columns if c not in fields])
            if mode == "append":
                batch.write.mode("overwrite").parquet(f"{data}/{BATCH}={batch_id}")
            else:
                writers.write_version(batch, data)

        rows = with_load_time(stream) if self.load_time else stream
        return (
            rows.writeStream.foreachBatch(write)
            .option("checkpointLocation", f"{path}/checkpoint")
            .trigger(availableNow=True).start()
        )

    def table_schema(self) -> T.StructType:
        """The fixed schema, the load time, and in append mode the batch number."""
        fields = list(self.schema.fields)
        if self.load_time:
            fields.append(T.StructField(LOAD_TIME, T.TimestampType()))
        if self.mode == "append":
            fields.append(T.StructField(BATCH, T.LongType()))
        return T.StructType(fields)

    def table(self) -> DataFrame:
        """Rows of the latest run."""
        path = self._data_path() if self.runs() else None
        if path is None:
            return self.spark.createDataFrame([], self.table_schema())
        return read_if_present(self.spark, path, self.table_schema())

    def register(self, name: str) -> DataFrame:
        """What is loaded now as a table of the catalogue; its files stay where they are.

        A table of that name and schema is pointed at the new files, not dropped. It
        does not see later batches by itself: register it again after a load.
        """
        path = self._data_path() if self.runs() else None
        if path is None:
            raise ValueError("nothing has been loaded yet")
        schema = self.table_schema()
        if self.spark.catalog.tableExists(name):
            found = [(f.name, f.dataType) for f in self.spark.table(name).schema.fields]
            if found != [(f.name, f.dataType) for f in schema.fields]:
                raise ValueError(f"the table {name} has another schema")
            if self.mode == "append":
                for row in self.spark.sql(f"SHOW PARTITIONS {name}").collect():
                    self.spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION ({row['partition']})")
            self.spark.sql(f"ALTER TABLE {name} SET LOCATION '{path}'")
        else:
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
            parted = f"PARTITIONED BY ({BATCH})" if self.mode == "append" else ""
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet {parted} LOCATION '{path}'")
        if self.mode == "append":
            self.spark.catalog.recoverPartitions(name)
        self.spark.catalog.refreshTable(name)
        return self.spark.table(name)

    def latest(self, keys: list[str], order: list[str]) -> DataFrame:
        """Last row of each key over all batches, later batches winning: repeated input does no harm."""
        return latest_rows(self.table(), keys, [BATCH, *order]).drop(BATCH)


def load_folder(
    spark: SparkSession, folder: str, schema: T.StructType, target: StreamTarget, glob: str | None = None,
    max_files: int | None = None, full_reload: bool = False,
) -> DataFrame:
    """Load all files not loaded yet and return the target table."""
    stream = read_table_stream(spark, folder, schema, glob, max_files)
    target.load(stream, full_reload).awaitTermination()
    return target.table()
