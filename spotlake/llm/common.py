"""Small helpers the training-data operators share."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spotlake.sources.scratch import materialise

# Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def ship(module: str) -> None:
    """Send the functions of `module` to the executors by value, so that they need not have it installed."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def _is_plain_scan(df: DataFrame) -> bool:
    """Whether `df` is one read of different files with nothing but filters and column selections: a row of it is a row of a file."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    if plan.nodeName() != "LogicalRelation" or "HadoopFsRelation" not in plan.relation().getClass().getName():
        return False
    paths = plan.relation().location().rootPaths()
    return paths.distinct().size() == paths.size()


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """All columns plus a row key under an unused name; the key of a row never changes.

    `doc_id` may be null or repeated, so rows are told apart by their place: the
    file and the row in it where `docs` is a plain read of Parquet files, else a
    number that is written with a copy of the table. Content comes before place in
    the key, so of rows that tie in everything an operator reads the same one is
    first in every run, unless they are equal in all columns.
    """
    taken = {c.lower() for c in docs.columns}
    name = next(n for n in ("_row", *(f"_row{i}" for i in range(len(taken) + 1))) if n not in taken)
    hashable = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    content = F.unhex(F.lpad(F.hex(F.xxhash64(*hashable) if hashable else F.lit(0)), 16, "0"))
    if _is_plain_scan(docs):
        place = F.unhex(F.md5(F.concat_ws(":", "_metadata.row_index", "_metadata.file_path")))
        try:
            return docs.select("*", F.concat(content, place).alias(name)), name
        except AnalysisException:
            # Files of another format have no row index.
            pass
    number = F.unhex(F.lpad(F.hex(F.monotonically_increasing_id()), 16, "0"))
    return materialise(docs.withColumn(name, F.concat(content, number)), "numbered"), name


def row_number_column(row_col: str | None) -> Column:
    """The caller's row key, else a new number; the caller must write the result before using it twice."""
    return F.col(f"`{row_col}`") if row_col else F.monotonically_increasing_id()


def type_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def held_out(id_col: str = "doc_id") -> Column:
    """True for the third of documents whose CRC-32 of the id leaves 1; nothing is learned from them."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 3 == 1, F.lit(False))
