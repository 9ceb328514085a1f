"""Column-level transforms: rename, drop, cast, audit."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotlake.functions.names import medium_of


def quoted(name: str) -> Column:
    """Column by literal name, whatever dots or blanks the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def string_columns(df: DataFrame) -> list[str]:
    return [name for name, kind in df.dtypes if kind == "string"]


def drop_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Drop by name; names that are not present are ignored."""
    doomed = set(names)
    return df.select([quoted(c) for c in df.columns if c not in doomed])


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename by exact name; names that are not present are ignored."""
    return df.toDF(*[mapping.get(c, c) for c in df.columns])


def first_of_each_name(df: DataFrame) -> DataFrame:
    """Keep the first column of every name, comparing names the way the session does."""
    sensitive = df.sparkSession.conf.get("spark.sql.caseSensitive", "false") == "true"
    seen: set[str] = set()
    keep = []
    for position, name in enumerate(df.columns):
        folded = name if sensitive else name.lower()
        if folded not in seen:
            seen.add(folded)
            keep.append((position, name))
    by_position = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return by_position.select([F.col(f"_{i}").alias(name) for i, name in keep])


def as_text(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Cast the named columns to string; NULL stays NULL."""
    return df.withColumns({n: quoted(n).cast("string") for n in names})


# Fixed value: the name of the load-time column.
LOAD_TIME = "Silver_Loadedtimestamp"


def with_load_time(df: DataFrame, name: str = LOAD_TIME) -> DataFrame:
    return df.withColumn(name, F.current_timestamp())


def with_spot_labels(df: DataFrame, key: str, party: str, version: str) -> DataFrame:
    """Add directory (`medium/party`), party and name to flattened catalogue rows."""
    return df.withColumns({
        "directorio": F.concat_ws("/", medium_of(key), quoted(party)),
        "partido": quoted(party),
        "nombre": quoted(version),
    })
