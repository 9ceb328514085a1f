"""Column profiles: NULL share, distinct values, duplicate rows, key sets."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotlake.functions.keys import compact_columns, compact_text
from spotlake.operators.columns import drop_columns, quoted, string_columns
from spotlake.operators.joins import cross_duplicates
from spotlake.shipping import ship

ship(__name__)


def null_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, null_pct) of the string columns, from one pass; NULL percentage on empty input."""
    chosen = columns or string_columns(df)
    rows = F.count(F.lit(1))
    one = df.agg(*[
        F.try_divide(F.lit(100.0) * F.count_if(quoted(c).isNull()), rows).alias(f"_{i}")
        for i, c in enumerate(chosen)
    ])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias("null_pct"))
                      for i, c in enumerate(chosen)])
    return one.select(F.inline(pairs))


def sparse_columns(df: DataFrame, over_pct: float = 30.0, columns: list[str] | None = None) -> list[str]:
    """String columns with strictly more than `over_pct` percent NULLs."""
    return [r["column"] for r in null_profile(df, columns).collect()
            if r["null_pct"] is not None and r["null_pct"] > over_pct]


def drop_sparse_columns(df: DataFrame, over_pct: float = 30.0) -> DataFrame:
    return drop_columns(df, sparse_columns(df, over_pct))


def distinct_profile(df: DataFrame, columns: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """(column, n_distinct) of the string columns; NULL counts as one value.

    The exact count shuffles each distinct value once per column, long values as
    a digest. `approximate` keeps one fixed-size sketch per column instead.
    """
    chosen = columns or string_columns(df)
    types = dict(df.dtypes)
    counts = []
    for i, c in enumerate(chosen):
        value = compact_text(quoted(c)) if types[c] == "string" else quoted(c)
        n = F.approx_count_distinct(quoted(c)) if approximate else F.count_distinct(value)
        has_null = F.coalesce(F.max(quoted(c).isNull().cast("int")), F.lit(0))
        counts.append((n + has_null).cast("bigint").alias(f"_{i}"))
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias("n_distinct"))
                      for i, c in enumerate(chosen)])
    return df.agg(*counts).select(F.inline(pairs))


def duplicate_rows(df: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    """One row: all rows, and how many of them repeat an earlier row.

    NULLs are equal; `exclude` leaves columns such as a row number out.
    """
    left_out = set(exclude or [])
    chosen = [c for c in df.columns if c not in left_out]
    compact = df.select(*[c.alias(f"_{i}") for i, c in enumerate(compact_columns(df, chosen))])
    groups = compact.groupBy(*compact.columns).agg(F.count(F.lit(1)).alias("_n"))
    zero = F.lit(0).cast("bigint")
    return groups.agg(
        F.coalesce(F.sum("_n"), zero).alias("n_rows"),
        F.coalesce(F.sum(F.col("_n") - 1), zero).alias("duplicates"),
    )


def key_sets(records: DataFrame, json_col: str) -> DataFrame:
    """(keys, n): the sets of top-level keys of JSON object texts and how often each occurs."""
    keys = F.array_join(F.array_sort(F.json_object_keys(quoted(json_col))), ",")
    return records.select(keys.alias("keys")).groupBy("keys").agg(F.count(F.lit(1)).alias("n"))


def has_one_key_set(records: DataFrame, json_col: str) -> bool:
    """Whether all records have the same keys; true for no records."""
    return len(key_sets(records, json_col).limit(2).collect()) <= 1


def schema_paths(schema: str) -> list[str]:
    """The paths of a variant schema in order: `a.b` for a key in an object, `[]` for the items of an array.

    Keys that hold a dot, a bracket or a back quote stand in back quotes.
    """
    found, at = set(), 0

    def name() -> str:
        nonlocal at
        if schema[at] != "`":
            end = schema.index(":", at)
            key, at = schema[at:end], end
            return key
        key, at = "", at + 1
        while schema[at] != "`" or schema[at:at + 2] == "``":
            step = 2 if schema[at] == "`" else 1
            key, at = key + schema[at], at + step
        at += 1
        return "`" + key.replace("`", "``") + "`" if any(c in key for c in ".[]`") else key

    def walk(path: str) -> None:
        nonlocal at
        if schema.startswith("OBJECT<", at):
            at += 7
            while schema[at] != ">":
                child = f"{path}.{name()}" if path else name()
                found.add(child)
                at += 2
                walk(child)
                at += 2 if schema.startswith(", ", at) else 0
            at += 1
        elif schema.startswith("ARRAY<", at):
            at += 6
            found.add(path + "[]")
            walk(path + "[]")
            at += 1
        else:
            # A plain type, perhaps with digits in parentheses.
            while at < len(schema) and schema[at] not in ",>":
                at = schema.index(")", at) if schema[at] == "(" else at
                at += 1

    walk("")
    return sorted(found)


def nested_key_sets(records: DataFrame, json_col: str) -> DataFrame:
    """(paths, n): the sets of paths of JSON texts, at any depth, and how often each occurs.

    The items of an array count as one. Text that is not JSON has a NULL set, a plain
    value an empty one. Schemas are counted before they are read as paths, so each is read once.
    """
    def paths(batches):
        for batch in batches:
            sets = [None if s is None else ",".join(schema_paths(s)) for s in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(sets, pa.string()), batch.column(1)], ["paths", "n"])

    schema = F.schema_of_variant(F.try_parse_json(quoted(json_col)))
    # Types differ where keys do not: numbers of other lengths, or NULLs.
    plain = F.regexp_replace(schema, r"(?<=: |ARRAY<)(?:DECIMAL\([0-9,]+\)|BIGINT|DOUBLE|STRING|BOOLEAN|VOID)", "VALUE")
    counted = records.select(plain.alias("schema")).groupBy("schema").agg(F.count(F.lit(1)).alias("n"))
    return counted.mapInArrow(paths, "paths string, n long").groupBy("paths").agg(F.sum("n").alias("n"))


def summary_of_reports(
    first: DataFrame, second: DataFrame, first_keys: list[str], second_keys: list[str],
    exclude: list[str] | None = None,
) -> DataFrame:
    """Reconciliation report: rows of each family, repeated rows inside each, pairs across."""
    def lines(one_row: DataFrame, **metrics: str) -> DataFrame:
        return one_row.select(F.inline(F.array(*[
            F.struct(F.lit(metric).alias("metric"), quoted(column).cast("decimal(38,0)").alias("value"))
            for metric, column in metrics.items()])))

    across = cross_duplicates(first, second, first_keys, second_keys)
    return (
        lines(duplicate_rows(first, exclude), first_rows="n_rows", first_duplicates="duplicates")
        .unionAll(lines(duplicate_rows(second, exclude), second_rows="n_rows", second_duplicates="duplicates"))
        .unionAll(lines(across, cross_pairs="pairs", second_rows_matched="second_rows"))
    )
