"""From report files of both families to one transmissions table."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotlake import schemas
from spotlake.functions.dates import mixed_date, standardize_datetime, strict_date
from spotlake.operators.columns import first_of_each_name, quoted, rename_columns
from spotlake.operators.joins import remove_cross_duplicates
from spotlake.operators.profile import summary_of_reports
from spotlake.operators.sets import outer_union, sort_nulls_last
from spotlake.sources.readers import any_file, read_family, read_report_with_preamble
from spotlake.sources.writers import write_csv

DATE, TIME = "FECHA TRANSMISIÓN", "HORA TRANSMISIÓN"
REQ_DATE, REQ_TIME = "Fecha de transmisión del material", "Hora transmisión"


def combine_excedentes(reports: DataFrame) -> DataFrame:
    """Excedentes with ISO date text; a date in another format fails the query."""
    return reports.withColumns({
        DATE: strict_date(quoted(DATE)).cast("string"),
        TIME: F.date_format(F.to_timestamp(quoted(TIME), "HH:mm:ss"), "HH:mm:ss"),
    })


def combine_requerimientos(reports: DataFrame, day_first: bool = True, strict: bool = False) -> DataFrame:
    """Requerimientos with ISO date text, whichever way a date was written; with `strict` unreadable text fails the query."""
    return reports.withColumn(REQ_DATE, mixed_date(quoted(REQ_DATE), day_first, strict).cast("string"))


def sort_report(reports: DataFrame, keys: list[str]) -> DataFrame:
    """By date and time, NULLs last; the row number breaks ties and spreads a busy minute."""
    return sort_nulls_last(reports, keys, tie_break=["No."] if "No." in reports.columns else None)


def unify(excedentes: DataFrame, requerimientos: DataFrame) -> DataFrame:
    """Requerimientos that repeat no Excedente, under Excedentes names, appended to the Excedentes."""
    fresh = remove_cross_duplicates(
        excedentes, requerimientos, schemas.EXCEDENTES_KEYS, schemas.REQUERIMIENTOS_KEYS)
    renamed = first_of_each_name(rename_columns(fresh, schemas.REQUERIMIENTOS_TO_EXCEDENTES))
    return outer_union(
        standardize_datetime(first_of_each_name(excedentes), DATE, TIME),
        standardize_datetime(renamed, DATE, TIME),
    )


def clean_reports(
    excedentes: DataFrame, requerimientos: DataFrame, day_first: bool = True, strict: bool = False
) -> DataFrame:
    """Whole cleaning job as one lazy plan: parse, drop cross duplicates, rename, union."""
    return unify(combine_excedentes(excedentes), combine_requerimientos(requerimientos, day_first, strict))


def write_clean_reports(
    excedentes: DataFrame, requerimientos: DataFrame, path: str, day_first: bool = True, strict: bool = False
) -> None:
    """The cleaning job with its result written: both families in one CSV report, sorted by date and time."""
    write_csv(sort_report(clean_reports(excedentes, requerimientos, day_first, strict), [DATE, TIME]), path)


def reconciliation(excedentes: DataFrame, requerimientos: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    """Counts of both families after date parsing, before anything is removed."""
    return summary_of_reports(
        combine_excedentes(excedentes), combine_requerimientos(requerimientos),
        schemas.EXCEDENTES_KEYS, schemas.REQUERIMIENTOS_KEYS, exclude)


# Cleaned header names and their names in the combined table.
_TABLE_NAMES = {
    "No.": "No", "VERSIÓN": "VERSION", "TIPO ACTOR": "TIPO_ACTOR", DATE: "FECHA_TRANSMISION",
    TIME: "HORA_TRANSMISION", "CALIFICACIÓN": "CALIFICACION", "NOMBRE CONCESIONARIO": "NOMBRE_CONCESIONARIO",
    "TIPO CONCESIÓN": "TIPO_CONCESION", "NOMBRE DE ESTACIÓN": "NOMBRE_DE_ESTACIÓN", "TIPO MEDIO": "TIPO_MEDIO",
    "MEDIO (RADIO/TELEVISIÓN)": "MEDIO2",
}


def as_transmissions(unified: DataFrame) -> DataFrame:
    """Combined table with its column order and a typed `Timestamp`."""
    named = rename_columns(unified, _TABLE_NAMES)
    present = set(named.columns)
    columns = [
        (F.col(c) if c in present else F.lit(None).cast("string").alias(c)) for c in schemas.TRANSMISSIONS_COLUMNS
    ]
    at = F.concat(F.col("FECHA_TRANSMISION"), F.lit(" "), F.col("HORA_TRANSMISION")).try_cast("timestamp")
    return named.select(*columns).withColumn("Timestamp", at)


FAMILIES = ("Excedentes_", "Requerimientos_")


@dataclass(frozen=True)
class ReportFolder:
    """A folder of report files, routed to the two families by file-name prefix.

    `both` says what a family without a file is to a reader: `notice` warns and goes
    on with an empty table, `error` fails, `silent` goes on.
    """

    path: str
    preamble: bool = False
    both: str = "notice"

    def missing(self, spark: SparkSession) -> list[str]:
        """The prefixes of the families that have no file."""
        return [prefix for prefix in FAMILIES if not any_file(spark, self.path, f"{prefix}*.csv")]

    def read(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """(excedentes, requerimientos); an absent family is an empty table, which the caller is told."""
        if self.both != "silent" and (missing := self.missing(spark)):
            notice = f"no report {' and no report '.join(p + '*.csv' for p in missing)} in {self.path}"
            if self.both == "error":
                raise FileNotFoundError(notice)
            warnings.warn(notice, stacklevel=2)

        def family(prefix: str, schema, skip: int) -> DataFrame:
            if self.preamble and any_file(spark, self.path, f"{prefix}*.csv"):
                return read_report_with_preamble(spark, f"{self.path.rstrip('/')}/{prefix}*.csv", schema, skip)
            return read_family(spark, self.path, prefix, schema)

        return (
            family(FAMILIES[0], schemas.EXCEDENTES, schemas.EXCEDENTES_PREAMBLE),
            family(FAMILIES[1], schemas.REQUERIMIENTOS, schemas.REQUERIMIENTOS_PREAMBLE),
        )


def clean_folder(spark: SparkSession, folder: ReportFolder, day_first: bool = True) -> DataFrame:
    """Transmissions table of a report folder."""
    return as_transmissions(clean_reports(*folder.read(spark), day_first))
