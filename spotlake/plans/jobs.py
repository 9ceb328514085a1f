"""Whole jobs: from report files to one written report, and from a table to joined airings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from spotlake.operators.columns import drop_columns
from spotlake.operators.joins import join_spots
from spotlake.operators.profile import distinct_profile, null_profile
from spotlake.plans.cleaning import ReportFolder, write_clean_reports
from spotlake.sources.writers import write_external_table
from spotlake.sources.scratch import materialise
from spotlake.streaming.loader import StreamTarget, load_folder


def cleaning_job(spark: SparkSession, folder: ReportFolder, path: str, day_first: bool = True, strict: bool = False) -> None:
    """Report files of both families to one cleaned report, sorted by date and time, at `path`."""
    write_clean_reports(*folder.read(spark), path, day_first, strict)


@dataclass(frozen=True)
class Analysis:
    """What the analysis job leaves: two profiles and the airings of known spots."""

    nulls: DataFrame
    distinct: DataFrame
    airings: DataFrame


def analysis_job(
    spark: SparkSession, transmissions: DataFrame, spots: DataFrame, base: str, source: str, target: str,
    row_number: str = "No", over_pct: float = 30.0, airing_key: str = "MATERIAL", spot_key: str = "titulo",
) -> Analysis:
    """Profile airings, drop sparse columns and the row number, write the table `source`, stream it into the table
    `target`, and join that with the spots.

    `base` is a folder of the job; a later run on the same folder loads what is new.
    """
    nulls = materialise(null_profile(transmissions), "null-profile")
    sparse = [r["column"] for r in nulls.collect() if r["null_pct"] is not None and r["null_pct"] > over_pct]
    kept = drop_columns(transmissions, [*sparse, row_number])
    write_external_table(kept, source, f"{base}/{source}")
    loaded = StreamTarget(spark, f"{base}/{target}", kept.schema)
    load_folder(spark, f"{base}/{source}", kept.schema, loaded)
    loaded.register(target)
    airings = spark.sql(f"SELECT * FROM {target}")
    return Analysis(nulls, distinct_profile(kept), join_spots(airings, spots, airing_key, spot_key))
