"""Report tables over airings joined with their spots.

`Airings` names the columns a report needs, so the same reports run on any
table of airings. Every report counts once and works on the small counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotlake.operators.aggregates import (
    category_values, histogram, joined_group_count, matrix_by_total, pivot_counts, top_matrix, with_share,
)
from spotlake.operators.columns import quoted
from spotlake.operators.joins import join_spots
from spotlake.operators.quantiles import box_plot
from spotlake.sources.scratch import materialise


@dataclass(frozen=True)
class Airings:
    """Airings and spots with the columns that link them."""

    airings: DataFrame
    spots: DataFrame
    airing_key: str = "MATERIAL"
    spot_key: str = "titulo"
    party: str = "partido"

    def counts(self, by: list[str] | None = None, party: bool = True) -> DataFrame:
        """Airings of known spots per airing columns and, by default, party."""
        groups = by or []
        spots = self.spots.select(quoted(self.spot_key), *([quoted(self.party)] if party else []))
        return joined_group_count(
            self.airings.select(quoted(self.airing_key), *[quoted(c) for c in groups]), spots,
            self.airing_key, self.spot_key, groups, [self.party] if party else [])

    def with_column(self, name: str, value: Column) -> Airings:
        return Airings(self.airings.withColumn(name, value), self.spots, self.airing_key, self.spot_key, self.party)


def _with_parties(counts: DataFrame, party: str, values: list[str] | None) -> tuple[DataFrame, list[str]]:
    """Counts and the matrix columns; columns found in the data need the counts twice, so these are written once."""
    if values is not None:
        return counts, values
    kept = materialise(counts, "counts")
    return kept, category_values(kept, party)


def party_share(a: Airings) -> DataFrame:
    """(party, n, share_pct)."""
    return with_share(a.counts())


def airings_per_date(a: Airings, date_col: str) -> DataFrame:
    """Counts per date in date order."""
    return a.counts([date_col], party=False).orderBy(quoted(date_col))


def airings_per_hour(a: Airings, hour: Column) -> DataFrame:
    """Counts per hour; hours without airings have no row."""
    return a.with_column("HORA", hour).counts(["HORA"], party=False).orderBy("HORA")


def airings_per_month_hour(a: Airings, month: Column, hour: Column) -> DataFrame:
    return (
        a.with_column("MES", month).with_column("HORA", hour).counts(["MES", "HORA"], party=False)
        .orderBy("MES", "HORA")
    )


def month_line(per_month_hour: DataFrame, month: int) -> DataFrame:
    """The hours of one month: one line of the month chart."""
    return per_month_hour.where(F.col("MES") == month)


def top_states_by_party(a: Airings, state: str, k: int = 10, parties: list[str] | None = None) -> DataFrame:
    """Party matrix of the k states with most airings, in falling order of their total."""
    counts, values = _with_parties(a.counts([state]), a.party, parties)
    return top_matrix(counts, state, a.party, values, k)


def states_by_party(a: Airings, state: str, parties: list[str] | None = None) -> DataFrame:
    """Party matrix of all states, in falling order of their total."""
    counts, values = _with_parties(a.counts([state]), a.party, parties)
    return matrix_by_total(counts, state, a.party, values)


def media_by_party(a: Airings, medium: str, parties: list[str] | None = None) -> DataFrame:
    """Party matrix of all media, in name order."""
    counts, values = _with_parties(a.counts([medium]), a.party, parties)
    return pivot_counts(counts, medium, a.party, values).orderBy(quoted(medium))


def weighted_scores(a: Airings, scores: DataFrame, score: str) -> DataFrame:
    """(party, score) with one row per airing of a scored spot."""
    scored = a.spots.select(quoted(a.spot_key), quoted(a.party)).join(scores, a.spot_key)
    # Written once: the airings join is then planned by the real size of the scored spots.
    spots = materialise(scored, "scored_spots")
    return join_spots(a.airings.select(quoted(a.airing_key)), spots, a.airing_key, a.spot_key).select(
        quoted(a.party), quoted(score))


def score_histogram(scores: DataFrame, score: str, bins: int = 20) -> DataFrame:
    return histogram(scores, score, bins)


def score_box_plot(scores: DataFrame, party: str, score: str, parties: list[str]) -> DataFrame:
    """Box-plot figures of the chosen parties."""
    return box_plot(scores.where(quoted(party).isin(parties)), party, score)
