"""Flattening of the nested spot catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotlake import schemas
from spotlake.functions.names import actor_of
from spotlake.operators.columns import with_spot_labels


# Place of a document: given number, file, place in the file.
_DOCUMENT = ["doc_no", "doc", "part"]


def first_key(entry: str) -> F.Column:
    """First key of a map column."""
    return F.get(F.map_keys(F.col(entry)), F.lit(0))


def flatten_catalogue(catalogue: DataFrame, ignored_actors: list[str] | None = None) -> DataFrame:
    """One row per spot of each catalogue document, in catalogue order.

    Input: `doc_no`, `doc`, `part` and a `catalogue` array of one-key maps. Version `i` of a party is
    paired with its `i`-th folio; a version without a folio keeps NULL folio
    fields. `entry_pos`, `party_pos` and `spot_pos` give the position in the document.
    Everything is row-local: there is no shuffle.
    """
    entries = catalogue.select(*_DOCUMENT, F.posexplode("catalogue").alias("entry_pos", "entry"))
    keyed = entries.select(*_DOCUMENT, "entry_pos", first_key("entry").alias("key"),
                           F.get(F.map_values("entry"), F.lit(0)).alias("parties"))
    if ignored_actors:
        keyed = keyed.where(~actor_of("key").isin(ignored_actors))
    parties = keyed.select(*_DOCUMENT, "entry_pos", "key", F.posexplode("parties").alias("party_pos", "party"))
    spots = parties.select(
        *_DOCUMENT, "entry_pos", "party_pos", "key",
        F.col("party.actor_politico").alias("actor_politico"),
        # Folios beyond the last version are not part of the catalogue walk.
        F.posexplode(F.arrays_zip(
            F.col("party.version").alias("version"),
            F.slice(F.coalesce("party.folio", F.array().cast(schemas.CATALOGUE_PARTY["folio"].dataType)),
                    F.lit(1), F.greatest(F.size("party.version"), F.lit(0))).alias("folio"),
        )).alias("spot_pos", "spot"),
    )
    fields = [F.col(f"spot.folio.{f.name}").alias(f.name) for f in schemas.CATALOGUE_FOLIO.fields]
    flat = spots.select(*_DOCUMENT, "entry_pos", "party_pos", "spot_pos", "key", "actor_politico",
                        F.col("spot.version").alias("version"), *fields)
    return with_spot_labels(flat, "key", "actor_politico", "version")


CATALOGUE_ORDER = [*_DOCUMENT, "entry_pos", "party_pos", "spot_pos"]


def spot_records(flat: DataFrame) -> DataFrame:
    """Flattened rows as spot records, the transcript still missing."""
    names = [f.name for f in schemas.SPOTS.fields if f.name != "transcripcion"]
    return flat.select(*names)
