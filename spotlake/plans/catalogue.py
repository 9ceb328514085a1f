"""Spot catalogue jobs: work list, order index, transcripts, pending audio."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotlake.functions.names import audio_path, file_id, file_name
from spotlake.operators.aggregates import last_value, merge_latest
from spotlake.operators.joins import append_all, append_new, lookup_enrich, pending
from spotlake.operators.nested import CATALOGUE_ORDER, flatten_catalogue, spot_records


def work_list(catalogue: DataFrame, ignored_actors: list[str] | None = None) -> DataFrame:
    return flatten_catalogue(catalogue, ignored_actors)


def order_index(flat: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """(folio, cautelar): the last flag of each folio in catalogue order, over an older index if given."""
    new = last_value(flat.where(F.col("folio").isNotNull()), "folio", "cautelar", CATALOGUE_ORDER)
    return new if old is None else merge_latest(old, new, "folio", "cautelar")


def with_transcripts(flat: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Spot records whose title has a transcript, with the transcript added."""
    return lookup_enrich(spot_records(flat), transcripts, "titulo")


def extend_records(existing: DataFrame, flat: DataFrame, transcripts: DataFrame, repeat: bool = False) -> DataFrame:
    """Stored spot records and the newly transcribed ones; `repeat` keeps titles already stored."""
    fresh = with_transcripts(flat, transcripts)
    return append_all(existing, fresh) if repeat else append_new(existing, fresh, "titulo")


def with_download_paths(flat: DataFrame, base: str = "audios") -> DataFrame:
    """Flattened rows with `target`, where the spot file goes, and `audio`, where its audio track belongs."""
    rows = flat.withColumn("target", F.concat_ws("/", "directorio", file_name("folio")))
    return rows.withColumn("audio", audio_path("target", base))


def downloads(flat: DataFrame, base: str = "audios") -> DataFrame:
    """(folio, target, audio) of the spots that have a file."""
    return with_download_paths(flat.where(F.col("folio").isNotNull()), base).select("folio", "target", "audio")


def pending_audio(listing: DataFrame, index: DataFrame, only_ids: DataFrame | None = None) -> DataFrame:
    """Listed files whose path is not in the transcription index, optionally of listed identifiers."""
    todo = pending(listing, index, "path")
    if only_ids is None:
        return todo
    wanted = only_ids.select(F.col("id").alias("_id")).distinct()
    return todo.withColumn("_id", file_id("path")).join(wanted, "_id", "left_semi").drop("_id")


def transcripts_from_index(index: DataFrame) -> DataFrame:
    """Transcription index (path, text) as transcripts (titulo, transcripcion).

    The file name gives the title; where files share one, the last path counts.
    """
    titled = index.select(file_id("path").alias("titulo"), "path", "text")
    return titled.groupBy("titulo").agg(F.max_by("text", "path").alias("transcripcion"))
