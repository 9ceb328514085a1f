"""Expressions over catalogue keys, file paths and report names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def medium_of(key: Column | str) -> Column:
    """Part of a catalogue key after its last underscore."""
    return F.substring_index(_col(key), "_", -1)


def actor_of(key: Column | str) -> Column:
    """Part of a catalogue key before its last underscore; the whole key if it has none."""
    return F.regexp_replace(_col(key), r"_[^_]*$", "")


def file_name(path: Column | str) -> Column:
    return F.substring_index(_col(path), "/", -1)


def file_stem(path: Column | str) -> Column:
    """File name without its last extension; a leading dot is part of the stem."""
    return F.regexp_replace(file_name(path), r"(?<=[^.])\.[^.]*$", "")


def file_extension(path: Column | str) -> Column:
    """Last extension with its dot, empty if there is none."""
    return F.regexp_extract(file_name(path), r"[^.](\.[^.]*)$", 1)


def file_id(path: Column | str) -> Column:
    """File name up to its first dot: the identifier that names the spot."""
    return F.substring_index(file_name(path), ".", 1)


def inner_directory(path: Column | str) -> Column:
    """Directory part between the first and the last slash, empty if there is none."""
    return F.regexp_extract(_col(path), r"^[^/]*/(.*)/[^/]*$", 1)


def audio_path(video_path: Column | str, base: str = "audios") -> Column:
    """Where the audio track of a video belongs: same inner directory and stem, `.mp3`."""
    return F.concat(F.lit(f"{base}/"), inner_directory(video_path), F.lit("/"), file_stem(video_path), F.lit(".mp3"))


def with_extension(path: Column | str, old: str, new: str) -> Column:
    """Path with every `old` text replaced by `new`, such as `.xlsx` by `.csv`."""
    return F.replace(_col(path), F.lit(old), F.lit(new))


# Fixed value: wording of the reporting period inside report headers.
PERIOD_PATTERN = r"(\d{2}/\d{2}/\d{4}) al (\d{2}/\d{2}/\d{4})"


def period_bound(text: Column | str, which: int) -> Column:
    """Start (1) or end (2) of a period text, as `dd_MM_yyyy`; NULL without a period."""
    return F.nullif(F.translate(F.regexp_extract(_col(text), PERIOD_PATTERN, which), "/", "_"), F.lit(""))


def period_file_name(family: str, text: Column | str, extension: str = ".csv") -> Column:
    """Report file name built from a period text; NULL without a period."""
    return F.concat(F.lit(f"{family}_"), period_bound(text, 1), F.lit("_"), period_bound(text, 2), F.lit(extension))


def file_period(name: Column | str, which: int) -> Column:
    """Start (1) or end (2) date encoded in a report file name, NULL if there is none."""
    return F.try_to_date(F.regexp_extract(_col(name), r"_(\d{2}_\d{2}_\d{4})_(\d{2}_\d{2}_\d{4})", which), "dd_MM_yyyy")
