from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from spotlake.functions import dates as D
from spotlake.functions import names as N
from spotlake.functions.keys import bucket_of, compact_columns, compact_text
from spotlake.functions.text import word_tokens


def values(df, column):
    return [r[column] for r in df.select(column).collect()]


def one(spark, text, expression):
    return spark.createDataFrame([(text,)], "t string").select(expression.alias("r")).first()["r"]


@pytest.mark.parametrize("text, day_first, expected", [
    ("05/11/2023", True, "2023-11-05"),
    ("05/11/2023", False, "2023-05-11"),
    ("15/11/2023", False, "2023-11-15"),
    ("2023-11-05", True, "2023-11-05"),
    ("2023-11-05", False, "2023-11-05"),
    ("5/1/2023", True, "2023-01-05"),
    ("31/02/2023", True, None),
    ("13/13/2023", False, None),
    ("5T/11/2023", True, None),
    ("2023-11-5T", True, None),
    ("12023-1-05", True, None),
    ("05-11-2023", True, "2023-11-05"),
    ("15-11-2023", False, "2023-11-15"),
    ("2023-11-15 00:00:00", True, "2023-11-15"),
    ("2023-11-15T07:00:00", True, "2023-11-15"),
    ("05/11/2023 07:00", False, "2023-05-11"),
    ("05/11/23", True, "2023-11-05"),
    ("05/11/69", True, "1969-11-05"),
    ("2023/11/15", True, "2023-11-15"),
    ("2023/1/5", False, "2023-01-05"),
    ("15.11.2023", True, "2023-11-15"),
    (" 15/11/2023 ", True, "2023-11-15"),
    ("15/11/2023 tarde", True, None),
    ("15/11/023", True, None),
    ("31/12/2023", False, "2023-12-31"),
    ("32/13/2023", False, None),
    ("15 Nov 2023", True, "2023-11-15"),
    ("15-nov-2023", False, "2023-11-15"),
    ("5 NOVEMBER 23", True, "2023-11-05"),
    ("5.sept.2023 07:00 PM", True, "2023-09-05"),
    ("May 5, 2023", False, "2023-05-05"),
    ("November 15 2023 7:00:01.5", True, "2023-11-15"),
    ("15 Novem 2023", True, None),
    ("31 Nov 2023", True, None),
    ("15 ene 2023", True, None),
    ("20231115", True, "2023-11-15"),
    ("20231315", True, None),
    ("202311", True, None),
    ("2023-11-15 07:00 pm", True, "2023-11-15"),
    ("S/D", True, None),
    ("", True, None),
    (None, True, None),
])
def test_mixed_date(spark, text, day_first, expected):
    got = one(spark, text, D.mixed_date("t", day_first).cast("string"))
    assert got == expected


@pytest.mark.parametrize("text, clock, hour", [
    ("07:05:09", "07:05:09", 7), ("7:5:9", "07:05:09", 7), ("23:59:59", "23:59:59", 23),
    ("24:00:00", None, None), ("25:61:00", None, None), ("S/D", None, None), (None, None, None),
    ("07:05:0x", None, None), ("07:05", "07:05:00", 7), ("aa:bb:c1", None, None), (" 7:05 ", "07:05:00", 7),
    ("1900-01-01 07:00:00", "07:00:00", 7), ("2023-11-15T23:59", "23:59:00", 23), ("07:05:09.25", "07:05:09", 7), ("24:00", None, None),
    ("07:00 PM", "19:00:00", 19), ("12:05am", "00:05:00", 0), ("12:05 p.m.", "12:05:00", 12), ("0:05 am", None, None), ("13:00 PM", None, None),
    ("7 pm", "19:00:00", 19), ("7", None, None), ("070000", "07:00:00", 7), ("256100", None, None), ("15/11/2023 7:05 PM", "19:05:00", 19),
])
def test_clock(spark, text, clock, hour):
    assert one(spark, text, D.clock_text("t")) == clock
    assert one(spark, text, D.clock_hour("t")) == hour


def test_strict_mixed_date_fails(spark):
    assert str(one(spark, "15-11-2023", D.mixed_date("t", strict=True))) == "2023-11-15"
    assert one(spark, None, D.mixed_date("t", strict=True)) is None
    with pytest.raises(Exception, match="not a date: S/D"):
        one(spark, "S/D", D.mixed_date("t", strict=True))


def test_airing_timestamp_is_lenient(spark):
    df = spark.createDataFrame([("05/11/2023", "07:14:41"), ("2023-11-05", "07:14:41"), ("05/11/2023", None), ("x", "y")],
                               "d string, h string")
    got = values(df.select(D.airing_timestamp("d", "h").cast("string").alias("r")), "r")
    assert got == ["2023-11-05 07:14:41", None, None, None]


def test_strict_date_fails_on_other_formats(spark):
    assert str(one(spark, "2023-11-05", D.strict_date("t"))) == "2023-11-05"
    with pytest.raises(Exception, match="CANNOT_PARSE_TIMESTAMP|DATETIME|parse"):
        one(spark, "05/11/2023", D.strict_date("t"))


def test_standardize_keeps_rows_and_names(spark):
    df = spark.createDataFrame([("05/11/2023", "7:00:00", 1), ("bad", "bad", 2)], "`FECHA TRANSMISIÓN` string, h string, k int")
    got = D.standardize_datetime(df, "FECHA TRANSMISIÓN", "h")
    assert got.columns == df.columns
    assert [tuple(r) for r in got.orderBy("k").collect()] == [("2023-11-05", "07:00:00", 1), (None, None, 2)]


def test_date_dimension(spark):
    dim = D.date_dimension(spark, "2023-10-01", "2024-05-17")
    assert dim.count() == 230
    first = dim.orderBy("date").first()
    assert (first.year, first.quarter, first.month, first.day, first.day_of_week) == (2023, 4, 10, 1, 1)
    assert first.date_key == first.date
    empty = spark.createDataFrame([], "d date")
    assert D.date_dimension_for(empty, "d").count() == 0


@pytest.mark.parametrize("key, actor, medium", [
    ("MORENA_radio", "MORENA", "radio"), ("partido_verde_tv", "partido_verde", "tv"), ("solo", "solo", "solo"),
])
def test_catalogue_key(spark, key, actor, medium):
    assert one(spark, key, N.actor_of("t")) == actor
    assert one(spark, key, N.medium_of("t")) == medium


@pytest.mark.parametrize("path, stem, ext, ident, inner, audio", [
    ("tv/MORENA/RV1.mp4", "RV1", ".mp4", "RV1", "MORENA", "audios/MORENA/RV1.mp3"),
    ("tv/a/b/x.tar.gz", "x.tar", ".gz", "x", "a/b", "audios/a/b/x.tar.mp3"),
    ("tv/a/none", "none", "", "none", "a", "audios/a/none.mp3"),
    ("tv/.hidden", ".hidden", "", "", "", "audios//.hidden.mp3"),
])
def test_paths(spark, path, stem, ext, ident, inner, audio):
    assert one(spark, path, N.file_stem("t")) == stem
    assert one(spark, path, N.file_extension("t")) == ext
    assert one(spark, path, N.file_id("t")) == ident
    assert one(spark, path, N.inner_directory("t")) == inner
    assert one(spark, path, N.audio_path("t")) == audio


def test_period(spark):
    text = "Periodo: 15/11/2023 al 21/11/2023"
    assert one(spark, text, N.period_bound("t", 1)) == "15_11_2023"
    assert one(spark, text, N.period_bound("t", 2)) == "21_11_2023"
    assert one(spark, text, N.period_file_name("Excedentes", "t")) == "Excedentes_15_11_2023_21_11_2023.csv"
    assert one(spark, "sin periodo", N.period_bound("t", 1)) is None
    assert one(spark, "sin periodo", N.period_file_name("Excedentes", "t")) is None
    assert str(one(spark, "Excedentes_15_11_2023_21_11_2023.csv", N.file_period("t", 2))) == "2023-11-21"
    assert one(spark, "Excedentes.csv", N.file_period("t", 1)) is None
    assert one(spark, "Excedentes_1.xlsx", N.with_extension("t", ".xlsx", ".csv")) == "Excedentes_1.csv"


def test_tokens_are_ascii_words_by_default(spark):
    assert one(spark, "¿Qué es? ¡Año 2024!", word_tokens("t")) == ["qu", "es", "a", "o", "2024"]
    assert one(spark, "¿Qué es? ¡Año 2024!", word_tokens("t", unicode_words=True)) == ["qué", "es", "año", "2024"]
    assert one(spark, "", word_tokens("t")) == []
    assert one(spark, None, word_tokens("t")) is None


def test_compact_text_is_a_digest(spark):
    rows = [("a",), ("x" * 65,), ("x" * 65,), (None,)]
    got = values(spark.createDataFrame(rows, "t string").select(compact_text(F.col("t")).alias("c")), "c")
    assert got[1] == got[2] != got[0] and got[3] is None and len(got[0]) == 64


def test_rows_are_compared_by_short_texts_as_they_are(spark):
    digest = hashlib.sha256(b"x" * 65).hexdigest()
    df = spark.createDataFrame([("a",), ("x" * 65,), (digest,), ("y" * 63,), ("é" * 32,), (None,)], "t string")
    got = values(df.select(*compact_columns(df)), "t")
    assert got[0] == "a" and got[1] == digest and got[3] == "y" * 63 and got[5] is None
    # No two texts come out equal, a digest and a text that looks like one included.
    assert len(set(got)) == 6 and len(got[4]) == 64


def test_bucket_is_stable_and_spread(spark):
    df = spark.range(1000).select(bucket_of("id", 10).alias("b"))
    counts = dict(df.groupBy("b").count().collect())
    assert set(counts) == set(range(10)) and min(counts.values()) > 60
    assert one(spark, "abc", bucket_of("t")) == int("90015098", 16) % 100
