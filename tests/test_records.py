"""Records across lines and splits, against Python's own readers."""

from __future__ import annotations

import csv
import json
import random

import pytest
from pyspark.sql import types as T

from spotlake.operators.nested import flatten_catalogue
from spotlake.sources import readers, records
from spotlake.sources.records import array_elements, logical_lines


@pytest.fixture
def tiny_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def write_report(path, rng, skip, rows, breaks):
    """A report with a preamble that holds single quotes marks, and fields with commas, quotes and line breaks."""
    fields = [[f"k{i}", "".join(rng.choice(["a", "ñ", ",", '""', " ", *(["\n", "\n\n"] if breaks else [])]) for _ in range(rng.randrange(12)))]
              for i in range(rows)]
    fields = [[k, v.replace('""', '"')] for k, v in fields]
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write("".join(f'title "{i}\n' if i % 2 == 0 else "\n" for i in range(skip)))
        f.write("k,v\n")
        for k, v in fields:
            f.write(k + "," + ('"' + v.replace('"', '\\"') + '"' if v else "") + "\n")
    return [(k, v or None) for k, v in fields]


@pytest.mark.parametrize("skip, breaks", [(0, True), (3, True), (90, True), (3, False)])
def test_quoted_line_breaks_and_long_preambles(spark, tmp_path, tiny_splits, skip, breaks):
    """Files of many splits, a preamble of several splits, records over several splits, a file without rows."""
    rng = random.Random(skip)
    expected = []
    for i, rows in enumerate((150, 0, 1, 40)):
        expected += [(f"f{i}", *r) for r in write_report(tmp_path / f"f{i}.csv", rng, skip, rows, breaks)]
    lines = logical_lines(spark, str(tmp_path), skip)
    assert sum(r["is_header"] for r in lines.collect()) == 4
    schema = T.StructType.fromDDL("k string, v string")
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
    got = readers.read_report_with_preamble(spark, str(tmp_path), schema, skip).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(((k, v) for _, k, v in expected), key=str)


def test_records_equal_the_csv_module(spark, tmp_path, tiny_splits):
    rng = random.Random(5)
    rows = [[rng.choice(["", "x", "a\nb", 'q"q', "\n", "l1\n\nl3,", "long " * 60]) for _ in range(3)] for _ in range(80)]
    with open(tmp_path / "a.csv", "w", newline="") as f:
        csv.writer(f, lineterminator="\n").writerows([["h1", "h\n2", "h3"], *rows])
    got = [r for r in logical_lines(spark, str(tmp_path / "a.csv")).collect()]
    assert [r["value"] for r in got if r["is_header"]] == ['h1,"h\n2",h3']
    read = sorted(tuple(next(csv.reader([r["value"] + "\n"]))) if "\n" not in r["value"] else tuple(next(csv.reader(iter(r["value"].splitlines(True)))))
                  for r in got if not r["is_header"])
    assert read == sorted(map(tuple, rows))


def test_a_quote_that_is_never_closed_is_an_error(spark, tmp_path, tiny_splits):
    (tmp_path / "a.csv").write_text('h\n1\n"2\n' + "3\n" * 500)
    with pytest.raises(ValueError, match="not closed"):
        logical_lines(spark, str(tmp_path), max_lines=100)


def awkward(rng, depth=0):
    """Any JSON value, strings full of what the cutting looks for."""
    kind = rng.randrange(7 if depth < 3 else 4)
    if kind == 0:
        return "".join(rng.choice(['"', "\\", "{", "}", "[", "]", ",", "é", "\n", "a", "\U0001f600"]) for _ in range(rng.randrange(9)))
    if kind < 4:
        return rng.choice([None, True, 1.5, -3, "", "\\", '\\"'])
    if kind < 6:
        return {f"k{i}\"}}": awkward(rng, depth + 1) for i in range(rng.randrange(4))}
    return [awkward(rng, depth + 1) for _ in range(rng.randrange(4))]


def test_large_arrays_are_cut_into_their_objects(spark, tmp_path, tiny_splits):
    rng = random.Random(9)
    expected = {}
    for i, (count, indent) in enumerate([(120, None), (40, 1), (0, None), (1, None), (3, 4)]):
        items = [{"i": n, "v": awkward(rng), "w": "x" * rng.choice([0, 5, 700])} for n in range(count)]
        name = f"f{i}.json"
        (tmp_path / name).write_text(json.dumps(items, indent=indent, ensure_ascii=bool(i % 2)) + "\n" * (i % 2), encoding="utf-8")
        expected[name] = items
    (tmp_path / "empty.json").write_text("")
    df = array_elements(spark, str(tmp_path))
    got = {}
    for r in df.orderBy("file", "part").collect():
        got.setdefault(r["file"].split("/")[-1], []).append(json.loads(r["value"]))
    assert got == {k: v for k, v in expected.items() if v}
    assert spark.read.text(str(tmp_path / "f0.json"), lineSep="}").rdd.getNumPartitions() > 20


def test_only_cut_elements_are_moved(spark, tmp_path, monkeypatch):
    """Pieces are joined where they are read; what is shuffled is the begin and the end of each run."""
    tables, written = {}, records.materialise
    monkeypatch.setattr(records, "materialise", lambda df, label: tables.setdefault(label, written(df, label)))
    items = [{"i": i, "v": [{"w": "}{"}] * 3} for i in range(500)]
    (tmp_path / "a.json").write_text(json.dumps(items))
    assert [json.loads(r["value"]) for r in array_elements(spark, str(tmp_path)).orderBy("part").collect()] == items
    assert sorted(tables) == ["depths", "elements", "split-depths"]
    assert tables["elements"].where("whole").count() >= 450


@pytest.mark.parametrize("text", ['[{"a": 1}', '[{"a": [1}]', '[{"a": "}]', '{"a": 1}'])
def test_incomplete_arrays_are_errors(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(ValueError, match="complete array"):
        array_elements(spark, str(tmp_path))


def test_spots_and_catalogues_as_large_arrays(spark, tmp_path, tiny_splits):
    spots = [{"titulo": f"RV{i}", "cautelar": i % 2 == 0, "partido": 'P"}{', "transcripcion": "hola\n" * (i % 7)} for i in range(30)]
    (tmp_path / "spots").mkdir()
    (tmp_path / "spots" / "data.json").write_text(json.dumps(spots))
    plain = readers.read_spots(spark, str(tmp_path / "spots")).collect()
    assert sorted(readers.read_spots(spark, str(tmp_path / "spots"), large_array=True).collect()) == sorted(plain) and len(plain) == 30
    catalogue = [{f"actor_{i}_{m}": [{"actor_politico": "x", "version": ["a", "b"], "folio": [{"folio": f"{i}-{m}.mp4", "titulo": "t"}]}]}
                 for i in range(9) for m in ("radio", "tv")]
    (tmp_path / "cat").mkdir()
    (tmp_path / "cat" / "c.json").write_text(json.dumps(catalogue))
    columns = ["key", "party_pos", "spot_pos", "nombre", "folio", "titulo", "directorio"]
    whole = flatten_catalogue(readers.read_catalogue(spark, str(tmp_path / "cat"))).select(*columns)
    parts = flatten_catalogue(readers.read_catalogue_array(spark, str(tmp_path / "cat")))
    assert sorted(parts.select(*columns).collect(), key=str) == sorted(whole.collect(), key=str)
    keys = [r["key"] for r in parts.where("spot_pos = 0").orderBy("part").collect()]
    assert keys == [next(iter(e)) for e in catalogue]
