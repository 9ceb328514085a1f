"""Keyed merges into touched buckets, and a table that follows rewritten files."""

from __future__ import annotations

import os
import random

import pandas as pd
import pytest
from pyspark.sql import types as T

from spotlake.sources import writers
from spotlake.sources.changes import FollowedFolder, digests, file_of, listing
from spotlake.sources.scratch import scratch_path
from spotlake.streaming.loader import StreamTarget, load_folder
from spotlake.streaming.upsert import UpsertTarget, upsert_folder

SCHEMA = T.StructType([
    T.StructField("k", T.LongType()), T.StructField("k2", T.StringType()), T.StructField("t", T.IntegerType()),
    T.StructField("v", T.StringType()), T.StructField("gone", T.BooleanType())])


def write(path, name, rows):
    os.makedirs(path, exist_ok=True)
    frame = pd.DataFrame(rows, columns=["k", "k2", "t", "v", "gone"]).astype({"k": "Int64", "t": "Int32"})
    frame.to_parquet(os.path.join(path, f"{name}.parquet"))


def folder_rows(target):
    return sorted((tuple(r) for r in target.table().collect()), key=str)


def test_upsert_equals_last_of_each_key(spark, tmp_path):
    """Random batches with NULL keys, NULL and equal times and deletions, against a dictionary."""
    rng, source = random.Random(1), str(tmp_path / "in")
    target = UpsertTarget(spark, str(tmp_path / "out"), SCHEMA, ["k", "k2"], ["t"], buckets=4, deleted="gone")
    assert target.table().count() == 0
    kept = {}
    for batch in range(4):
        rows = {}
        for _ in range(30):
            key = (rng.choice([None, 1, 2, 3, 4]), rng.choice([None, "a", "b"]))
            row = (*key, rng.choice([None, 1, 2, 3]), f"{batch}-{rng.random()}", rng.choice([None, False, False, True]))
            # Within a batch times of a key differ, so that the last one is defined.
            rows[key, row[2]] = row
        write(source, f"b{batch}", list(rows.values()))
        for (key, t), row in rows.items():
            old = kept.get(key)
            if old is None or (-1 if old[2] is None else old[2]) <= (-1 if t is None else t):
                kept[key] = row
        upsert_folder(target, source)
        assert folder_rows(target) == sorted((r for r in kept.values() if not r[4]), key=str)
    upsert_folder(target, source)
    assert folder_rows(target) == sorted((r for r in kept.values() if not r[4]), key=str)


def test_upsert_writes_touched_buckets_only(spark, tmp_path):
    source = str(tmp_path / "in")
    target = UpsertTarget(spark, str(tmp_path / "out"), SCHEMA, ["k"], ["t"], buckets=32)
    write(source, "a", [(k, "x", 1, "old", False) for k in range(500)])
    upsert_folder(target, source)
    before = target.versions()
    assert set(before) == set(range(32)) and set(before.values()) == {0}
    write(source, "b", [(7, "x", 2, "new", False), (8, "x", 0, "late", False)])
    upsert_folder(target, source)
    after = target.versions()
    touched = {b for b in after if after[b] != before[b]}
    assert 1 <= len(touched) <= 2
    written = {int(f.split("=")[1]) for f in os.listdir(tmp_path / "out" / "run=0" / "data" / "v=1") if f.startswith("bucket=")}
    assert written == touched
    rows = {r["k"]: r["v"] for r in target.table().collect()}
    assert len(rows) == 500 and rows[7] == "new" and rows[8] == "old"


def test_upsert_replay_failure_and_reload(spark, tmp_path, monkeypatch):
    source = str(tmp_path / "in")
    target = UpsertTarget(spark, str(tmp_path / "out"), SCHEMA, ["k"], ["t"], buckets=4)
    write(source, "a", [(k, "x", 1, "old", False) for k in range(20)])
    upsert_folder(target, source)
    first = folder_rows(target)
    path = str(tmp_path / "out" / "run=0")
    batch = spark.read.schema(SCHEMA).parquet(f"{source}/a.parquet")
    # The same batch once more changes nothing; a merge whose manifest cannot be written is not seen.
    target.merge(batch, 0, path)
    assert folder_rows(target) == first
    newer = spark.createDataFrame([(3, "x", 9, "new", False)], SCHEMA)
    with monkeypatch.context() as m:
        m.setattr(writers, "write_version", lambda *a: (_ for _ in ()).throw(OSError("no space")))
        with pytest.raises(OSError):
            target.merge(newer, 1, path)
    assert folder_rows(target) == first
    target.merge(newer, 1, path)
    assert (3, "x", 9, "new", False) in folder_rows(target) and len(folder_rows(target)) == 20
    write(source, "b", [(99, "x", 1, "b", False)])
    assert upsert_folder(target, source, full_reload=True).count() == 21
    with pytest.raises(ValueError, match="buckets"):
        UpsertTarget(spark, str(tmp_path / "out"), SCHEMA, ["k"], ["t"], buckets=8).table()
    with pytest.raises(ValueError, match="must not hold"):
        UpsertTarget(spark, "x", T.StructType.fromDDL("k long, Bucket int"), ["k"], ["k"])


def test_overwriting_load_keeps_the_last_complete_batch(spark, tmp_path, monkeypatch):
    source = str(tmp_path / "in")
    target = StreamTarget(spark, str(tmp_path / "out"), SCHEMA, "overwrite", load_time=False)
    write(source, "a", [(1, "x", 1, "a", False)])
    assert load_folder(spark, source, SCHEMA, target).count() == 1
    name = scratch_path(spark, "t").split("/")[-2]
    target.register(f"t{name}")
    write(source, "b", [(2, "x", 1, "b", False), (3, "x", 1, "b", False)])
    with monkeypatch.context() as m:
        m.setattr(writers, "write_version", lambda *a: (_ for _ in ()).throw(OSError("no space")))
        with pytest.raises(Exception, match="no space"):
            load_folder(spark, source, SCHEMA, target)
    assert target.table().count() == 1 and spark.table(f"t{name}").count() == 1
    assert load_folder(spark, source, SCHEMA, target).count() == 2
    assert target.register(f"t{name}").count() == 2


FILES = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType())])


def put(path, name, rows, at=None):
    os.makedirs(path, exist_ok=True)
    file = os.path.join(path, name)
    pd.DataFrame(rows, columns=["k", "v"]).astype({"k": "Int64"}).to_parquet(file)
    if at:
        os.utime(file, (at, at))


def test_rewritten_files_are_read_again(spark, tmp_path):
    source = str(tmp_path / "in")
    target = FollowedFolder(spark, source, str(tmp_path / "out"), FILES)
    assert target.load() == {} and target.table().count() == 0
    put(source, "a b+c%20ñ.parquet", [(1, "a"), (None, None), (1, "a")], 1e9)
    put(source, "b.parquet", [(2, "b")], 1e9)
    put(os.path.join(source, "deep"), "c.parquet", [(3, "c")], 1e9)
    put(source, "empty.parquet", [], 1e9)
    assert target.load() == {"added": 4}
    assert folder_rows(target) == sorted([(1, "a"), (1, "a"), (None, None), (2, "b"), (3, "c")], key=str)
    assert target.load() == {"same": 4}
    # Rewritten, touched only, removed, added.
    put(source, "a b+c%20ñ.parquet", [(1, "a"), (None, None), (4, "d")], 2e9)
    put(source, "b.parquet", [(2, "b")], 2e9)
    os.remove(os.path.join(source, "deep", "c.parquet"))
    put(source, "d.parquet", [(5, "e")])
    put(source, "empty.parquet", [(6, "f")])
    assert target.load() == {"changed": 2, "touched": 1, "removed": 1, "added": 1}
    assert folder_rows(target) == sorted([(1, "a"), (4, "d"), (None, None), (2, "b"), (5, "e"), (6, "f")], key=str)
    versions = {r["path"].split("/")[-1]: r["version"] for r in target.manifest().collect()}
    assert versions["b.parquet"] == 1 and versions["d.parquet"] == 2
    assert target.load() == {"same": 4}
    # Removed and back again.
    put(os.path.join(source, "deep"), "c.parquet", [(7, "g")])
    assert target.load() == {"same": 4, "added": 1}
    assert (7, "g") in folder_rows(target) and (3, "c") not in folder_rows(target)


def test_same_length_and_time_need_verification(spark, tmp_path):
    source = str(tmp_path / "in")
    put(source, "a.parquet", [(1, "a")], 1e9)
    target = FollowedFolder(spark, source, str(tmp_path / "out"), FILES)
    target.load()
    put(source, "a.parquet", [(1, "b")], 1e9)
    assert target.load() == {"same": 1}
    checked = FollowedFolder(spark, source, str(tmp_path / "out"), FILES, verify=True)
    assert checked.load() == {"changed": 1} and folder_rows(checked) == [(1, "b")]


def test_a_load_that_fails_is_not_seen(spark, tmp_path, monkeypatch):
    source = str(tmp_path / "in")
    put(source, "a.parquet", [(1, "a")])
    target = FollowedFolder(spark, source, str(tmp_path / "out"), FILES)
    target.load()
    put(source, "a.parquet", [(2, "b"), (3, "b")])
    with monkeypatch.context() as m:
        m.setattr(writers, "write_version", lambda *a: (_ for _ in ()).throw(OSError("no space")))
        with pytest.raises(OSError):
            target.load()
    assert folder_rows(target) == [(1, "a")]
    assert target.load() == {"changed": 1} and folder_rows(target) == [(2, "b"), (3, "b")]


def test_digests_tell_nulls_and_repeats_apart(spark, tmp_path):
    """Equal in any order of rows; different for a repeated row or a NULL that moves."""
    schema = T.StructType.fromDDL("a string, b string, m map<string,int>, x array<int>")
    variants = {"one": [("p", None, {"k": 1, "l": 2}, [1]), ("q", "r", None, None)], "two": [("q", "r", None, None), ("p", None, {"l": 2, "k": 1}, [1])],
                "moved": [(None, "p", {"k": 1, "l": 2}, [1]), ("q", "r", None, None)], "twice": [("p", None, {"k": 1, "l": 2}, [1])] * 2}
    found = {}
    for name, rows in variants.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / name))
        df = spark.read.schema(schema).parquet(str(tmp_path / name))
        found[name] = [r["digest"] for r in digests(df, file_of()).collect()]
        paths = {r["path"] for r in listing(spark, str(tmp_path / name)).collect()}
        assert {r["path"] for r in digests(df, file_of()).collect()} == paths
    assert found["one"] == found["two"] and found["moved"] != found["one"] and found["twice"] != found["one"]
