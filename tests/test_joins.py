from __future__ import annotations

import itertools

import pytest

from spotlake.operators import joins as J
from spotlake.operators.aggregates import joined_group_count


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def skewed(spark):
    """One key holds a third of the rows, among them equal copies; some keys are NULL."""
    data = [("hot", i % 7) for i in range(300)] + [(f"k{i % 50}", i) for i in range(500)] + [(None, i) for i in range(100)]
    return data, spark.createDataFrame(data, "k string, v int").repartition(8)


def test_join_spots_fans_out_and_drops_null(spark):
    airings = spark.createDataFrame([("RV1", 1), ("RV1", 2), (None, 3), ("RV9", 4)], "MATERIAL string, n int")
    spots = spark.createDataFrame([("RV1", "A"), ("RV1", "B"), (None, "C")], "titulo string, partido string")
    got = J.join_spots(airings, spots)
    assert set(got.columns) == {"MATERIAL", "n", "titulo", "partido"}
    assert rows(got.select("MATERIAL", "n", "titulo", "partido")) == rows(spark.createDataFrame(
        [("RV1", 1, "RV1", "A"), ("RV1", 1, "RV1", "B"), ("RV1", 2, "RV1", "A"), ("RV1", 2, "RV1", "B")],
        "a string, b int, c string, d string"))


def families(spark):
    first = [("A", "d1", "t1"), ("A", "d1", "t1"), ("A", None, "t1"), ("B", "d2", "t2")]
    second = [(1, "A", "d1", "t1"), (2, "A", "d1", "t1"), (3, "A", None, "t1"), (4, "B", "d2", "t9"), (5, None, None, None)]
    return (
        first, second,
        spark.createDataFrame(first, "e string, d string, h string"),
        spark.createDataFrame(second, "n int, e2 string, d2 string, h2 string"),
    )


def test_cross_duplicates_counts_pairs_and_matches_null(spark):
    first, second, a, b = families(spark)
    pairs = sum(x == y[1:] for x, y in itertools.product(first, second))
    got = J.cross_duplicates(a, b, ["e", "d", "h"], ["e2", "d2", "h2"]).first()
    assert (got.pairs, got.first_rows, got.second_rows) == (pairs, 3, 3) == (5, 3, 3)
    nothing = J.cross_duplicates(a.limit(0), b, ["e", "d", "h"], ["e2", "d2", "h2"]).first()
    assert tuple(nothing) == (0, 0, 0)


def test_cross_duplicates_large_against_brute_force(spark):
    data, left = skewed(spark)
    got = J.cross_duplicates(left, left, ["k"], ["k"]).first()
    assert got.pairs == sum(x[0] == y[0] for x, y in itertools.product(data, data))


@pytest.mark.parametrize("threshold", ["10485760", "-1"])
def test_remove_cross_duplicates_keeps_null_keys(spark, threshold):
    _, _, a, b = families(spark)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        kept = J.remove_cross_duplicates(a, b, ["e", "d", "h"], ["e2", "d2", "h2"])
        assert kept.columns == b.columns
        assert sorted(r.n for r in kept.collect()) == [3, 4, 5]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_keys_of_different_types_compare_as_text(spark):
    a = spark.createDataFrame([(1,)], "k int")
    b = spark.createDataFrame([("1",), ("2",)], "k string")
    assert J.cross_duplicates(a, b, ["k"], ["k"]).first().pairs == 1
    assert [r.k for r in J.remove_cross_duplicates(a, b, ["k"], ["k"]).collect()] == ["2"]


def test_pending_and_append(spark):
    work = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "path string, n int")
    done = spark.createDataFrame([("a", "x"), ("a", "y")], "path string, text string")
    assert rows(J.pending(work, done, "path").select("n")) == [(2,), (3,)]
    existing = spark.createDataFrame([("a", "old")], "titulo string, t string")
    new = spark.createDataFrame([("a", "new"), ("b", "new")], "titulo string, t string")
    assert rows(J.append_new(existing, new, "titulo")) == [("a", "old"), ("b", "new")]
    assert J.append_all(existing, new).count() == 3


@pytest.mark.parametrize("threshold", ["10485760", "-1"])
def test_joined_group_count_with_and_without_broadcast(spark, threshold):
    airings = spark.createDataFrame(
        [("RV1", "X")] * 5 + [("RV1", "Y")] * 2 + [("RV2", "X")] * 3 + [(None, "X"), ("RV9", "X")], "m string, estado string")
    spots = spark.createDataFrame([("RV1", "A"), ("RV1", "A"), ("RV2", "B"), (None, "C")], "titulo string, partido string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        got = joined_group_count(airings, spots, "m", "titulo", ["estado"], ["partido"])
        assert rows(got) == [("X", "A", 10), ("X", "B", 3), ("Y", "A", 4)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
