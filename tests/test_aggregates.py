from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotlake.operators import aggregates as A
from spotlake.operators import profile as P
from spotlake.operators import quantiles as Q


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_share_of_total(spark):
    df = spark.createDataFrame([("a",)] * 2 + [("b",)] + [(None,)] * 3, "k string")
    got = A.with_share(A.group_count(df, ["k"]))
    assert sorted(rows(got), key=repr) == sorted([("a", 2, 33.3), ("b", 1, 16.7), (None, 3, 50.0)], key=repr)


def test_top_groups_break_ties_by_key_and_skip_null(spark):
    counts = spark.createDataFrame([("c", 5), ("a", 3), ("b", 3), ("d", 1), (None, 9)], "k string, n int")
    assert rows(A.top_groups(counts, "k", 2)) == [("c", 5), ("a", 3)]
    kept = A.within_top_groups(counts, "k", 2)
    assert sorted(r.k for r in kept.collect()) == ["a", "c"]
    assert A.top_groups(counts, "k", 10).count() == 4


def test_pivot_and_order_by_total(spark):
    counts = spark.createDataFrame([("x", "A", 1), ("y", "A", 2), ("y", "B", 3), ("z", None, 7)], "s string, p string, n int")
    got = A.matrix_by_total(counts, "s", "p", ["A", "B"])
    assert got.columns == A.pivot_counts(counts, "s", "p", ["A", "B"]).columns == ["s", "A", "B"]
    # A category that is not listed counts for the total.
    assert rows(got) == [("z", None, None), ("y", 2, 3), ("x", 1, None)]
    assert rows(A.top_matrix(counts, "s", "p", ["A", "B"], 2)) == rows(got)[:2]
    assert A.category_values(counts, "p") == ["A", "B"]


def test_category_values_refuses_wide_matrices(spark):
    spark.conf.set("spark.sql.pivotMaxValues", "3")
    try:
        with pytest.raises(ValueError, match="more than 3"):
            A.category_values(spark.range(10).select(F.col("id").cast("string").alias("p")), "p")
    finally:
        spark.conf.unset("spark.sql.pivotMaxValues")


def test_nonnull_count_sorts_null_groups_last(spark):
    df = spark.createDataFrame([(None,)] * 5 + [("a",)] * 2 + [("b",)] * 3, "k string")
    assert rows(A.count_with_nonnull(df, ["k"], "k")) == [("b", 3, 3), ("a", 2, 2), (None, 5, 0)]


def test_histogram_closes_last_bin_and_keeps_empty_bins(spark):
    data = [0.0, 0.1, 1.0, 9.99, 10.0, 10.0, None]
    got = A.histogram(spark.createDataFrame([(x,) for x in data], "v double"), "v", 5).orderBy("bin")
    counts, edges = np.histogram([x for x in data if x is not None], bins=5)
    assert [r.n for r in got.collect()] == list(counts)
    assert np.allclose([r.lower for r in got.collect()], edges[:-1])
    assert np.allclose([r.upper for r in got.collect()], edges[1:])


def test_histogram_of_one_value(spark):
    got = A.histogram(spark.createDataFrame([(3.0,)] * 4, "v double"), "v", 20).orderBy("bin").collect()
    counts, edges = np.histogram([3.0] * 4, bins=20)
    assert [r.n for r in got] == list(counts)
    assert got[0].lower == edges[0] == 2.5 and got[-1].upper == edges[-1] == 3.5


def test_confusion_matrix_and_accuracy(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 1.0)], "label double, prediction double")
    assert rows(A.confusion_matrix(df, "label", "prediction", [0.0, 1.0, 2.0])) == [(0.0, 1, 1, 0), (1.0, 0, 2, 0)]
    assert A.accuracy(df, "label", "prediction").first().accuracy == 0.75
    assert A.accuracy(df.limit(0), "label", "prediction").first().accuracy is None


def test_last_value_and_merge(spark):
    df = spark.createDataFrame([("f", 0, 5, True), ("f", 1, 0, False), ("g", 0, 0, None), ("g", 0, 1, True)],
                               "folio string, a int, b int, cautelar boolean")
    new = A.last_value(df, "folio", "cautelar", ["a", "b"])
    assert dict(rows(new)) == {"f": False, "g": True}
    old = spark.createDataFrame([("f", True), ("h", True)], "folio string, cautelar boolean")
    assert dict(rows(A.merge_latest(old, new, "folio", "cautelar"))) == {"f": False, "g": True, "h": True}


def test_latest_rows_keep_columns(spark):
    df = spark.createDataFrame([(1, "a", 1, None), (1, "b", 2, 5), (2, "c", 1, 7)], "k int, v string, t int, w int")
    got = A.latest_rows(df, ["k"], ["t"])
    assert got.columns == df.columns
    assert sorted(rows(got)) == [(1, "b", 2, 5), (2, "c", 1, 7)]


def test_word_frequencies_count_distinct_texts(spark):
    df = spark.createDataFrame([("the cat. The dog",), ("the cat. The dog",), ("cat",), ("",), (None,)], "t string")
    assert dict(rows(A.word_frequencies(df, "t"))) == {"the": 2, "cat": 2, "dog": 1}
    assert rows(A.top_words(A.word_frequencies(df, "t", ["the"]), 1)) == [("cat", 2)]


def test_exact_quantiles_against_numpy(spark):
    rng = np.random.default_rng(7)
    groups = np.repeat(["big", "mid", "tiny", "same"], [20000, 3000, 7, 500])
    data = np.round(rng.lognormal(0, 2, len(groups)), 2)
    data[groups == "same"] = 4.0
    order = rng.permutation(len(groups))
    df = spark.createDataFrame([(str(g), float(v)) for g, v in zip(groups[order], data[order])] + [("tiny", None), (None, 1.0)],
                               "g string, v double").repartition(8)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r.g: r for r in Q.exact_quantiles(df, "g", "v", probs).collect()}
    assert set(got) == {"big", "mid", "tiny", "same"}
    for g in got:
        values = data[groups == g]
        assert got[g].n == len(values)
        assert np.allclose([got[g][f"q{i}"] for i in range(len(probs))], np.quantile(values, probs))


def test_box_plot(spark):
    data = [1.0, 2.0, 3.0, 4.0, 5.0, 100.0]
    df = spark.createDataFrame([("a", v) for v in data] + [("a", None), ("b", 2.0)], "g string, v double")
    a, b = Q.box_plot(df, "g", "v").orderBy("g").collect()
    assert tuple(a) == ("a", 6, 2.25, 3.5, 4.75, 1.0, 5.0, 1)
    assert tuple(b) == ("b", 1, 2.0, 2.0, 2.0, 2.0, 2.0, 0)
    assert rows(Q.outliers(df, "g", "v")) == [("a", 100.0)]
    rough = Q.box_plot(df, "g", "v", approximate=True).orderBy("g").first()
    assert rough.n == 6 and rough.median in (3.0, 4.0)


def sparse(spark):
    data = [("x", None, None), ("y", None, "b"), ("x", None, None), (None, "a", None), ("z", "a", None), ("z", "a", "c"),
            ("z", "a", None), ("z", "a", None), ("z", "a", None), ("z", "a", None)]
    return spark.createDataFrame(data, "a string, b string, c string").withColumn("n", F.lit(1))


def test_null_profile_and_threshold(spark):
    df = sparse(spark)
    assert dict(rows(P.null_profile(df))) == {"a": 10.0, "b": 30.0, "c": 80.0}
    assert P.sparse_columns(df) == ["c"]
    assert P.drop_sparse_columns(df).columns == ["a", "b", "n"]
    assert dict(rows(P.null_profile(df.limit(0)))) == {"a": None, "b": None, "c": None}


def test_distinct_profile_counts_null_once(spark):
    df = sparse(spark)
    assert dict(rows(P.distinct_profile(df))) == {"a": 4, "b": 2, "c": 3}
    assert dict(rows(P.distinct_profile(df, approximate=True))) == {"a": 4, "b": 2, "c": 3}
    assert dict(rows(P.distinct_profile(df.limit(0)))) == {"a": 0, "b": 0, "c": 0}


def test_duplicate_rows(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "a", None), (4, "b", "x" * 200), (5, "b", "x" * 200)],
                               "`No.` int, a string, b string")
    assert rows(P.duplicate_rows(df)) == [(5, 0)]
    assert rows(P.duplicate_rows(df, exclude=["No."])) == [(5, 3)]
    assert rows(P.duplicate_rows(df.limit(0))) == [(0, 0)]


def test_key_sets(spark):
    df = spark.createDataFrame([('{"a":1,"b":{"c":2}}',), ('{"b":[1],"a":null}',), ('{"a":1}',)], "j string")
    assert dict(rows(P.key_sets(df, "j"))) == {"a,b": 2, "a": 1}
    assert not P.has_one_key_set(df, "j")
    assert P.has_one_key_set(df.limit(2), "j")
    assert P.has_one_key_set(df.limit(0), "j")


def test_summary_of_reports(spark):
    a = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "n int, k string")
    b = spark.createDataFrame([(1, "x"), (2, "z")], "n int, k2 string")
    got = dict(rows(P.summary_of_reports(a, b, ["k"], ["k2"], exclude=["n"])))
    assert got == {"first_rows": 3, "first_duplicates": 1, "second_rows": 2, "second_duplicates": 0,
                   "cross_pairs": 2, "second_rows_matched": 1}
