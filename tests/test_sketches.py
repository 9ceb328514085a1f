"""Summaries, sketches, hashed features, exact splits, nested key sets and the index of stored keys."""

from __future__ import annotations

import json
import math
import os
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from spotlake.operators import features, heavy, sizing, sketches
from spotlake.operators.features import hashed_features, term_counts
from spotlake.operators.profile import nested_key_sets, schema_paths
from spotlake.operators.quantiles import box_plot
from spotlake.plans import classify as K
from spotlake.sources import writers

# Heavy hitters


def test_a_summary_falls_short_by_no_more_than_it_says():
    rng = random.Random(1)
    words = [f"w{int(rng.paretovariate(0.9))}" for _ in range(4000)]
    true, held, off = Counter(words), (pa.array([], pa.string()), np.zeros(0, np.int64)), 0
    for start in range(0, len(words), 250):
        counts = Counter(dict(zip(held[0].to_pylist(), held[1].tolist()))) + Counter(words[start:start + 250])
        *held, taken = heavy.reduced(pa.array(list(counts)), np.array(list(counts.values())), 40)
        off += taken
        assert len(held[1]) <= 40
    kept = dict(zip(held[0].to_pylist(), held[1].tolist()))
    assert off > 0 and all(kept.get(w, 0) <= n <= kept.get(w, 0) + off for w, n in true.items())


@pytest.mark.parametrize("counters, most", [(8192, 1 << 20), (30, 1 << 20), (8, 8)])
def test_frequent_words_equal_full_counts(spark, monkeypatch, counters, most):
    """With room for all words, with candidates proven by the bound, and with summaries that prove nothing."""
    monkeypatch.setattr(heavy, "MOST_COUNTERS", most)
    rng = random.Random(counters)
    texts = [" ".join(f"W{int(rng.paretovariate(0.8))}" for _ in range(rng.randrange(40))) for _ in range(300)] + [None, "", "w1 the the"]
    texts += texts[:50]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(5)
    expected = Counter(w for t in set(filter(None, texts)) for w in t.lower().split() if w != "the")
    best = sorted(expected.items(), key=lambda x: (-x[1], x[0]))[:10]
    assert [tuple(r) for r in heavy.frequent_words(df, "t", 10, ["the"], counters).collect()] == best
    assert heavy.frequent_words(df.limit(0), "t", 10).count() == 0
    assert len(heavy.frequent_words(df, "t", 10_000).collect()) == len(expected) + 1


# Stored sketches


def test_merged_profile_equals_exact_counts(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.choice([None, "x"]), f"v{rng.randrange(3000)}", None) for _ in range(8000)]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    one = sketches.column_sketches(df.limit(0))
    store = sketches.SketchStore(spark, str(tmp_path / "s"), one.schema)
    assert sketches.merged_profile(store.rows()).count() == 0
    parts = [spark.createDataFrame(rows[i::3], df.schema) for i in range(3)]
    for i, part in enumerate([*parts, parts[0]]):
        store.add(f"load{i % 3}", sketches.column_sketches(part))
    store.add("empty", one)
    got = {r["column"]: r for r in sketches.merged_profile(store.rows()).collect()}
    for i, c in enumerate("abc"):
        exact = len({r[i] for r in rows})
        assert got[c]["n_rows"] == 8000 and got[c]["null_pct"] == 100.0 * sum(r[i] is None for r in rows) / 8000
        assert abs(got[c]["n_distinct"] - exact) <= max(0, exact * sketches.distinct_error())


def test_merged_quantiles_within_the_rank_error(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.randrange(5), rng.choice([None, rng.gauss(0, 10), 5.0])) for _ in range(30000)] + [("c", 1, 7.0), ("d", 1, None)]
    df = spark.createDataFrame(rows, "g string, day int, x double")
    schema = sketches.quantile_sketches(df, ["g", "day"], "x").schema
    store = sketches.SketchStore(spark, str(tmp_path / "s"), schema)
    for i in range(3):
        store.add(str(i), sketches.quantile_sketches(spark.createDataFrame(rows[i::3], df.schema), ["g", "day"], "x"))
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = {r["g"]: r for r in sketches.merged_quantiles(store.rows(), ["g"], probs).collect()}
    assert set(got) == {"a", "b", "c"}
    for g, r in got.items():
        values = np.array([x for k, _, x in rows if k == g and x is not None])
        assert (r["n"], r["low"], r["high"]) == (len(values), values.min(), values.max())
        for i, p in enumerate(probs):
            assert (values < r[f"q{i}"]).mean() - sketches.KLL_RANK_ERROR <= p <= (values <= r[f"q{i}"]).mean() + sketches.KLL_RANK_ERROR
    box = {r["g"]: r for r in sketches.merged_box_plot(store.rows(), "g").collect()}
    exact = {r["g"]: r for r in box_plot(df, "g", "x").collect()}
    for g in "ab":
        assert abs(box[g]["median"] - exact[g]["median"]) < 0.6 and box[g]["fence_low"] <= exact[g]["whisker_low"] + 1.5


# Hashed features


def test_hashed_features_keep_inner_products(spark):
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(400)}" for _ in range(80)) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    terms = term_counts(df, "k", "t")
    wide = {(r["k"], r["bucket"]): r["value"] for r in hashed_features(terms, "k", 1 << 14).collect()}
    vectors = np.zeros((30, 1 << 14))
    for (k, b), v in wide.items():
        vectors[k, b] = v
    counts = [Counter(t.split()) for t in texts]
    true = np.array([[sum(a[w] * b[w] for w in a) for b in counts] for a in counts])
    assert np.abs(vectors @ vectors.T - true).mean() < 1.0
    assert {abs(v) for v in wide.values()} <= set(range(1, 20)) and min(wide.values()) < 0 < max(wide.values())


def test_hashed_classifier_is_within_a_point(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    train, test = K.hash_split(docs, "doc_id")
    full = K.accuracy_of(K.fit_classifier(train, "text", "lang", key="doc_id").predict(test))
    hashed = K.fit_classifier(train, "text", "lang", key="doc_id", width=1 << 18)
    assert hashed.weights.count() <= 1 << 18 and K.accuracy_of(hashed.predict(test)) >= full - 0.01


def plan_of(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def test_terms_of_large_inputs_move_with_their_texts(spark, monkeypatch):
    """However large the input, the one shuffle is that of the texts."""
    monkeypatch.setattr(sizing, "SMALL_PER_CORE", 0)
    df = spark.createDataFrame([(1, "a b a"), (1, "b c"), (None, "a a"), (None, "c"), (2, None)], "k int, t string")
    hashed = hashed_features(term_counts(df, "k", "t"), "k", 1 << 14)
    assert plan_of(hashed).count("Exchange") == 1
    counts = {(r.k, r.term): r.tf for r in term_counts(df, "k", "t").collect()}
    assert counts == {(1, "a"): 2, (1, "b"): 2, (1, "c"): 1, (None, "a"): 2, (None, "c"): 1}


@pytest.mark.parametrize("name", ["fit", "tfidf"])
def test_no_row_per_text_and_term_is_written(spark, monkeypatch, name):
    module, tables = (K if name == "fit" else features), []
    written = module.materialise
    monkeypatch.setattr(module, "materialise", lambda df, label: tables.append(df.columns) or written(df, label))
    df = spark.createDataFrame([(1, "ka kb ka", "x"), (1, "kb kc", "y"), (None, "ka ka", "x"), (2, "kc", None), (3, "kd", "y")], "k int, t string, p string")
    if name == "fit":
        fitted = K.fit_classifier(df, "t", "p", key="k")
        # The texts of key 1 count as one text of both labels; rows without a key or a label count for the vocabulary.
        idf = {r.term: r.idf for r in fitted.weights.collect()}
        assert {t: round(6 / math.exp(v) - 1) for t, v in idf.items()} == {"ka": 2, "kb": 1, "kc": 2, "kd": 1}
        assert len(fitted.weights.where("term = 'ka'").first().gains) == 2
    else:
        monkeypatch.setattr(features, "FREQUENT", 2)
        got = {(r.k, r.term): (r.tf, r.df) for r in features.tfidf(df, "k", "t").collect()}
        assert got == {(1, "ka"): (2, 2), (1, "kb"): (2, 1), (1, "kc"): (1, 2), (None, "ka"): (2, 2), (2, "kc"): (1, 2), (3, "kd"): (1, 1)}
    assert tables and not any("k" in c for c in tables)


# Exact split


@pytest.mark.parametrize("share", [0.0, 0.1, 0.5, 0.8, 1.0])
def test_exact_split(spark, share):
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(40)]), rng.choice("ab")) for _ in range(500)] + [(7, "z")] * 100
    df = spark.createDataFrame(rows, "k int, v string")
    first = None
    for parts in (1, 7):
        train, test = K.exact_split(df.repartition(parts), "k", share)
        one, two = Counter(map(tuple, train.collect())), Counter(map(tuple, test.collect()))
        assert sum(one.values()) == int(share * 600) and one + two == Counter(rows)
        assert first is None or first == one
        first = one
    train, test = K.exact_split(df.limit(0), "k", share)
    assert train.count() == test.count() == 0


# Nested key sets


def python_paths(value, path=""):
    out = set()
    if isinstance(value, dict):
        for key, child in value.items():
            name = "`" + key.replace("`", "``") + "`" if any(c in key for c in ".[]`") else key
            out |= {f"{path}.{name}" if path else name} | python_paths(child, f"{path}.{name}" if path else name)
    elif isinstance(value, list):
        out.add(path + "[]")
        for child in value:
            out |= python_paths(child, path + "[]")
    return out


def test_nested_key_sets(spark):
    rng = random.Random(6)

    def record(depth=0):
        keys = ["a", "b c", "d.e", "f`g", "h<i: j>, k", "l[]", "ñ", ""]
        return {k: record(depth + 1) if depth < 2 and rng.random() < .4 else [{"x": 1}, {"y": 2.25, "z": None}] if rng.random() < .2
                else rng.choice([1, "s, t: <u>", None, True, 2.5, 10 ** 30, [], {}]) for k in rng.sample(keys, rng.randrange(4))}

    records = [record() for _ in range(150)] + [[1, 2], [], 3, "x", {"a": 1}, {"a": 22.5}, {"a": None}]
    rows = [(json.dumps(r),) for r in records] + [("not json",), (None,)]
    expected = Counter(",".join(sorted(python_paths(r))) for r in records)
    got = {r["paths"]: r["n"] for r in nested_key_sets(spark.createDataFrame(rows, "j string"), "j").collect()}
    assert got.pop(None) == 2 and got == dict(expected)
    assert schema_paths("OBJECT<a: DECIMAL(3,1), b: ARRAY<OBJECT<c: VOID>>>") == ["a", "b", "b[]", "b[].c"]


# Index of stored keys


def stored(path):
    out = []
    for name in sorted(os.listdir(path)):
        if name.endswith(".json"):
            out += [json.loads(line) for line in open(os.path.join(path, name))]
    return sorted(((r.get("k"), r["v"]) for r in out), key=str)


@pytest.mark.parametrize("bits", [1 << 30, 8])
def test_indexed_append_equals_plain_append(spark, tmp_path, monkeypatch, bits):
    """With room for all keys, and with so few bits that most new keys meet a bit that is set."""
    monkeypatch.setattr(writers, "INDEX_BITS", bits)
    rng, path, kept = random.Random(bits), str(tmp_path / "d"), {}
    expected = []
    for batch in range(4):
        rows = [(f"k{rng.randrange(40)}", f"{batch}") for _ in range(15)] + [(None, f"{batch}")]
        expected.append((None, f"{batch}"))
        for k, v in rows[:-1]:
            kept.setdefault(k, v)
        writers.append_indexed_json(spark.createDataFrame(rows, "k string, v string"), path, "k")
        assert stored(path) == sorted([*kept.items(), *expected], key=str)
    reads = []
    plain = type(spark.read).json
    monkeypatch.setattr(type(spark.read), "json", lambda self, *a, **k: reads.append(a) or plain(self, *a, **k))
    writers.append_indexed_json(spark.createDataFrame([("k1", "x"), ("new", "x")], "k string, v string"), path, "k")
    assert not reads and ("new", "x") in stored(path)


def test_index_is_built_for_old_and_broken_datasets(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "d")
    old = spark.createDataFrame([("a", "1"), ("b", "1")], "k string, v string")
    writers.append_json(old, path)
    writers.append_indexed_json(spark.createDataFrame([("a", "2"), ("c", "2")], old.schema), path, "k")
    assert stored(path) == [("a", "1"), ("b", "1"), ("c", "2")]
    with monkeypatch.context() as m:
        m.setattr(writers, "_write_index", lambda *a: (_ for _ in ()).throw(OSError("no space")))
        with pytest.raises(OSError):
            writers.append_indexed_json(spark.createDataFrame([("d", "3")], old.schema), path, "k")
    for _ in range(2):
        writers.append_indexed_json(spark.createDataFrame([("d", "4"), ("c", "4")], old.schema), path, "k")
    assert stored(path) == [("a", "1"), ("b", "1"), ("c", "2"), ("d", "3")]
    assert spark.read.parquet(f"{path}.index/keys").select("_key").distinct().count() == 4
