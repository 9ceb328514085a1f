"""Near duplicates on shingle sets against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spotlake.llm import minhash


def plain_sets(texts, size=4):
    out = []
    for t in texts:
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
        out.append({tuple(words[i:i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} if words else set())
    return out


def plain_components(rows, percent=80):
    """Rows (id, text) to (id, set size, component's least id)."""
    sets = plain_sets([t for _, t in rows])
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups: dict[int, list] = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    least = {r: min((rows[i][0] for i in members if rows[i][0] is not None), default=None) for r, members in groups.items()}
    return [(rows[i][0], len(sets[i]), least[find(i)]) for i in range(len(rows))], len(groups)


def corpus(seed, families, copies):
    """Families that drift apart from member to member, so that links form chains and many pairs lie about the threshold."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = [None, "", " \t\n", "one", "One two", "one two THREE", "one two three four", "  x", "x " * 50, "x " * 60]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    for _ in range(families):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([20, 60, 150]))] + passage
        for _ in range(rng.randrange(1, copies)):
            for _ in range(max(1, len(words) * rng.randrange(0, 4) // 100)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words) if rng.random() < .7 else "  ".join(words).upper())
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("block", [1024, 3])
def test_components_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    texts = corpus(block, 30, 14)
    rows = [(None if i % 11 == 5 else i - i % 2 if i % 5 == 0 else i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t, "x", 1, "y", "z") for i, t in rows],
                                 "doc_id long, text string, row string, node int, bits string, _row string").repartition(5)
    expected, groups = plain_components(rows)
    got = minhash.near_duplicates(docs).collect()
    key = [(-1 if i is None else i, n, -1 if c is None else c) for i, n, c in expected]
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_shingles"], -1 if r["component_id"] is None else r["component_id"])
                  for r in got) == sorted(key)
    assert sum(r["kept"] for r in got) == groups and len({r["row"] for r in got}) == len(rows)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_buckets_over_many_partitions(spark):
    """A bucket that fills several partitions is a star in each, and the stars meet through their first nodes."""
    rows = [(1, n) for n in range(50)] + [(2, 60), (3, 70), (3, 71), (4, 80)]
    nodes = spark.createDataFrame([(n, 10, bytes(minhash.BITS * minhash._WORDS * 8)) for _, n in rows], "node long, size long, bits binary")
    old = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        for batch in ("2", "10000"):
            for c, v in zip(old, ("13", "false", batch)):
                spark.conf.set(c, v)
            members = minhash.shared_buckets(spark.createDataFrame(rows, "key long, node long").repartition(4))
            assert {r["node"] for r in members.where("key IN (1, 3)").collect()} == {*range(50), 70, 71}
            got = minhash.starred(members, nodes, 80).collect()
            firsts = {r["a"] for r in got if r["b"] is None and r["key"] == 1}
            links = {(r["a"], r["b"]) for r in got if r["b"] is not None} | {(min(firsts), a) for a in firsts}
            reached = {0} | firsts
            assert {b for a, b in links if a in reached} | reached == set(range(50)) and (70, 71) in links and len(firsts) > 2
            assert {a for a, _ in links} <= {*range(50), 70}
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)


def test_signatures_estimate_similarity():
    """Corrected bit counts are near the true similarity, and pairs at the threshold pass the least count."""
    rng = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.8, 0.95):
        found = []
        for _ in range(20):
            both = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
            cut = round(2000 * share)
            one, two = both[:cut + (2000 - cut) // 2], np.concatenate([both[:cut], both[cut + (2000 - cut) // 2:]])
            least = minhash.minima(np.concatenate([np.sort(one), np.sort(two)]), np.array([0, len(one)]))
            bits = minhash.packed(least)
            found.append(int(minhash.matches(bits[0], bits[1])))
        assert abs(minhash.similarity(float(np.mean(found))) - share) < 0.04
        if share >= 0.8:
            assert min(found) >= minhash.least_matches(80)
    assert minhash.similarity(minhash.least_matches(80)) > 0.5


def test_sets_of_long_texts():
    texts = ["a b c d " * 300_000, "", None, "A b\tc\x0bd", "é x"]
    got = dict(minhash.shingle_sets(pa.array([t or "" for t in texts]), 4))
    assert {k: len(v) for k, v in got.items()} == {0: 4, 3: 1, 4: 1}
    assert got[3][0] in got[0]


def test_a_family_of_one_base(spark):
    """Thousands of near copies of one text, all in the same buckets, and a few strangers."""
    rng = random.Random(3)
    base = [f"v{rng.randrange(900)}" for _ in range(120)]
    rows = []
    for i in range(1500):
        words = list(base)
        words[i % 120] = f"n{i}"
        rows.append((i, " ".join(words)))
    rows += [(9000 + i, " ".join(f"u{rng.randrange(900)}" for _ in range(80))) for i in range(20)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("component_id").count()
    sizes = sorted(r["count"] for r in got.where(F.col("component_id") < 9000).collect())
    assert sizes == [1500] and got.count() == 21
