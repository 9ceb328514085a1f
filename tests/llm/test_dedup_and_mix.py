"""Exact dedup, SimHash, mixing and quality rules on small tables, and every query against its SQL twin."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from spotlake.llm import exact_dedup, mixing, quality, simhash
from spotlake.llm.components import components
from spotlake.llm.queries import ORACLES, QUERIES
from tests.compare import connect, spark_rows, sql_rows
from tests.llm.test_pipeline import expected_mix

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    columns, rows = spark_rows(QUERIES[name](spark, FOLDER))
    assert rows and (columns, rows) == sql_rows(connect(FOLDER), ORACLES[name])


def odd_rows(spark, texts):
    """Texts with null and repeated ids, null sources, and columns whose names the operators use themselves."""
    rows = [(None if i % 7 == 3 else i - i % 2, t, None if i % 5 == 0 else f"s{i % 3}", "x", "y", 1, "z") for i, t in enumerate(texts)]
    return rows, spark.createDataFrame(
        rows, "doc_id long, text string, source string, row string, id string, size int, name string").repartition(3)


# Exact dedup

@pytest.mark.parametrize("block", [1, 4, 4096])
def test_exact_groups(spark, block):
    rng = random.Random(block)
    texts = [None, "", "a" * 17, "a" * 16, "a" * 15, "ab" * 8, "é" * 9, "é" * 9 + "a"]
    texts += ["".join(rng.choice("ab") for _ in range(rng.choice([3, 4, 5, 9]))) for _ in range(60)] + ["\x00", "\x00\x00"]
    rows, docs = odd_rows(spark, texts)
    groups: dict[str, list] = {}
    for r in rows:
        groups.setdefault(r[1] or "", []).append(r[0])
    got = exact_dedup.exact_duplicates(docs, block_bytes=block).collect()
    assert len(got) == len(rows)
    by_digest = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_digest[r["text_sha256"]]
        known = [i for i in ids if i is not None]
        assert (r["group_size"], r["keep_id"]) == (len(ids), max(known, default=None))
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    for digest in by_digest:
        assert sum(r["kept"] for r in got if r["text_sha256"] == digest) == 1
    assert exact_dedup.exact_duplicates(docs.limit(0)).count() == 0


def test_keys_that_meet_are_drawn_anew(spark, monkeypatch):
    drawn = []
    strong = exact_dedup._key

    def key(block, draw):
        drawn.append(draw)
        weak = F.struct(F.length(block).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
        return weak if draw == 0 else strong(block, draw)

    monkeypatch.setattr(exact_dedup, "_key", key)
    docs = spark.createDataFrame([(1, "ab"), (2, "cd"), (3, "ab")], "doc_id long, text string")
    got = {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_duplicates(docs).collect()}
    assert got == {1: 3, 2: 2, 3: 3} and max(drawn) == 1


# SimHash

def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("bucket", [1024, 2])
def test_simhash_components(spark, bucket):
    rng = random.Random(bucket)
    base = [" ".join(rng.choice("abcdefg") * rng.randrange(1, 4) for _ in range(120)) for _ in range(12)]
    texts = [None, "", " \n", "One two", "one TWO", "É a b c", "é A b c", "x"] + base
    for t in base:
        w = t.split()
        for _ in range(5):
            w = w[:]
            w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    rows, docs = odd_rows(spark, texts)
    prints = [plain_fingerprint(r[1]) for r in rows]
    root = list(range(len(rows)))
    while True:
        new = [min(root[j] for j in range(len(rows)) if (prints[i] ^ prints[j]).bit_count() <= 2) for i in range(len(rows))]
        if new == root:
            break
        root = new
    smallest = {}
    for r, c in zip(rows, root):
        smallest[c] = min((i for i in (smallest.get(c), r[0]) if i is not None), default=None)
    want = sorted(((r[0], f"{p:016x}", smallest[c]) for r, p, c in zip(rows, prints, root)), key=str)
    got = simhash.near_duplicates(docs, bucket=bucket).collect()
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got), key=str) == want
    assert sum(r["kept"] for r in got) == len(set(root)) < len(rows)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_chains_lose_no_pair():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a = int(rng.integers(0, 1 << 63)) * 2
        b = a
        for bit in rng.choice(64, rng.integers(0, 3), replace=False):
            b ^= 1 << int(bit)
        if a == b:
            continue
        pair = np.array([a, b], np.uint64)
        ring = simhash.ring_masks()
        starts = [s for s in range(9) if (a ^ b) & simhash.chain_masks(s, ring)[3] == 0]
        assert any(len(simhash.linked(pair, s, 9, 2)[0]) for s in starts)
    assert sum(simhash.ring_masks()) == (1 << 64) - 1


def test_components_of_long_paths(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 102), (101, 102), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[101] == got[102] == 100


# Mixing

def test_mix_on_odd_rows(spark):
    rng = random.Random(8)
    texts = ["word " * rng.randrange(0, 30) for _ in range(80)] + [None, " a b", "x" * 1000]
    rows = [(i, t, rng.choice(["b", "a", "é", "", None]), 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, taken int").repartition(3)
    sizes = {i: len((t or "").encode().split()) for i, t, *_ in rows}
    target, copies = expected_mix([(i, s, sizes[i]) for i, _, s, _ in rows])
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    source = {i: s for i, _, s, _ in rows}
    for r in got:
        assert r["size"] == sizes[r["doc_id"]] and r["taken"] == copies.get(r["doc_id"], 0) * r["size"] <= 3 * r["size"]
        assert abs(r["target"] - target[source[r["doc_id"]]]) < 1e-6
    assert sorted(map(tuple, got)) != [] and mixing.mix(docs.limit(0)).count() == 0


def test_mix_with_null_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, "a b", "s"), (None, "a b", "s"), (1, "c", "s"), (1, "c", None)], "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    assert len(got) == 4 and sum(r["taken"] for r in got) > 0


def test_targets_stop_at_the_cap(spark):
    sources = spark.createDataFrame([("+a", "a", 1000), ("+b", "b", 10), ("+c", "c", 100)], "key string, source string, source_size long")
    got = {r["key"]: r["target"] for r in mixing.source_targets(sources).collect()}
    assert got == {"+a": 780.0, "+b": 30.0, "+c": 300.0}


# Quality rules

def test_lines_that_a_host_repeats(spark):
    own = [" ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}word{chr(97 + k)}" for k in range(15)) for i in range(60)]
    menu = " ".join(f"menu{a}{b}" for a in "abc" for b in "abcdefghijklmnopqrstuvwxyz")
    full = "\n".join(own[:6])
    rows = [(i, f"{menu} {i}\n{own[i + 10]}\n{own[i + 11]}\n", "host", None) for i in range(30)]
    rows += [(100, full, "host", None), (101, f"{menu} 7\n{full}\n{full.upper()}", "other", None), (102, None, None, "x")]
    rows += [(200 + i, full + " same text", "host", None) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, removed string").repartition(4)
    got = {r["doc_id"]: r for r in quality.judged(docs, max_documents=20).collect()}
    assert got[0]["kept"] and not any(got[i]["kept"] for i in range(1, 30))
    assert got[100]["kept"] and got[101]["kept"] and all(got[200 + i]["kept"] for i in range(40))
    assert got[102]["base_failed"] and got[102]["n_words"] == 0
    assert quality.judged(docs.limit(0)).count() == 0
    keyed = docs.withColumn("key", F.col("doc_id"))
    texts = {r["row"]: r["text"] for r in quality.without_frequent_lines(keyed, "key", max_documents=20).collect()}
    assert texts[0] == rows[0][1] and texts[100] == full and texts[102] is None
    assert texts[3] == f"{own[13]}\n{own[14]}\n"


def test_the_line_limit_does_not_grow_with_the_host(spark):
    """A line in 30 documents goes, whether its host has 30 documents or 1,500; a very long text counts like any other."""
    def word(i):
        return "".join(chr(97 + (i // 26 ** k) % 26) for k in range(4))

    menu = " ".join(word(90_000 + i) for i in range(80))
    rows = [(i, f"{menu}\n" + " ".join(word(40 * i + k) for k in range(40)), "host") for i in range(30)]
    others = [(1000 + i, " ".join(word(200_000 + 60 * i + k) for k in range(60)), "host") for i in range(1500)]
    long = (5000, "\n".join(" ".join(word(3 * i + k) for k in range(9)) for i in range(60_000)), "host")
    verdicts = []
    for table in (rows, rows + others + [long]):
        docs = spark.createDataFrame(table, "doc_id long, text string, source string")
        got = {r["doc_id"]: r for r in quality.judged(docs).collect()}
        verdicts.append([got[i]["kept"] for i in range(30)])
    assert verdicts[0] == verdicts[1] == [True] + [False] * 29 and all(got[1000 + i]["kept"] for i in range(1500))
    assert got[5000]["n_words"] == 540_000


def test_mix_of_empty_and_nameless_documents(spark):
    """Empty documents are taken as often as their source's others; rows without an id are drawn by their text."""
    rows = [(i, "a b c " * 2000, "x") for i in range(10)] + [(20 + i, "", "x") for i in range(5)] + [(40 + i, "", "none") for i in range(3)]
    rows += [(None, " ".join(["w"] * (1 + i)) + f" {i}", "y") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = []
    for parts in (1, 5):
        got = mixing.mix(docs.repartition(parts)).collect()
        assert all(r["copies"] <= mixing.MAX_EPOCHS for r in got)
        empty = [r for r in got if r["size"] == 0]
        assert {r["copies"] for r in empty if r["source_size"] == 0} == {0} and len(empty) == 8
        sizes.append(sorted((r["size"], r["copies"]) for r in got if r["doc_id"] is None))
    assert sizes[0] == sizes[1] and len({c for _, c in sizes[0]}) > 1


def test_repeated_words():
    assert quality.repeated_words([]) == quality.repeated_words([b"a"] * 3) == 0
    assert quality.repeated_words([b"a"] * 4) == 4
    assert quality.repeated_words(b"a b c x a b c y".split()) == 6
    assert quality.measures("a\nb\na\n\n \n a\n#é|") == (5, 7, 2, 1, 0, {b"a": 3, b"b": 1, b"#\xc3\xa9|": 1})
