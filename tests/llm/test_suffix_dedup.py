"""Repeated passages against a dictionary of all strings."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from spotlake.llm.suffix_dedup import anchors, least_places, repeats_of_earlier, without_repeats


def expected(texts, length=100):
    """Per document in order: bytes, removed bytes, runs, digest of the rest."""
    seen, out = set(), []
    for text in texts:
        body = (text or "").encode()
        gone = np.zeros(len(body) + 1, bool)
        for s in range(len(body) - length + 1):
            part = body[s:s + length]
            if part in seen:
                gone[s:s + length] = True
            seen.add(part)
        gone = gone[:len(body)]
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()) if len(body) else 0
        out.append((len(body), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(body, np.uint8)[~gone])).hexdigest()))
    return out


def random_texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randrange(2, 9)))
    passages = ["".join(word() for _ in range(rng.randrange(10, 80))) for _ in range(12)]
    texts = [None, "", "a" * 99, "a" * 100, "a" * 101, "b" * 5000, "b" * 300, "ab" * 400, "\0" * 150, "x" + "\0" * 120]
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            p = rng.choice(passages)
            if rng.random() < 0.5:
                a, b = sorted(rng.randrange(len(p) + 1) for _ in range(2))
                p = p[a:b]
            if rng.random() < 0.3 and p:
                i = rng.randrange(len(p))
                p = p[:i] + word() + p[i + 1:]
            parts.append(p + (word() * 3 if rng.random() < 0.5 else ""))
        texts.append("".join(parts))
    return texts + texts[20:30]


def rows_of(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()}


@pytest.mark.parametrize("crowd", [20_000, 3])
def test_random_texts(spark, crowd):
    texts = random_texts(crowd)
    docs = spark.createDataFrame([(3 * i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, row string").repartition(5)
    got = rows_of(without_repeats(docs, crowd=crowd))
    for i, want in enumerate(expected(texts)):
        assert got[3 * i] == want, (i, texts[i])


def test_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = docs.orderBy("doc_id").collect()
    got = rows_of(without_repeats(docs))
    assert [got[r["doc_id"]] for r in texts] == expected([r["text"] for r in texts])


def test_null_and_repeated_ids(spark):
    passage = "".join(random.Random(1).choices("abcdefgh ", k=300))
    docs = spark.createDataFrame([(None, passage), (2, passage), (2, passage), (1, "z"), (None, None)], "doc_id long, text string")
    rows = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"]) for r in without_repeats(docs).collect())
    assert rows == [("1", 1, 0), ("2", 300, 0), ("2", 300, 300), ("None", 0, 0), ("None", 300, 300)]
    assert without_repeats(docs.limit(0)).count() == 0


def test_long_text_in_segments(spark, monkeypatch):
    monkeypatch.setattr("spotlake.llm.suffix_dedup._SEGMENT", 700)
    monkeypatch.setattr("spotlake.llm.suffix_dedup._BATCH", 1500)
    texts = random_texts(9)
    texts.append("".join(t or "" for t in texts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = rows_of(without_repeats(docs))
    assert [got[i] for i in range(len(texts))] == expected(texts)


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(4)
    assert least_places(np.array([5, 3, 4, 1, 9], np.uint64), 3).tolist() == [3, 1, 1]
    bodies = [bytes(rng.integers(97, 100, n, np.uint8)) for n in (50, 100, 101, 400, 2000)]
    windows = {}
    for number, place, first, last, _ in anchors(bodies):
        for n, p, a, b in zip(number, place, first, last):
            for s in range(a, b + 1):
                windows[n, s] = p - s
    assert set(windows) == {(n, s) for n, b in enumerate(bodies) for s in range(len(b) - 99)}
    assert all(0 <= o <= 76 for o in windows.values())


def test_multikey_sort_finds_later_copies():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 2, (200, 5)).astype(np.uint64)
    seen, want = set(), []
    for i, w in enumerate(words):
        want += [i] * (tuple(w) in seen)
        seen.add(tuple(w))
    assert sorted(repeats_of_earlier(words).tolist()) == want
