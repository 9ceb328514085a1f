"""Spelling variants against all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from spotlake.llm import spelling, textparts


def plain_words(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def plain_variants(rows):
    words = plain_words(rows)
    forms, out = {}, {}
    for w, n in words.items():
        near = [x for x in words if is_near(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best is not None and words[best] >= 5 * n else None
        out[w] = len(near)
    result = []
    for w, n in words.items():
        end = w
        while forms[end] is not None:
            end = forms[end]
        result.append((w, forms[w], end, n, out[w], words[forms[w]] if forms[w] else None))
    return sorted(result)


def texts(seed):
    """A few roots with frequent and rare misspellings, in chains, in letters of one and two bytes."""
    rng = random.Random(seed)
    letters = "abéÿ×Z"
    roots = ["".join(rng.choice(letters) for _ in range(rng.randrange(5, 12))) for _ in range(12)]
    pool = []
    for root in roots:
        word, n = root, 400
        while n >= 3:
            pool += [word] * n
            at, n = rng.randrange(len(word) + 1), n // rng.choice([2, 5, 6])
            word = rng.choice([word[:at] + word[at + 1:], word[:at] + rng.choice(letters) + word[at:], word[:at] + rng.choice(letters) + word[at + 1:]])
    rng.shuffle(pool)
    rows = [(None, None), (1, ""), (2, "中文 1234 !"), (None, "abcdefg" * 300)]
    marks = [" ", ". ", "-", "1", "—", "\n", "¿", "Ā"]
    while pool:
        some, pool = pool[:rng.randrange(1, 60)], pool[60:]
        rows.append((rng.choice([None, len(pool), 7]), "".join(w + rng.choice(marks) for w in some)))
    return rows + [(5, "longestword" * 400 + " ") for _ in range(6)]


@pytest.mark.parametrize("part, sample, cell, leaf", [(8 << 20, 65536, 64, 16), (40, 50, 3, 2), (16, 5, 1, 1)])
def test_variants_equal_all_pairs(spark, monkeypatch, part, sample, cell, leaf):
    """Small parts cut texts between words; small samples and leaves make deep trees and lengths without a sampled word."""
    monkeypatch.setattr(textparts.parts_of, "__defaults__", (part,))
    monkeypatch.setattr(spelling, "SAMPLE", sample)
    monkeypatch.setattr(spelling, "CELL_SAMPLE", cell)
    monkeypatch.setattr(spelling, "LEAF", leaf)
    rows = texts(sample)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n int").repartition(4)
    got = sorted(tuple(r) for r in spelling.variants(docs).collect())
    assert sorted(got, key=str) == sorted(plain_variants(rows), key=str)
    assert any(r[1] for r in got) and any(r[2] != r[1] and r[1] for r in got)
    assert spelling.variants(docs.limit(0)).count() == 0


def test_words_of_the_given_table(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in spelling.variants(docs).collect()), key=str)
    assert got == sorted(plain_variants(rows), key=str)


def test_joined_hashes():
    rng = random.Random(2)
    heads = [bytes(rng.randrange(256) for _ in range(rng.randrange(9))) for _ in range(300)]
    tails = [bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 2, 7, 300]))) for _ in range(300)]
    got = spelling.hashes(np.array([zlib.crc32(h) for h in heads], np.uint32), np.array([zlib.crc32(t) for t in tails], np.uint32),
                          np.array([len(t) for t in tails]))
    assert got.tolist() == [zlib.crc32(h + t) for h, t in zip(heads, tails)]


def test_parts_keep_all_words():
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab .") for _ in range(rng.randrange(40))) for _ in range(50)] + ["", "a" * 500, "", ""]
    cut = np.zeros(256, bool)
    cut[[32, 46]] = True
    for size in (1, 7, 64, 1 << 20):
        found = []
        for data, begins, rows in textparts.parts_of(pa.array(texts).slice(3), cut, size):
            words, word, text, _ = textparts.words_in(data, begins, ~cut[data])
            found += [(int(rows[t]), words[w].as_py().decode()) for t, w in zip(text, word.tolist())]
        assert found == [(i, w) for i, t in enumerate(texts[3:]) for w in re.findall("[ab]+", t)]
