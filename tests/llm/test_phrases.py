"""Collocated phrases against a plain count of every phrase."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from spotlake.llm import phrases, textparts


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_counts(rows):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            counts.update((lang, tuple(words[i:i + n])) for n in range(1, 5) for i in range(len(words) - n + 1))
    return counts, totals


def plain(rows, min_count, top):
    counts, totals = plain_counts(rows)
    found = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= min_count}
    longest = Counter()
    for (lang, words), a in found.items():
        for n in range(2, len(words)):
            for i in range(len(words) - n + 1):
                key = (lang, words[i:i + n])
                longest[key] = max(longest[key], a)
    scored: dict[str, list] = {}
    for (lang, words), a in found.items():
        if 100 * longest[lang, words] >= 80 * a:
            continue
        cuts = [(counts[lang, words[:k]], counts[lang, words[k:]]) for k in range(1, len(words))]
        score, _, left, right = min((2000000 * a // (x + y), k, x, y) for k, (x, y) in enumerate(cuts))
        scored.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    return sorted((lang, rank, p.decode(), -a, x, y, totals[lang], -score) for lang, found in scored.items()
                  for rank, (score, a, p, x, y) in enumerate(sorted(found)[:top], 1))


def texts(seed, rows):
    rng = random.Random(seed)
    words = ["a", "B", "b", "c", "dé", "Àx", "e\x00f", "g h", "\U0001f600"]
    marks = [" ", " ", " ", "  ", "\t", ".", ", ", "\n", "\r\n", "!?", " ;: "]
    out = [("en", None), (None, ""), ("en", " \t. "), ("", "a b c a b c a b c"), ("und", "b c b c"), (None, "b c b c")]
    return out + [(rng.choice(["en", "en", None, "de", ""]),
                   "".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.randrange(60)))) for _ in range(rows)]


@pytest.mark.parametrize("chunk, bits, shards, min_count", [(64, 24, 2, 4), (8, 3, 3, 3), (8 << 20, 1, 1, 6)])
def test_phrases_equal_plain_counts(spark, monkeypatch, chunk, bits, shards, min_count):
    """Small chunks cut texts at every mark; a few slots make almost all phrases meet."""
    monkeypatch.setattr(textparts.parts_of, "__defaults__", (chunk,))
    monkeypatch.setattr(phrases, "SLOT_BITS", bits)
    rows = texts(bits, 60)
    docs = spark.createDataFrame([(None, t, lang, 1, "x") for lang, t in rows], "doc_id long, text string, lang string, n int, phrase string")
    got = phrases.collocations(docs.repartition(3), min_count=min_count, top=7, shards=shards).collect()
    assert sorted(tuple(r) for r in got) == plain(rows, min_count, 7)
    assert len(got) >= 7


def test_a_very_long_text_and_an_empty_table(spark):
    long = [("en", "x y " * 400_000 + ". " + "p q r; " * 200_000)]
    docs = spark.createDataFrame([(1, t, lang) for lang, t in long], "doc_id long, text string, lang string")
    assert sorted(tuple(r) for r in phrases.collocations(docs, shards=2).collect()) == plain(long, 30, 2000)
    assert phrases.collocations(docs.limit(0)).count() == 0


def test_score_of_large_counts(spark):
    """The product passes 64 bits above a count of 4.6e12."""
    a, left, right = 9 * 10**15, 9 * 10**15 + 7, 10**16 + 1
    assert 2_000_000 * a > 2**63
    row = spark.range(1).selectExpr(f"{a}L AS a", f"{left}L AS l", f"{right}L AS r").select(phrases.score_of("a", "l", "r").alias("s")).first()
    assert row["s"] == 2_000_000 * a // (left + right)
