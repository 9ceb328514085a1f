"""Packing against the tokenizer itself: every id in exactly one place, sequences full or powers of two."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from spotlake.llm.packing import END_ID, Index, document_frequencies, encoder, fill, pack, powers, tokenised

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check(rows, texts, tokenizer, window=2048):
    """The pieces of texts (by distinct id) cover them, and sequences are gapless."""
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [END_ID] for i, t in texts.items()}
    pieces, sequences = {i: [] for i in texts}, {}
    for r in rows:
        doc = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(doc)
        part = np.array(doc[r["start"]:r["start"] + r["length"]], "<u4")
        assert len(part) == r["length"] > 0 and zlib.crc32(part.tobytes()) == r["ids_crc32"]
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, got in pieces.items():
        at = 0
        for start, length in sorted(got):
            assert start == at
            at += length
        assert at == len(ids[i])
    for got in sequences.values():
        at = 0
        for offset, length in sorted(got):
            assert offset == at
            at += length
        assert at <= window and at & (at - 1) == 0
    return sequences


def test_documents_of_the_small_table(spark, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    rows = pack(docs, RANKS, PATTERN, shard_tokens=20_000).collect()
    assert len({r["sequence_id"] >> 32 for r in rows}) > 1
    sequences = check(rows, texts, tokenizer)
    whole = sum(1 for s in sequences.values() if sum(n for _, n in s) == 2048)
    assert whole > 0.5 * len(sequences)


def test_edge_cases(spark, tokenizer):
    texts = {0: None, 1: "", 2: "x" * 50_000, 3: "word " * 9000, 4: "😀é퟿" * 10, 5: "a", 6: "a", 7: " \n\t "}
    docs = spark.createDataFrame([(i, t, 9) for i, t in texts.items()], "doc_id long, text string, shard int").repartition(3)
    check(pack(docs, RANKS, PATTERN).collect(), texts, tokenizer)
    assert pack(docs.limit(0), RANKS, PATTERN).count() == 0
    twice = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["length"]) for r in pack(twice, RANKS, PATTERN).collect())
    assert sum(n for i, n in got if i == "None") == sum(n for i, n in got if i == "1") == 6


def test_added_token_in_texts(spark, tokenizer):
    end = "<|endoftext|>"
    texts = dict(enumerate([f"{end}a b", f"a {end} b", f"a b{end}", end, f"{end}{end} \n {end}", f"x  {end}  y", end[:-1], f"<{end}>", (end + " word") * 3000]))
    assert tokenizer.encode(end, add_special_tokens=False).ids == [50256]
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check(pack(docs, RANKS, PATTERN).collect(), texts, tokenizer)


def test_neighbours_share_rare_terms():
    tails = [np.array(t, np.uint16) for t in ([1, 2, 3], [1, 9, 9], [2, 3, 7], [5, 6])]
    index = Index(tails, np.ones(1 << 16), 3.0)
    assert index.neighbours(0, np.ones(4, bool)).tolist()[0] in (0, 2)
    assert index.neighbours(0, np.array([False, True, True, True])).tolist() == [2, 1]
    assert index.neighbours(0, np.array([False, True, False, True])).tolist() == [1]


def test_seeds_ask_with_all_terms_of_whole_documents(spark):
    rng = np.random.default_rng(5)
    tails = [np.sort(rng.choice(200, rng.integers(1, 80), False)).astype(np.uint16) for _ in range(300)]
    rarity = rng.random(1 << 16) + 0.1
    index = Index(tails, rarity, 40.0)
    for seed in (0, 7, 299):
        want = [sum(rarity[t] * 2.2 / (1 + 1.2 * (0.25 + 0.75 * len(d) / 40)) for t in set(d) & set(tails[seed])) for d in tails]
        assert np.allclose(index.scores(seed), want, rtol=1e-4)
        got = index.neighbours(seed, np.ones(300, bool))
        assert set(got.tolist()) == {i for i, w in enumerate(want) if w} and (np.diff(np.array(want)[got]) < 1e-3).all()
    # The text before the last full window counts, the end id does not.
    docs = spark.createDataFrame([(0, "alpha " * 20), (1, " beta" + " alpha" * 20), (2, "")], "doc_id long, text string")
    tokens = tokenised(docs, RANKS, PATTERN, "doc_id", "text", 8, None)
    seen = document_frequencies(tokens)
    encoding = encoder(RANKS, PATTERN)
    assert seen[encoding.encode(" beta")[0]] == 1 and seen[encoding.encode(" alpha")[0]] == 2 and seen[END_ID] == 0


def test_related_documents_meet_in_a_shard(spark):
    rng = np.random.default_rng(11)
    topics = [[f"{chr(97 + k)}{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(150)] for k in range(6)]
    rows = [(i, " ".join(rng.choice(topics[i % 6], 120))) for i in range(360)] + [(1000 + i, "the same text " * 20) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    shards: dict[int, set] = {}
    for r in pack(docs, RANKS, PATTERN, shard_tokens=20_000).collect():
        shards.setdefault(r["sequence_id"] >> 32, set()).add(r["doc_id"])
    home = {d: s for s, ids in shards.items() for d in ids}
    assert len(shards) > 5 and len(home) == len(rows)
    met = [home[a] == home[b] for a in range(360) for b in range(a + 6, 360, 6)]
    assert np.mean(met) > 0.4 > 2 / len(shards)
    # Copies are many shards' worth, and dealt out.
    assert len({home[1000 + i] for i in range(300)}) > 1 and max(map(len, shards.values())) < 250


def test_fill_and_powers_keep_every_id():
    rng = np.random.default_rng(3)
    lengths = rng.integers(0, 40, 50)
    seen = {i: set() for i in range(50)}
    for parts in fill(lengths, lambda s, unused: np.flatnonzero(unused & (np.arange(50) % 3 == s % 3)), 40):
        for doc, start, size in parts:
            span = set(range(start, start + size))
            assert not span & seen[doc]
            seen[doc] |= span
    assert all(seen[i] == set(range(lengths[i])) for i in range(50))
    assert [[p[2] for p in w] for w in powers([(0, 0, 5), (1, 3, 6)], 11)] == [[5, 3], [2], [1]]
