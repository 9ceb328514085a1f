"""Language, toxicity and archives: held-out accuracy, exact kernels, round trips."""

from __future__ import annotations

import gzip
import itertools
import random
import zlib
from collections import Counter
from hashlib import sha1

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotlake.llm import language, toxicity, warc

FOLDER = "/root/testdata/sf0.01"


# Language

def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = language.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    held = {r["doc_id"] for r in got}
    assert held == {r["doc_id"] for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1}
    assert sum(r["lang"] == r["lang_pred"] for r in got) > 0.97 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_grams_by_counter():
    text = "Ab  ÀB, x1y 😀𐐀z"
    words = ["ab", "àb", "x", "y", "𐐨z"]
    want = Counter(g for w in words for n in (1, 2, 3) for i in range(len(w) + 3 - n)
                   if (g := f" {w} "[i:i + n]) and len(g) == n and g != " ")
    grams, counts = language.text_grams(text)
    unpack = lambda g: "".join(chr(c).replace("\x01", " ") for i in range(3) if (c := int(g) >> 21 * i & 0x1FFFFF))
    assert {unpack(g): int(n) for g, n in zip(grams, counts)} == want


def test_language_reads_long_texts_in_pieces(monkeypatch):
    text = "some words of a text that is read in pieces " * 50
    whole = [a.tolist() for a in language.text_grams(text)]
    monkeypatch.setattr(language, "_PIECE", 64)
    assert [a.tolist() for a in language.text_grams(text)] == whole


def plain_language(rows, size, text_size):
    """Profiles, out-of-place distances, predictions and scores, word by word."""
    def grams(text):
        words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        return Counter(f" {w} "[i:i + n] for w in words for n in (1, 2, 3) for i in range(len(w) + 3 - n) if f" {w} "[i:i + n] != " ")

    def ranks(counts, limit):
        def code(gram):
            return sum((1 if c == " " else ord(c)) << 21 * k for k, c in enumerate(gram))
        return sorted(counts, key=lambda g: (-counts[g], code(g)))[:limit]

    learned = {}
    for i, text, lang in rows:
        if text is not None and lang is not None and (i is None or zlib.crc32(str(i).encode()) % 3 != 1):
            learned.setdefault(lang, Counter()).update(grams(text))
    places = {lang: {g: k for k, g in enumerate(ranks(c, size))} for lang, c in learned.items()}
    out = []
    for i, text, _ in rows:
        own = ranks(grams(text or ""), text_size)
        if not own or not places:
            out.append((i, "und", 0.0))
            continue
        far = {lang: sum(min(size, abs(p[g] - k)) if g in p else size for k, g in enumerate(own)) / (size * len(own)) for lang, p in places.items()}
        best = min(sorted(far), key=far.get)
        out.append((i, best, round(1 - far[best], 9)))
    return out


@pytest.mark.parametrize("size, text_size", [(400, 300), (15, 9)])
def test_language_equals_a_plain_ranking(spark, size, text_size):
    """Profiles, distances, ties and scores on short texts of made-up languages; small profiles make many ties."""
    rng = random.Random(size)
    letters = {"aa": "abcdeé", "bb": "defghß", "cc": "abgxyz", "dd": "жзик中"}
    rows = []
    for i in range(160):
        lang = rng.choice([*letters, None])
        pool = letters[lang] if lang else "abcdefgh"
        rows.append((i if i % 9 else None, " ".join("".join(rng.choice(pool) for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(1, 30)))
                     + rng.choice(["", "!", " 12", "\n"]), lang))
    rows += [(900, "A1B2 c", "aa"), (901, "", "aa"), (902, None, "bb"), (903, "123 ?", None), (904, "ÀÉ İx", "cc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = language.languages(docs, size=size, text_size=text_size).collect()
    assert sorted(((r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in got), key=str) == sorted(plain_language(rows, size, text_size), key=str)


def test_language_edge_cases(spark):
    rows = [(i, "the cat and the dog " * 3, "en", None) for i in range(9)] + [(20 + i, "der hund und die katze " * 3, "de", None) for i in range(9)]
    rows += [(40, None, "en", None), (41, "123 ...", "en", None), (None, "der hund", None, "x"), (None, "the dog", "en", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, held_out string").repartition(3)
    got = {(r["doc_id"], r["lang_pred"]) for r in language.languages(docs).collect()}
    assert {(40, "und"), (41, "und"), (None, "de"), (None, "en"), (0, "en"), (20, "de")} <= got
    assert language.languages(docs.limit(0)).count() == 0
    unlabelled = language.languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in unlabelled} == {("und", 0.0)}


# Toxicity

def plain_kernel(s, t, order=toxicity.ORDER, decay=toxicity.DECAY):
    total = 0.0
    for a in itertools.combinations(range(len(s)), order):
        for b in itertools.combinations(range(len(t)), order):
            if all(s[i] == t[j] for i, j in zip(a, b)):
                total += decay ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
    return total


def test_kernel_counts_subsequences():
    # In the recursion every letter of the subsequence and every skipped one costs a factor.
    pairs = [(b"idiot", b"idiot"), (b"idi-ot", b"idiot"), (b"abcabc", b"cab"), (b"ab", b"abc"), (b"loser", b"moron")]
    got = toxicity.kernel([a for a, _ in pairs], [b for _, b in pairs])
    assert np.allclose(got, [plain_kernel(a, b) for a, b in pairs])


def test_gapped_insults_stay_close():
    close = toxicity.Closeness([b"idiot", b"worthless"])
    values = close.to_landmarks([b"idiot", b"IDIOT".lower() + b"!!", b"i-d-i-o-t", b"idi*ot", b"worth-less", b"table", b"x" * 100 + b"idiot"])
    assert values[0, 0] == pytest.approx(1) and values[1, 0] == pytest.approx(1)
    assert values[3, 0] > 0.5 and values[2, 0] > 0.1 and values[4, 1] > 0.6 and values[5].max() == 0 and values[6, 0] > 0
    found = toxicity.sentences("you i d i o t here. Fine words.\nAn idiot", close)
    assert len(found) == 2 and found[0, 0] == pytest.approx(1)
    assert len(toxicity.sentences(None, close)) == len(toxicity.sentences("", close)) == 0


def test_pieces_are_whole(monkeypatch):
    monkeypatch.setattr(toxicity, "_PIECE", 10)
    for body in (b"", b"abc", b"abc def ghi jkl", b"a" * 35, b"ab\n" * 20):
        assert b"".join(toxicity._pieces(body)) == body


def test_toxicity_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    some = docs.join(labels.select("doc_id"), "doc_id").where("length(text) < 3000")
    got = toxicity.toxicity(some, labels).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    bad, good = [r for r in got if r["toxic"]], [r for r in got if not r["toxic"]]
    assert sum(r["predicted"] for r in bad) > 0.6 * len(bad)
    assert sum(r["predicted"] for r in good) < 0.03 * len(good)
    assert all(r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in got)


def test_toxicity_edge_cases(spark):
    rows = [(i, f"plain words number {i} are here", None) for i in range(60)] + [(100 + i, f"you are an awful idiot {i}", None) for i in range(60)]
    rows += [(300, None, "x"), (301, "", "x"), (None, "you i-d-i-o-t", "x"), (None, "plain words", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string").repartition(3)
    labels = spark.createDataFrame([(i, int(i >= 100)) for i, *_ in rows if i is not None] + [(None, 1), (5, None), (100, 0)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    score = {(r["doc_id"], r["predicted"]) for r in got}
    assert len(got) == len(rows) and {(0, 0), (300, 0), (301, 0), (101, 1)} <= score
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    assert {r["score"] for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.0}


# Archives

def test_archives_round_trip(spark):
    big = "é" * 600
    rows = [(1, "http://a b/", big, "x"), (2, None, big, "x"), (3, "http://c", big, "x"), (3, "http://c", big, "x"), (4, "u", "short", "x"), (5, "u", "short", "x"),
            (6, "u", None, "x"), (7, "u", "", "x"), (None, "u", big, "x"), (8, "u", "\r\n\r\nWARC/1.1\r\n" * 200, "x"), (9, "u", "\x00" * 2000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string").repartition(3)
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect()), key=str)
    want = []
    for i, _, html, _ in rows:
        body = (html or "").encode()
        revisit = html == big and i != 3
        want.append((i, len(body), sha1(body).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None))
    want[2] = (*want[2][:3], "revisit", 3)
    assert got == sorted(want, key=str)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_records_are_written_as_archives_only(spark, tmp_path, monkeypatch):
    tables, written = [], warc.materialise
    monkeypatch.setattr(warc, "materialise", lambda df, label: tables.append(df.columns) or written(df, label))
    pages = spark.createDataFrame([(i, f"u{i}", "x" * 2000) for i in range(5)], "page_id long, url string, html string")
    assert {r["record_type"] for r in warc.round_trip(pages).collect()} == {"response", "revisit"}
    # The one copy of the pages is that of rows that are no plain scan.
    assert [c for c in tables if {"record", "body"} & set(c)] == []


def test_archives_are_cut_by_bytes(spark, tmp_path):
    """Few long records and many short ones fill archives alike; a very long one does not grow with its neighbours."""
    rows = [(i, f"u{i}", f"{i} " * (50 if i % 3 else 5000)) for i in range(300)] + [(999, "u", "long page " * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    warc.write_archives(warc.records(pages), str(tmp_path / "a"), archive_bytes=500_000)
    sizes = [len(gzip.decompress(f.read_bytes())) for f in (tmp_path / "a").glob("*.gz")]
    assert len(sizes) >= 8 and sorted(sizes)[-2] < 2_000_000 < sum(sizes) / 2 and sum(s > 3_000_000 for s in sizes) == 1
    index = warc.normalise(spark, str(tmp_path / "a"), f"file://{tmp_path}/n")
    got = {int(r["page_id"]): r["payload_bytes"] for r in warc.read_records(index, f"file://{tmp_path}/n").collect()}
    assert got == {i: len(html) for i, _, html in rows}


def record(n, body):
    return b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:%d>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (n, len(body), body)


def test_every_record_becomes_a_member():
    records = [record(1, b"abc"), record(2, b""), record(3, bytes(3_000_000)), record(4, b"\r\n\r\n")]
    for content in (gzip.compress(b"".join(records)), b"".join(map(gzip.compress, records)),
                    gzip.compress(b"".join(records[:2])) + gzip.compress(b"".join(records[2:]))):
        got = [zlib.decompress(member, 31) for _, member in warc.members(content)]
        assert got == records
    assert list(warc.members(gzip.compress(b""))) == []
    with pytest.raises(ValueError):
        list(warc.members(gzip.compress(records[0][:-8])))
