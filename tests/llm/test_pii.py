"""Base spans against Python's regular expressions; the classifier's additions on small texts."""

from __future__ import annotations

import hashlib
import random
import re

from spotlake.llm.pii import personal_data, reliabilities

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def passes(kind, span):
    digits = re.sub("[^0-9]", "", span)
    if kind == "ip":
        return all(int(p) <= 255 for p in span.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 10 <= len(digits) <= 15
    return True


def expected(text):
    text = text or ""
    spans = sorted((m.start(), k, m.end(), kind) for k, kind in enumerate(BASE) for m in re.finditer(BASE[kind], text)
                   if passes(kind, m.group()))
    joined = ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in spans)
    return [sum(s[3] == k for s in spans) for k in BASE], hashlib.sha256(joined.encode()).hexdigest(), joined


def random_text(rng):
    pieces = ["a@b.c", "x_y.z%1+2-3@m-1.example.com", "@", ".", "a@b", "_q@w.e", "1.2.3.4", "300.1.1.1", "0255.1.2.03", "1.2.3.4.5.6.7.8",
              "4111 1111 1111 1111", "4111-1111-1111-1112", "12345678901234", "+1 (555) 010-9999", "+12", "+1..2", "+", " ", "  ", "\n", "é", "😀",
              "ß1", "-", "5500005555555559", "+441632960961 ", "text", "(555) 867-5309", "123-45-6789", "\x01", "%"]
    return "".join(rng.choice(pieces) for _ in range(rng.randrange(0, 30)))


def test_base_spans_equal_python(spark):
    rng = random.Random(5)
    texts = [None, "", "a" * 200_000 + "@", "1" * 50_000, ("a.b@c.d " * 3000)] + [random_text(rng) for _ in range(400)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string").repartition(4)
    for r in personal_data(docs).collect():
        counts, digest, joined = expected(texts[r["doc_id"]])
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == counts, texts[r["doc_id"]]
        assert r["base_sha256"] == digest, (texts[r["doc_id"]], joined, r["spans"])
        assert set(filter(None, joined.split(","))) <= set(r["spans"].split(","))


def test_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a@b.c"), (None, "a@b.c"), (1, None)], "doc_id long, text string")
    rows = sorted(personal_data(docs).select("doc_id", "n_email", "spans").collect(), key=str)
    assert [tuple(r) for r in rows] == [(1, 0, ""), (None, 1, "email:0:5"), (None, 1, "email:0:5")]
    assert personal_data(docs.limit(0)).count() == 0


def test_looser_spans_need_support(spark):
    good = [(i, f"Please call phone 202-555-{1000 + i} or mail me: jo{i} [at] mail [dot] com, thanks") for i in range(60)]
    base = [(100 + i, f"mail a{i}@b.com and call +1 (555) 010-{1000 + i}") for i in range(60)]
    bad = [(200 + i, f"version 9999.{i}.1.1 of order 12345678901235{i:02d}") for i in range(60)]
    docs = spark.createDataFrame(good + base + bad, "doc_id long, text string")
    rows = {r["doc_id"]: r["spans"] for r in personal_data(docs).collect()}
    assert all("national" in rows[i] and "masked" in rows[i] for i in range(60))
    assert all(rows[i] == expected(text)[2] for i, text in bad)


def test_reliabilities_find_the_noisy_labeler():
    patterns = [{"form": 1, "listed": 1, "context": 1, "count": 400}, {"form": -1, "listed": -1, "context": -1, "count": 400},
                {"form": 1, "listed": 1, "context": -1, "count": 200}, {"form": -1, "listed": -1, "context": 1, "count": 200}]
    _, chance = reliabilities(patterns)
    assert chance["form"][1][0] > 0.9 and chance["context"][1][0] < chance["form"][1][0]
