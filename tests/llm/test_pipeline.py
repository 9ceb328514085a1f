"""The pipeline's stages against plain Python on a small table with nulls, copies and clashing columns."""

from __future__ import annotations

import hashlib
from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import types as T
from tokenizers import Tokenizer

from spotlake.llm import mixing
from spotlake.llm.simhash import fingerprint
from spotlake.sources.scratch import materialise

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("kept", T.StringType()),
    T.StructField("_row", T.StringType()), T.StructField("copies", T.StringType())])


def words(text):
    return (text or "").encode().split()


def passes(text):
    w = words(text)
    windows = list(zip(w, w[1:], w[2:]))
    times = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if times[x] > 1 for k in range(3)}
    return len(w) >= 50 and 100 * len(covered) <= 50 * len(w)


def expected_mix(rows):
    """Copies of each (id, source, size) by the definition of the mix."""
    sources = sorted({s for _, s, _ in rows if s is not None}) + [None] * any(s is None for _, s, _ in rows)
    total = {s: sum(n for _, x, n in rows if x == s) for s in sources}
    weight = {s: i % 3 + 1 for i, s in enumerate(sources)}
    target, free = {}, set(sources)
    while free:
        left = sum(total.values()) - sum(target.values())
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if 3 * total[s] <= level * weight[s]}
        target |= {s: 3 * total[s] for s in full}
        if not full:
            target |= {s: level * weight[s] for s in free}
            break
        free -= full
    out = Counter()
    for s in sources:
        whole = int(target[s] // total[s]) if total[s] else 0
        rest, before = target[s] - whole * total[s], 0
        for draw, size, i in sorted((hashlib.md5(f"{mixing.SEED}:{'null' if i is None else i}".encode()).hexdigest(), n, i)
                                    for i, x, n in rows if x == s):
            out[i] += whole + (before + size / 2 <= rest)
            before += size
    return target, {i: n for i, n in out.items() if n}


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], "kept?", "row?", "copies?") for r in table]
    rows += [(None, rows[1][1], None, None, None, None, None, None), (5000, None, "en", None, 0, "", "", ""), (5001, "", "en", "", 0, "", "", "")]
    rows += [(6000, rows[3][1] + " tail", "en", "src0", 1, "", "", "")] * 2
    path = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def test_stages(spark, docs, tmp_path):
    rows = [tuple(r) for r in docs.collect()]
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, "").write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        assert docs.columns == SCHEMA.names
        got = sorted((tuple(r) for r in docs.collect()), key=str)
        if n == 0:
            want = [r for r in rows if passes(r[1])]
        elif n == 1:
            last = {}
            for r in rows:
                k = r[1] or ""
                if k not in last or (r[0] is not None and (last[k][0] is None or r[0] > last[k][0])):
                    last[k] = r
            want = list(last.values())
        elif n == 2:
            prints = [fingerprint(r[1] or "") for r in rows]
            root = list(range(len(rows)))
            order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
            for _ in rows:
                for i in order:
                    near = [j for j in order if (prints[i] ^ prints[j]).bit_count() <= 2]
                    root[i] = min((root[j] for j in near), key=order.index)
            want = [rows[i] for i in sorted(set(root))]
        else:
            _, times = expected_mix([(r[0], r[3], len(words(r[1]))) for r in rows])
            assert Counter(r[0] for r in got) == times
            want = [r for r in rows for _ in range(times.get(r[0], 0))]
        assert got == sorted(want, key=str), name
        rows = got
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, n in Counter(r[0] for r in rows).items():
        text = next(r[1] for r in rows if r[0] == i)
        size = len(tokenizer.encode(text or "", add_special_tokens=False).ids) + 1
        assert sum(p["length"] for p in pieces if p["doc_id"] == i) == n * size


def test_empty_table(spark, docs, tmp_path):
    docs = docs.limit(0)
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "").write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        assert docs.count() == 0


def test_run(spark):
    """Every sequence is filled without gaps, and every document that is mixed in is there whole, as often as it is taken."""
    folder = "/root/testdata/sf0.001"
    pieces = corpus_pipeline.run(spark, folder).collect()
    sequences, lengths, sizes = {}, Counter(), {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        lengths[p["doc_id"]] += p["length"]
        assert sizes.setdefault(p["doc_id"], p["doc_tokens"]) == p["doc_tokens"] and p["start"] + p["length"] <= p["doc_tokens"]
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end and length > 0
            end += length
        assert end <= 2048
    docs = corpus_pipeline.table(spark, folder, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, folder), "stage")
    taken = Counter(r["doc_id"] for r in docs.select("doc_id").collect())
    assert lengths == {i: n * sizes[i] for i, n in taken.items()} and len(taken) > 50
