"""Near duplicates by SimHash fingerprints, linked through pigeonring chains.

A 64-bit fingerprint is a ring of segments. If two fingerprints differ in at
most d bits, some segment starts a chain in which the first l segments differ
in at most l * d / m bits, for every l up to all m of them. The first few of
these budgets are zero, so those segments form a key: only fingerprints that
share it are candidates, and the chain's later budgets prune them before the
full Hamming check. Equal fingerprints are handled once. A key with more than
`bucket` different fingerprints is not paired up: its fingerprints meet at the
points halfway instead, each of which is near at most 65 of them (d <= 2).

Nulls and edge cases: a null text is an empty text; texts without a word have
fingerprint zero and are linked like any other. Null ids count for linking but
are no `component_id` unless a component has no other id. Repeated rows are rows
of their own. A very long text is hashed by one task, a part of its shingles at a
time. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotlake.llm.common import row_number_column, ship, text_of, type_of
from spotlake.llm.components import components
from spotlake.sources.scratch import materialise

SHINGLE_WORDS = 3
MAX_BITS = 2
SEGMENTS = 9
BUCKET = 1024
SEED = 42
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_CHUNK = 1 << 16

ship(__name__)


def fingerprint(text: str, shingle_words: int = SHINGLE_WORDS) -> int:
    """SimHash of a text's word shingles, repeats included, as an unsigned number."""
    words = text.encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return 0
    if len(words) < shingle_words:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(shingle_words)))))
    ones = np.zeros(64, np.int64)
    for start in range(0, len(shingles), _CHUNK):
        part = shingles[start:start + _CHUNK]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, part, repeat(SEED)), np.uint64, len(part))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(shingles), bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS,
                 row_col: str | None = None) -> DataFrame:
    """`row`, `id`, `print` (the 64 bits as a signed number) of every document."""
    rows = docs.select(row_number_column(row_col).alias("row"), F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text"))

    def prints(batches):
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle_words) for t in batch.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], ["row", "id", "print"])

    schema = f"row {type_of(rows, 'row')}, id {type_of(rows, 'id')}, print long"
    return rows.mapInArrow(prints, schema)


def ring_masks(segments: int = SEGMENTS) -> list[int]:
    """The 64 bits cut into `segments` parts of almost equal length."""
    cuts = [64 * i // segments for i in range(segments + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]


def chain_masks(start: int, masks: list[int]) -> list[int]:
    """Bits of the first 1, 2, ... segments of the chain that starts at `start`."""
    out, bits = [], 0
    for step in range(len(masks)):
        bits |= masks[(start + step) % len(masks)]
        out.append(bits)
    return out


def linked(prints: np.ndarray, start: int, segments: int, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of the fingerprints of one key whose chain stays in budget to the end."""
    left, right = np.triu_indices(len(prints), 1)
    diff = prints[left] ^ prints[right]
    for step, mask in enumerate(chain_masks(start, ring_masks(segments)), 1):
        near = np.bitwise_count(diff & np.uint64(mask)) <= step * max_bits // segments
        left, right, diff = left[near], right[near], diff[near]
    return left, right


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def links(distinct_prints: DataFrame, max_bits: int = MAX_BITS, segments: int = SEGMENTS, bucket: int = BUCKET) -> DataFrame:
    """Links `a`, `b` that connect all fingerprints (column `print`) within `max_bits`; stars, not all pairs."""
    if max_bits > 2:
        raise ValueError("points halfway between two fingerprints are built for two bits at most")
    ring = ring_masks(segments)
    zero = max(step for step in range(1, segments + 1) if step * max_bits < segments)
    keys = F.array(*(F.struct(F.lit(i).alias("start"), F.col("print").bitwiseAND(
        F.lit(_signed(chain_masks(i, ring)[zero - 1]))).alias("bits")) for i in range(segments)))
    keyed = materialise(distinct_prints.select("print", F.explode(keys).alias("k")).select("print", "k.*"), "keys")
    shared = materialise(keyed.groupBy("start", "bits").count().where("count > 1"), "shared-keys")
    small = keyed.join(shared.where(F.col("count") <= bucket), ["start", "bits"]).groupBy("start", "bits").agg(
        F.collect_list("print").alias("prints")).select("start", "prints")

    def pair_up(batches):
        for batch in batches:
            a, b = [], []
            for start, prints in zip(batch.column(0).to_pylist(), batch.column(1)):
                prints = np.sort(np.asarray(prints.values, np.int64))
                left, right = linked(prints.view(np.uint64), start, segments, max_bits)
                # A forest over the pairs, so that a key gives fewer links than it has fingerprints.
                root = np.arange(len(prints))
                while len(left):
                    low = np.minimum(root[left], root[right])
                    before = root.copy()
                    np.minimum.at(root, left, low)
                    np.minimum.at(root, right, low)
                    root = root[root]
                    if np.array_equal(root, before):
                        break
                far = root != np.arange(len(prints))
                a.append(prints[far])
                b.append(prints[root[far]])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    near = small.mapInArrow(pair_up, "a long, b long")
    crowded = keyed.join(shared.where(F.col("count") > bucket), ["start", "bits"], "left_semi").select("print").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.lit(_signed(1 << i)) for i in range(64)))
    halfway = crowded.select("print", F.explode(flips).alias("flip")).groupBy(
        F.col("print").bitwiseXOR(F.col("flip")).alias("point")).agg(
        F.min("print").alias("b"), F.collect_list("print").alias("prints")).where(F.size("prints") > 1)
    return near.unionByName(halfway.select(F.explode("prints").alias("a"), "b").where("a <> b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS,
                    max_bits: int = MAX_BITS, segments: int = SEGMENTS, bucket: int = BUCKET,
                    row_col: str | None = None) -> DataFrame:
    """Every document with its component of linked fingerprints.

    Returns `row`, `doc_id`, `fingerprint`, `component_id` (smallest id of the
    component) and `kept` (true for the one row that stands for it).
    """
    prints = materialise(fingerprints(docs, id_col, text_col, shingle_words, row_col), "prints")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row")))
    distinct = materialise(prints.groupBy("print").agg(first.alias("first")), "distinct-prints")
    roots = components(links(distinct.select("print"), max_bits, segments, bucket), "a", "b").withColumnRenamed("node", "print")
    # Single fingerprints are their own root.
    of_print = materialise(distinct.join(roots, "print", "left").withColumn("root", F.coalesce("root", "print")), "roots")
    least = of_print.groupBy("root").agg(F.min("first").alias("first"))
    named = materialise(of_print.select("print", "root").join(least, "root").select("print", "first"), "component-names")
    return prints.join(named, "print").select(
        "row", F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        F.col("first.id").alias("component_id"), (F.col("row") == F.col("first.row")).alias("kept"))
