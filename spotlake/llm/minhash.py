"""Near duplicates by b-bit MinHash signatures, confirmed on full shingle sets.

Documents with equal sets of word shingles are one node. Of each of
`BANDS * ROWS` hash functions a node keeps the least value: bands of these
minima are its bucket keys, and their lowest `BITS` bits, packed, its signature.
Two nodes that share a bucket are a candidate pair. The share of equal low bits,
counted with population counts and corrected for the bits that agree by chance,
estimates their similarity; a pair goes on only if it could still reach the
threshold, where a pair at the threshold is lost with a chance of `MISS` at most.
Pairs that go on are confirmed on their full sets.

No bucket is paired up as it is. Its nodes are first compared with the first of
them, in one pass over sorted range partitions, so a bucket may be of any size. The
best of these links are confirmed and give components. After that, only buckets
whose nodes are in different components are compared, in blocks of bounded size
and without the pairs inside a bucket's largest component. Pairs from different
components that go on meet on the 32-bit halves of their full sets in that task,
in the first bucket they share, and those that pass are confirmed: no link
between components is left out, and no link inside one is needed.

A pair at the threshold shares no bucket with a chance of (1 - 0.8^5)^46, about
1e-8, and is taken for one of an earlier bucket, by 32 bits of the keys, with a
chance of the same size; every more similar pair is lost with a lesser one.

Nulls and edge cases: texts without a word, null ones included, have an empty set
and are linked with nothing. Texts of fewer words than a shingle have one shingle,
all their words. Null ids count for linking but are no `component_id` unless a
component has no other id. Repeated rows are rows of their own. A very long text
is held by one task, as its shingle hashes. An empty table gives an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotlake.llm.common import numbered, ship, text_of, type_of
from spotlake.llm.components import components
from spotlake.llm.textparts import parts_of, words_in
from spotlake.sources.scratch import materialise

SHINGLE_WORDS = 4
PERCENT = 80
BANDS = 46
ROWS = 5
BITS = 2
MISS = 1e-9
# Nodes of a bucket that one task compares with as many others at a time.
BLOCK = 1024
# Best estimated neighbours of a node that are confirmed before components are built.
FIRST = 2
# Shingles that are hashed at once, so that they stay in the processor's cache.
_CHUNK = 1 << 15
_STEP = np.uint64(0x9E3779B97F4A7C15)
_WORDS = (BANDS * ROWS + 63) // 64
_SPACE = np.zeros(256, bool)
_SPACE[9:14] = _SPACE[32] = True

ship(__name__)


def _odd_numbers(count: int, seed: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(i.to_bytes(4, "little"), seed) | 1 for i in range(count)], np.uint64)


_TIMES, _PLUS = _odd_numbers(BANDS * ROWS, 1), _odd_numbers(BANDS * ROWS, 2)


def shingle_sets(texts: pa.Array, shingle_words: int):
    """(number of the text, its different shingles as sorted hashes) of the texts that have a word."""
    for data, begins, rows in parts_of(texts, None):
        words, word, text, _ = words_in(data, begins, ~_SPACE[data])
        if not len(word):
            continue
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in words.to_pylist()], np.uint64)[word]
        cuts = np.append(np.flatnonzero(np.diff(text, prepend=-1)), len(text))
        for a, b in zip(cuts, cuts[1:]):
            size = min(shingle_words, b - a)
            rolling = hashes[a:b - size + 1]
            for i in range(1, size):
                rolling = rolling * _STEP + hashes[a + i:b - size + 1 + i]
            yield int(rows[text[a]]), np.unique(rolling)


def minima(sets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The least value of each hash function over each set; sets lie one after the other in `sets`."""
    out = np.empty((len(starts), len(_TIMES)), np.uint64)
    for i, (times, plus) in enumerate(zip(_TIMES, _PLUS)):
        # The upper half of the product is the better mixed one; the low bits kept are taken from it.
        out[:, i] = np.minimum.reduceat((sets * times + plus) >> np.uint64(24), starts)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """One key a band, which holds the band's number."""
    keys = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(least), 1))
    for row in range(ROWS):
        keys = (keys ^ least[:, row::ROWS]) * _STEP
        keys ^= keys >> np.uint64(31)
    return keys


def packed(least: np.ndarray) -> np.ndarray:
    """The lowest `BITS` bits of each value, a plane of bits after the other, in 64-bit words."""
    planes = [np.packbits(((least >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), axis=1, bitorder="little") for b in range(BITS)]
    planes = [np.pad(p, ((0, 0), (0, 8 * _WORDS - p.shape[1]))) for p in planes]
    return np.ascontiguousarray(np.concatenate(planes, axis=1)).view(np.uint64)


def matches(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many of the hash functions agree in all kept bits."""
    differ = left ^ right
    differ = np.bitwise_or.reduce(differ.reshape(*differ.shape[:-1], BITS, _WORDS), axis=-2)
    return len(_TIMES) - np.bitwise_count(differ).sum(axis=-1, dtype=np.int64)


def similarity(agreeing: float) -> float:
    """The Jaccard similarity of a share of agreeing values, corrected for values that agree by chance."""
    chance = 2.0 ** -BITS
    return (agreeing / len(_TIMES) - chance) / (1 - chance)


def least_matches(percent: int) -> int:
    """The largest number of matches that a pair at the threshold reaches but for a chance of `MISS`."""
    size, chance = len(_TIMES), 2.0 ** -BITS
    p = chance + (1 - chance) * percent / 100
    below, m = 0.0, 0
    while True:
        below += math.comb(size, m) * p**m * (1 - p) ** (size - m)
        if below > MISS:
            return m
        m += 1


def signatures(rows: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """`row`, `id`, `size`, `digest` of the shingle set, `keys` of its bands, `bits` of its signature; from `row`, `id`, `text`."""
    def sign(batches):
        for batch in batches:
            sizes, digests = np.zeros(batch.num_rows, np.int64), [None] * batch.num_rows
            keys, bits = [None] * batch.num_rows, [None] * batch.num_rows
            texts, sets = [], []

            def flush():
                starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
                least = minima(np.concatenate(sets), starts)
                for text, key, bit in zip(texts, band_keys(least).view(np.int64), packed(least)):
                    keys[text], bits[text] = key, bit.tobytes()
                texts.clear()
                sets.clear()

            waiting = 0
            for text, found in shingle_sets(batch.column(2), shingle_words):
                sizes[text], digests[text] = len(found), xxhash.xxh3_128_digest(found)
                texts.append(text)
                sets.append(found)
                waiting += len(found)
                if waiting >= _CHUNK:
                    flush()
                    waiting = 0
            if sets:
                flush()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes), pa.array(digests, pa.binary()),
                 pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.binary())],
                ["row", "id", "size", "digest", "keys", "bits"])

    schema = f"row {type_of(rows, 'row')}, id {type_of(rows, 'id')}, size long, digest binary, keys array<long>, bits binary"
    return rows.select("row", "id", "text").mapInArrow(sign, schema)


def shared_buckets(buckets: DataFrame) -> DataFrame:
    """The rows `key`, `node` whose key another row has, in one pass over range partitions.

    Rows next to a partition's ends are kept too, as their bucket may go on in the next one.
    """
    def keep(batches):
        # A row is given out when the next one is known.
        held, before, first = None, None, True
        for batch in batches:
            keys, nodes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(keys):
                continue
            if held is not None:
                keys, nodes = np.append(held[0], keys), np.append(held[1], nodes)
            same = keys[1:] == keys[:-1]
            given = np.append(before == keys[0], same[:-1]) | same if len(same) else np.zeros(0, bool)
            if len(given):
                given[0] |= first
                first = False
                yield pa.RecordBatch.from_arrays([pa.array(keys[:-1][given]), pa.array(nodes[:-1][given])], ["key", "node"])
                before = keys[-2]
            held = keys[-1:], nodes[-1:]
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1])], ["key", "node"])

    return buckets.repartitionByRange("key", "node").sortWithinPartitions("key", "node").mapInArrow(keep, "key long, node long")


def starred(members: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """`key`, `a`, `b`, `same`: the first node of each bucket with each other one that can reach the threshold.

    A bucket that goes on in another range partition has a first node in each; of the
    buckets at the ends of a partition these are given too, without `b`.
    """
    need = least_matches(percent)

    def star(batches):
        def rows(keys, a, b, same):
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(a, pa.int64()), b, pa.array(same, pa.int64())], ["key", "a", "b", "same"])

        def end(row):
            return rows(row[0], row[1], pa.array([None], pa.int64()), [0])

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            found = [batch.column(i).to_numpy() for i in range(3)] + [np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint64).reshape(batch.num_rows, -1)]
            if held is None:
                yield end([c[:1] for c in found])
                held = [c[:1] for c in found]
            # The first node of the bucket that is open stands ahead of the batch.
            key, node, size, bits = (np.concatenate([h, c]) for h, c in zip(held, found))
            place = np.arange(len(key))
            begins = np.append(True, key[1:] != key[:-1])
            hub = np.maximum.accumulate(np.where(begins, place, 0))
            other = np.flatnonzero((hub != place) & (node != node[hub]))
            one = hub[other]
            sized = 100 * np.minimum(size[one], size[other]) >= percent * np.maximum(size[one], size[other])
            one, other = one[sized], other[sized]
            same = matches(bits[one], bits[other])
            near = same >= need
            yield rows(key[other[near]], node[one[near]], pa.array(node[other[near]]), same[near])
            held = [c[hub[-1:]] for c in (key, node, size, bits)]
        if held is not None:
            yield end(held)

    dealt = members.join(nodes.select("node", "size", "bits"), "node").select("key", "node", "size", "bits")
    return dealt.repartitionByRange("key", "node").sortWithinPartitions("key", "node").mapInArrow(star, "key long, a long, b long, same long")


def _estimated(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """`a`, `b`, `same` (matches) of the pairs that can reach the threshold by their sizes and signatures."""
    need = least_matches(percent)
    of = nodes.select("node", "size", "bits")
    both = pairs.join(of.select(F.col("node").alias("a"), F.col("size").alias("size_a"), F.col("bits").alias("bits_a")), "a").join(
        of.select(F.col("node").alias("b"), F.col("size").alias("size_b"), F.col("bits").alias("bits_b")), "b")
    both = both.where(100 * F.least("size_a", "size_b") >= percent * F.greatest("size_a", "size_b"))

    def estimate(batches):
        for batch in batches:
            if batch.num_rows:
                left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for i in (2, 3))
                same = matches(left, right)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(same)], ["a", "b", "same"]).filter(
                    pa.array(same >= need))

    return both.select("a", "b", "bits_a", "bits_b").mapInArrow(estimate, "a long, b long, same long")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs `a`, `b` whose full sets are similar enough."""
    def confirm(batches):
        for batch in batches:
            keep = []
            for one, two in zip(batch.column(2), batch.column(3)):
                one, two = np.frombuffer(one.as_buffer(), np.uint64), np.frombuffer(two.as_buffer(), np.uint64)
                shared = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(100 * shared >= percent * (len(one) + len(two) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("one")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("hashes").alias("two")), "b")
    return both.select("a", "b", "one", "two").mapInArrow(confirm, "a long, b long")


def _best(pairs: DataFrame, count: int) -> DataFrame:
    """The pairs that are among the `count` best estimated ones of one of their ends."""
    ends = pairs.select(F.col("a").alias("node"), "same", "a", "b").unionByName(pairs.select(F.col("b").alias("node"), "same", "a", "b"))
    # An end keeps its best in a map-side aggregate, so a node with many pairs is no single task.
    kept = ends.withColumn("g", F.pmod(F.xxhash64("a", "b"), F.lit(count))).groupBy("node", "g").agg(
        F.max(F.struct("same", "a", "b")).alias("p"))
    return kept.select("p.a", "p.b").distinct()


def mixed_buckets(members: DataFrame, roots: DataFrame) -> DataFrame:
    """`key`, `node`, `root` of the buckets whose nodes are in different components, with the blocks they are cut into."""
    placed = materialise(members.select("key", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "placed")
    sizes = placed.groupBy("key", "root").count()
    mixed = materialise(sizes.groupBy("key").agg(
        F.max(F.struct("count", "root")).alias("most"), F.sum("count").alias("nodes"), F.count(F.lit(1)).alias("roots")).where("roots > 1").select(
        "key", F.col("most.root").alias("major"), F.ceil(F.col("most.count") / BLOCK).cast("int").alias("major_blocks"),
        F.ceil((F.col("nodes") - F.col("most.count")) / BLOCK).cast("int").alias("minor_blocks")), "mixed-buckets")
    here = placed.join(mixed, "key").withColumn("is_major", F.col("root") == F.col("major"))
    block = F.pmod(F.xxhash64("node"), F.when(F.col("is_major"), F.col("major_blocks")).otherwise(F.col("minor_blocks"))).cast("int")
    return here.withColumn("block", block).drop("major")


def across(mixed: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs `a`, `b` of nodes of different components that share a bucket and pass on the halves of their sets."""
    need = least_matches(percent)
    # Groups are pairs of blocks; blocks of the largest component count from minus one down and never meet each other.
    others = F.expr("""CASE WHEN is_major THEN transform(sequence(0, minor_blocks - 1), i -> struct(i AS i, -1 - block AS j))
        ELSE concat(transform(sequence(0, minor_blocks - 1), i -> struct(greatest(i, block) AS i, least(i, block) AS j)),
            transform(sequence(0, major_blocks - 1), j -> struct(block AS i, -1 - j AS j))) END""")
    marks = nodes.select("node", "bits", F.transform("keys", lambda k: k.bitwiseAND(0xFFFFFFFF)).alias("marks")).join(sets.select("node", "halves"), "node")
    dealt = mixed.withColumn("group", F.explode(others)).join(marks, "node")
    signed = F.struct("node", "root", F.when(F.col("is_major"), -1 - F.col("block")).otherwise(F.col("block")).alias("block"), "bits", "marks", "halves")
    groups = dealt.groupBy("key", "group").agg(F.collect_list(signed).alias("rows")).select(
        "group.i", "group.j", "rows", F.col("key").bitwiseAND(0xFFFFFFFF).alias("mark"))

    def compare(batches):
        for batch in batches:
            for i, j, rows, mark in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
                rows = rows.values
                node, root, of = (rows.field(f).to_numpy() for f in ("node", "root", "block"))
                marks = rows.field("marks").flatten().to_numpy().reshape(len(node), -1)
                bits = np.frombuffer(b"".join(rows.field("bits").to_pylist()), np.uint64).reshape(len(node), -1)
                halves = [np.frombuffer(h.as_buffer(), np.uint32) for h in rows.field("halves")]
                left, right = np.flatnonzero(of == i), np.flatnonzero(of == j)
                a, b = [], []
                for start in range(0, len(left), 64):
                    part = left[start:start + 64]
                    same = matches(bits[part][:, None, :], bits[right][None, :, :])
                    p, q = np.nonzero((same >= need) & (root[part][:, None] != root[right][None, :]))
                    p, q = part[p], right[q]
                    # Only in the first bucket that both share.
                    both = marks[p] == marks[q]
                    own = marks[p, both.argmax(axis=1)] == mark
                    for x, y in zip(p[own].tolist(), q[own].tolist()):
                        one, two = halves[x], halves[y]
                        if 100 * min(len(one), len(two)) >= percent * max(len(one), len(two)):
                            shared = len(np.intersect1d(one, two, assume_unique=True))
                            if 100 * shared >= percent * (len(one) + len(two) - shared):
                                a.append(min(node[x], node[y]))
                                b.append(max(node[x], node[y]))
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return groups.mapInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS,
                    percent: int = PERCENT) -> DataFrame:
    """Every document with its component of linked shingle sets.

    Returns `row`, `doc_id`, `n_shingles`, `component_id` (smallest id of the
    component) and `kept` (true for the one row that stands for it).
    """
    keyed, row = numbered(docs)
    rows = keyed.select(F.col(row).alias("row"), F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text"))
    signed = materialise(signatures(rows, shingle_words), "signatures")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row"))).alias("first")
    nodes = signed.where("size > 0").groupBy("digest").agg(
        first, F.first("size").alias("size"), F.first("keys").alias("keys"), F.first("bits").alias("bits"))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    members = materialise(shared_buckets(nodes.select("node", F.explode("keys").alias("key")).select("key", "node")), "bucket-members")
    stars = materialise(starred(members, nodes, percent), "stars")
    ends = stars.where("b IS NULL").groupBy("key").agg(F.min("a").alias("a"), F.collect_set("a").alias("firsts")).select(
        "a", F.explode("firsts").alias("b")).where("a <> b").distinct()
    likely = materialise(stars.where("b IS NOT NULL").select("a", "b", "same").unionByName(_estimated(ends, nodes, percent)).distinct(), "likely-pairs")

    def sets_of(wanted: DataFrame) -> DataFrame:
        """The full sets of these nodes, from the texts that stand for them, and the halves of their hashes."""
        texts = rows.join(nodes.join(wanted, "node", "left_semi").select("node", F.col("first.row").alias("row")), "row")

        def hashed(batches):
            for batch in batches:
                for text, found in shingle_sets(batch.column(1), shingle_words):
                    # Halves that meet can only add to what two sets share.
                    half = (found >> np.uint64(32)).astype(np.uint32)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(text, 1), pa.array([found.tobytes()], pa.binary()), pa.array([half.tobytes()], pa.binary())],
                        ["node", "hashes", "halves"])

        return materialise(texts.select("node", "text").mapInArrow(hashed, "node long, hashes binary, halves binary"), "sets")

    first_links = _best(likely, FIRST)
    links = materialise(confirmed(first_links, sets_of(first_links.select(F.explode(F.array("a", "b")).alias("node")).distinct()), percent), "links")
    roots = components(links, "a", "b")
    mixed = materialise(mixed_buckets(members, roots), "mixed")
    sets = sets_of(mixed.select("node").distinct())
    more = materialise(confirmed(across(mixed, nodes, sets, percent), sets, percent), "links")
    if not more.isEmpty():
        roots = components(links.unionByName(more), "a", "b")

    of_node = materialise(nodes.select("digest", "node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "roots")
    least = of_node.groupBy("root").agg(F.min("first").alias("first"))
    named = materialise(of_node.select("digest", "root").join(least, "root").select("digest", "first"), "component-names")
    out = signed.select("row", "id", "size", "digest").join(named, "digest", "left")
    alone = F.col("first").isNull()
    return out.select(
        "row", F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), F.when(alone, F.col("id")).otherwise(F.col("first.id")).alias("component_id"),
        (alone | (F.col("row") == F.col("first.row"))).alias("kept"))
