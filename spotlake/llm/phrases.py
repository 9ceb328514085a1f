"""Collocated phrases by dynamic itemset counting.

The documents are dealt into `shards` that are scanned in a cycle, one a step.
Words are counted from the first step on. A longer phrase becomes active in the
step after both its subphrases (all words but the last, all but the first) have
reached `min_count`, and is counted until it has seen every shard once, so
lengths are counted side by side and no scan is made for one length alone. The
work ends when the last active phrase has completed its cycle.

Counters are kept under 64-bit hashes of the phrases and dealt by ranges of the
hash, one for each shuffle partition: a scan hands over one packed row a range, and
a task sums a range as sorted arrays, about 16 bytes a phrase; set
`spark.sql.shuffle.partitions` so that a range fits. A scan tests subphrases
against an array of one byte a slot that holds, under the upper bits of the hash,
the step after which a phrase may activate others; it has that size at any size
of the corpus. Phrases that share a counter or a slot are counted too often or too
long, never too little. So the counters name all phrases that can reach the
threshold, and a last cycle counts just these on their words: the counts returned
are exact.

Nulls and edge cases: a null text is empty, a null language is `und`. Repeated
rows count as often as they come; ids are not read. Ties of the score are broken
by count and phrase, ties between cuts by the shorter first part. Texts are cut
at the marks that end a piece before they are counted, so a very long text is
never worked on whole; a single piece of many megabytes is. Texts without a word
and an empty table give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotlake.llm.common import ship, text_of
from spotlake.llm.textparts import parts_of, words_in
from spotlake.sources.scratch import materialise

MIN_COUNT = 30
MAX_WORDS = 4
TOP = 2000
CONTAINED_PERCENT = 80
SCALE = 2_000_000
UNKNOWN = "und"
SHARDS = 3
# One byte each; the upper bits of a hash pick a slot, its lowest ones hold the number of words less one.
SLOT_BITS = 24
LENGTH_BITS = 3
# Counters a scan gathers before it hands them over.
GATHERED = 1 << 20
# The best of a language are chosen in so many groups before they meet.
GROUPS = 64

_END = np.zeros(256, bool)
_END[list(b".,;:!?\n\x0b\x0c\r")] = True
_GAP = _END.copy()
_GAP[[9, 32]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)

ship(__name__)


def word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    head = lang.encode() + b"\0"
    return np.fromiter((xxhash.xxh64_intdigest(head + w) for w in words), np.uint64, len(words))


def slot_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def counter_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash a phrase of `n` words is counted under."""
    low = np.uint64((1 << LENGTH_BITS) - 1)
    return (hashes & ~low) | np.uint64(n - 1)


def range_starts(ranges: int) -> np.ndarray:
    """The least hash of each of `ranges` ranges of equal length."""
    return np.array([(i << 64) // ranges + (i > 0) for i in range(ranges)], np.uint64)


def _cut(hashes: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Which ranges sorted hashes fall in, and where each begins and the last one ends."""
    cuts = np.append(np.searchsorted(hashes, range_starts(ranges)), len(hashes))
    filled = np.flatnonzero(np.diff(cuts))
    return filled, np.append(cuts[filled], len(hashes))


def _packed(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The bytes of `values` between cuts, one row each."""
    values = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


class Words:
    """The words of one part of texts: `kinds` the different ones, `at` the one at each place, `piece` the piece it is in."""

    def __init__(self, lang: str, data: np.ndarray, begins: np.ndarray):
        self.kinds, self.at, _, starts = words_in(data, begins, ~_GAP[data])
        ends = _END[data]
        ends[begins[begins < len(data)]] = True
        self.piece = np.cumsum(ends, dtype=np.int32)[starts]
        self.hashes = word_hashes(lang, self.kinds.to_pylist())

    def active(self, starts_at: np.ndarray, step: int, shards: int, max_words: int):
        """(n, hashes) of the phrases of two words and more that may be active in `step`, one hash an occurrence."""
        # Places of phrases that have reached the threshold, their hashes and steps.
        level = starts_at[slot_of(self.hashes)][self.at]
        places = np.flatnonzero(level)
        rolling, level = self.hashes[self.at[places]], level[places].astype(np.int64)
        for n in range(2, max_words + 1):
            # Both subphrases: the one that begins here and the one that begins a word later.
            pair = np.flatnonzero(np.diff(places) == 1)
            if n == 2:
                pair = pair[self.piece[places[pair]] == self.piece[places[pair] + 1]]
            begin = np.maximum(level[pair], level[pair + 1])
            places = places[pair]
            rolling = rolling[pair] * _STEP + self.hashes[self.at[places + n - 1]]
            yield n, rolling[begin + shards > step]
            level = starts_at[slot_of(rolling)].astype(np.int64)
            kept = level > 0
            places, level, rolling = places[kept], level[kept], rolling[kept]

    def found(self, slots: np.ndarray, max_words: int):
        """(n, words, hashes, counts) of the phrases whose slot is taken, and whose subphrases' are."""
        places, code = np.arange(len(self.at)), self.at
        columns = [np.arange(len(self.kinds))]
        rolling = self.hashes[self.at]
        for n in range(1, max_words + 1):
            if n > 1:
                pair = np.flatnonzero(np.diff(places) == 1)
                if n == 2:
                    pair = pair[self.piece[places[pair]] == self.piece[places[pair] + 1]]
                places = places[pair]
                last = self.at[places + n - 1]
                rolling = rolling[pair] * _STEP + self.hashes[last]
                code = code[pair] * len(self.kinds) + last
            kept = slots[slot_of(rolling)]
            places, rolling, code = places[kept], rolling[kept], code[kept]
            if not len(places):
                return
            codes, first, code, counts = np.unique(code, return_index=True, return_inverse=True, return_counts=True)
            columns = [codes] if n == 1 else [*(c[codes // len(self.kinds)] for c in columns), codes % len(self.kinds)]
            parts = [self.kinds.take(pa.array(c)) for c in columns]
            yield n, parts[0] if n == 1 else pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())), rolling[first], counts


def _parts(batches):
    for batch in batches:
        for lang in pc.unique(batch.column(0)).to_pylist():
            texts = batch.column(1).filter(pc.equal(batch.column(0), lang))
            for data, begins, _ in parts_of(texts, _END):
                words = Words(lang, data, begins)
                if len(words.at):
                    yield lang, words


def _sent(spark, values: np.ndarray):
    """The bytes of an array as a broadcast; mostly zeros, so packed."""
    return spark.sparkContext.broadcast(zlib.compress(values.tobytes(), 1))


def _unpacked(sent) -> np.ndarray:
    return np.frombuffer(zlib.decompress(sent.value), np.uint8)


_DEALT = "bucket long, kind int, h binary, c binary"
NOW, BEFORE, KNOWN = range(3)


def _counted(shard: DataFrame, starts_at, step: int, shards: int, max_words: int, ranges: int) -> DataFrame:
    """Counters of the phrases that may be active in `step`, packed by range."""
    def rows(parts):
        hashes, counts = _sum(*zip(*parts))
        filled, cuts = _cut(hashes, ranges)
        return pa.RecordBatch.from_arrays(
            [pa.array(filled), pa.array(np.full(len(filled), NOW, np.int32)), _packed(hashes, cuts), _packed(counts, cuts)],
            ["bucket", "kind", "h", "c"])

    def count(batches):
        levels = _unpacked(starts_at)
        held, size = [], 0
        for _, words in _parts(batches):
            found = [counter_of(h, n) for n, h in words.active(levels, step, shards, max_words)]
            held.append(np.unique(np.concatenate(found), return_counts=True))
            if step < shards:
                held.append((counter_of(words.hashes, 1), np.bincount(words.at, minlength=len(words.kinds))))
            size += sum(len(h) for h, _ in held[-2:])
            if size >= GATHERED:
                yield rows(held)
                held, size = [], 0
        if held:
            yield rows(held)

    return shard.select("lang", "text").mapInArrow(count, _DEALT)


def _groups(batches):
    """(bucket, its rows) of rows that are sorted by bucket."""
    held, bucket = [], None
    for batch in batches:
        for row in zip(*(batch.column(i) for i in range(batch.num_columns))):
            number = row[0].as_py()
            if number != bucket and held:
                yield bucket, held
                held = []
            bucket = number
            held.append(row[1:])
    if held:
        yield bucket, held


def _sum(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different hashes with the sums of their counts."""
    h, c = np.concatenate([np.zeros(0, np.uint64), *hashes]), np.concatenate([np.zeros(0, np.int64), *counts])
    order = np.argsort(h)
    h, c = h[order], c[order]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1])[:len(h)])
    return h[first], np.add.reduceat(c, first) if len(first) else c


def _bits(hashes: np.ndarray, low: int, high: int) -> bytes:
    """One bit for each slot from `low` to `high`, set where a hash lies."""
    bits = np.zeros(high - low + 1, np.uint8)
    bits[slot_of(hashes) - low] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _summed(dealt: DataFrame, min_count: int, max_words: int, ranges: int) -> DataFrame:
    """Per range the counters of this step, those that reach the threshold now, and their slots.

    `dealt` holds this step's counters, those of the earlier steps of a cycle, and those that reached it before.
    """
    starts = range_starts(ranges)

    def reduce_ranges(batches):
        for bucket, rows in _groups(batches):
            of = {kind: ([], []) for kind in (NOW, BEFORE, KNOWN)}
            for kind, h, c in rows:
                of[kind.as_py()][0].append(np.frombuffer(h.as_buffer(), np.uint64))
                of[kind.as_py()][1].append(np.frombuffer(c.as_buffer(), np.int64))
            now = _sum(*of[NOW])
            total, counts = _sum([now[0], *of[BEFORE][0]], [now[1], *of[BEFORE][1]])
            new = np.setdiff1d(total[counts >= min_count], np.concatenate([np.zeros(0, np.uint64), *of[KNOWN][0]]), assume_unique=True)
            low = int(slot_of(starts[bucket:bucket + 1])[0])
            high = int(slot_of(starts[bucket + 1:bucket + 2])[0]) if bucket + 1 < ranges else (1 << SLOT_BITS) - 1
            shorter = new[(new & np.uint64((1 << LENGTH_BITS) - 1)) < max_words - 1]
            values = [bucket, now[0].tobytes(), now[1].tobytes(), new.tobytes(), low, _bits(new, low, high), _bits(shorter, low, high)]
            yield pa.RecordBatch.from_pylist(
                [dict(zip(schema.names, values))], schema=schema)

    schema = pa.schema([("bucket", pa.int64()), ("h", pa.binary()), ("c", pa.binary()), ("new", pa.binary()), ("low", pa.int64()),
                        ("taken", pa.binary()), ("activating", pa.binary())])
    return dealt.repartitionById(ranges, F.col("bucket").cast("int")).sortWithinPartitions("bucket").mapInArrow(
        reduce_ranges, "bucket long, h binary, c binary, new binary, low long, taken binary, activating binary")


def _slots(rows: pa.Table, column: str) -> np.ndarray:
    """The slots whose bits are set; all bits together are at most one a slot and two a range."""
    out = [np.zeros(0, np.int64)]
    for low, bits in zip(rows.column("low").to_pylist(), rows.column(column).to_pylist()):
        out.append(low + np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")))
    return np.concatenate(out)


def _recounted(ring: DataFrame, slots, min_count: int, max_words: int, ranges: int) -> DataFrame:
    """`lang`, `n`, `phrase`, `c` of the phrases whose slot is taken, and under `n` = 0 the words of each language."""
    fields = pa.schema([("n", pa.int32()), ("phrase", pa.string()), ("c", pa.int64())])
    schema = pa.schema([("lang", pa.string()), *fields])

    def blob(n, phrases, counts) -> bytes:
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, fields) as stream:
            stream.write(pa.RecordBatch.from_arrays([pa.array(n, pa.int32()), phrases, pa.array(counts, pa.int64())], schema=fields))
        return out.getvalue().to_pybytes()

    def count(batches):
        kept = _unpacked(slots).view(bool)
        for lang, words in _parts(batches):
            numbers, phrases, hashes, counts = [[0]], [pa.array([""])], [np.zeros(1, np.uint64)], [[len(words.at)]]
            for n, some, h, c in words.found(kept, max_words):
                numbers.append(np.full(len(c), n))
                phrases.append(some.cast(pa.large_string()).cast(pa.string()))
                hashes.append(h)
                counts.append(c)
            hashes = np.concatenate(hashes)
            order = np.argsort(hashes)
            phrases = pa.concat_arrays(phrases).take(pa.array(order))
            numbers, counts = np.concatenate(numbers)[order], np.concatenate(counts)[order]
            filled, cuts = _cut(hashes[order], ranges)
            blobs = [blob(numbers[a:b], phrases[a:b], counts[a:b]) for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(filled), pa.array([lang] * len(blobs), pa.string()), pa.array(blobs, pa.binary())], ["bucket", "lang", "rows"])

    def add(batches):
        for _, rows in _groups(batches):
            tables = []
            for lang, packed in rows:
                table = pa.ipc.open_stream(packed.as_buffer()).read_all()
                tables.append(table.add_column(0, "lang", pa.array([lang.as_py()] * len(table), pa.string())))
            sums = pa.concat_tables(tables).group_by(["lang", "n", "phrase"], use_threads=False).aggregate([("c", "sum")])
            sums = sums.rename_columns(["lang", "n", "phrase", "c"]).select(schema.names)
            yield from sums.filter(pc.or_(pc.equal(sums["n"], 0), pc.greater_equal(sums["c"], min_count))).to_batches()

    found = ring.select("lang", "text").mapInArrow(count, "bucket long, lang string, rows binary")
    return found.repartitionById(ranges, F.col("bucket").cast("int")).sortWithinPartitions("bucket").mapInArrow(add, "lang string, n int, phrase string, c long")


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT,
                  max_words: int = MAX_WORDS, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """Exact counts `f` of all phrases (`lang`, `n`, `phrase`) held `min_count` times or more, and word totals `n` per `lang`."""
    if max_words > 1 << LENGTH_BITS or max_words * shards > 255:
        raise ValueError(f"at most {1 << LENGTH_BITS} words, and words times shards up to 255")
    spark = docs.sparkSession
    dealt = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(UNKNOWN)).alias("lang"), text_of(text_col).alias("text"),
                        (F.monotonically_increasing_id() % shards).alias("shard"))
    ring = materialise(dealt.where("text <> ''"), "shards", "shard")
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    starts_at = np.zeros(1 << SLOT_BITS, np.uint8)
    taken = np.zeros(1 << SLOT_BITS, bool)
    steps: list[DataFrame] = []
    step, last = 0, shards - 1
    while step <= last:
        seen = _sent(spark, starts_at)
        dealt = _counted(ring.where(F.col("shard") == step % shards), seen, step, shards, max_words, ranges)
        # A phrase's own cycle is among the last steps until it ends.
        for i, done in enumerate(steps):
            if i > step - shards:
                dealt = dealt.unionByName(done.select("bucket", F.lit(BEFORE).alias("kind"), "h", "c"))
            dealt = dealt.unionByName(done.select("bucket", F.lit(KNOWN).alias("kind"), F.col("new").alias("h"), F.lit(b"").alias("c")))
        steps.append(materialise(_summed(dealt, min_count, max_words, ranges), "counters"))
        seen.destroy()
        slots = steps[-1].where("length(new) > 0").select("low", "taken", "activating").toArrow()
        taken[_slots(slots, "taken")] = True
        activating = _slots(slots, "activating")
        if len(activating):
            starts_at[activating] = step + 1
            # What these activate is counted through one whole cycle.
            last = max(last, step + shards)
        step += 1
    seen = _sent(spark, taken)
    counts = materialise(_recounted(ring, seen, min_count, max_words, ranges), "phrase-counts")
    seen.destroy()
    return (counts.where("n > 0").select("lang", "n", "phrase", F.col("c").alias("f")),
            counts.where("n = 0").select("lang", F.col("c").alias("n")))


def _wide(column: str) -> Column:
    return F.col(column).cast("decimal(20,0)")


def score_of(a: str, left: str, right: str) -> Column:
    """floor(2,000,000 a / (l + r)) without a product that passes 64 bits."""
    return F.expr(f"(cast({a} AS decimal(20,0)) * {SCALE}) div (cast({left} AS decimal(20,0)) + cast({right} AS decimal(20,0)))")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT,
                 max_words: int = MAX_WORDS, top: int = TOP, shards: int = SHARDS) -> DataFrame:
    """The best phrases of each language.

    Returns `lang`, `rank`, `phrase`, `a` (its count), `l` and `r` (counts of the
    parts of its weakest cut), `n` (words of the language) and `score`. A phrase
    inside a longer one that is at least 80% as frequent is left out.
    """
    counts, words = phrase_counts(docs, text_col, lang_col, min_count, max_words, shards)
    found = counts.where("n > 1").select("lang", "phrase", F.col("n").alias("size"), F.col("f").alias("a"))
    runs = F.explode(F.expr(
        "flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1), i -> array_join(slice(split(phrase, ' '), i, m), ' '))))"))
    inner = found.where("size > 2").select("lang", "a", runs.alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    open_ = found.join(inner, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (_wide("longer") * 100 < _wide("a") * CONTAINED_PERCENT)).drop("longer")
    cuts = open_.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).withColumns({
        "first": F.expr("substring_index(phrase, ' ', k)"), "rest": F.expr("substring_index(phrase, ' ', k - size)")})
    parts = counts.select("lang", "phrase", "f")
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(
        parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    cuts = cuts.withColumn("score", score_of("a", "l", "r"))
    weakest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select(
        "lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    # A language may hold a third of all phrases: groups of it are cut to the best first.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    grouped = weakest.withColumn("g", F.pmod(F.xxhash64("phrase"), F.lit(GROUPS)))
    best = grouped.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "g").orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
