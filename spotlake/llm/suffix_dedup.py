"""Repeated passages by distributed suffix sorting over bytes.

A byte goes when a string of `length` bytes over it also starts earlier: in a
smaller id, or earlier in the same document. Every window of `length` bytes has
one anchor inside it, the leftmost place at which a hash of the next `GRAM`
bytes is least, so equal windows have their anchors at the same offset. Only
suffixes that start at anchors are sorted; an anchor stands for a run of windows.

1. The hashes at the anchors are counted; an anchor whose hash occurs once has
   no twin and is done with.
2. The suffixes at the other anchors, with the bytes of their windows before
   them, are dealt into ranges of leading bytes by sampled splitters and sorted
   there. A suffix equal to the one before it in order repeats all its windows.
   What differs somewhere remains, if other suffixes start with the same gram or
   it lies at the edge of a bucket.
3. These meet again by gram alone, across the boundaries of the buckets. Their
   windows are compared by multikey sorting, eight bytes at a time, first place
   first. Grams with more than `crowd` different suffixes send windows, not
   suffixes, so that no task holds them all.

Equality is always decided on bytes. Documents go by their ids where those are
different whole numbers; otherwise by a number in order of id, null last and
copies of an id in a fixed order, which costs one sorted copy of the table.

Nulls and edge cases: a null text is empty; texts shorter than `length` lose
nothing. An empty table gives an empty result. Extra columns are ignored. Very
long texts are read in pieces that overlap by `length`.
"""

from __future__ import annotations

from bisect import bisect_right
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotlake.llm.common import ship, text_of
from spotlake.sources.scratch import materialise

LENGTH = 100
GRAM = 24
CROWD = 20_000
BUCKET_ROWS = 40_000
BUCKET_SUFFIXES = 200_000
SAMPLED = 64
_SEGMENT = 1 << 18
_BATCH = 1 << 19
_PLACE = np.uint64((1 << 22) - 1)
_MIX = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]
_TABLE = np.random.default_rng(100).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)

ship(__name__)


def gram_hashes(body: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 24 bytes from each place on."""
    h = _TABLE[body]
    for size, mix in zip((1, 2, 4), _MIX):
        h = h[:-size] * mix + h[size:]
    # From eight bytes to twice and three times as many.
    n = len(body) - GRAM + 1
    h = (h[:n] * _MIX[3] + h[8:8 + n]) * _MIX[4] + h[16:16 + n]
    h ^= h >> np.uint64(31)
    h *= _MIX[0]
    h ^= h >> np.uint64(29)
    return h


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of `width` values."""
    out, size = values, 1
    while 2 * size <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[:len(values) - width + 1], out[width - size:]) if size < width else out


def anchors(bodies: list[bytes], length: int = LENGTH):
    """Anchors of all windows of all bodies: body number, place, first and last window start, hash."""
    batch, base, size = [], [], 0
    for number, body in enumerate(bodies):
        for start in range(0, max(0, len(body) - length + 1), _SEGMENT):
            part = body[start:start + _SEGMENT + length - 1]
            if size + len(part) > _BATCH and batch:
                yield _batch_anchors(batch, base, length)
                batch, base, size = [], [], 0
            batch.append(part)
            base.append((number, start))
            size += len(part)
    if batch:
        yield _batch_anchors(batch, base, length)


def _batch_anchors(parts: list[bytes], base: list[tuple[int, int]], length: int):
    sizes = np.array([len(p) for p in parts])
    begins = np.cumsum(sizes) - sizes
    hashes = gram_hashes(np.frombuffer(b"".join(parts), np.uint8))
    places = least_places((hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64), length - GRAM + 1)
    # Windows that reach into the next part are not windows of a document.
    windows = np.concatenate([np.arange(b, b + n - length + 1) for b, n in zip(begins, sizes)])
    places = (places[windows] & _PLACE).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], places[1:] != places[:-1])))
    last = windows[np.concatenate((new[1:], [len(windows)])) - 1]
    place, first = places[new], windows[new]
    part = np.searchsorted(begins, place, "right") - 1
    number, start = np.array(base, np.int64)[part].T
    shift = start - begins[part]
    return number, place + shift, first + shift, last + shift, hashes[place].view(np.int64)


def _rows(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], list(columns))


def in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`id`, `row`, `text`; rows are unique numbers in order of id: the ids themselves where they can be."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text"))
    whole = rows.schema["id"].dataType.typeName() in ("byte", "short", "integer", "long")
    if whole and rows.groupBy("id").count().where(F.col("id").isNull() | (F.col("count") > 1)).isEmpty():
        return rows.withColumn("row", F.col("id").cast("long"))
    order = F.col("id").asc_nulls_last()
    spread = rows.repartitionByRange(order, F.md5("text")).sortWithinPartitions(order, F.md5("text"))
    return materialise(spread.withColumn("row", F.monotonically_increasing_id()), "in-order")


def _grouped(hashes: np.ndarray, pairs: np.ndarray) -> pa.RecordBatch:
    """One row per hash with all its pairs (row, place) as bytes."""
    order = np.argsort(hashes, kind="stable")
    hashes, pairs = hashes[order], np.ascontiguousarray(pairs[order])
    starts = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
    offsets = (16 * np.append(starts, len(hashes))).astype(np.int32)
    at = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(pairs)])
    return _rows(hash=hashes[starts], at=at)


def repeated_anchors(texts: DataFrame, length: int) -> DataFrame:
    """`row`, `place` of every anchor whose hash occurs again.

    A batch of texts sends each hash once, with all its places, so a hash that
    fills the corpus is a row per batch.
    """
    def emit(batches):
        for batch in batches:
            rows = batch.column(0).to_numpy()
            found = [(hashes, np.stack((rows[number], place), axis=1)) for number, place, _, _, hashes in anchors(
                [t.as_py().encode("utf-8", "replace") for t in batch.column(1)], length)]
            if found:
                yield _grouped(*map(np.concatenate, zip(*found)))

    def twins(batches):
        # In order of hash; a row is held back until the next one is known.
        held, held_flag = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            hashes = table["hash"].to_numpy()
            flag = pc.greater(pc.binary_length(table["at"]), 16).to_numpy()
            same = hashes[1:] == hashes[:-1]
            flag = flag | np.append(same, False) | np.insert(same, 0, False)
            flag[0] |= held_flag
            held, held_flag = table.slice(table.num_rows - 1), bool(flag[-1])
            yield pairs(table.slice(0, table.num_rows - 1), flag[:-1])
        if held is not None:
            yield pairs(held, np.array([held_flag]))

    def pairs(table, flag):
        found = np.frombuffer(b"".join(table["at"].filter(pa.array(flag)).to_pylist()), np.int64).reshape(-1, 2)
        return _rows(row=found[:, 0].copy(), place=found[:, 1].copy())

    found = texts.select("row", "text").mapInArrow(emit, "hash long, at binary")
    return found.repartition("hash").sortWithinPartitions("hash").mapInArrow(twins, "row long, place long")


def packed_with(texts: DataFrame, places: DataFrame) -> DataFrame:
    """`row`, `body` (compressed text), `places`: documents that have repeated anchors."""
    def compress(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            yield _rows(row=batch.column(0), body=[pack.compress(t.as_py().encode("utf-8", "replace")) for t in batch.column(1)])

    small = texts.select("row", "text").mapInArrow(compress, "row long, body binary")
    return materialise(small.join(places.groupBy("row").agg(F.collect_list("place").alias("places")), "row"), "bodies")


_SUFFIX = "suffix binary, before binary, low long, high long, row long, place long"
_ORDER = ["suffix", "before", "low", "high", "row", "place"]
_KEY = 48


def _suffix_rows(batch: pa.RecordBatch, length: int):
    """Of the documents of a batch: each repeated anchor's bytes to both sides, its windows, its row and place."""
    unpack = zstandard.ZstdDecompressor()
    rows = batch.column(0).to_numpy()
    texts = [unpack.decompress(b.as_py()) for b in batch.column(1)]
    wanted = [np.asarray(p.values, np.int64) for p in batch.column(2)]
    for number, place, first, last, _ in anchors(texts, length):
        keep = np.zeros(len(place), bool)
        for n in np.unique(number):
            of = slice(*np.searchsorted(number, (n, n + 1)))
            keep[of] = np.isin(place[of], wanted[n])
        number, place, first, last = number[keep], place[keep], first[keep], last[keep]
        at = list(zip(number.tolist(), first.tolist(), place.tolist(), (last + length).tolist()))
        yield [texts[n][p:b] for n, _, p, b in at], [texts[n][a:p] for n, a, p, _ in at], place - last, place - first, rows[number], place


def _keys(suffix: list[bytes], rows: np.ndarray, place: np.ndarray) -> list[bytes]:
    """Leading bytes, then row and place, which part even copies of one suffix."""
    sign = np.uint64(1 << 63)
    tails = (np.stack((rows, place), axis=1).astype(np.uint64) ^ sign).astype(">u8").tobytes()
    return [s[:_KEY] + tails[16 * i:16 * i + 16] for i, s in enumerate(suffix)]


def splitters(bodies: DataFrame, length: int) -> list[bytes]:
    """Keys that part the suffixes into buckets of about equal size, from a sample of SAMPLED keys per bucket."""
    total = bodies.agg(F.sum(F.size("places"))).first()[0] or 0
    buckets = max(int(bodies.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_SUFFIXES))
    share = min(1.0, SAMPLED * buckets / max(1, total))
    # One place in `thin` of more documents, so that no document weighs much.
    thin = 16 if share < 1 / 16 else 1
    limit = int(thin * share * (1 << 20)) + 1

    def sample(batches):
        for batch in batches:
            for suffix, _, _, _, rows, place in _suffix_rows(batch, length):
                drawn = ((place * 2654435761 + rows * 40503) >> 7) % thin == 0
                keys = _keys([s for s, d in zip(suffix, drawn) if d], rows[drawn], place[drawn])
                yield _rows(key=pa.array(keys, pa.binary()))

    drawn = bodies.where(F.pmod(F.xxhash64("row"), F.lit(1 << 20)) < limit).mapInArrow(sample, "key binary")
    keys = sorted(bytes(r["key"]) for r in drawn.collect())
    return [keys[i * len(keys) // buckets] for i in range(1, buckets)] if keys else []


def suffixes(bodies: DataFrame, length: int) -> DataFrame:
    """The suffix at each repeated anchor to the end of its last window, with the bytes before it from its first window on.

    Its windows start `low` to `high` bytes before it. Rows are dealt into buckets by leading bytes, and sorted there.
    """
    cuts = splitters(bodies, length)

    def emit(batches):
        for batch in batches:
            for suffix, before, low, high, rows, place in _suffix_rows(batch, length):
                bucket = np.fromiter((bisect_right(cuts, k) for k in _keys(suffix, rows, place)), np.int32, len(suffix))
                yield _rows(bucket=bucket, suffix=pa.array(suffix, pa.binary()), before=pa.array(before, pa.binary()),
                            low=low, high=high, row=rows, place=place)

    dealt = bodies.mapInArrow(emit, "bucket int, " + _SUFFIX).repartitionById(len(cuts) + 1, "bucket")
    return dealt.select(*_ORDER).sortWithinPartitions(*_ORDER)


def neighbours(found: DataFrame, length: int) -> DataFrame:
    """Sorted suffixes: `start`, `end` where one repeats the one before it; the suffix itself where it must be compared further."""
    def compare(batches):
        kept, kept_flag, before = None, True, None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            seen = table if before is None else pa.concat_tables([before, table])
            before = table.slice(table.num_rows - 1)
            equal = np.ones(seen.num_rows - 1, bool)
            for name in _ORDER[:4]:
                column = seen[name].combine_chunks()
                equal &= pc.equal(column.slice(0, len(column) - 1), column.slice(1)).to_numpy(zero_copy_only=False)
            repeats = equal if seen.num_rows > table.num_rows else np.concatenate(([False], equal))
            copies = table.filter(pa.array(repeats))
            place = copies["place"].to_numpy()
            yield _judged(copies, place - copies["high"].to_numpy(), place - copies["low"].to_numpy() + length)
            # Of those that differ, only ones next to another with the same gram can share windows.
            others = table.filter(pa.array(~repeats))
            others = others if kept is None else pa.concat_tables([kept, others])
            if not others.num_rows:
                continue
            gram = pc.binary_slice(others["suffix"].combine_chunks(), 0, GRAM)
            same = pc.equal(gram.slice(0, len(gram) - 1), gram.slice(1)).to_numpy(zero_copy_only=False)
            flag = np.append(same, False) | np.insert(same, 0, False)
            flag[0] |= kept_flag
            kept, kept_flag = others.slice(others.num_rows - 1), bool(flag[-1])
            yield _judged(others.slice(0, others.num_rows - 1).filter(pa.array(flag[:-1])))
        # The first and the last of a bucket may have others of their gram in the next bucket.
        if kept is not None:
            yield _judged(kept)

    return found.mapInArrow(compare, _SUFFIX + ", start long, end long")


def _judged(table: pa.Table, start=None, end=None) -> pa.RecordBatch:
    """Rows with their span, which then need no bytes any more, or with the bytes and no span."""
    table, n = table.combine_chunks(), table.num_rows
    columns = {name: table[name].combine_chunks() for name in _ORDER}
    if start is not None:
        columns["suffix"] = columns["before"] = pa.nulls(n, pa.binary())
    spans = [pa.nulls(n, pa.int64()) if x is None else pa.array(x, pa.int64()) for x in (start, end)]
    return _rows(**columns, start=spans[0], end=spans[1])


def repeats_of_earlier(words: np.ndarray) -> np.ndarray:
    """Rows of `words` (eight bytes each) that equal an earlier row.

    Multikey sort: rows that agree so far are split by the next word; groups stop
    when they are single or when all of their rows are the same to the end.
    """
    active, group = np.arange(len(words)), np.zeros(len(words), np.int64)
    for depth in range(words.shape[1]):
        order = np.lexsort((words[active, depth], group))
        active, group, key = active[order], group[order], words[active[order], depth]
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (key[1:] != key[:-1])))
        group = np.cumsum(new) - 1
        many = np.bincount(group)[group] > 1
        active, group = active[many], group[many]
        if not len(active):
            return active
        head = np.concatenate(([True], group[1:] != group[:-1]))
        heads = active[head][np.cumsum(head) - 1]
        if (words[active, depth + 1:] == words[heads, depth + 1:]).all():
            break
    return active[~head]


def context_bytes(table: pa.Table, length: int) -> np.ndarray:
    """The bytes around each anchor, one row each, the anchor at the same column."""
    reach = length - GRAM
    out = np.zeros((table.num_rows, reach + length), np.uint8)
    for i, (suffix, before) in enumerate(zip(table["suffix"].to_pylist(), table["before"].to_pylist())):
        out[i, reach - len(before):reach] = np.frombuffer(before, np.uint8)
        out[i, reach:reach + len(suffix)] = np.frombuffer(suffix, np.uint8)
    return out


def _windows(around: np.ndarray, rows: np.ndarray, back: int, length: int) -> np.ndarray:
    """The windows that start `back` bytes before the anchors, as words of eight bytes."""
    reach = length - GRAM
    out = np.zeros((len(rows), -(-length // 8) * 8), np.uint8)
    out[:, :length] = around[rows, reach - back:reach - back + length]
    return out.view(np.uint64)


def shared_windows(rest: DataFrame, length: int, buckets: int) -> DataFrame:
    """`row`, `start`, `end` of windows that occur earlier; suffixes with the same gram meet in one task."""
    def compare(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts).sort_by([("row", "ascending"), ("place", "ascending")])
        around = context_bytes(table, length)
        low, high = table["low"].to_numpy(), table["high"].to_numpy()
        row, place = table["row"].to_numpy(), table["place"].to_numpy()
        found = np.zeros((len(row), int(high.max()) + 3), np.int8)
        for back in range(int(low.min()), int(high.max()) + 1):
            held = np.flatnonzero((low <= back) & (back <= high))
            if len(held) > 1:
                found[held[repeats_of_earlier(_windows(around, held, back, length))], back + 1] = 1
        steps = np.diff(found, axis=1)
        (at, begin), (_, stop) = np.nonzero(steps == 1), np.nonzero(steps == -1)
        # Windows from `begin` to `stop` - 1 bytes before the anchor.
        yield _rows(row=row[at], start=place[at] - stop + 1, end=place[at] - begin + length)

    return rest.repartitionByRange(buckets, F.substring("suffix", 1, GRAM)).mapInArrow(compare, "row long, start long, end long")


def crowded_windows(rest: DataFrame, length: int) -> DataFrame:
    """The same for grams with many suffixes: every window is a row, and rows with the same bytes are grouped."""
    def emit(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            around, reach = context_bytes(table, length), length - GRAM
            for i, (low, high, row, place) in enumerate(zip(*(table[c].to_pylist() for c in ("low", "high", "row", "place")))):
                back = np.arange(low, high + 1)
                yield _rows(window=pa.array([around[i, reach - b:reach - b + length].tobytes() for b in back.tolist()], pa.binary()),
                            row=np.full(len(back), row), start=place - back)

    windows = materialise(rest.mapInArrow(emit, "window binary, row long, start long"), "windows")
    first = windows.groupBy("window").agg(F.min(F.struct("row", "start")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return windows.join(first, "window").where(F.struct("row", "start") != F.col("first")).select(
        "row", "start", (F.col("start") + length).alias("end"))


def repeated_spans(bodies: DataFrame, length: int, crowd: int) -> DataFrame:
    """`row`, `start`, `end`: bytes that a repeated string covers; spans may overlap."""
    judged = materialise(neighbours(suffixes(bodies, length), length), "neighbours")
    rest = judged.where(F.col("start").isNull()).select(*_ORDER)
    gram = F.substring("suffix", 1, GRAM)
    counts = materialise(rest.groupBy(gram.alias("gram")).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "grams")
    found = judged.where(F.col("start").isNotNull()).select("row", "start", "end")
    total, most = counts.agg(F.sum("n"), F.max("n")).first()
    if not total:
        return found
    keyed = rest.withColumn("gram", gram)
    few = keyed.join(counts.where(F.col("n") <= crowd), "gram", "left_semi").select(*_ORDER)
    buckets = max(bodies.sparkSession.sparkContext.defaultParallelism, -(-total // BUCKET_ROWS))
    found = found.unionByName(shared_windows(few, length, buckets))
    if most > crowd:
        many = keyed.join(counts.where(F.col("n") > crowd), "gram", "left_semi").select(*_ORDER)
        found = found.unionByName(crowded_windows(many, length))
    return found


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, crowd: int = CROWD) -> DataFrame:
    """Every document with what is left of it.

    Returns `doc_id`, `n_bytes`, `n_removed`, `n_spans`, `kept_sha256`, `removed`
    (spans as start, end), null where nothing goes.
    """
    if length < GRAM + 8:
        raise ValueError(f"strings of at least {GRAM + 8} bytes are looked for")
    texts = in_order(docs, id_col, text_col)
    bodies = packed_with(texts, repeated_anchors(texts, length))
    spans = repeated_spans(bodies, length, crowd).groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    def cut(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            lost, runs, digests, kept = [], [], [], []
            for body, found in zip(batch.column(1), batch.column(2)):
                text = unpack.decompress(body.as_py())
                pairs = sorted((s["start"], s["end"]) for s in found.as_py())
                merged: list[list[int]] = []
                for start, end in pairs:
                    if merged and start <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], end)
                    else:
                        merged.append([start, end])
                digest, at = sha256(), 0
                for start, end in merged:
                    digest.update(text[at:start])
                    at = end
                digest.update(text[at:])
                lost.append(sum(b - a for a, b in merged))
                runs.append(len(merged))
                digests.append(digest.hexdigest())
                kept.append([{"start": a, "end": b} for a, b in merged])
            yield _rows(row=batch.column(0), n_removed=pa.array(lost, pa.int64()), n_spans=pa.array(runs, pa.int64()), kept=digests,
                        removed=pa.array(kept, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))

    changed = bodies.select("row", "body").join(spans, "row").mapInArrow(
        cut, "row long, n_removed long, n_spans long, kept string, removed array<struct<start: long, end: long>>")
    nothing = F.lit(0).cast("long")
    whole = texts.select("id", "row", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"))
    return whole.join(changed, "row", "left").select(
        F.col("id").alias("doc_id"), "n_bytes", F.coalesce("n_removed", nothing).alias("n_removed"),
        F.coalesce("n_spans", nothing).alias("n_spans"), F.coalesce("kept", "sha").alias("kept_sha256"), "removed")
