"""Lexical retrieval packing: documents that share rare words fill a window together.

Every document becomes token ids with an end id. Full windows of a document are
sequences of their own. What is left of each document, its tail, goes to a shard
of a BM25 index. In a shard each seed, the longest unused tail, asks the index
with all different ids of its document for its best unused neighbours; they fill
its window greedily, whole where they fit, and the best one that does not fit is
cut. The few tokens that
no window takes are laid out in sequences whose lengths are powers of two, so
nothing is padded.

Shards follow the content: a sample of short sketches of the documents' BM25
weights is cut in halves along its widest direction until each part is one
shard, and every document goes where its sketch falls. A part that is much
larger, such as a group of copies, is dealt evenly to several shards, so none
grows with the input. A seed asks its own shard only. Documents are indexed whole, with what is in their full windows,
and document frequencies are those of all documents of the table.

Nulls and edge cases: a null text is empty, and an empty document is its end id
alone. Rows that share an id are documents of their own. A null id stays null.
An empty table gives no pieces. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotlake.llm.common import row_number_column, ship, text_of, type_of
from spotlake.sources.scratch import materialise

WINDOW = 2048
END_ID = 1
SHARD_TOKENS = 2_000_000
# A term is a column of a shard's matrix if more than this part of its documents hold it.
COMMON_SHARE = 20
# Documents are sketched by so many random sums of their weights; the sketches of so many a shard choose the cuts.
SKETCH = 64
SAMPLE, LEAST_SAMPLE = 64, 4096
# Room that a document takes in a shard besides its tail, so that very short ones do not crowd; a shard is cut above SLACK.
ROW_TOKENS = 128
SLACK = 1.5
SEEDS = 32
K1, B = 1.2, 0.75
# The added token of the vocabulary; the tokenizer file reads it as one id wherever it stands in a text.
SPECIAL = {"<|endoftext|>": 50256}
_IDS = 1 << 16

ship(__name__)


def encoder(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    """Byte-level BPE from a rank file; its ids are those of the tokenizer file of the same vocabulary."""
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    if max(ranks.values()) >= _IDS:
        raise ValueError("ids of over 16 bits are not supported")
    return tiktoken.Encoding("pack", pat_str=pattern, mergeable_ranks=ranks, special_tokens=SPECIAL)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def tokenised(docs: DataFrame, ranks_path: str, pattern: str, id_col: str, text_col: str, window: int, row_col: str | None) -> DataFrame:
    """One row per document.

    `row`, `id`, `doc_tokens`, `full` (checksums of its full windows), `tail` (the ids after them, two bytes each),
    `terms` and `times` (the different ids of the whole text and their counts, two and four bytes each).
    """
    rows = docs.select(row_number_column(row_col).alias("row"), F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text"))

    def encode(batches):
        encoding = encoder(ranks_path, pattern)
        for batch in batches:
            sizes, full, tails, terms, times = [], [], [], [], []
            for text in batch.column(2):
                ids = encoding.encode_to_numpy(text.as_py(), allowed_special="all").astype("<u4")
                found, count = np.unique(ids.astype("<u2"), return_counts=True)
                terms.append(found.tobytes())
                times.append(count.astype("<u4").tobytes())
                ids = np.append(ids, np.uint32(END_ID))
                whole = len(ids) // window * window
                sizes.append(len(ids))
                full.append([crc(ids[i:i + window]) for i in range(0, whole, window)])
                tails.append(ids[whole:].astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(full, pa.list_(pa.int64())),
                 *(pa.array(c, pa.binary()) for c in (tails, terms, times))],
                ["row", "id", "doc_tokens", "full", "tail", "terms", "times"])

    return rows.mapInArrow(encode, f"row {type_of(rows, 'row')}, id {type_of(rows, 'id')}, doc_tokens long, full array<long>, "
                                   "tail binary, terms binary, times binary")


def document_frequencies(tokens: DataFrame) -> np.ndarray:
    """In how many whole documents each id occurs; a vector of fixed length."""
    def count(batches):
        seen = np.zeros(_IDS, np.int64)
        for batch in batches:
            for terms in batch.column(0):
                seen[np.frombuffer(terms.as_py(), "<u2")] += 1
        ids = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(seen[ids])], ["term", "n"])

    out = np.zeros(_IDS, np.int64)
    for r in tokens.select("terms").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r["term"]] = r["n"]
    return out


def term_weights(terms: np.ndarray, times: np.ndarray, size, rarity: np.ndarray, mean: float) -> np.ndarray:
    """BM25 weight of each term of a document of `size` ids."""
    return (rarity[terms] * times * (K1 + 1) / (times + K1 * (1 - B + B * size / mean))).astype(np.float32)


class Index:
    """BM25 index of the documents of one shard: every term of a document is indexed, and asked for.

    Terms that many documents hold are columns of a matrix, the others have postings; a score is the sum of both.
    """

    def __init__(self, docs: list, rarity: np.ndarray, mean: float, order: np.ndarray | None = None):
        # A document is its ids, or its different ids with their counts.
        found = [d if isinstance(d, tuple) else np.unique(d, return_counts=True) for d in docs]
        self.size, self.terms = len(docs), [t for t, _ in found]
        # The matrix is asked for several seeds at once, in the order in which they are likely to come.
        self.order = np.arange(self.size) if order is None else order
        self.place = np.argsort(self.order)
        self.ready: dict[int, np.ndarray] = {}
        counts = np.array([len(t) for t in self.terms], np.int64)
        lengths = np.array([n.sum() for _, n in found], np.float64)
        every = np.concatenate([np.zeros(0, np.int64), *self.terms]).astype(np.int64)
        times = np.concatenate([np.zeros(0, np.int64), *(n for _, n in found)])
        weights = term_weights(every, times, np.repeat(lengths, counts), rarity, mean)
        where = np.repeat(np.arange(self.size, dtype=np.int32), counts)
        held = np.bincount(every, minlength=_IDS)
        common = np.flatnonzero(held > max(16, self.size // COMMON_SHARE))
        self.column = np.full(_IDS, -1, np.int32)
        self.column[common] = np.arange(len(common), dtype=np.int32)
        self.matrix = np.zeros((self.size, len(common)), np.float32)
        dense = self.column[every] >= 0
        self.matrix[where[dense], self.column[every[dense]]] = weights[dense]
        every, where, weights = every[~dense], where[~dense], weights[~dense]
        order = np.argsort(every, kind="stable")
        self.docs, self.weights = where[order], weights[order]
        self.starts = np.searchsorted(every[order], np.arange(_IDS + 1))

    def _common(self, seed: int, unused: np.ndarray | None) -> np.ndarray:
        if seed not in self.ready:
            later = self.order[self.place[seed] + 1:]
            block = [seed, *(later[unused[later]][:SEEDS - 1].tolist() if unused is not None else ())]
            queries = np.zeros((self.matrix.shape[1], len(block)), np.float32)
            for i, doc in enumerate(block):
                columns = self.column[self.terms[doc]]
                queries[columns[columns >= 0], i] = 1
            self.ready = dict(zip(block, np.ascontiguousarray((self.matrix @ queries).T)))
        return self.ready[seed]

    def scores(self, seed: int, unused: np.ndarray | None = None) -> np.ndarray:
        """Score of every document for all terms of the seed."""
        terms = self.terms[seed]
        out = self._common(seed, unused).astype(np.float64)
        spans = [slice(self.starts[t], self.starts[t + 1]) for t in terms[self.column[terms] < 0].tolist()]
        if spans:
            out += np.bincount(np.concatenate([self.docs[s] for s in spans]),
                               np.concatenate([self.weights[s] for s in spans]), self.size)
        return out

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share a term with the seed, best first."""
        scores = self.scores(seed, unused) * unused
        found = np.flatnonzero(scores > 0)
        return found[np.argsort(-scores[found], kind="stable")]


def seed_order(lengths: np.ndarray) -> np.ndarray:
    return np.lexsort((np.arange(len(lengths)), -lengths))


def fill(lengths: np.ndarray, neighbours, window: int):
    """Windows as lists of (tail, first id, number of ids); every id of every tail is in exactly one."""
    start = np.zeros(len(lengths), np.int64)
    left = lengths.copy()
    unused = left > 0
    # Seeds by length; a tail that was cut comes again with what is left of it.
    order = seed_order(lengths).tolist()
    at = 0
    while at < len(order):
        seed = order[at]
        if not unused[seed]:
            at += 1
            continue
        unused[seed] = False
        window_left = window - int(left[seed])
        parts = [(seed, int(start[seed]), int(left[seed]))]
        while window_left and unused.any():
            best = neighbours(seed, unused)
            if not len(best):
                best = np.flatnonzero(unused)
            cut = int(best[0])
            while window_left and len(best):
                # The next that fits, then only those behind it that still fit.
                best = best[left[best] <= window_left]
                if len(best):
                    doc, best = int(best[0]), best[1:]
                    unused[doc] = False
                    parts.append((doc, int(start[doc]), int(left[doc])))
                    window_left -= int(left[doc])
            if window_left and unused[cut]:
                parts.append((cut, int(start[cut]), window_left))
                start[cut] += window_left
                left[cut] -= window_left
                window_left = 0
        if window_left:
            yield from powers(parts, window - window_left)
        else:
            yield parts


def powers(parts: list[tuple[int, int, int]], total: int):
    """The parts laid out in windows whose lengths are the powers of two that make up the total."""
    parts = list(reversed(parts))
    for bit in reversed(range(total.bit_length())):
        room, out = total & (1 << bit), []
        while room:
            doc, start, size = parts.pop()
            out.append((doc, start, min(size, room)))
            if size > room:
                parts.append((doc, start + room, size - room))
            room -= out[-1][2]
        if out:
            yield out


def signs() -> np.ndarray:
    return np.random.RandomState(7).choice(np.array([-1, 1], np.float32), (_IDS, SKETCH))


def sketch(terms: np.ndarray, times: np.ndarray, rarity: np.ndarray, mean: float, every: np.ndarray) -> np.ndarray:
    """The direction of a document's BM25 weights, in few numbers."""
    out = term_weights(terms, times, times.sum(), rarity, mean) @ every[terms]
    return out / max(1e-9, float(np.linalg.norm(out)))


def cuts(sketches: np.ndarray, loads: np.ndarray, shards: int):
    """A tree of cuts across the widest direction, (direction, limit, left, right), down to leaves of one shard's load.

    A leaf is how many shards it stands for; it is more than one where sketches are all alike.
    """
    if shards < 2 or len(sketches) < 2:
        return shards
    apart = sketches - np.average(sketches, axis=0, weights=loads)
    direction = np.linalg.eigh((apart * loads[:, None]).T @ apart)[1][:, -1].astype(np.float32)
    along = sketches @ direction
    order, half = np.argsort(along, kind="stable"), shards // 2
    load = np.cumsum(loads[order])
    at = min(int(np.searchsorted(load, load[-1] * half / shards)), len(order) - 1)
    # A cut between two values that differ, so that equal texts are not parted by rounding.
    at = next((i for d in range(len(order)) for i in (at - d, at + d + 1)
               if 0 < i < len(order) and along[order[i]] - along[order[i - 1]] > 1e-5), 0)
    if not at:
        return shards
    limit = (along[order[at]] + along[order[at - 1]]) / 2
    left = along < limit
    return direction, limit, cuts(sketches[left], loads[left], half), cuts(sketches[~left], loads[~left], shards - half)


def leaves(tree, sketches: np.ndarray) -> np.ndarray:
    """The number of each sketch's leaf."""
    out, number = np.zeros(len(sketches), np.int64), 0
    stack = [(tree, np.arange(len(sketches)))]
    while stack:
        node, rows = stack.pop()
        if not isinstance(node, tuple):
            out[rows] = number
            number += 1
            continue
        left = sketches[rows] @ node[0] < node[1]
        stack += [(node[3], rows[~left]), (node[2], rows[left])]
    return out


def with_shards(tokens: DataFrame, rarity: np.ndarray, mean: float, load: int, n: int, shard_tokens: int) -> DataFrame:
    """`tokens` with a `shard` that follows the content: documents of like terms go to one shard.

    Where a shard would take much more than `shard_tokens`, such as a large group of copies, its rows are dealt evenly to several.
    """
    shards = -(-load // shard_tokens)
    if shards < 2:
        return tokens.withColumn("shard", F.lit(0).cast("long"))
    tokens = tokens.withColumn("deal", F.xxhash64("row"))
    loads = (F.octet_length("tail") / 2 + ROW_TOKENS).cast("long")

    def sketched(batch, every):
        pairs = zip(batch.column("terms"), batch.column("times"))
        found = [sketch(np.frombuffer(a.as_py(), "<u2"), np.frombuffer(b.as_py(), "<u4"), rarity, mean, every) for a, b in pairs]
        return np.array(found, np.float32).reshape(-1, SKETCH)

    def sample(batches):
        every = signs()
        for batch in batches:
            found = pa.array([x.tobytes() for x in sketched(batch, every)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("deal"), batch.column("load"), found], ["deal", "load", "sketch"])

    # A bounded number of short rows for each shard.
    part = max(1, n // max(LEAST_SAMPLE, SAMPLE * shards))
    drawn = tokens.where(F.pmod("deal", F.lit(part)) == 0).select("deal", "terms", "times", loads.alias("load")).mapInArrow(
        sample, "deal long, load long, sketch binary").toArrow().sort_by("deal")
    points = np.array([np.frombuffer(x.as_py(), np.float32) for x in drawn["sketch"]], np.float32).reshape(-1, SKETCH)
    tree = cuts(points, drawn["load"].to_numpy().astype(np.float64), int(shards))

    def place(batches):
        every = signs()
        for batch in batches:
            yield batch.append_column("leaf", pa.array(leaves(tree, sketched(batch, every))))

    def placed(rows: DataFrame) -> DataFrame:
        return rows.mapInArrow(place, ", ".join(f"`{c}` {type_of(rows, c)}" for c in rows.columns) + ", leaf long")

    # Sketched again for the shuffle, which takes less than to write all tails a second time. One row for each leaf.
    full = {r["leaf"]: r["load"] for r in placed(tokens.select("terms", "times", loads.alias("load"))).groupBy("leaf").agg(
        F.sum("load").alias("load")).collect()}
    parts = [1 if full.get(i, 0) <= SLACK * shard_tokens else -(-full[i] // shard_tokens) for i in range(max(full) + 1)]
    first = np.cumsum([0, *parts]).tolist()
    ends = F.array(*(F.lit(x).cast("long") for x in first))
    leaf = F.col("leaf").cast("int")
    start = F.get(ends, leaf)
    return placed(tokens).withColumn("shard", start + F.pmod(F.col("deal"), F.get(ends, leaf + 1) - start)).drop("deal", "leaf")


def pack(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
         shard_tokens: int = SHARD_TOKENS, row_col: str | None = None) -> DataFrame:
    """Every piece of every document with its place.

    Returns `doc_id`, `start`, `length`, `ids_crc32`, `doc_tokens`, `sequence_id`, `offset`.
    """
    tokens = materialise(tokenised(docs, ranks_path, pattern, id_col, text_col, window, row_col), "tokens")
    totals = tokens.agg(F.sum(F.octet_length("tail")).alias("bytes"), F.sum("doc_tokens").alias("ids"), F.count(F.lit(1)).alias("n")).first()
    # The end id is no part of a text.
    n, mean = totals["n"], max(1.0, (totals["ids"] or 0) / max(1, totals["n"]) - 1)
    seen = document_frequencies(tokens)
    rarity = np.log1p((n - seen + 0.5) / (seen + 0.5))
    id_type = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def pack_shard(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by("row").combine_chunks()
        base = shard["shard"][0].as_py() << 32
        tails = [np.frombuffer(t.as_py(), "<u2") for t in shard["tail"]]
        sizes = shard["doc_tokens"].to_pylist()
        lengths = np.array([len(t) for t in tails], np.int64)
        index = Index([(np.frombuffer(a.as_py(), "<u2"), np.frombuffer(b.as_py(), "<u4")) for a, b in zip(shard["terms"], shard["times"])],
                      rarity, mean, seed_order(lengths))
        which, start, length, checks, sequence, offset = [], [], [], [], [], []
        number = 0
        for doc, full in enumerate(shard["full"].to_pylist()):
            for i, check in enumerate(full):
                for column, value in zip((which, start, length, checks, sequence, offset), (doc, i * window, window, check, base + number, 0)):
                    column.append(value)
                number += 1
        for parts in fill(lengths, index.neighbours, window):
            place = 0
            for doc, first, size in parts:
                values = (doc, sizes[doc] - len(tails[doc]) + first, size, crc(tails[doc][first:first + size]), base + number, place)
                for column, value in zip((which, start, length, checks, sequence, offset), values):
                    column.append(value)
                place += size
            number += 1
        rows = pa.array(which, pa.int64())
        return pa.table([shard["id"].take(rows), *(pa.array(c, pa.int64()) for c in (start, length, checks)),
                         shard["doc_tokens"].take(rows), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=names)

    load = (totals["bytes"] or 0) // 2 + ROW_TOKENS * n
    return with_shards(tokens, rarity, mean, load, n, shard_tokens).groupBy("shard").applyInArrow(
        pack_shard, f"doc_id {id_type}, " + ", ".join(f"{c} long" for c in names[1:]))
