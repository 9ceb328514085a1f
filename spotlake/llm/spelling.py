"""Spelling variants by range searches in K-d trees over letter-count vectors.

One inserted, deleted or replaced letter moves a word's vector of letter counts
by at most two in L1 distance: by one to a word a letter shorter, by two or none
to a word of the same length. For each length a K-d tree holds the words; words
of the same and of the next length search it. A search leaves out every box that
is further away than the radius, and what it finds is verified letter by letter.

The upper levels of the trees are fitted on at most `SAMPLE` words, the ones of
least hash, and cut the words into cells. Every word lies in one cell and is sent
to all cells its search box meets, so no near pair is lost whatever the sample
is. A task holds the words of one cell at a time, with a tree of its own over
them; the words that search it stream past.

Nulls and edge cases: a null text has no words; a null id counts as an empty one
in the hash that picks letters to drop. Ties between forms go to the word that is
first in code-point order. Repeated rows count as often as they come. Texts are
worked on in parts that end between words, so a very long text is never held in
several copies. Empty tables and texts without letters give no rows. Extra
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotlake.llm.common import ship, text_of
from spotlake.llm.textparts import parts_of, words_in
from spotlake.sources.scratch import materialise

DROP_ONE_IN = 199
MIN_LETTERS = 6
MIN_COUNT = 5
FORM_RATIO = 5
# Words the upper levels of the trees are fitted on, and how many of them a cell keeps.
SAMPLE = 65536
CELL_SAMPLE = 64
# Words in a leaf of the tree within a cell.
LEAF = 16
# Letters a-z have a dimension each, the accented ones share six.
DIMENSIONS = 32
# Comparisons of one step of a search.
STEP = 1 << 20

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_CUT = np.zeros(256, bool)
_CUT[:128] = ~_LETTER[:128]
_LEAD = 0xC3
_DIMENSION = np.zeros(256, np.int64)
_DIMENSION[97:123] = np.arange(26)
_DIMENSION[192:256] = 26 + np.arange(64) % (DIMENSIONS - 26)
_UNARY = np.array([(1 << n) - 1 for n in range(5)], np.uint64)

ship(__name__)


def crc_shift(length: int) -> np.ndarray:
    """Tables that carry a CRC-32 over `length` more bytes: the CRC of a joined text is this of the head, xor that of the tail."""
    zeros = bytes(length)
    empty = zlib.crc32(zeros)
    bits = [zlib.crc32(zeros, 1 << b) ^ empty for b in range(32)]
    tables = np.zeros((4, 256), np.uint32)
    for byte in range(4):
        for b in range(8):
            tables[byte, (np.arange(256) >> b) & 1 == 1] ^= np.uint32(bits[8 * byte + b])
    return tables


def hashes(heads: np.ndarray, tails: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of head and tail joined, from the CRC-32 of both and the tails' bytes."""
    kinds, which = np.unique(lengths, return_inverse=True)
    tables = np.stack([crc_shift(int(n)) for n in kinds])
    out = tails.copy()
    for byte in range(4):
        out ^= tables[which, byte, (heads >> np.uint32(8 * byte)) & np.uint32(255)]
    return out


def letters_in(data: np.ndarray) -> np.ndarray:
    """True for the bytes of letters A-Z, a-z and U+00C0 to U+00FF; these last are one lead byte and one more."""
    lead = data == _LEAD
    inside = _LETTER[data] | lead
    inside[1:] |= lead[:-1]
    return inside


def counted(batches):
    """`word`, `c` of the words of each batch of (id, text), one letter dropped where the hash says so."""
    for batch in batches:
        heads = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in batch.column(0).to_pylist()], np.uint32)
        for data, begins, rows in parts_of(batch.column(1), _CUT):
            words, word, text, _ = words_in(data, begins, letters_in(data))
            if not len(word):
                continue
            spelled = words.to_pylist()
            sizes = np.array([len(w) for w in spelled])
            tails = np.array([zlib.crc32(w) for w in spelled], np.uint32)
            h = hashes(heads[rows[text]], tails[word], sizes[word])
            dropped = np.flatnonzero(h % DROP_ONE_IN == 0)
            counts = np.bincount(word, minlength=len(spelled))
            counts -= np.bincount(word[dropped], minlength=len(spelled))
            changed = Counter()
            for w, draw in zip(word[dropped].tolist(), h[dropped].tolist()):
                letters = spelled[w].decode()
                at = draw % len(letters)
                changed[letters[:at] + letters[at + 1:]] += 1
            whole = [(w.decode(), c) for w, c in zip(spelled, counts.tolist()) if c]
            found = [(w, c) for w, c in [*whole, *changed.items()] if len(w) >= MIN_LETTERS]
            yield pa.RecordBatch.from_arrays(
                [pa.array([w for w, _ in found], pa.string()), pa.array([c for _, c in found], pa.int64())], ["word", "c"])


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`word`, `n` of all words of at least `MIN_LETTERS` letters and `MIN_COUNT` occurrences."""
    found = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), text_of(text_col).alias("text")).mapInArrow(counted, "word string, c long")
    return found.groupBy("word").agg(F.sum("c").alias("n")).where(F.col("n") >= MIN_COUNT)


# K-d trees. A node is (dimension, cut, left, right); a leaf is its number.


def matrix(words: list[str]) -> np.ndarray:
    """The code points of words of one length."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def vectors(letters: np.ndarray) -> np.ndarray:
    """Letter counts of the rows of `matrix`."""
    out = np.zeros((len(letters), DIMENSIONS), np.int32)
    rows = np.arange(len(letters))
    for column in _DIMENSION[letters].T:
        out[rows, column] += 1
    return out


def build(points: np.ndarray, leaf: int, members: list[np.ndarray], rows: np.ndarray | None = None):
    """A tree over `points`; `members` receives the rows of each leaf."""
    rows = np.arange(len(points)) if rows is None else rows
    here = points[rows]
    spread = here.max(axis=0) - here.min(axis=0) if len(here) else np.zeros(1)
    if len(rows) <= leaf or not spread.any():
        members.append(rows)
        return len(members) - 1
    dimension = int(np.argmax(here.var(axis=0)))
    values = here[:, dimension]
    cut = int(np.median(values))
    cut = cut - 1 if cut == values.max() else cut
    left = values <= cut
    return dimension, cut, build(points, leaf, members, rows[left]), build(points, leaf, members, rows[~left])


def visit(tree, queries: np.ndarray, radius: int, rows=None, away=None, low=None, high=None):
    """(leaf, rows of the queries within `radius` of its box) for all leaves that have some.

    A child's box differs from its parent's in one dimension, so only that part of a distance is counted anew.
    """
    if rows is None:
        rows, away = np.arange(len(queries)), np.zeros(len(queries), np.int32)
        low, high = [-1 << 30] * DIMENSIONS, [1 << 30] * DIMENSIONS
    if not len(rows):
        return
    if isinstance(tree, int):
        yield tree, rows
        return
    dimension, cut, left, right = tree
    here = queries[rows, dimension]

    def outside():
        return np.maximum(low[dimension] - here, 0) + np.maximum(here - high[dimension], 0)

    others = away - outside()
    for child, bounds, value in ((left, high, cut), (right, low, cut + 1)):
        kept, bounds[dimension] = bounds[dimension], value
        there = others + outside()
        near = there <= radius
        yield from visit(child, queries, radius, rows[near], there[near], low, high)
        bounds[dimension] = kept


def unary(points: np.ndarray) -> np.ndarray:
    """Counts as runs of at most four bits: the bits that differ are never more than the L1 distance."""
    runs = _UNARY[np.minimum(points, 4)].reshape(len(points), 2, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))
    return np.bitwise_or.reduce(runs, axis=2)


def one_edit(longer: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Rows of two letter matrices that differ by one replaced letter, or by one letter that only `longer` has."""
    size = shorter.shape[1]
    if longer.shape[1] == size:
        return (longer != shorter).sum(axis=1) == 1
    head = np.logical_and.accumulate(longer[:, :size] == shorter, axis=1).sum(axis=1)
    tail = np.logical_and.accumulate((longer[:, 1:] == shorter)[:, ::-1], axis=1).sum(axis=1)
    return head + tail >= size


class Cell:
    """The words of one cell, all of one length, with their tree."""

    def __init__(self, words: list[str], counts: list[int]):
        self.words, self.counts = np.array(words, object), np.array(counts, np.int64)
        self.letters = matrix(words)
        points = vectors(self.letters)
        self.codes = unary(points)
        self.leaves: list[np.ndarray] = []
        self.tree = build(points, LEAF, self.leaves)

    def near(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Index pairs (searching word, word of the cell) that are one edit apart."""
        letters = matrix(words)
        points = vectors(letters)
        codes = unary(points)
        radius = 2 if letters.shape[1] == self.letters.shape[1] else 1
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for leaf, rows in visit(self.tree, points, radius):
            members = self.leaves[leaf]
            step = max(1, STEP // len(members))
            for start in range(0, len(rows), step):
                part = rows[start:start + step]
                differ = sum(np.bitwise_count(codes[part, k][:, None] ^ self.codes[members, k][None, :]) for k in range(2))
                q, p = np.nonzero(differ <= radius)
                q, p = part[q], members[p]
                same = one_edit(letters[q], self.letters[p])
                left.append(q[same])
                right.append(p[same])
        return np.concatenate(left), np.concatenate(right)


_NEAR = pa.schema([("word", pa.string()), ("other", pa.string()), ("other_n", pa.int64())])


def _pairs(words, counts, cell: Cell, both: bool) -> pa.RecordBatch:
    q, p = cell.near(words)
    words, counts = np.array(words, object), np.array(counts, np.int64)
    one, two, n = words[q], cell.words[p], cell.counts[p]
    if both:
        one, two, n = np.concatenate([one, two]), np.concatenate([two, one]), np.concatenate([n, counts[q]])
    return pa.RecordBatch.from_arrays([pa.array(one, pa.string()), pa.array(two, pa.string()), pa.array(n)], schema=_NEAR)


def searched(batches):
    """`word`, `other`, `other_n` from rows (cell, role, word, n) that are sorted by cell and role.

    Role 0 are the words of the cell, 1 words of their length from other cells, 2 words one letter longer.
    """
    current, words, counts, cell = None, [], [], None
    for batch in batches:
        key = batch.column(0).to_numpy() * 4 + batch.column(1).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            number, role = divmod(int(key[a]), 4)
            some, n = batch.column(2)[a:b].to_pylist(), batch.column(3)[a:b].to_pylist()
            if number != current and words:
                own = cell or Cell(words, counts)
                if cell is None:
                    yield _pairs(words, counts, own, False)
                words, counts = [], []
            if number != current:
                current, cell = number, None
            if role == 0:
                words += some
                counts += n
                continue
            if words and cell is None:
                cell = Cell(words, counts)
                yield _pairs(words, counts, cell, False)
            if cell is not None:
                yield _pairs(some, n, cell, role == 2)
    if words and cell is None:
        yield _pairs(words, counts, Cell(words, counts), False)


def upper_trees(sample: list[str]) -> dict[int, tuple]:
    """For each length the tree of its sampled words, and the number of its first cell."""
    of_length: dict[int, list[str]] = {}
    for w in sample:
        of_length.setdefault(len(w), []).append(w)
    trees, first = {}, 0
    for length, words in sorted(of_length.items()):
        leaves: list[np.ndarray] = []
        trees[length] = build(vectors(matrix(words)), CELL_SAMPLE, leaves), first
        first += len(leaves)
    return trees


def near_words(vocab: DataFrame) -> DataFrame:
    """`word`, `other`, `other_n` for every ordered pair of words that are one edit apart."""
    sample = [r["word"] for r in vocab.select("word").orderBy(F.xxhash64("word"), "word").limit(SAMPLE).collect()]
    trees = upper_trees(sample)
    free = 1 + max((first for _, first in trees.values()), default=0) + 2 * len(sample)

    def tree_of(length: int):
        # A length without a sampled word is one cell with a number of its own.
        return trees.get(length, (0, free + length))

    def dealt(batches):
        for batch in batches:
            words = np.array(batch.column(0).to_pylist(), object)
            counts = batch.column(1).to_numpy()
            lengths = np.array([len(w) for w in words], np.int64)
            for length in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == length)
                points = vectors(matrix(words[rows].tolist()))
                tree, first = tree_of(length)
                home = np.zeros(len(rows), np.int64)
                for leaf, inside in visit(tree, points, 0):
                    home[inside] = leaf
                out = [(first + home, np.zeros(len(rows), np.int64), rows)]
                for leaf, inside in visit(tree, points, 2):
                    inside = inside[home[inside] != leaf]
                    out.append((np.full(len(inside), first + leaf), np.ones(len(inside), np.int64), rows[inside]))
                shorter, first = tree_of(length - 1)
                if length > MIN_LETTERS:
                    for leaf, inside in visit(shorter, points, 1):
                        out.append((np.full(len(inside), first + leaf), np.full(len(inside), 2), rows[inside]))
                cell, role, row = (np.concatenate(c) for c in zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell), pa.array(role), pa.array(words[row], pa.string()), pa.array(counts[row])], ["cell", "role", "word", "n"])

    rows = vocab.select("word", "n").mapInArrow(dealt, "cell long, role long, word string, n long")
    return rows.repartition("cell").sortWithinPartitions("cell", "role").mapInArrow(searched, "word string, other string, other_n long")


def roots(forms: DataFrame) -> DataFrame:
    """`word`, `root` from `word`, `form`: the end of each chain of forms, by doubling the steps.

    A form is at least `FORM_RATIO` times as frequent as its word, so chains end.
    """
    ends = forms.select("word", F.col("form").alias("root"))
    while True:
        further = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ends = materialise(ends.join(further, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if ends.where("moved").isEmpty():
            return ends.select("word", "root")
        ends = ends.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every word with the more frequent spelling it is a variant of.

    Returns `word`, `form` (its most frequent near word, if `FORM_RATIO` times as
    frequent), `root` (the end of the chain of forms), `n`, `n_near`, `form_n`.
    """
    vocab = materialise(vocabulary(docs, id_col, text_col), "vocabulary")
    best = F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word")))
    near = near_words(vocab).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    frequent = -F.col("best.n") >= FORM_RATIO * F.col("n")
    words = materialise(vocab.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(frequent, F.col("best.word")).alias("form"),
        F.when(frequent, -F.col("best.n")).alias("form_n")), "variants")
    ends = roots(words.where("form IS NOT NULL").select("word", "form"))
    return words.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
