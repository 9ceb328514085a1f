"""Toxic texts by a subsequence string kernel and a support vector machine over Nyström landmarks.

The kernel compares two words by the letter subsequences of length three they
share, each worth less the more it is stretched, so that an insult with gaps or
inserted characters stays close to the plain one. Landmarks are the words that
set labelled toxic documents apart, and frequent words of clean ones. A sentence
is described by its closest word to each landmark; the landmarks' own kernel
matrix turns that into Nyström features for a linear support vector machine,
trained on labelled sentences: the most suspicious one of each toxic document
against the most suspicious ones of clean documents. A text scores as its worst
sentence.

A word counts for a landmark only if it holds all of the landmark's different
letters a to z. Single letters in a row ("i d i o t") also count as a word;
words of over 24 characters are read through overlapping windows.

The model is fitted on at most `sample` labelled documents per class; every text
is scored whole.

Nulls and edge cases: null and empty texts score like a sentence without any
suspicious word. Without labels of both classes every score is 0. Rows that
share an id are rows of their own; where labels repeat an id, any toxic label
counts. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotlake.llm.common import held_out, ship

SAMPLE = 2000
TOXIC_WORDS = 48
CLEAN_WORDS = 8
CANDIDATES = 600
ORDER = 3
DECAY = 0.6
LONGEST = 24
CLEAN_SENTENCES = 3
THRESHOLD = 0.7
_CACHE = 1 << 19
_PIECE = 1 << 22
_BITS = np.zeros(256, np.uint32)
_BITS[97:123] = np.uint32(1) << np.arange(26, dtype=np.uint32)
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_ENDS = np.zeros(256, bool)
_ENDS[[33, 46, 63]] = True
_SPELLED = re.compile(rb"(?<!\S)(?:[a-z]\s){2,}[a-z](?!\S)")
_EDGES = bytes(range(97)) + bytes(range(123, 128))

ship(__name__)


def letter_mask(word: bytes) -> int:
    return int(np.bitwise_or.reduce(_BITS[np.frombuffer(word, np.uint8)])) if word else 0


def _padded(words: list[bytes], fill: int) -> tuple[np.ndarray, np.ndarray]:
    width = max(map(len, words))
    out = np.full((len(words), width), fill, np.uint8)
    for i, w in enumerate(words):
        out[i, :len(w)] = np.frombuffer(w, np.uint8)
    return out, np.array([len(w) for w in words])


def kernel(left: list[bytes], right: list[bytes], order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """Subsequence kernel of each pair left[i], right[i], not normalised."""
    if not left:
        return np.zeros(0)
    s, _ = _padded(left, 0)
    t, _ = _padded(right, 1)
    same = s[:, :, None] == t[:, None, :]
    # `ends[i, a, b]`: subsequences that end at letters a and b, with their stretch so far.
    ends = same * decay ** 2
    for _ in range(order - 1):
        carried = np.zeros(ends.shape)
        # Sums over all earlier pairs of places, each step away costing one more factor.
        above = np.zeros((len(s), t.shape[1]))
        for a in range(1, s.shape[1]):
            above = decay * above + ends[:, a - 1, :]
            total = np.zeros(len(s))
            for b in range(1, t.shape[1]):
                total = decay * total + above[:, b - 1]
                carried[:, a, b] = total
        ends = same * carried * decay ** 2
    return ends.sum(axis=(1, 2))


class Closeness:
    """Kernel of words to the landmarks, between 0 and 1, remembered per word."""

    def __init__(self, landmarks: list[bytes]):
        self.landmarks = landmarks
        self.masks = np.array([letter_mask(w) for w in landmarks], np.uint32)
        self.own = np.sqrt(kernel(landmarks, landmarks))
        self.known: dict[bytes, np.ndarray] = {}

    def suspects(self, masks: np.ndarray) -> np.ndarray:
        """Which words hold the letters of some landmark."""
        found = np.zeros(len(masks), bool)
        for mask in self.masks:
            found |= masks & mask == mask
        return found

    def _windows(self, word: bytes) -> list[bytes]:
        word = word.strip(_EDGES)
        if len(word) <= LONGEST:
            return [word]
        return [word[i:i + LONGEST] for i in range(0, len(word) - LONGEST // 2, LONGEST // 2)]

    def to_landmarks(self, words: list[bytes]) -> np.ndarray:
        new = list({w for w in words if w not in self.known})
        if new:
            if len(self.known) + len(new) > _CACHE:
                self.known.clear()
                new = list(set(words))
            parts, owner, mark = [], [], []
            for i, w in enumerate(new):
                for part in self._windows(w):
                    held = self.masks & np.uint32(letter_mask(part)) == self.masks
                    for m in np.flatnonzero(held) if len(part) >= ORDER else ():
                        parts.append(part)
                        owner.append(i)
                        mark.append(m)
            close = np.zeros((len(new), len(self.landmarks)), np.float32)
            if parts:
                # Pairs of like length together, so that little is padded.
                turn = np.argsort([len(p) for p in parts], kind="stable")
                values = np.zeros(len(parts))
                for at in np.array_split(turn, max(1, len(turn) // 8192)):
                    some = [parts[i] for i in at]
                    each, back = np.unique(np.array(some, object), return_inverse=True)
                    own = np.sqrt(kernel(each.tolist(), each.tolist()))[back]
                    pair = kernel(some, [self.landmarks[mark[i]] for i in at])
                    values[at] = np.divide(pair, own * self.own[np.array(mark)[at]], out=np.zeros(len(at)), where=own > 0)
                np.maximum.at(close, (np.array(owner), np.array(mark)), values.astype(np.float32))
            self.known.update(zip(new, close))
        return np.stack([self.known[w] for w in words])


def _pieces(body: bytes):
    """The text in pieces that end at a line or, failing that, a space; all of it."""
    start = 0
    while len(body) - start > _PIECE:
        cut = max(body.rfind(b"\n", start + 1, start + _PIECE), 0) or max(body.rfind(b" ", start + 1, start + _PIECE), 0)
        end = cut if cut > start else start + _PIECE
        yield body[start:end]
        start = end
    yield body[start:]


def sentences(text: str | None, close: Closeness) -> np.ndarray:
    """Closeness to the landmarks of every sentence that has a suspicious word."""
    found = []
    for body in _pieces((text or "").lower().encode("utf-8", "replace")):
        body = _SPELLED.sub(lambda m: m.group() + b" " + b"".join(m.group().split()), body)
        codes = np.frombuffer(body, np.uint8)
        space = _SPACES[codes]
        starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
        if not len(starts):
            continue
        suspects = np.flatnonzero(close.suspects(np.bitwise_or.reduceat(_BITS[codes], starts)))
        if not len(suspects):
            continue
        ends = np.flatnonzero(~space & np.concatenate((space[1:], [True]))) + 1
        # A sentence ends with a line or with a word that ends in a full stop or the like.
        last = _ENDS[codes[ends - 1]].copy()
        last[np.minimum(np.searchsorted(starts, np.flatnonzero(codes == 10)) - 1, len(last) - 1)] = True
        sentence = np.concatenate(([0], np.cumsum(last[:-1])))[suspects]
        words = [body[a:b] for a, b in zip(starts[suspects].tolist(), ends[suspects].tolist())]
        values = close.to_landmarks(words)
        groups = np.flatnonzero(np.concatenate(([True], sentence[1:] != sentence[:-1])))
        found.append(np.maximum.reduceat(values, groups, axis=0))
    return np.concatenate(found) if found else np.zeros((0, len(close.landmarks)), np.float32)


def nystroem(landmarks: list[bytes]) -> np.ndarray:
    """Inverse square root of the landmarks' kernel matrix."""
    n = len(landmarks)
    pairs = kernel([a for a in landmarks for _ in landmarks], landmarks * n).reshape(n, n)
    own = np.sqrt(np.diag(pairs))
    values, vectors = np.linalg.eigh(pairs / np.outer(own, own))
    return vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T


def train_svm(features: np.ndarray, labels: np.ndarray, penalty: float = 1.0, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear machine with squared hinge loss, classes weighed alike."""
    x = np.hstack([features, np.ones((len(features), 1))])
    y = np.where(labels, 1.0, -1.0)
    cost = np.where(labels, 0.5 / max(1, labels.sum()), 0.5 / max(1, (~labels).sum())) * penalty * len(x)
    w, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(rounds):
        inside = y * (x @ w) < 1
        xi = x[inside] * cost[inside, None]
        new = np.linalg.solve(ridge + xi.T @ x[inside], xi.T @ y[inside])
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w[:-1], float(w[-1])


def calibrate(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve from margins to chances."""
    y = np.where(labels, (labels.sum() + 1) / (labels.sum() + 2), 1 / ((~labels).sum() + 2))
    slope, offset = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(slope * margins + offset, -30, 30)))
        weight = np.maximum(p * (1 - p), 1e-9)
        x = np.stack([margins, np.ones(len(margins))])
        step = np.linalg.solve((x * weight) @ x.T + 1e-3 * np.eye(2), x @ (y - p) - 1e-3 * np.array([slope, offset]))
        slope, offset = slope + step[0], offset + step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(slope), float(offset)


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample: int) -> DataFrame:
    """`toxic`, `text` of at most `sample` documents per class, drawn by a hash of the id from rows that may be learned from."""
    marks = labels.select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("toxic")).where(
        F.col("id").isNotNull() & F.col("toxic").isNotNull()).groupBy("id").agg(F.max("toxic").alias("toxic"))
    marks = marks.where(~held_out("id"))
    drawn = [marks.where(F.col("toxic") == t).orderBy(F.md5(F.col("id").cast("string")), "id").limit(sample) for t in (0, 1)]
    # 2 * sample rows of two numbers.
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return texts.join(F.broadcast(drawn[0].unionByName(drawn[1])), "id").select("toxic", "text")


def landmark_words(sample: DataFrame, toxic_words: int, clean_words: int) -> tuple[list[bytes], list[bytes]]:
    """Words that set toxic documents apart, then frequent words of clean ones."""
    word = F.explode(F.array_distinct(F.filter(
        F.transform(F.split(F.lower("text"), r"\s+"), lambda w: F.regexp_replace(w, r"^[^\p{L}]+|[^\p{L}]+$", "")),
        lambda w: w.rlike(rf"^\p{{L}}{{4,{LONGEST // 2}}}$"))))
    counts = sample.select("toxic", word.alias("word")).groupBy("word").agg(
        F.count_if(F.col("toxic") == 1).alias("bad"), F.count_if(F.col("toxic") == 0).alias("good"))
    totals = sample.groupBy("toxic").count().collect()
    n = {r["toxic"]: r["count"] for r in totals}
    if not n.get(0) or not n.get(1):
        return [], []
    odds = F.log((F.col("bad") + 0.5) / n[1]) - F.log((F.col("good") + 0.5) / n[0])
    least = max(3, n[1] // 100)
    bad = counts.where(F.col("bad") >= least).withColumn("odds", odds).where("odds > 2.5").orderBy(
        F.desc("bad"), "word").limit(CANDIDATES).collect()
    # Letters that also fill many clean words would make everything a suspect.
    good = counts.where(odds < 1).where(F.size(F.array_distinct(F.split("word", ""))) > 7).orderBy(
        F.desc("good"), "word").limit(clean_words).collect()
    return spread([r["word"].encode() for r in bad], toxic_words), [r["word"].encode() for r in good]


def spread(words: list[bytes], limit: int, near: float = 0.8) -> list[bytes]:
    """The first words of the list that no earlier choice is close to."""
    words = [w for w in words if letter_mask(w).bit_count() > 2]
    own = dict(zip(words, np.sqrt(kernel(words, words)).tolist()))
    chosen: list[bytes] = []
    for w in words:
        if len(chosen) < limit and not (
                chosen and (kernel([w] * len(chosen), chosen) / (own[w] * np.array([own[c] for c in chosen]))).max() >= near):
            chosen.append(w)
    return chosen


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample: int) -> tuple[list[bytes], np.ndarray, float, float, float] | None:
    """Landmarks, weights over closeness, bias, and the calibration; None without labels of both classes."""
    drawn = labelled_sample(docs, labels, id_col, text_col, sample).repartition(
        docs.sparkSession.sparkContext.defaultParallelism, F.md5("text"))
    bad, good = landmark_words(drawn, TOXIC_WORDS, CLEAN_WORDS)
    if not bad:
        return None
    landmarks = bad + good

    def describe(batches):
        close = Closeness(landmarks)
        for batch in batches:
            toxic, vectors = [], []
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = sentences(text.as_py(), close)
                if not len(found):
                    found = np.zeros((1, len(landmarks)), np.float32)
                keep = 1 if label else CLEAN_SENTENCES
                for v in found[np.argsort(-found[:, :len(bad)].max(axis=1), kind="stable")[:keep]]:
                    toxic.append(label)
                    vectors.append(v.tolist())
            yield pa.RecordBatch.from_arrays(
                [pa.array(toxic, pa.int32()), pa.array(vectors, pa.list_(pa.float32()))], ["toxic", "vector"])

    # CLEAN_SENTENCES * 2 * sample short vectors at most.
    rows = drawn.mapInArrow(describe, "toxic int, vector array<float>").collect()
    x = np.array([r["vector"] for r in rows])
    y = np.array([r["toxic"] == 1 for r in rows])
    order = np.lexsort((*x.T, y))
    x, y = x[order], y[order]
    half = nystroem(landmarks)
    weights, bias = train_svm(x @ half, y)
    slope, offset = calibrate(x @ half @ weights + bias, y)
    return landmarks, half @ weights, bias, slope, offset


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE,
             threshold: float = THRESHOLD) -> DataFrame:
    """Every document with its score: `doc_id`, `held_out`, `score`, `predicted`."""
    model = fit(docs, labels, id_col, text_col, sample)

    def score(batches):
        close = Closeness(model[0]) if model else None
        for batch in batches:
            scores = []
            for text in batch.column(2):
                if not model:
                    scores.append(0.0)
                    continue
                _, weights, bias, slope, offset = model
                found = sentences(text.as_py(), close)
                margin = max(0.0, float((found @ weights).max())) + bias if len(found) else bias
                scores.append(float(1 / (1 + np.exp(-np.clip(slope * margin + offset, -500, 500)))))
            bad = [int(s >= threshold) for s in scores]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array(bad, pa.int32())],
                ["doc_id", "held_out", "score", "predicted"])

    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), held_out(id_col).alias("held_out"),
                        F.col(f"`{text_col}`").cast("string").alias("text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    return texts.mapInArrow(score, f"doc_id {id_type}, held_out boolean, score double, predicted int")
