"""Language identification by rank-order profiles.

Each language has a profile: its most frequent letter n-grams by rank. A text's
own n-grams are ranked the same way and compared by out-of-place distance: the
sum, over the text's n-grams, of how far each is from its place in the profile;
an n-gram the profile lacks counts as far as can be. Profiles are counted over
all labelled texts that may be learned from.

N-grams are those of words with a space on both sides; case and everything but
letters are left out. Equal counts are ranked by the n-gram itself, and of
languages at the same distance the first by name is predicted, so reruns agree.

Nulls and edge cases: a text that is null or has no letter is `und` with score
0, and so is every text when nothing is labelled. Rows that share an id are rows
of their own. An empty table gives an empty result. Extra columns are ignored.
Long texts are read in pieces, whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotlake.llm.common import held_out, ship

GRAM_LETTERS = 3
PROFILE = 400
TEXT_GRAMS = 300
UNKNOWN = "und"
_PIECE = 1 << 20
_FLUSH = 1 << 20
_SPACE = np.uint64(1)
_BITS = np.uint64(21)

ship(__name__)


def _letters(codes: np.ndarray) -> np.ndarray:
    """The code points, everything but letters turned into a space."""
    kinds, inverse = (codes, None) if len(codes) < 2 else np.unique(codes, return_inverse=True)
    mapped = np.fromiter((c if chr(c).isalpha() else 1 for c in kinds.tolist()), np.uint64, len(kinds))
    return mapped if inverse is None else mapped[inverse]


_ALPHA = np.fromiter((c if not 0xD800 <= c < 0xE000 and chr(c).isalpha() else 1 for c in range(1 << 16)), np.uint64, 1 << 16)


def _piece_grams(piece: str, letters: int) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer(piece.lower().encode("utf-32-le", "replace"), np.uint32)
    codes = _ALPHA[codes] if not len(codes) or codes.max() < 1 << 16 else _letters(codes)
    codes = np.concatenate(([_SPACE], codes, [_SPACE]))
    codes = codes[np.concatenate(([True], (codes[1:] != _SPACE) | (codes[:-1] != _SPACE)))]
    grams, packed = [codes[codes != _SPACE]], codes
    for n in range(2, letters + 1):
        packed = packed[:-1] | (codes[n - 1:] << (_BITS * np.uint64(n - 1)))
        # A space may only be the first or the last letter.
        inner = np.ones(len(packed), bool)
        for i in range(1, n - 1):
            inner &= codes[i:i + len(packed)] != _SPACE
        grams.append(packed[inner])
    return np.unique(np.concatenate(grams), return_counts=True)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of counts per n-gram."""
    if len(parts) == 1:
        return parts[0]
    grams, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return grams, np.bincount(inverse, np.concatenate([p[1] for p in parts]), len(grams)).astype(np.int64)


def text_grams(text: str | None, letters: int = GRAM_LETTERS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text, packed into integers, and their counts."""
    text = text or ""
    if len(text) <= _PIECE:
        return _piece_grams(text, letters)
    parts, start = [], 0
    while start < len(text):
        # Pieces end between words where there is a space near the end.
        end = start + _PIECE
        cut = text.rfind(" ", start + 1, end) if end < len(text) else -1
        end = cut if cut > start else end
        parts.append(_piece_grams(text[start:end], letters))
        start = end
    return merged(parts)


def ranked(grams: np.ndarray, counts: np.ndarray, limit: int) -> np.ndarray:
    """The most frequent n-grams in order of rank."""
    return grams[np.lexsort((grams, -counts))[:limit]]


def profiles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             letters: int = GRAM_LETTERS, size: int = PROFILE) -> DataFrame:
    """`lang`, `gram`, `place` of the `size` most frequent n-grams of every language, from rows that may be learned from."""
    known = docs.select(held_out(id_col).alias("out"), F.col(f"`{lang_col}`").cast("string").alias("lang"),
                        F.col(f"`{text_col}`").cast("string").alias("text")).where(
        ~F.col("out") & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")

    def count(batches):
        held: dict[str, list] = {}

        def rows():
            for lang, parts in held.items():
                grams, counts = merged(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(grams)), pa.array(grams.view(np.int64)), pa.array(counts.astype(np.int64))],
                    ["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.setdefault(lang, []).append(text_grams(text.as_py(), letters))
            for lang, parts in held.items():
                held[lang] = [merged(parts)]
            if sum(len(p[0][0]) for p in held.values()) > _FLUSH:
                yield from rows()
        yield from rows()

    counted = known.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # First the best of every slice of a language, then the best of those.
    order = [F.col("n").desc(), F.col("gram")]
    sliced = Window.partitionBy("lang", F.pmod(F.xxhash64("gram"), F.lit(32))).orderBy(*order)
    best = counted.withColumn("place", F.row_number().over(sliced)).where(F.col("place") <= size).drop("place")
    return best.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(*order)) - 1).where(
        F.col("place") < size).select("lang", "gram", "place")


def distances(grams: np.ndarray, known: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    """Out-of-place distance of ranked n-grams to every profile, as a share of the largest possible."""
    at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
    there = known[at] == grams
    place = np.where(there, places[:, at], -1)
    far = np.where(place < 0, size, np.abs(place - np.arange(len(grams))))
    return np.minimum(far, size).sum(axis=1) / (size * len(grams))


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
              letters: int = GRAM_LETTERS, size: int = PROFILE, text_size: int = TEXT_GRAMS) -> DataFrame:
    """Every document with its predicted language: `doc_id`, `held_out`, `lang_pred`, `score`."""
    # `size` rows per language.
    rows = profiles(docs, id_col, text_col, lang_col, letters, size).collect()
    names = sorted({r["lang"] for r in rows})
    known = np.unique(np.array([r["gram"] for r in rows], np.int64).view(np.uint64))
    places = np.full((len(names), len(known)), -1, np.int32)
    for r in rows:
        gram = np.array([r["gram"]], np.int64).view(np.uint64)[0]
        places[names.index(r["lang"]), np.searchsorted(known, gram)] = r["place"]

    def predict(batches):
        for batch in batches:
            found, scores = [], []
            for text in batch.column(2):
                grams, counts = text_grams(text.as_py(), letters)
                if not len(grams) or not names:
                    found.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                far = distances(ranked(grams, counts, text_size), known, places, size)
                best = int(far.argmin())
                found.append(names[best])
                scores.append(1.0 - float(far[best]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"])

    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), held_out(id_col).alias("held_out"),
                        F.col(f"`{text_col}`").cast("string").alias("text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    return texts.mapInArrow(predict, f"doc_id {id_type}, held_out boolean, lang_pred string, score double")
