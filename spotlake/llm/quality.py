"""Quality rules: repetition inside a document, and lines that many documents of a host share.

Lines are normalised, hashed and counted in distinct documents per host, where
documents with the same text are one document. A line is above the limit if more
than `max_documents` of the host's distinct documents hold it, however large the
host is. Such lines are removed from every document but the first of the host that
holds it, so a page that others quote stays whole. A document is rejected when
the removed lines held more than `max_removed` of its words, or when it fails the
base rules.

Nulls and edge cases: a null text has no words and fails the base rules; a null
host is a host of its own. Rows that share an id are rows of their own. A very long
text is read whole by one task, and counts like any other. An empty table gives
an empty result. Extra columns are ignored. Two lines whose 64-bit hashes meet
count as one; the chance is far below one in a billion per pair.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotlake.llm.common import row_number_column, ship, text_of, type_of
from spotlake.sources.scratch import materialise

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_DOCUMENTS = 20
MAX_REMOVED = 0.5
_SYMBOLS = b"#*$%&|<>"
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_DIGITS = re.compile(rb"[0-9]+")

ship(__name__)


def normal_line(line: bytes) -> bytes:
    """A line without its case, spacing and numbers."""
    return b" ".join(_DIGITS.sub(b"0", line.translate(_LOWER)).split())


def _signed_hash(value: bytes) -> int:
    number = xxhash.xxh64_intdigest(value)
    return number - (1 << 64) if number >> 63 else number


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that the text holds twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    twice = np.fromiter((counts[w] > 1 for w in windows), bool, len(windows))
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift:shift + len(twice)] |= twice
    return int(covered.sum())


def measures(text: str) -> tuple[int, int, int, int, int, dict[bytes, int]]:
    """Words, their characters, symbols, repeated lines, repeated words; words per normalised line."""
    body = text.encode("utf-8", "replace")
    words = body.split()
    seen: set[bytes] = set()
    repeats, lines = 0, {}
    for line in body.split(b"\n"):
        count = len(line.split())
        if count:
            repeats += line in seen
            seen.add(line)
            key = normal_line(line)
            lines[key] = lines.get(key, 0) + count
    symbols = sum(map(body.count, (_SYMBOLS[i:i + 1] for i in range(len(_SYMBOLS)))))
    # Every byte but the continuation bytes of UTF-8 starts a character.
    letters = sum(len(w) for w in words) if body.isascii() else sum(len(w.decode("utf-8", "replace")) for w in words)
    return len(words), letters, symbols, repeats, repeated_words(words), lines


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
             row_col: str | None = None) -> DataFrame:
    """One row per document: counts, a digest of the text, and its lines as hashes with their words."""
    rows = docs.select(row_number_column(row_col).alias("row"), F.col(f"`{id_col}`").alias("id"),
                       F.col(f"`{host_col}`").cast("string").alias("host"), F.xxhash64(text_of(text_col)).alias("digest"),
                       text_of(text_col).alias("text"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def measure(batches):
        for batch in batches:
            found = [measures(t.as_py()) for t in batch.column(4)]
            lines = [f[5] for f in found]
            ends = np.cumsum([0, *map(len, lines)], dtype=np.int32)
            hashes = pa.array(map(_signed_hash, chain.from_iterable(lines)), pa.int64())
            words = pa.array(chain.from_iterable(x.values() for x in lines), pa.int64())
            numbers = [pa.array([f[i] for f in found], pa.int64()) for i in range(5)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], *numbers, pa.ListArray.from_arrays(ends, hashes), pa.ListArray.from_arrays(ends, words)],
                ["row", "id", "host", "digest", *counts, "line", "line_words"])

    schema = (f"row {type_of(rows, 'row')}, id {type_of(rows, 'id')}, host string, digest long, "
              + ", ".join(f"{c} long" for c in counts) + ", line array<long>, line_words array<long>")
    return rows.mapInArrow(measure, schema)


def frequent_lines(lines: DataFrame, max_documents: int) -> DataFrame:
    """Lines (`host`, `line`) above the limit, with the row of the first document that holds each."""
    per_text = lines.groupBy("host", "line", "digest").agg(F.min(F.struct(F.col("id"), F.col("row"))).alias("first"))
    counted = per_text.groupBy("host", "line").agg(F.count(F.lit(1)).alias("documents"), F.min("first").alias("first"))
    return counted.where(F.col("documents") > max_documents).select("host", "line", F.col("first.row").alias("first_row"))


def _lines(found: DataFrame) -> DataFrame:
    """One row per different line of each document."""
    return found.select("row", "id", "host", "digest", F.explode(F.arrays_zip("line", "line_words")).alias("l")).select(
        "row", "id", "host", "digest", "l.line", "l.line_words")


def _removed(found: DataFrame, max_documents: int) -> DataFrame:
    """Lines that go, one row per document and line."""
    lines = _lines(found)
    frequent = materialise(frequent_lines(lines, max_documents), "frequent-lines")
    return lines.join(frequent, ["host", "line"]).where("row <> first_row")


def _found(docs: DataFrame, id_col: str, text_col: str, host_col: str, row_col: str | None) -> DataFrame:
    return materialise(measured(docs, id_col, text_col, host_col, row_col).withColumn(
        "host", F.when(F.col("host").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("host")))), "measures")


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
           max_documents: int = MAX_DOCUMENTS, max_removed: float = MAX_REMOVED,
           row_col: str | None = None) -> DataFrame:
    """Every document with its measures and verdict.

    Returns `row`, `doc_id`, `n_words`, `word_chars`, `n_symbols`, `n_dup_lines`,
    `n_repeat_words`, `base_failed`, `n_removed_words`, `kept`.
    """
    found = _found(docs, id_col, text_col, host_col, row_col)
    removed = _removed(found, max_documents).groupBy("row").agg(F.sum("line_words").alias("removed"))
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    lost = F.coalesce(F.col("removed"), F.lit(0).cast("long"))
    return found.join(removed, "row", "left").select(
        "row", F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"), lost.alias("n_removed_words"),
        (~base_failed & (lost <= max_removed * F.col("n_words"))).alias("kept"))


def without_frequent_lines(docs: DataFrame, row_col: str, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                           max_documents: int = MAX_DOCUMENTS) -> DataFrame:
    """`row`, `text`: the texts without the lines above the limits. `row_col` holds a stable row key."""
    found = _found(docs, id_col, text_col, host_col, row_col)
    removed = _removed(found, max_documents).groupBy("row").agg(F.collect_set("line").alias("gone"))
    texts = docs.select(F.col(f"`{row_col}`").alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def strip(batches):
        for batch in batches:
            out = []
            for text, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if gone and text is not None:
                    gone, lines = set(gone), text.split("\n")
                    hashes = [_signed_hash(normal_line(line.encode("utf-8", "replace"))) for line in lines]
                    text = "\n".join(line for line, h in zip(lines, hashes) if h not in gone)
                out.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["row", "text"])

    return texts.join(removed, "row", "left").select("row", "text", "gone").mapInArrow(strip, f"row {type_of(texts, 'row')}, text string")
