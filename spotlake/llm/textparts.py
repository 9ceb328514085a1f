"""Cutting batches of texts into words on their bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from spotlake.llm.common import ship

# Bytes of text that are worked on at once.
PART = 8 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

ship(__name__)


def parts_of(texts: pa.Array, cut: np.ndarray | None, size: int = PART):
    """(bytes, offsets where a text starts, number of the text at each offset), about `size` bytes at a time.

    `cut` marks the byte values after which a text may be parted; without it
    texts stay whole. What has no such byte for `size` bytes stays whole too.
    """
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    if texts.buffers()[2] is None:
        return
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    start = 0
    while start < len(data):
        end = min(start + size, len(data))
        if end < len(data):
            text = int(offsets[np.searchsorted(offsets, end, "right") - 1])
            stop = int(offsets[np.searchsorted(offsets, end, "left")])
            marks = np.flatnonzero(cut[data[max(start, text):end]]) if cut is not None else ()
            if len(marks):
                end = max(start, text) + int(marks[-1]) + 1
            elif text > start:
                end = text
            else:
                ahead = np.flatnonzero(cut[data[end:stop]]) if cut is not None else ()
                end = end + int(ahead[0]) + 1 if len(ahead) else stop
        # Texts that begin in this part, and the one that goes on from the part before.
        rows = np.arange(np.searchsorted(offsets, start, "right") - 1, np.searchsorted(offsets, end))
        yield data[start:end], np.maximum(offsets[rows] - start, 0), rows
        start = end


def words_in(data: np.ndarray, begins: np.ndarray, inside: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The different words, the word at every place, the place in `begins` of its text, and its first byte.

    `inside` marks the bytes of words; letters A-Z are lower-cased.
    """
    first = np.zeros(len(data) + 1, bool)
    first[begins] = first[-1] = True
    # A word begins after a byte outside or where a text begins, and ends likewise.
    edge = np.empty(len(data) + 1, bool)
    edge[0] = edge[-1] = True
    np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
    edge |= first
    starts = np.flatnonzero(edge[:-1] & inside)
    ends = np.flatnonzero(edge[1:] & inside) + 1
    letters = LOWER[data[inside]]
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    found = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
    # Empty texts begin where the next one does; a word belongs to the last that begins at or before it.
    text = np.searchsorted(begins, starts, "right") - 1
    return found.dictionary, found.indices.to_numpy(zero_copy_only=False).astype(np.int64), text, starts
