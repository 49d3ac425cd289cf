"""Whole-column text arithmetic on Arrow buffers.

Texts arrive as one UTF-8 buffer per Arrow batch.  Words (runs of anything but the six ASCII
white-space characters) are found and hashed with numpy over the whole buffer, so no Python object is
made per word.  Work goes in pieces of about ``PIECE`` bytes, cut at document ends or, inside a longer
document, at white space, so memory follows the piece and not the document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 5  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    """``_BASE**i`` and ``_BASE**-i`` modulo 2**64 for i up to n, kept for the next call."""
    if len(_powers[0]) <= n:
        size = max(n + 1, PIECE + 1)
        for k, base in enumerate((_BASE, _INVERSE)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            np.multiply.accumulate(out, out=out)
            _powers[k] = out
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every bit of a 64-bit key over all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


class Hashes:
    """64-bit hashes of spans of ``data``, equal for equal bytes wherever they stand."""

    def __init__(self, data: np.ndarray):
        up, self.down = _power_tables(len(data))
        self.sums = np.empty(len(data) + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        found = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        return mix(found + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return Hashes(data).of(starts, ends)


def word_spans(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of ``data``; no word crosses a place in ``cuts`` (document starts)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~SPACE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = solid[cuts]
    last[cuts - 1] = solid[cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def pieces(offsets: np.ndarray, size: int | None = None) -> Iterator[tuple[int, int]]:
    """Runs of whole documents (first, past last) of about ``size`` bytes together."""
    size, n, a = size or PIECE, len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def _long_words(data: np.ndarray) -> np.ndarray:
    """Word hashes of one long document, piece by piece, cut where white space is."""
    found, at, n = [], 0, len(data)
    while at < n:
        end = min(n, at + PIECE)
        while end < n and not SPACE[data[end]]:  # a word never falls apart
            ahead = np.flatnonzero(SPACE[data[end : end + PIECE]])
            end = end + int(ahead[0]) if len(ahead) else min(n, end + PIECE)
        part = data[at:end]
        starts, ends = word_spans(part, np.zeros(0, np.int64))
        found.append(span_hashes(part, starts, ends))
        at = end
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def document_words(column: pa.Array, lower: bool = False, table: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield (index of the first document, word offsets of the documents, word hashes) per piece.

    ``table`` maps bytes before words are cut; ``lower`` is short for A-Z to a-z."""
    table = LOWER if lower else table
    offsets, data = text_buffers(column)
    for a, b in pieces(offsets):
        part, starts_at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        if table is not None:
            part = table[part]
        if len(part) > 2 * PIECE:
            words = _long_words(part)
            yield a, np.array([0, len(words)]), words
            continue
        starts, ends = word_spans(part, starts_at[:-1])
        yield a, np.searchsorted(starts, starts_at), span_hashes(part, starts, ends)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words (in order, repeats kept); fewer words make one run of all of them."""
    if len(words) < k:
        k = len(words)
        if not k:
            return np.zeros(0, np.uint64)
    n = len(words) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = out * np.uint64(0xC2B2AE3D27D4EB4F) + words[i : i + n]
    return mix(out)
