"""Vectorised word and shingle hashing over Arrow string columns.

Works on the UTF-8 buffer of a whole Arrow chunk at once: word boundaries,
64-bit word hashes and 64-bit hashes of k consecutive words come from a few
numpy passes, never from a Python loop over words.  Texts are cut into chunks
of bounded bytes first, so the temporaries stay bounded whatever the batch
size; a single text is never cut.

A word is a maximal run of bytes other than space and 0x09-0x0D, after A-Z
has been lower-cased.  In UTF-8 these bytes never occur inside another
character, so the byte rule equals the code point rule.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18

# odd multipliers of the polynomial word hash and of the finaliser
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_K1, _K2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_FOLD = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser (a bijection on 64-bit words)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _K1
    x = x ^ (x >> np.uint64(27))
    x = x * _K2
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    done = 1
    while done < n:                       # doubling: log2(n) vector products
        take = min(done, n - done)
        out[done:done + take] = out[:take] * np.uint64(pow(base, done, 1 << 64))
        done += take
    return out


class _Tables:
    up = _powers(_BASE, 1024)
    down = _powers(_BASE_INV, 1024)

    @classmethod
    def need(cls, n: int):
        if n > len(cls.up):
            size = 1 << int(n - 1).bit_length()
            cls.up, cls.down = _powers(_BASE, size), _powers(_BASE_INV, size)
        return cls.up, cls.down


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of rows of about ``limit`` bytes: yields
    ``(first row, row count, bytes, offsets of the rows in bytes)``.  Null rows
    count as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(n, max(at + 1, end))
        yield at, end - at, data[offsets[at]:offsets[end]], offsets[at:end + 1] - offsets[at]
        at = end


def word_hashes(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a chunk, in order, and the word count per row;
    ``space`` marks the bytes that separate words."""
    rows = len(offsets) - 1
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(rows, np.int64)
    low = _LOWER[data]
    inside = ~space[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < len(data)]
    starts[first] = inside[first]         # a word never runs across two texts
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    ends[last] = inside[last]
    b = np.flatnonzero(starts)
    e = np.flatnonzero(ends) + 1
    up, down = _Tables.need(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=sums[1:])
    words = mix((sums[e] - sums[b]) * down[b] + (e - b).astype(np.uint64) * _FOLD)
    counts = np.searchsorted(b, offsets[1:]) - np.searchsorted(b, offsets[:-1])
    return words, counts.astype(np.int64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingle hashes per row: ``(hashes sorted within each row,
    distinct count per row)``.  A row with 1 to k-1 words has its whole sequence
    as one shingle; a row without words has none."""
    words, counts = word_hashes(data, offsets)
    rows = len(counts)
    if not len(words):
        return np.empty(0, np.uint64), np.zeros(rows, np.int64)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    n = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    span = np.minimum(counts, k)
    row = np.repeat(np.arange(rows), n)
    start = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    length = span[row]
    h = length.astype(np.uint64)
    for i in range(k):
        on = length > i
        h = np.where(on, mix(h * _FOLD + words[np.minimum(start + i, len(words) - 1)]), h)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[keep], np.bincount(row[keep], minlength=rows).astype(np.int64)
