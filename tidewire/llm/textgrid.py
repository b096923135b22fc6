"""Vectorised tokenisation of whole Arrow string columns.

A *grid* is a flat view of many texts at once: one byte buffer, and for every
word its document, byte range and 64-bit hash.  Words are maximal runs of bytes
other than space, tab, newline, vertical tab, form feed and carriage return
(``[^\\x20\\x09-\\x0D]+``).  Those bytes never occur inside a multi-byte UTF-8
sequence, so working on bytes equals working on code points.

Hashes are polynomial (mod 2**64) and then mixed, which lets numpy hash every
word, shingle or window of a batch with a handful of array passes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Texts are processed in slices of about this many bytes, which bounds memory.
SLICE_BYTES = 512 << 10

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

#: Breaks at every ASCII byte that is not a letter.
NOT_LETTER = np.ones(256, dtype=bool)
NOT_LETTER[0x80:] = False
NOT_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = False

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int, kind: str = "up") -> np.ndarray:
    """The first ``n`` powers of the hash base (``up``) or of its inverse.  Tables of up to a million are kept."""
    if len(_powers[kind]) >= n:
        return _powers[kind][:n]
    size = n if n > 1 << 20 else 1 << max(n - 1, 1).bit_length()
    table = np.full(size, _BASE if kind == "up" else _INVERSE, np.uint64)
    table[0] = 1
    np.cumprod(table, out=table)
    if size <= 1 << 20:
        _powers[kind] = table
    return table[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(values: np.ndarray, plus: int = 0) -> np.ndarray:
    """Prefix sums, of ``values`` and ``plus``, from which ``span_hash`` takes the hash of any range."""
    out = np.zeros(len(values) + 1, np.uint64)
    out[1:] = values
    if plus:
        out[1:] += np.uint64(plus)
    out[1:] *= powers(len(values))
    np.cumsum(out[1:], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of ``values[start:end]``; depends on the values only."""
    with np.errstate(over="ignore"):
        return mix((prefix[end] - prefix[start]) * powers(len(prefix), "down")[start] + (end - start).astype(np.uint64))


@dataclass
class Grid:
    """Words of ``n_docs`` texts; ``first[d]:first[d + 1]`` are the words of text ``d``."""

    data: np.ndarray
    bounds: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    prefix: np.ndarray

    @property
    def n_docs(self) -> int:
        return len(self.bounds) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(bounds: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``size`` bytes each; one long text stands alone."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = int(np.searchsorted(bounds, bounds[i] + size, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def grid(data: np.ndarray, bounds: np.ndarray, lower: bool = False, breaks: np.ndarray = _SPACE) -> Grid:
    """Tokenise ``data``, the concatenated texts with the given offsets, at the bytes marked in ``breaks``."""
    if lower:
        data = _LOWER[data]
    n = len(data)
    word = ~breaks[data]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = word[:-1]
    start = np.flatnonzero(word & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1:] = False
    after[:-1] = word[1:]
    end = np.flatnonzero(word & (~after | edge[1:])) + 1
    prefix = prefix_hash(data, 1)
    first = np.searchsorted(start, bounds)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    return Grid(data, bounds, doc, start, end, span_hash(prefix, start, end), first, prefix)


def grids(column: pa.Array, lower: bool = False, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, Grid]]:
    """Grids over consecutive ranges ``lo:hi`` of the column's texts."""
    data, bounds = buffers(column)
    for lo, hi in slices(bounds, size):
        yield lo, hi, grid(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo], lower)


def shingles(g: Grid, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of every run of ``width`` words.

    A text with at least one word and fewer than ``width`` gives one shingle,
    its whole word sequence.
    """
    prefix = prefix_hash(g.hash)
    count = g.counts()
    n = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    doc = np.repeat(np.arange(g.n_docs), n)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + g.first[:-1][doc]
    return doc, span_hash(prefix, at, at + np.minimum(width, count)[doc])


def cut_long(data: np.ndarray, bounds: np.ndarray, breaks: np.ndarray, size: int = SLICE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Offsets in which texts of over twice ``size`` bytes are cut behind bytes marked in ``breaks``, and the text of every part."""
    extra = [np.zeros(0, np.int64)]
    for d in np.flatnonzero(np.diff(bounds) > 2 * size):
        lo, hi = int(bounds[d]), int(bounds[d + 1])
        at = np.flatnonzero(breaks[data[lo:hi]]) + lo + 1
        k = np.searchsorted(at, np.arange(lo + size, hi, size))
        extra.append(np.unique(at[k[k < len(at)]]))
    new = np.setdiff1d(np.concatenate(extra), bounds)
    every = np.concatenate([bounds, new])
    order = np.argsort(every, kind="stable")
    return every[order], np.cumsum(order < len(bounds))[:-1] - 1
