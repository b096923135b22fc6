"""Bloom filters that tasks fill on their own and merge by segment.

A filter is an array of 64-bit words; a hash sets four bits of one word.  ``Pair`` holds two of
them: what was seen once, and what was seen again.  Two pairs merge word by word: what either has seen
twice, or each has seen once, has been seen twice.  A merged pair has no false negatives,
whatever the order, so tasks may fill their pairs in any split of the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textgrid import mix

#: Words of one segment, the unit in which filters are merged.
SEGMENT = 1 << 13


def words_for(n: int, bits: int, most_bits: int) -> int:
    """Words of a filter with ``bits`` bits for each of ``n`` hashes, ``most_bits`` at most; a power of two, a segment at least."""
    wanted = max(SEGMENT, -(-min(n * bits, most_bits) // 64))
    return min(1 << (wanted - 1).bit_length(), max(SEGMENT, most_bits // 64))


def places(h: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Word and four bits of every hash."""
    x = mix(h.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D))
    mask = np.zeros(len(x), np.uint64)
    for shift in (40, 46, 52, 58):
        mask |= np.uint64(1) << (x >> np.uint64(shift) & np.uint64(63))
    return (x & np.uint64(words - 1)).astype(np.int64), mask


def contains(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at, mask = places(h, len(bits))
    return bits[at] & mask == mask


class Pair:
    """Filters of hashes seen once and seen twice."""

    def __init__(self, words: int) -> None:
        self.once, self.twice = np.zeros(words, np.uint64), np.zeros(words, np.uint64)

    def add(self, h: np.ndarray) -> None:
        h, times = np.unique(h, return_counts=True)
        at, mask = places(h, len(self.once))
        again = (times > 1) | (self.once[at] & mask == mask)
        np.bitwise_or.at(self.twice, at[again], mask[again])
        np.bitwise_or.at(self.once, at, mask)

    def merge(self, at: np.ndarray, once: np.ndarray, twice: np.ndarray) -> None:
        """Take in the words ``at`` (each at most once) of another pair."""
        self.twice[at] |= twice | (self.once[at] & once)
        self.once[at] |= once


def filled(hashes: DataFrame, words: int) -> DataFrame:
    """segment, once, twice: the merged filters of all ``hashes`` (one long column).

    A task sends the words it has touched, at most two filters whatever it has read; equal segments
    meet in one task, which holds one segment at a time.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Pair(words)
        for batch in batches:
            own.add(batch.column(0).to_numpy().view(np.uint64))
        for lo in range(0, words, SEGMENT):
            at = np.flatnonzero(own.once[lo : lo + SEGMENT])
            if len(at):
                parts = (at.astype(np.uint16), own.once[lo + at], own.twice[lo + at])
                yield pa.record_batch([pa.array([lo // SEGMENT], pa.int32()), *[pa.array([p.tobytes()], pa.binary()) for p in parts]], ["segment", "at", "once", "twice"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, both = None, None

        def done() -> pa.RecordBatch:
            return pa.record_batch([pa.array([here], pa.int32()), pa.array([both.once.tobytes()], pa.binary()), pa.array([both.twice.tobytes()], pa.binary())], ["segment", "once", "twice"])

        for batch in batches:
            for segment, at, once, twice in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if segment != here:
                    if here is not None:
                        yield done()
                    here, both = segment, Pair(SEGMENT)
                both.merge(np.frombuffer(at, np.uint16), np.frombuffer(once, np.uint64), np.frombuffer(twice, np.uint64))
        if here is not None:
            yield done()

    sent = hashes.mapInArrow(local, "segment int, at binary, once binary, twice binary")
    return sent.repartition("segment").sortWithinPartitions("segment").mapInArrow(merged, "segment int, once binary, twice binary")


def collected(segments: DataFrame, which: str, words: int) -> np.ndarray:
    """One filter on the driver: ``words`` words, however many hashes it was filled with."""
    out = np.zeros(words, np.uint64)
    for segment, bits in segments.select("segment", which).toLocalIterator():
        out[segment * SEGMENT : (segment + 1) * SEGMENT] = np.frombuffer(bytes(bits), np.uint64)
    return out
