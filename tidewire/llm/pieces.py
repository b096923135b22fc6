"""SentencePiece encoding by sampling from the piece lattice, and decoding.

A text is cut where no piece of the vocabulary can cross: before a run of
spaces that follows other characters, and around line breaks.  Each unit has a
lattice with an arc for every piece that matches; a character without a piece of
its own is spelled in bytes.  Forward filtering sums the weights of all paths to
each position; backward sampling draws a segmentation from the end with exactly
the probability its weight gives it.  Every draw is a hash of the row's key, the
unit's number and the step, so a row is segmented alike wherever it is computed.

The vocabulary's scores are ranks of merges.  A piece of rank r weighs
(r + 10) ** -1, the frequencies of Zipf's law, to the power ``theta``.

Units of a batch are handled as arrays: matches of all distinct units are looked
up by hash and verified, positions are summed in lockstep, and all occurrences draw
their next piece at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .textgrid import buffers, mix, prefix_hash, slices, span_hash

SPACE = 0x2581  # the vocabulary's sign for a space


@dataclass(frozen=True)
class Settings:
    #: Vocabulary file; never copied into the repository.
    model_file: str
    theta: float = 1.0
    seed: int = 17


class Vocabulary:
    """Pieces as code-point arrays, found by hash."""

    def __init__(self, model_file: str, theta: float) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = model.get_piece_size()
        self.text = [model.id_to_piece(i) for i in range(n)]
        self.byte = np.full(256, -1)
        ordinary = []
        for i, t in enumerate(self.text):
            if model.is_byte(i):
                self.byte[int(t[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) and t:
                ordinary.append(i)
        if (self.byte < 0).any():
            raise ValueError("the vocabulary has no piece for some byte; decoding would lose text")
        inner = [t for i in ordinary if (t := self.text[i]).strip("▁") and "▁" in t.lstrip("▁")]
        if inner or any("\n" in self.text[i] for i in ordinary):
            raise ValueError("the vocabulary has pieces across words")
        score = np.array([model.get_score(i) for i in ordinary])
        rank = np.empty(len(ordinary))
        rank[np.argsort(-score, kind="stable")] = np.arange(len(ordinary))
        weight = (rank + 10.0) ** -theta
        self.byte_weight = (len(ordinary) + 10.0) ** -theta
        longest = max(len(self.text[i]) for i in ordinary)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.sieve: dict[int, np.ndarray] = {}
        for length in range(1, longest + 1):
            own = [k for k, i in enumerate(ordinary) if len(self.text[i]) == length]
            if not own:
                continue
            code = np.frombuffer("".join(self.text[ordinary[k]] for k in own).encode("utf-32-le"), np.uint32)
            prefix = prefix_hash(code.astype(np.uint64) + np.uint64(1))
            start = np.arange(len(own)) * length
            key = span_hash(prefix, start, start + length)
            order = np.argsort(key)
            self.by_length[length] = (key[order], np.array(ordinary)[own][order], weight[own][order])
            sieve = np.zeros(1 << 18, bool)
            sieve[(key & np.uint64((1 << 18) - 1)).astype(np.int64)] = True
            self.sieve[length] = sieve
        self.bytes_of = [bytes([int(t[3:5], 16)]) if model.is_byte(i) else t.replace("▁", " ").encode() for i, t in enumerate(self.text)]

    def matches(self, code: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Arcs over the code points of many units: start, end, piece (-1: spelled in bytes), weight."""
        prefix = prefix_hash(code, 1)
        n = len(code)
        starts, ends, ids, weights = [], [], [], []
        single = np.zeros(n, bool)
        for length, (key, piece, weight) in reversed(self.by_length.items()):  # longest first: likelier arcs lie in front
            if length > n:
                continue
            at = np.flatnonzero(unit[: n - length + 1] == unit[length - 1 :])
            if not len(at):
                continue
            h = span_hash(prefix, at, at + length)
            some = np.flatnonzero(self.sieve[length][(h & np.uint64((1 << 18) - 1)).astype(np.int64)])
            where = np.minimum(np.searchsorted(key, h[some]), len(key) - 1)
            good = key[where] == h[some]
            at, where = at[some[good]], where[good]
            if length == 1:
                single[at] = True
            starts.append(at)
            ends.append(at + length)
            ids.append(piece[where])
            weights.append(weight[where])
        rest = np.flatnonzero(~single)
        size = np.where(code[rest] < 0x80, 1, np.where(code[rest] < 0x800, 2, np.where(code[rest] < 0x10000, 3, 4)))
        starts.append(rest)
        ends.append(rest + 1)
        ids.append(np.full(len(rest), -1))
        weights.append(self.byte_weight**size)
        return tuple(np.concatenate(x) for x in (starts, ends, ids, weights))


@lru_cache(maxsize=2)
def vocabulary(model_file: str, theta: float) -> Vocabulary:
    return Vocabulary(model_file, theta)


def forward(start: np.ndarray, end: np.ndarray, weight: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Filtered arc probabilities, arcs sorted by end: given that a path passes the
    arc's end, the probability that it came by this arc.

    Sums are kept relative to the total at the position before, with the scale
    in logarithms, so units of any length neither vanish nor overflow.
    """
    n = int(size.sum())
    base = np.repeat(first, size)
    place = np.arange(n) - base  # of each character in its unit
    log_sum = np.full(n + 1, -np.inf)  # of all paths up to after character i; a unit's start counts 0
    group = np.flatnonzero(np.diff(end, prepend=-1))
    count = np.diff(np.append(group, len(end)))
    at_end = end[group] - 1
    log_weight = np.log(weight)
    depth = place[at_end]
    order = np.argsort(depth, kind="stable")
    steps = np.searchsorted(depth[order], np.arange(depth.max() + 2))
    p = np.empty(len(end))
    for d in range(len(steps) - 1):
        own = order[steps[d] : steps[d + 1]]
        if not len(own):
            continue
        c = count[own]
        arcs = np.repeat(group[own] - np.cumsum(c) + c, c) + np.arange(c.sum())
        s = start[arcs]
        before = np.where(s == base[s], 0.0, log_sum[s - 1])
        value = before + log_weight[arcs]
        cut = np.cumsum(c) - c
        top = np.maximum.reduceat(value, cut)
        part = np.exp(value - np.repeat(top, c))
        total = np.add.reduceat(part, cut)
        log_sum[at_end[own]] = top + np.log(total)
        p[arcs] = part / np.repeat(total, c)
    return p


def encode_column(column: pa.Array, keys: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts and their offsets.  ``keys``: a 64-bit seed for each text."""
    v = vocabulary(s.model_file, s.theta)
    data, bounds = buffers(column)
    out: list[np.ndarray] = []
    sizes = np.zeros(len(column), np.int64)
    for lo, hi in slices(bounds, 512 << 10):
        ids, n = _encode(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo], keys[lo:hi], v)
        out.append(ids)
        sizes[lo:hi] = n
    return np.concatenate(out) if out else np.zeros(0, np.int32), np.concatenate([[0], np.cumsum(sizes)])


def _encode(data: np.ndarray, bounds: np.ndarray, keys: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    n_docs = len(bounds) - 1
    wide = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    at = lead[bounds]
    some = np.flatnonzero(np.diff(at))  # empty texts have no pieces
    # a space goes before every text, as the vocabulary was made for; decoding drops it
    code = np.insert(wide, at[some], 0x20)
    doc = np.repeat(np.arange(n_docs), np.diff(at) + (np.diff(at) > 0))
    n = len(code)
    if not n:
        return np.zeros(0, np.int32), np.zeros(n_docs, np.int64)
    space, line = code == 0x20, code == 0x0A
    cut = np.ones(n, bool)
    cut[1:] = (space[1:] & ~space[:-1]) | line[1:] | line[:-1] | (doc[1:] != doc[:-1])
    first = np.flatnonzero(cut)
    size = np.diff(np.append(first, n))
    sign = np.where(space, SPACE, np.where(code == SPACE, 0x110000, code)).astype(np.uint64)  # the sign itself in a text is spelled in bytes
    prefix = prefix_hash(sign, 1)
    kind_hash = span_hash(prefix, first, first + size)
    _, sample, kind = np.unique(kind_hash, return_index=True, return_inverse=True)
    # lattices of distinct units
    k_size = size[sample]
    k_first = np.cumsum(k_size) - k_size
    take = np.repeat(first[sample] - k_first, k_size) + np.arange(k_size.sum())
    k_code = sign[take].astype(np.uint32)
    start, end, piece, weight = v.matches(k_code, np.repeat(np.arange(len(sample)), k_size))
    order = np.argsort(end, kind="stable")
    start, end, piece, weight = start[order], end[order], piece[order], weight[order]
    p = forward(start, end, weight, k_first, k_size)
    # arcs that end at a position lie together, with running sums of their probabilities
    group = np.flatnonzero(np.diff(end, prepend=-1))
    sums = np.cumsum(p)
    sums -= np.repeat(sums[group] - p[group], np.diff(np.append(group, len(end))))
    sums[np.append(group[1:], len(end)) - 1] = 2.0
    position = np.zeros(len(k_code) + 1, np.int64)
    position[end[group]] = group
    # draw backwards for all occurrences at once
    owner = doc[first]
    number = np.arange(len(first)) - np.searchsorted(owner, np.arange(n_docs))[owner]
    seed = mix(keys[owner] ^ mix(number.astype(np.uint64) + np.uint64(0x51ED27)))
    live = np.arange(len(first))
    here = k_first[kind] + k_size[kind]
    begin = k_first[kind]
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    n_pieces = np.zeros(len(first), np.int64)
    step = 0
    while len(live):
        u = (mix(seed[live] + np.uint64(step)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        arc = position[here[live]]
        short = np.flatnonzero(sums[arc] <= u)
        while len(short):
            arc[short] += 1
            short = short[sums[arc[short]] <= u[short]]
        steps.append((live, arc))
        n_pieces[live] += 1
        here[live] = start[arc]
        live = live[start[arc] > begin[live]]
        step += 1
    # a spelled character becomes its bytes
    spelled = np.where(piece < 0, k_code[np.minimum(start, len(k_code) - 1)], 0)
    spelled[spelled == 0x110000] = SPACE
    width = np.where(piece >= 0, 1, np.where(spelled < 0x80, 1, np.where(spelled < 0x800, 2, np.where(spelled < 0x10000, 3, 4))))
    length = np.zeros(len(first), np.int64)
    for occ, arc in steps:
        length[occ] += width[arc]
    stop = np.cumsum(length)
    out = np.empty(int(stop[-1]), np.int32)
    left = stop.copy()
    for occ, arc in steps:
        left[occ] -= width[arc]
        whole = piece[arc] >= 0
        out[left[occ[whole]]] = piece[arc[whole]]
        o, a = occ[~whole], arc[~whole]
        for k in range(4):  # the k-th byte of each spelled character
            long = np.flatnonzero(width[a] > k)
            out[left[o[long]] + k] = v.byte[_utf8(spelled[a[long]], width[a[long]], k)]
    return out, np.bincount(owner, length, n_docs).astype(np.int64)


def _utf8(code: np.ndarray, size: np.ndarray, k: int) -> np.ndarray:
    """The ``k``-th byte of code points whose UTF-8 form has ``size`` bytes."""
    lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[size]
    bits = code.astype(np.int64) >> (6 * (size - 1 - k))
    return np.where(k == 0, lead | bits, 0x80 | (bits & 0x3F))


def decode(ids: np.ndarray, v: Vocabulary) -> bytes:
    """The text of a sequence of pieces, in UTF-8."""
    whole = b"".join([v.bytes_of[i] for i in ids])
    return whole[1:] if whole.startswith(b" ") else whole


def row_keys(ids: pa.Array, seed: int) -> np.ndarray:
    """A 64-bit seed from each row's key (null keys share one)."""
    key = ids.cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return mix(key + np.uint64(seed << 32))


def encode(docs: DataFrame, s: Settings, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``ids``, a sampled segmentation of every whole text.

    Null and empty texts have no pieces; bytes that are no UTF-8 read as U+FFFD.  Rows equal in key and text get equal
    pieces; other columns are ignored; an empty table gives no rows.  Every text decodes
    to itself, whatever characters it holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                ids, offsets = encode_column(part.column(1), row_keys(part.column(0), s.seed), s)
                yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))], ["key", "ids"])

    small_batches(docs.sparkSession)
    return docs.select(docs[key].cast("long").alias("key"), F.make_valid_utf8(docs[text]).alias("text")).mapInArrow(run, "key long, ids array<int>").withColumnRenamed("key", key)


def decoded(rows: DataFrame, s: Settings, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key`` and ``text`` of every row's pieces; null pieces give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(s.model_file, s.theta)
        for batch in batches:
            texts = [None if x is None else decode(x, v).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], ["key", "text"])

    return rows.select(rows[key].cast("long").alias("key"), rows[ids].alias("ids")).mapInArrow(run, "key long, text string").withColumnRenamed("key", key)


def summary(docs: DataFrame, s: Settings) -> DataFrame:
    """doc_id, n_pieces, ids_sha256 (of the ids as little-endian 32-bit numbers) and
    ``lossless``: whether the pieces decode to the very text.

    Null and empty texts have no pieces, and are lossless.  Rows equal in doc_id and text get equal pieces, and null doc_ids share a
    seed; texts are read whole, however long; bytes that are no UTF-8 read as U+FFFD.  Other columns are
    ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(s.model_file, s.theta)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                ids, offsets = encode_column(part.column(1), row_keys(part.column(0), s.seed), s)
                data, bounds = buffers(part.column(1))
                n = np.diff(offsets)
                lists = ids.tolist()
                same = [decode(lists[a:b], v) == data[c:d].tobytes() for a, b, c, d in zip(offsets[:-1], offsets[1:], bounds[:-1], bounds[1:], strict=True)]
                sha = [hashlib.sha256(ids[a:b].astype("<i4").tobytes()).hexdigest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.record_batch([part.column(0), pa.array(n), pa.array(sha), pa.array(same)], ["doc_id", "n_pieces", "ids_sha256", "lossless"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", F.make_valid_utf8("text").alias("text")).mapInArrow(run, "doc_id long, n_pieces long, ids_sha256 string, lossless boolean")
