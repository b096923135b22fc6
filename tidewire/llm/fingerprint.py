"""Document fingerprints by consistent weighted sampling.

A document is a bag of words: each word, known by its 64-bit hash, weighs
its number of occurrences.  For each of ``SAMPLES`` samples a word k has
r ~ Gamma(2, 1), c ~ Gamma(2, 1) and b ~ U(0, 1), drawn by hashing k with the
sample's number; with t = floor(ln w / r + b) its
key is ln c - r (t - b) - r, and the least key wins.  Two documents share a
sample with a probability equal to their generalised Jaccard similarity,
sum(min(w)) / sum(max(w)).  Since a key is a fixed real number for each (k, t),
equal keys stand for equal samples; a fingerprint holds 16 bits of each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small_batches, written
from .textgrid import grids, mix

SAMPLES = 128
#: Words whose parameters are held at a time, words drawn for in one step, and pairs of text and word whose keys are held.
_WORDS = 1 << 12
_STEP = 1 << 8
_PAIRS = 1 << 10

_rng = np.random.Generator(np.random.PCG64(20240229))
_xor, _odd = (_rng.integers(0, 1 << 32, (2, 5, SAMPLES), np.uint64).astype(np.uint32) | np.uint32(x) for x in (0, 1))


_scratch = np.empty((7, _STEP, SAMPLES), np.uint32)


def _uniform(low: np.ndarray, high: np.ndarray, k: int) -> np.ndarray:
    """Stream ``k`` of numbers above 0, at most 1, for every word and sample, from both halves of the word's hash."""
    v, part, out = _scratch[5, : len(low)], _scratch[6, : len(low)], _scratch[k, : len(low)].view(np.float32)
    np.bitwise_xor(low, _xor[0, k], out=v)
    v *= _odd[0, k]
    v ^= np.right_shift(v, np.uint32(15), out=part)
    v += np.bitwise_xor(high, _xor[1, k], out=part)
    v *= _odd[1, k]
    v ^= np.right_shift(v, np.uint32(16), out=part)
    v *= np.uint32(0x2C1B3C6D)
    v ^= np.right_shift(v, np.uint32(13), out=part)
    v >>= np.uint32(1)
    out[:] = v.view(np.int32)
    out += np.float32(0.5)
    out *= np.float32(2.0**-31)
    return out


def _params(words: np.ndarray) -> np.ndarray:
    """For every word and sample r, b and the key at t = 0."""
    out = np.empty((3, len(words), SAMPLES), np.float32)
    for i in range(0, len(words), _STEP):
        out[:, i : i + _STEP] = _step(words[i : i + _STEP])
    return out


def _step(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of at most ``_STEP`` words; the arrays last until the next call.

    A product of two uniforms has a Gamma(2, 1) as its -ln.
    """
    mixed = mix(words)
    low, high = (mixed & np.uint64(0xFFFFFFFF)).astype(np.uint32)[:, None], (mixed >> np.uint64(32)).astype(np.uint32)[:, None]

    def gamma(k: int) -> np.ndarray:
        x = _uniform(low, high, k)
        x *= _uniform(low, high, k + 1)
        np.log(x, out=x)
        np.negative(x, out=x)
        return np.maximum(x, np.float32(1e-9), out=x)

    r, base = gamma(0), gamma(2)
    b = _uniform(low, high, 4)
    np.minimum(b, np.float32(1 - 2.0**-24), out=b)
    np.log(base, out=base)
    part = np.subtract(np.float32(1), b, out=_scratch[6, : len(words)].view(np.float32))
    part *= r
    base -= part
    return r, b, base


def signatures(column: pa.Array) -> np.ndarray:
    """A row of ``SAMPLES`` 16-bit values for every text; all zero for texts without words."""
    out = np.zeros((len(column), SAMPLES), np.uint16)
    for lo, hi, g in grids(column, size=4 << 20):
        if not len(g.hash):
            continue
        words, word = np.unique(g.hash, return_inverse=True)
        texts = hi - lo
        # sorted by block of words, then text: a block's parameters and a few keys stay in cache
        pair, weight = np.unique((word // _WORDS * texts + g.doc) * _WORDS + word % _WORDS, return_counts=True)
        block, doc = np.divmod(pair // _WORDS, texts)
        term, log_weight = pair % _WORDS, np.log(weight.astype(np.float32))
        least = np.full((texts, SAMPLES), np.inf, np.float32)
        cut = np.searchsorted(block, np.arange(block[-1] + 2))
        for k, (begin, end) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            r, b, base = _params(words[k * _WORDS : (k + 1) * _WORDS])
            for i in range(begin, end, _PAIRS):
                j = min(i + _PAIRS, end)
                d, t = doc[i:j], term[i:j]
                keys = base[t]
                at = np.flatnonzero(weight[i:j] > 1)
                keys[at] -= r[t[at]] * np.floor(log_weight[i:j][at][:, None] / r[t[at]] + b[t[at]])
                first = np.flatnonzero(np.diff(d, prepend=-1))
                least[d[first]] = np.minimum(least[d[first]], np.minimum.reduceat(keys, first, axis=0))
        some = np.flatnonzero(np.isfinite(least[:, 0]))
        bits = least[some].view(np.uint32)
        bits = (bits ^ (bits >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        out[lo + some] = (bits >> np.uint32(16)).astype(np.uint16) | np.uint16(1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal samples, row by row: an estimate of generalised Jaccard similarity."""
    return (a == b).mean(1)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (hex) of every text.  Null reads as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = signatures(batch.column(1))
            yield pa.record_batch([batch.column(0), pa.array([s.tobytes().hex() for s in sig], pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", F.make_valid_utf8("text").alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by the beginning of ``following``."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_FIELDS = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _changed(texts: list[str], following: list[str]) -> list[bytes]:
    return [edited(a, b).encode("utf-8", "surrogatepass") for a, b in zip(texts, following, strict=True)]


def _together(texts: list[str], changed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of texts and of as many edited ones, side by side so that parameters of common words are drawn once."""
    both = [x for a, b in zip(texts, changed, strict=True) for x in (a.encode("utf-8", "surrogatepass"), b)]
    sig = signatures(pa.array(both, pa.large_binary()))
    return sig[::2], sig[1::2]


def _compare(ids: list, texts: list[str], changed: list[bytes], sig: np.ndarray, sig_changed: np.ndarray, sig_next: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch(
        [
            pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t).hexdigest() for t in changed], pa.string()),
            pa.array([s.tobytes().hex() for s in sig], pa.string()), pa.array([s.tobytes().hex() for s in sig_changed], pa.string()),
            pa.array(likeness(sig, sig_changed), pa.float64()), pa.array(likeness(sig, sig_next), pa.float64()),
        ],
        schema=_FIELDS,
    )


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprint every text, its edited text, and compare it with that and with the next document.

    The next document is the next by ascending doc_id, after the last the first;
    equal doc_ids go by text, and null doc_ids come first.  Null text reads
    as empty; texts without words are like each other only.  A table of one row
    is its own next.  Other columns are ignored; an empty table gives no rows;
    texts are read whole, however long; bytes that are no UTF-8 read as U+FFFD.

    One range shuffle puts documents in order, so a text's successor is the next
    row of its task.  Only the last text of each task waits for the first text of
    the next task that has any; those few rows are joined on the task's number.
    """
    small_batches(docs.sparkSession)
    # rows: kind 0 a finished result; kind 1 a task's first text, kind 2 its last
    lean = docs.select("doc_id", F.make_valid_utf8(F.coalesce("text", F.lit(""))).alias("text"))
    ordered = lean.repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", "text")
    extra = [("kind", pa.int32()), ("task", pa.int32()), ("text", pa.string())]
    full = pa.schema([*_FIELDS, *extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()

        def special(kind: int, doc: int | None, text: str) -> pa.RecordBatch:
            return pa.record_batch([pa.array([doc], pa.int64()), *[pa.nulls(1, f.type) for f in list(_FIELDS)[1:]], pa.array([kind], pa.int32()), pa.array([task], pa.int32()), pa.array([text], pa.string())], schema=full)

        held: tuple[int | None, str, np.ndarray] | None = None
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                if held is None:
                    yield special(1, ids[0], texts[0])
                    changed = [b"", *_changed(texts[:-1], texts[1:])]
                    sig, sig_changed = _together(texts, changed)
                    changed, sig_changed = changed[1:], sig_changed[1:]
                else:
                    changed = _changed([held[1], *texts[:-1]], texts)
                    sig, sig_changed = _together(texts, changed)
                    ids, texts, sig = [held[0], *ids], [held[1], *texts], np.concatenate([held[2], sig])
                if len(ids) > 1:
                    done = _compare(ids[:-1], texts[:-1], changed, sig[:-1], sig_changed, sig[1:])
                    yield pa.record_batch([*done.columns, pa.array(np.zeros(len(ids) - 1), pa.int32()), pa.array(np.full(len(ids) - 1, task), pa.int32()), pa.nulls(len(ids) - 1, pa.string())], schema=full)
                held = (ids[-1], texts[-1], sig[-1:])
        if held is not None:
            yield special(2, held[0], held[1])

    rows = written(ordered.mapInArrow(run, f"{_OUT}, kind int, task int, text string"), "fingerprints")
    heads = rows.where("kind = 1").select(F.col("task").alias("next_task"), F.col("text").alias("following"))
    tasks = rows.where("kind = 1").select("task")
    every = Window.partitionBy()
    follow = tasks.select("task", F.coalesce(F.lead("task").over(Window.orderBy("task")), F.min("task").over(every)).alias("next_task"))
    tails = rows.where("kind = 2").select("doc_id", "text", "task").join(follow, "task").join(heads, "next_task").select("doc_id", "text", "following")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, following = (batch.column(k).to_pylist() for k in range(3))
            if ids:
                changed = _changed(texts, following)
                sig, sig_changed = _together(texts, changed)
                yield _compare(ids, texts, changed, sig, sig_changed, signatures(batch.column(2)))

    return rows.where("kind = 0").select(*_FIELDS.names).unionByName(tails.mapInArrow(finish, _OUT))
