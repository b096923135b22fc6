"""Substring dedup: remove every word inside a window of words that occurs elsewhere too.

Windows find each other through anchors: the least hash among a window's short
word n-grams.  Equal windows have equal anchors, so consecutive windows with one
anchor form a segment, and segments with the same anchor go to the same shard.

1. Anchors are counted over the corpus; a segment whose anchor occurs once has no repeated window.
2. The other segments are cut out.  Anchors with very many occurrences give single windows,
   dealt by the window's own hash, so that no shard grows with one of them.  Equal
   segments collapse into one with a count, in the task that reads them and, those
   of such anchors, once more between the shuffle's two sides.
3. Every shard builds an FM-index over its distinct segments, each position weighing as
   often as its segment occurs, and streams all of them against it: matching
   statistics by backward search tell which windows occur at least twice.
4. The intervals go back to their documents, which drop the covered words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, small_batches, written
from .fm_index import FMIndex, repeated_windows
from .textgrid import Grid, buffers, grid, grids, mix, prefix_hash, slices, span_hash


@dataclass(frozen=True)
class Settings:
    window: int = 35
    #: Words in an n-gram that may be an anchor.
    gram: int = 6
    #: Windows of one segment; at most 64, since a segment's answer is one number.
    segment: int = 30
    #: From so many occurrences on, an anchor's windows are dealt one by one.
    hot: int = 1_000
    #: Words in one FM-index; a task builds one after another.
    shard_words: int = 1 << 19


def _sliding(x: np.ndarray, width: int, f) -> np.ndarray:
    """``f`` over every run of ``width`` values."""
    span = 1
    while span * 2 <= width:
        x = f(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return f(x[:-rest], x[rest:]) if rest else x


@dataclass
class Windows:
    """Anchors of all windows of a grid; window ``j`` begins with word ``j``."""

    gram: np.ndarray
    anchor: np.ndarray
    fine: np.ndarray


def windows(g: Grid, s: Settings) -> Windows | None:
    n = len(g.hash) - s.window + 1
    if n < 1:
        return None
    at = np.arange(len(g.hash) - s.gram + 1)
    gram = span_hash(prefix_hash(g.hash), at, at + s.gram)
    anchor = _sliding(gram, s.window - s.gram + 1, np.minimum)
    return Windows(gram, anchor, g.doc[:n] == g.doc[s.window - 1 :])


def anchors(g: Grid, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of every n-gram that is the anchor of some window."""
    w = windows(g, s)
    if w is None:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    width = s.window - s.gram + 1
    pad = np.zeros(width - 1, np.uint64)
    highest = _sliding(np.concatenate([pad, np.where(w.fine, w.anchor, 0), pad]), width, np.maximum)
    at = np.flatnonzero(highest == w.gram)
    return g.doc[at], w.gram[at]


def segments(g: Grid, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and anchor of every segment."""
    w = windows(g, s)
    if w is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n = len(w.anchor)
    cut = np.ones(n, bool)
    cut[1:] = (w.anchor[1:] != w.anchor[:-1]) | (g.doc[1:n] != g.doc[: n - 1]) | ~w.fine[:-1]
    edge = np.append(np.flatnonzero(cut | ~w.fine), n)
    first = np.flatnonzero(cut & w.fine)
    size = edge[np.searchsorted(edge, first, "right")] - first
    parts = -(-size // s.segment)
    number = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    first, size = np.repeat(first, parts) + number * s.segment, np.repeat(size, parts) - number * s.segment
    return first, np.minimum(size, s.segment), w.anchor[first]


def dealt(g: Grid, keys: pa.Array, hot: pa.Array, s: Settings) -> dict[str, np.ndarray]:
    """The segments (or single windows of hot anchors) of texts with the given repeated anchors:
    route, hash of the words, first window, number of windows, number of words."""
    first, size, anchor = segments(g, s)

    def listed(column: pa.Array) -> np.ndarray:
        doc = np.repeat(np.arange(len(column)), np.asarray(column.value_lengths().fill_null(0)))
        both = mix(column.flatten().to_numpy(zero_copy_only=False).view(np.uint64) ^ mix(doc.astype(np.uint64)))
        return np.isin(mix(anchor ^ mix(g.doc[first].astype(np.uint64))), both)

    cool, warm = listed(keys), listed(hot)
    warm_first = np.repeat(first[warm], size[warm]) + np.arange(size[warm].sum()) - np.repeat(np.cumsum(size[warm]) - size[warm], size[warm])
    at = np.concatenate([first[cool], warm_first])
    n = np.concatenate([size[cool], np.ones(len(warm_first), np.int64)])
    h = span_hash(prefix_hash(g.hash), at, at + n + s.window - 1)
    route = np.concatenate([anchor[cool], mix(h[cool.sum() :])])
    return {"route": route, "hash": h, "at": at, "n": n, "warm": np.arange(len(at)) >= cool.sum()}


def _docs(batch: pa.RecordBatch, text: int) -> Iterator[tuple[int, int, Grid]]:
    return grids(batch.column(text))


def _text_sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def cut(docs: DataFrame, s: Settings = Settings(), texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row (and ``kept_text`` and ``uid`` if ``texts``).

    Windows are judged on the input.  Null and empty texts have no words; texts
    shorter than a window lose nothing.  Repeated rows are copies of one another and
    lose all their windows.  Kept words are joined by single spaces; with
    ``texts``, a text that loses nothing keeps its white space.  Other columns are
    ignored; an empty table gives no rows.  Texts are taken whole, however long; one longer
    than a slice is worked on alone.
    """
    small_batches(docs.sparkSession)
    own = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("uid"), "text")

    def emit_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid = batch.column(0).to_numpy()
            for lo, _, g in _docs(batch, 1):
                doc, key = anchors(g, s)
                yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(uid[lo + doc])], ["key", "uid"])

    found = written(own.where("text IS NOT NULL").select("uid", "text").mapInArrow(emit_anchors, "key long, uid long"), "anchors")
    often = written(found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "n", (F.col("n") > s.hot).alias("hot")), "anchors-often")
    lists = join_hot(found, often, ["key"], "n", "inner").groupBy("uid").agg(F.collect_set(F.when(~F.col("hot"), F.col("key"))).alias("keys"), F.collect_set(F.when(F.col("hot"), F.col("key"))).alias("hot_keys"))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows without repeated anchors are done; the others keep their text and anchors."""
        for batch in batches:
            open_ = batch.column(3).is_valid()
            n_words, sha = [], []
            data, bounds = buffers(batch.column(2))
            for a, b, later in zip(bounds[:-1], bounds[1:], open_.to_pylist(), strict=True):
                words = data[a:b].tobytes().split()
                n_words.append(len(words))
                sha.append(None if later else _text_sha(words))
            text = batch.column(2) if texts else pa.compute.if_else(open_, batch.column(2), None)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(sha, pa.string()), text, batch.column(3), batch.column(4)], ["doc_id", "uid", "n_words", "kept_sha256", "text", "keys", "hot_keys"])

    id_type = dict(docs.dtypes)["doc_id"]
    work = own.join(lists, "uid", "left").select("doc_id", "uid", "text", "keys", "hot_keys").mapInArrow(settle, f"doc_id {id_type}, uid long, n_words long, kept_sha256 string, text string, keys array<long>, hot_keys array<long>")
    work = written(work, "substring-work")
    pending = work.where("kept_sha256 IS NULL")

    def emit_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, g in _docs(batch, 0):
                x = dealt(g, batch.column(1).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), s)
                _, one, times = np.unique(mix(x["route"]) ^ x["hash"], return_index=True, return_counts=True)
                begin, end = g.start[x["at"][one]], g.end[x["at"][one] + x["n"][one] + s.window - 2]
                words = [g.data[a:b].tobytes() for a, b in zip(begin, end, strict=True)]
                yield pa.record_batch([pa.array(x["route"][one].view(np.int64)), pa.array(x["hash"][one].view(np.int64)), pa.array(x["n"][one].astype(np.int32)), pa.array(times.astype(np.int64)), pa.array(x["warm"][one]), pa.array(words, pa.binary())], ["route", "hash", "n", "times", "warm", "words"])

    shards = written(pending.select("text", "keys", "hot_keys").mapInArrow(emit_segments, "route long, hash long, n int, times long, warm boolean, words binary"), "substring-segments")
    once = shards.where("warm").groupBy("route", "hash", "n").agg(F.sum("times").alias("times"), F.first("words").alias("words"))
    shards = shards.where("NOT warm").select(*once.columns).unionByName(once).select("route", "hash", "n", "times", "words")
    shards = shards.repartition("route").sortWithinPartitions("route", "hash")
    answers = written(shards.mapInArrow(_searcher(s), "route long, hash long, mask long, times long"), "substring-masks")

    def emit_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid = batch.column(3).to_numpy()
            for lo, hi, g in _docs(batch, 0):
                x = dealt(g, batch.column(1).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), s)
                doc = g.doc[x["at"]] if len(x["at"]) else x["at"]
                yield pa.record_batch([pa.array(x["route"].view(np.int64)), pa.array(x["hash"].view(np.int64)), pa.array(uid[lo + doc]), pa.array((x["at"] - g.first[doc]).astype(np.int64))], ["route", "hash", "uid", "at"])

    places = written(pending.select("text", "keys", "hot_keys", "uid").mapInArrow(emit_places, "route long, hash long, uid long, at long"), "substring-places")
    spans = join_hot(places, answers, ["route", "hash"], "times", "inner").groupBy("uid").agg(F.collect_set(F.struct("at", "mask")).alias("spans"))
    kept = ", kept_text string" if texts else ""

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            flat = lists.flatten()
            at, mask = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(2))
            bound = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths().fill_null(0)))])
            removed, sha, left = [], [], []
            for k, text in enumerate(batch.column(2).cast(pa.binary()).to_pylist()):
                words = (text or b"").split()
                lo, hi = bound[k], bound[k + 1]
                if lo < hi:
                    bits = np.flatnonzero(np.unpackbits(mask[lo:hi].astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").ravel())
                    first = at[lo:hi][bits >> 6] + (bits & 63)
                    cover = np.zeros(len(words) + 1, np.int64)
                    np.add.at(cover, first, 1)
                    np.add.at(cover, first + s.window, -1)
                    stay = np.cumsum(cover[:-1]) == 0
                    removed.append(int(len(words) - stay.sum()))
                    words = [w for w, ok in zip(words, stay, strict=True) if ok]
                    left.append(b" ".join(words).decode("utf-8", "replace"))
                else:
                    removed.append(0)
                    left.append(None if text is None else text.decode("utf-8", "replace"))
                sha.append(_text_sha(words))
            columns = [batch.column(0), batch.column(1), batch.column(4), pa.array(removed, pa.int64()), pa.array(sha, pa.string())]
            names = ["doc_id", "uid", "n_words", "n_removed", "kept_sha256"]
            yield pa.record_batch([*columns, *([pa.array(left, pa.string())] if texts else [])], [*names, *(["kept_text"] if texts else [])])

    changed = pending.select("doc_id", "uid", "text", "n_words").join(spans, "uid", "left").select("doc_id", "uid", "text", "spans", "n_words")
    changed = changed.mapInArrow(finish, f"doc_id {id_type}, uid long, n_words long, n_removed long, kept_sha256 string{kept}")
    whole = work.where("kept_sha256 IS NOT NULL").select("doc_id", "uid", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", *([F.col("text").alias("kept_text")] if texts else []))
    out = whole.unionByName(changed)
    return out if texts else out.drop("uid")


def _searcher(s: Settings):
    """Streams segments sorted by route through one FM-index after another."""

    def answer(route: np.ndarray, h: np.ndarray, n: np.ndarray, times: np.ndarray, words: pa.Array) -> pa.RecordBatch:
        new = np.concatenate([[True], (route[1:] != route[:-1]) | (h[1:] != h[:-1])])
        at = np.flatnonzero(new)
        times = np.add.reduceat(times, at)
        route, h, n = route[at], h[at], n[at].astype(np.int64)
        data, bounds = buffers(words.take(pa.array(at)))
        whole = [grid(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo]) for lo, hi in slices(bounds)]
        _, number = np.unique(np.concatenate([g.hash for g in whole]), return_inverse=True)
        size = np.concatenate([g.counts() for g in whole])
        first = np.cumsum(size + 1) - size - 1  # a separator follows every segment
        symbols = np.zeros(int((size + 1).sum()), np.int32)
        symbols[np.repeat(first - np.cumsum(size) + size, size) + np.arange(len(number))] = number + 1
        index = FMIndex(symbols, np.repeat(times, size + 1), s.window + s.segment)
        mask = repeated_windows(index, symbols, first, n, s.window)
        hit = np.flatnonzero(mask)
        return pa.record_batch([pa.array(route[hit]), pa.array(h[hit]), pa.array(mask[hit].view(np.int64)), pa.array(times[hit])], ["route", "hash", "mask", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush(t: pa.Table) -> pa.RecordBatch:
            return answer(*(t[c].to_numpy() for c in ("route", "hash", "n", "times")), t["words"].combine_chunks())

        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                held.append(part)
                size += int(np.sum(part.column(2).to_numpy())) + part.num_rows * s.window
                if size >= s.shard_words:
                    t = pa.Table.from_batches(held)
                    last = t["route"][-1].as_py()
                    stop = int(np.searchsorted(t["route"].to_numpy(), last))
                    if stop:  # a route is never cut
                        yield flush(t.slice(0, stop))
                        held = t.slice(stop).to_batches()
                        size = sum(int(np.sum(b.column(2).to_numpy())) + b.num_rows * s.window for b in held)
        if held and sum(b.num_rows for b in held):
            yield flush(pa.Table.from_batches(held))

    return run
