"""Line dedup: drop the lines that many documents hold, but for one document.

1. One pass over the texts gives every long line of a document as a 128-bit digest.
2. Tasks put the digests into two Bloom filters, seen once and seen twice; the filters are merged, the lines stay where they are.
3. Only lines whose digest is in the filter of those seen twice, suspected repeats, are shuffled: exact
   counts of documents and the largest doc_id of every digest.
4. What must go returns to its documents, which drop those lines.

A filter has a bounded size; where the lines need more bits, digests are dealt to several
filters, built and probed one after another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import join_hot, new_path, small_batches, written
from .textgrid import _LOWER, _SPACE, buffers, slices


@dataclass(frozen=True)
class Settings:
    #: Code points of a key that may be dropped, and documents that must hold it.
    least: int = 40
    documents: int = 5
    #: Filter bits for a line, and bits of one filter at most (32 MB).
    bits: int = 16
    most_bits: int = 1 << 28


@dataclass
class Lines:
    """Lines of consecutive texts: document, byte range, byte range of the key and its code points."""

    lower: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    key: np.ndarray
    stop: np.ndarray
    points: np.ndarray

    def digest(self, k: int) -> bytes:
        """128 bits of the key of line ``k``."""
        return hashlib.blake2b(self.lower[self.key[k] : self.stop[k]], digest_size=16).digest()


def lines(data: np.ndarray, bounds: np.ndarray) -> Lines:
    """Every text has at least one line."""
    new = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([bounds[:-1], new + 1]), kind="stable")
    end = np.sort(np.concatenate([new, bounds[1:]]), kind="stable")
    doc = np.repeat(np.arange(len(bounds) - 1), 1 + np.diff(np.searchsorted(new, bounds)))
    solid = np.append(np.flatnonzero(~_SPACE[data]), len(data))
    first = solid[np.searchsorted(solid, start)]
    key = np.minimum(first, end)
    last = np.searchsorted(solid, end) - 1
    stop = np.where((last >= 0) & (first < end), solid[last] + 1, key)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return Lines(_LOWER[data], doc, start, end, key, stop, points[stop] - points[key])


def _grids(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, Lines]]:
    """Texts ``lo:hi`` of the column with their bytes and lines, about half a megabyte or one longer text at a time."""
    data, bounds = buffers(column)
    for lo, hi in slices(bounds):
        part = data[bounds[lo] : bounds[hi]]
        yield lo, hi, part, lines(part, bounds[lo : hi + 1] - bounds[lo])


def long_lines(docs: DataFrame, s: Settings) -> DataFrame:
    """high, low (the digest), doc_id and uid of every different long line of each row of ``docs`` (doc_id, uid, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, _, g in _grids(batch.column(2)):
                found = dict.fromkeys((int(g.doc[k]), g.digest(k)) for k in np.flatnonzero(g.points >= s.least))
                halves = np.frombuffer(b"".join(d for _, d in found), np.int64).reshape(-1, 2)
                at = pa.array([lo + k for k, _ in found], pa.int64())
                yield pa.record_batch([pa.array(halves[:, 0]), pa.array(halves[:, 1]), batch.column(0).take(at), batch.column(1).take(at)], ["high", "low", "doc_id", "uid"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.where("text IS NOT NULL").select("doc_id", "uid", "text").mapInArrow(run, f"high long, low long, doc_id {kind}, uid long")


def suspects(found: DataFrame, s: Settings) -> DataFrame:
    """The rows of ``found`` (a written table) whose digest may stand in several of them.

    No row is shuffled here.  Every digest that stands in several rows is among them.
    """
    spark = found.sparkSession
    n = found.count()
    parts = max(1, -(-n * s.bits // s.most_bits))
    if parts > 1:  # a part is read alone
        path = new_path(spark, "line-parts")
        found.withColumn("part", F.pmod("low", F.lit(parts)).cast("int")).write.partitionBy("part").parquet(path)
        found = spark.read.parquet(path)
    words = bloom.words_for(-(-n // parts), s.bits, s.most_bits)
    out = new_path(spark, "line-suspects")
    schema = ", ".join(f"{c} {t}" for c, t in found.dtypes if c != "part")
    for part in range(parts):
        own = found.where(F.col("part") == part).drop("part") if parts > 1 else found
        twice = spark.sparkContext.broadcast(bloom.collected(bloom.filled(own.select("high"), words), "twice", words))

        def probe(batches: Iterator[pa.RecordBatch], twice=twice) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(bloom.contains(twice.value, batch.column(0).to_numpy().view(np.uint64))))

        own.mapInArrow(probe, schema).write.mode("append").parquet(out)
        twice.unpersist()
    return spark.read.schema(schema).parquet(out)


def drop(docs: DataFrame, s: Settings = Settings(), texts: bool = False) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every row (and ``kept_text`` if ``texts``).

    A text is split at newlines; null and empty texts are one empty line.  A line's key is the line
    without ASCII white space at its ends, A-Z lower-cased.  Keys of at least ``least``
    code points in at least ``documents`` documents lose all their lines, also several in one text, except in the
    document with the largest doc_id that holds them.  Rows that share a doc_id are one document; all rows with a
    null doc_id are one too, which is never the largest.  Texts of any length are read whole; bytes that
    are no UTF-8 stay as they are (a code point begins at each byte but 80 to BF).
    Other columns are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    own = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("uid"), "text")
    known = suspects(written(long_lines(own, s), "lines"), s)
    by_doc = known.groupBy("high", "low", "doc_id").agg(F.count(F.lit(1)).alias("rows"))
    exact = by_doc.groupBy("high", "low").agg(F.count(F.lit(1)).alias("documents"), F.max("doc_id").alias("keeper"), F.sum("rows").alias("rows"))
    exact = written(exact.where(F.col("documents") >= s.documents).select("high", "low", "keeper", "rows"), "line-repeats")
    gone = join_hot(known, exact, ["high", "low"], "rows", "inner").where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    lists = gone.groupBy("uid").agg(F.collect_set(F.struct("high", "low")).alias("gone"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, n_dropped, sha, left = [], [], [], []
            for lo, hi, data, g in _grids(batch.column(1)):
                first = np.searchsorted(g.doc, np.arange(hi - lo + 1))
                for d in range(hi - lo):
                    a, b = int(first[d]), int(first[d + 1])
                    listed, stay = batch.column(2)[lo + d], np.ones(b - a, bool)
                    if listed.is_valid:
                        halves = listed.values
                        bad = set(np.stack([halves.field(k).to_numpy() for k in range(2)], 1).astype("<i8").tobytes()[k : k + 16] for k in range(0, 16 * len(halves), 16))
                        stay = np.array([g.points[k] < s.least or g.digest(k) not in bad for k in range(a, b)])
                    if stay.all():
                        text = data[g.start[a] : g.end[b - 1]].tobytes()
                    else:
                        text = b"\n".join(data[g.start[a + k] : g.end[a + k]].tobytes() for k in np.flatnonzero(stay))
                    n_lines.append(b - a)
                    n_dropped.append(b - a - int(stay.sum()))
                    sha.append(hashlib.sha256(text).hexdigest())
                    if texts:
                        left.append(text)
            columns = [batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(sha, pa.string())]
            names = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
            yield pa.record_batch([*columns, *([pa.array(left, pa.binary())] if texts else [])], [*names, *(["kept_text"] if texts else [])])

    kind = dict(docs.dtypes)["doc_id"]
    out = own.join(lists, "uid", "left").select("doc_id", "text", "gone").mapInArrow(finish, f"doc_id {kind}, n_lines long, n_dropped long, kept_sha256 string" + (", kept_text binary" if texts else ""))
    return out.withColumn("kept_text", F.col("kept_text").cast("string")) if texts else out
