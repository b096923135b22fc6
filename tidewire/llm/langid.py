"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts are gathered by Spark over all training rows; the matrix of log
probabilities (languages x buckets, both bounded) is broadcast, and documents
are scored in numpy, one gather per n-gram and language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import small_batches
from .textgrid import buffers, mix, slices

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    orders: tuple[int, ...] = (1, 2, 3)
    buckets: int = 1 << 14
    smoothing: float = 0.5
    #: More training labels than this are refused: the broadcast matrix has a row for each.
    max_languages: int = 512


def ngrams(column: pa.Array, s: Settings) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For ranges ``lo:hi`` of texts: document and bucket of every n-gram, and
    whether each text has a letter.  Case is folded; n-grams stay inside a text.
    """
    data, bounds = buffers(column)
    for lo, hi in slices(bounds, 256 << 10):
        raw = data[bounds[lo] : bounds[hi]].tobytes()
        cuts = bounds[lo : hi + 1] - bounds[lo]
        texts = [raw[a:b].decode("utf-8", "replace").lower() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        doc = np.repeat(np.arange(len(texts), dtype=np.int32), size)
        kinds, which = np.unique(code, return_inverse=True) if len(code) else (code, code)
        letter = np.fromiter((chr(c).isalpha() for c in kinds), bool, len(kinds))
        has = np.bincount(doc, letter[which], len(texts)) > 0 if len(code) else np.zeros(len(texts), bool)
        docs, ids = [], []
        wide = code.astype(np.uint64)
        rolled = np.zeros(len(code), np.uint64)
        for n in range(1, max(s.orders) + 1):
            rolled = (rolled[: len(code) - n + 1] * np.uint64(0x100000001B3)) + wide[n - 1 :]
            if n in s.orders:
                inside = doc[: len(rolled)] == doc[n - 1 :]
                ids.append((mix(rolled[inside] + np.uint64(n << 56)) & np.uint64(s.buckets - 1)).astype(np.int32))
                docs.append(doc[: len(rolled)][inside])
        yield lo, hi, np.concatenate(docs), np.concatenate(ids), has


def train(docs: DataFrame, s: Settings = Settings(), text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and their matrix of log probabilities (last column: log prior).

    Rows with null text or language teach nothing.  Counts cover every row given.
    """
    small_batches(docs.sparkSession)
    found = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        for batch in batches:
            names, which = np.unique(np.asarray(batch.column(1).to_pylist(), object), return_inverse=True)
            for lo, hi, doc, ids, _ in ngrams(batch.column(0), s):
                own = which[lo:hi]
                sums = np.bincount(own[doc].astype(np.int64) * (s.buckets + 1) + ids, minlength=len(names) * (s.buckets + 1)).reshape(len(names), -1)
                sums[:, -1] += np.bincount(own, minlength=len(names))
                for k, name in enumerate(names):
                    tables[name] = tables[name] + sums[k] if name in tables else sums[k]
        for name, sums in tables.items():
            at = np.flatnonzero(sums)
            yield pa.record_batch([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(sums[at], pa.int64())], ["lang", "bucket", "n"])

    sums = found.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    names = sorted(r[0] for r in found.select("lang").distinct().limit(s.max_languages + 1).collect())
    if len(names) > s.max_languages:
        raise ValueError(f"more than {s.max_languages} languages")
    # at most max_languages * (buckets + 1) rows: a bound that the corpus does not move
    table = sums.toArrow()
    counts = np.zeros((len(names), s.buckets + 1))
    row = np.searchsorted(np.asarray(names, object), np.asarray(table.column(0).to_pylist(), object)) if names else np.zeros(0, int)
    counts[row, table.column(1).to_numpy()] = table.column(2).to_numpy()
    grams = counts[:, :-1] + s.smoothing
    logp = np.log(grams / grams.sum(1, keepdims=True)) if names else grams
    prior = np.log((counts[:, -1:] + 1) / (counts[:, -1:] + 1).sum()) if names else counts[:, -1:]
    return names, np.concatenate([logp, prior], 1)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], s: Settings = Settings(), text: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (posterior of that language) to the rows.

    Null text, or text without any letter: ``und`` with score 0.  So is every
    text where nothing was learned.  The columns of ``docs`` pass through
    (``lang_pred`` and ``score`` are replaced if there); an empty table gives no
    rows; equal texts get equal answers, and texts are read whole, however long.
    """
    small_batches(docs.sparkSession)
    names, logp = model
    shared = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(logp.T))
    docs = docs.drop("lang_pred", "score")
    keep = docs.columns
    at = docs.columns.index(text)
    labels = np.asarray([*names, UNKNOWN], object)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            best, sure = np.full(batch.num_rows, len(names)), np.zeros(batch.num_rows)
            for lo, hi, doc, ids, has in ngrams(batch.column(at), s) if names else ():
                logits = np.empty((hi - lo, len(names)))
                for k in range(len(names)):
                    logits[:, k] = np.bincount(doc, table[:, k][ids], hi - lo) + table[-1, k]
                top = logits.argmax(1)
                odds = np.exp(logits - logits.max(1, keepdims=True))
                best[lo:hi] = np.where(has, top, len(names))
                sure[lo:hi] = np.where(has, 1 / odds.sum(1), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(labels[best], pa.string()), pa.array(sure, pa.float64())], [*keep, "lang_pred", "score"])

    return docs.mapInArrow(score, StructType([*docs.schema, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))
