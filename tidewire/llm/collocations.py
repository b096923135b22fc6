"""Phrase collocations: short phrases that occur together more often than their parts would.

1. Every shard of texts, about 4 MB in a task, builds a suffix automaton over (language, word) symbols; its endpos counts
   are the counts of words and pairs there.  Their 64-bit hashes and counts are summed over all shards, and the
   frequent ones go into a Bloom filter of bounded size.
2. The shards build automata of the full depth.  Phrases of which each word and pair is in the filter are counted
   over all shards by their text, so what the filter lets through by chance is counted exactly and then dropped.
3. Scores from exact counts.  A suffix link leads from a phrase to the phrase without its first word; over these links,
   and those to the phrase without its last word, each phrase learns the largest count of a longer one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bloom
from .common import join_hot, small_batches, written
from .suffix_automaton import build, grouped
from .textgrid import _LOWER, buffers, cut_long, grid, mix, slices


@dataclass(frozen=True)
class Settings:
    longest: int = 3
    least: int = 10
    #: A phrase goes if a longer one has at least this percentage of its count.
    percent: int = 50
    top: int = 2_000
    shard_bytes: int = 4 << 20
    #: Filter bits for a frequent word or pair, and bits of the filter at most (32 MB).
    bits: int = 12
    most_bits: int = 1 << 28


_PIECE = np.zeros(256, bool)
_PIECE[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_BREAK = _PIECE.copy()
_BREAK[[0x20, 0x09]] = True

UNKNOWN = "und"


@dataclass
class Shard:
    """Words of many texts: bytes, ranges, hash with the language, symbol, words before it in its piece, language."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    symbol: np.ndarray
    room: np.ndarray
    lang: np.ndarray
    langs: list[str]

    def pair(self, end: np.ndarray) -> np.ndarray:
        """Hash of the two words that end at ``end``."""
        return mix(self.hash[end - 1] * np.uint64(0x9E3779B97F4A7C15) + self.hash[end])

    def text(self, end: int, n: int) -> bytes:
        return b" ".join(self.data[self.start[k] : self.end[k]].tobytes() for k in range(end - n + 1, end + 1))


def _shard(held: list[pa.RecordBatch]) -> Shard:
    """The shard of batches of lang and text."""
    langs, texts = pa.Table.from_batches(held).columns
    coded = langs.fill_null(UNKNOWN).combine_chunks().dictionary_encode()
    names = coded.dictionary.to_pylist()
    salt = np.array([int.from_bytes(hashlib.blake2b(str(x).encode(), digest_size=8).digest()) for x in names], np.uint64)
    data, bounds = buffers(texts)
    bounds, owner = cut_long(data, bounds, _PIECE)  # no phrase crosses these bytes
    of = coded.indices.to_numpy(zero_copy_only=False)[owner]
    parts = []
    for lo, hi in slices(bounds):
        g = grid(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo], lower=True, breaks=_BREAK)
        piece = np.cumsum(_PIECE[g.data])[g.start]
        new = np.ones(len(g.doc), bool)
        new[1:] = (g.doc[1:] != g.doc[:-1]) | (piece[1:] != piece[:-1])
        at = np.arange(len(new))
        parts.append((g.start + bounds[lo], g.end + bounds[lo], g.hash, at - np.maximum.accumulate(np.where(new, at, 0)), of[lo:hi][g.doc]))
    start, end, h, room, lang = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    h = mix(h ^ salt[lang])
    return Shard(_LOWER[data], start, end, h, grouped(h)[1], room, lang, names)


def _shards(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[Shard]:
    """Shards of up to ``shard_bytes`` of text, or one larger batch."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if held and size + batch.column(1).nbytes > s.shard_bytes:
            yield _shard(held)
            held, size = [], 0
        held.append(batch)
        size += batch.column(1).nbytes
    if held:
        yield _shard(held)


def _hashes(docs: DataFrame, s: Settings) -> DataFrame:
    """hash and n of every word and pair of each shard."""

    def one(g: Shard) -> pa.RecordBatch:
        a = build(g.symbol, g.room, 2)
        state, n = a.substrings()
        end = a.end[state]
        h = np.where(n == 1, g.hash[end], g.pair(np.maximum(end, 1))) if len(end) else np.zeros(0, np.uint64)
        return pa.record_batch([pa.array(h.view(np.int64)), pa.array(a.count[state])], ["hash", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(one, _shards(batches, s))  # so that no shard is held while the next is made

    return docs.mapInArrow(run, "hash long, n long")


def counts(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """lang, words, phrase, n: counts of the phrases of up to ``longest`` words with at least ``least`` occurrences,
    and, with ``words`` 0 and an empty phrase, the number of all words of each language (written)."""
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    # most hashes are rare, so tasks have little to add up beyond what their shards have: no sums before the shuffle
    often = written(_hashes(own, s).repartition("hash").groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") >= s.least).select("hash"), "phrase-often")
    words = bloom.words_for(often.count(), s.bits, s.most_bits)
    known = spark.sparkContext.broadcast(bloom.collected(bloom.filled(often, words), "once", words))

    def one(g: Shard) -> pa.RecordBatch:
        word = bloom.contains(known.value, g.hash)
        pair = np.zeros(len(word), bool)  # with the word before it
        inside = np.flatnonzero(g.room >= 1)
        pair[inside] = word[inside] & word[inside - 1] & bloom.contains(known.value, g.pair(inside))
        # how many words before a word are bound to it by frequent pairs
        at = np.arange(len(pair))
        bound = at - np.maximum.accumulate(np.where(pair, 0, at)) if len(at) else at
        a = build(g.symbol, g.room, s.longest)
        state, n = a.substrings()
        end = a.end[state]
        good = np.where(n == 1, word[end], bound[end] >= n - 1)
        state, n, end = state[good], n[good], end[good]
        total = np.bincount(g.lang, minlength=len(g.langs))
        seen = np.flatnonzero(total)
        phrase = [g.text(e, k) for e, k in zip(end.tolist(), n.tolist(), strict=True)] + [b""] * len(seen)
        lang = pa.array(g.langs, pa.string()).take(pa.array(np.concatenate([g.lang[end], seen])))
        return pa.record_batch([lang, pa.array(np.concatenate([n, np.zeros(len(seen), np.int64)]).astype(np.int32)), pa.array(phrase, pa.binary()), pa.array(np.concatenate([a.count[state], total[seen]]))], ["lang", "words", "phrase", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(one, _shards(batches, s))

    found = own.mapInArrow(run, "lang string, words int, phrase binary, n long").groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))
    return written(found.where((F.col("n") >= s.least) | (F.col("words") == 0)).withColumn("phrase", F.col("phrase").cast("string")), "phrase-counts")


def mine(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of 2 to ``longest`` words.

    a, l and r count the phrase and the two parts of its lowest-scoring cut (of equal scores that with the shorter first
    part), n all words of the language; score is floor(1,000,000 a a / (l r)), exact up to a of 10^16.  A null
    lang is ``und``, also beside a real ``und``; null, empty and wordless texts have no phrase; repeated
    rows count as often as they stand.  Phrases equal in score and count are ordered by their bytes.
    Long texts are cut where no phrase crosses.  Other columns are ignored; an empty table gives no rows.
    """
    known = counts(docs, s)
    candidates = known.where("words >= 2").select("lang", "phrase", "words", F.col("n").alias("a"))
    w = F.split("phrase", " ")
    part = lambda lo, n: F.array_join(F.slice(w, lo, n), " ")
    cut = candidates.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    sides = cut.select("lang", "phrase", "a", "k", F.explode(F.array(F.struct(F.lit(True).alias("first"), part(F.lit(1), F.col("k")).alias("part")), F.struct(F.lit(False).alias("first"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("part")))).alias("x")).select("lang", "phrase", "a", "k", "x.*")
    sides = written(sides, "phrase-parts")
    asked = sides.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("rows"))
    parts = written(asked.join(known.where("words > 0").select("lang", F.col("phrase").alias("part"), F.col("n").alias("f")), ["lang", "part"]), "phrase-part-counts")
    both = join_hot(sides, parts, ["lang", "part"], "rows", "inner").groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("first"), F.col("f"))).alias("l"), F.max(F.when(~F.col("first"), F.col("f"))).alias("r"))
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    wide = both.withColumns({"_over": (F.lit(1_000_000).cast("decimal(7,0)") * whole("a") * whole("a")).cast("decimal(38,0)"), "_under": (whole("l") * whole("r")).cast("decimal(38,0)")})
    least = wide.withColumn("score", F.expr("CAST(_over div _under AS BIGINT)")).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
    # contiguous shorter phrases of every longer candidate, by repeated steps along the links
    inner = candidates.where("words >= 3").select("lang", "a", "words", w.alias("w")).withColumn("n", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
    inner = inner.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("n") + 1))).select("lang", F.array_join(F.slice("w", F.col("at"), F.col("n")), " ").alias("phrase"), "a")
    longer = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    free = least.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < s.percent * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    best = free.select("lang", "phrase", "a", "x.l", "x.r", "x.score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= s.top)
    return best.join(known.where("words = 0").select("lang", "n"), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
