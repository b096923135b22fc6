"""Ranked lexical search by TPUT, the three-phase uniform threshold, over term-partitioned postings.

Postings: one pass over the documents gives, for terms that an item may ask for, chunks of a term's
postings; chunks of a term meet in lists ordered by contribution, the highest first.  A term of very many documents
has several lists, each of bounded size.

1. Heads: the best ``k`` postings of every term give partial sums; the k-th best sum of an item is a lower bound of its k-th best score.
2. Every list of an item is read down to the bound divided by the number of its terms.  A document that
   shows up nowhere has less than the bound.  Sums over what was read give a better bound, and what a
   document may still get from the rest of the lists gives its upper bound.
3. Documents whose upper bound reaches the lower bound are looked up in all lists of the item.

Items are taken in blocks of about ``pairs`` (item, term) pairs, and these pairs alone are broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bloom
from .common import small_batches, written
from .textgrid import _LOWER, buffers, cut_long, grid, slices

#: Terms end at every ASCII byte that is neither a letter nor a digit.
_BREAK = np.ones(256, bool)
_BREAK[0x80:] = False
_BREAK[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = False


@dataclass(frozen=True)
class Settings:
    k: int = 20
    #: (item, term) pairs in a block of items, postings in a list, documents in a block of documents.
    pairs: int = 1 << 16
    postings: int = 1 << 16
    documents: int = 1 << 13
    chunk_bytes: int = 8 << 20
    #: Bits of the filters of terms and candidates for each, and at most (32 MB).
    bits: int = 16
    most_bits: int = 1 << 28


@dataclass
class Terms:
    """Terms of many texts: bytes, and for every (text, term): text, hash, frequency, and the range of one occurrence; terms of each text."""

    data: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    tf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    n: np.ndarray


def terms(column: pa.Array | pa.ChunkedArray, wanted: np.ndarray | None = None) -> Terms:
    """The terms of whole texts, only those in the filter ``wanted`` if there is one (``n`` counts all)."""
    data, whole = buffers(column)
    bounds, owner = cut_long(data, whole, _BREAK)
    n = np.zeros(len(whole) - 1, np.int64)
    parts = [tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64))]
    for lo, hi in slices(bounds):
        g = grid(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo], lower=True, breaks=_BREAK)
        np.add.at(n, owner[lo:hi], g.counts())
        keep = np.flatnonzero(bloom.contains(wanted, g.hash)) if wanted is not None else np.arange(len(g.hash))
        parts.append((owner[lo:hi][g.doc[keep]], g.hash[keep], g.start[keep] + bounds[lo], g.end[keep] + bounds[lo]))
    doc, h, start, end = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])])) if len(doc) else np.zeros(0, np.int64)
    at = order[first]
    return Terms(_LOWER[data], doc[first], h[first], np.diff(np.append(first, len(doc))), start[at], end[at], n)


def item_terms(items: DataFrame) -> DataFrame:
    """item, item_id, term, hash, q (how often) of every item; rows equal in item_id and text are one item (written)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g = terms(batch.column(2))
            at = pa.array(g.doc)
            words = pa.array([g.data[a:b].tobytes() for a, b in zip(g.start, g.end, strict=True)], pa.binary())
            yield pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), words, pa.array(g.hash.view(np.int64)), pa.array(g.tf)], ["item", "item_id", "term", "hash", "q"])

    own = items.select(F.xxhash64("item_id", "text").alias("item"), "item_id", F.col("text").cast("string").alias("text")).dropDuplicates(["item"])
    return written(own.mapInArrow(run, f"item long, item_id {dict(items.dtypes)['item_id']}, term binary, hash long, q long"), "search-items")


def _filter(hashes: DataFrame, s: Settings):
    """Bloom filter of a column of hashes, as a broadcast of bounded size."""
    words = bloom.words_for(hashes.count(), s.bits, s.most_bits)
    return hashes.sparkSession.sparkContext.broadcast(bloom.collected(bloom.filled(hashes, words), "once", words))


def chunks(docs: DataFrame, wanted, s: Settings) -> DataFrame:
    """Chunks of postings: term, rows, tf, n, and for each chunk of documents a line without a term: their rows, doc_ids and n (written)."""
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"term binary, rows array<long>, tf array<long>, n array<long>, doc_ids array<{kind}>"

    def chunk(t: pa.Table) -> pa.RecordBatch:
        g = terms(t.column(2), wanted.value)
        row = t.column(0).to_numpy()
        order = np.argsort(g.hash, kind="stable")
        h = g.hash[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        words = [g.data[g.start[k] : g.end[k]].tobytes() for k in order[first]]
        cut = pa.array([*first, len(h), len(h) + len(row)], pa.int32())
        doc = g.doc[order]
        lists = [pa.ListArray.from_arrays(cut, pa.array(np.concatenate(x))) for x in ((row[doc], row), (g.tf[order], np.zeros(len(row), np.int64)), (g.n[doc], g.n))]
        ids = t.column(1).combine_chunks()
        ids = pa.ListArray.from_arrays(pa.array([0] * (len(words) + 1) + [len(row)], pa.int32()), ids)
        return pa.record_batch([pa.array([*words, None], pa.binary()), *lists, ids], ["term", "rows", "tf", "n", "doc_ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.column(2).nbytes
            if size >= s.chunk_bytes:
                yield chunk(pa.Table.from_batches(held))
                held, size = [], 0
        if held:
            yield chunk(pa.Table.from_batches(held))

    own = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("string").alias("text"))
    return written(own.mapInArrow(run, schema), "search-chunks")


def lists(found: DataFrame, weights: DataFrame, n_docs: int, n_terms: int, s: Settings) -> DataFrame:
    """term, w, rows and c (contributions, the highest first), with the heads, greatest and least c, of every list (written).

    ``weights``: term, df, w.  A term has a list for about every ``postings`` of its documents.
    """
    parted = found.where("term IS NOT NULL").join(weights, "term").withColumn("list", F.pmod(F.xxhash64(F.col("rows")[0]), F.ceil(F.col("df") / s.postings)).cast("int"))
    ordered = parted.select("term", "list", "w", "rows", "tf", "n").repartition("term", "list").sortWithinPartitions("term", "list")

    def one(held: list[tuple]) -> tuple:
        term, number, w = held[0][:3]
        rows, tf, n = (np.concatenate([h[k] for h in held]) for k in (3, 4, 5))
        m = 75 + (25 * n * n_docs) // n_terms
        c = w * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))
        order = np.lexsort((rows, -c))
        return term, number, rows[order], c[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[tuple]) -> pa.RecordBatch:
            term, number, rows, c = one(held)
            wrap = lambda x: pa.array([x], pa.list_(pa.int64()))
            return pa.record_batch([pa.array([term], pa.binary()), pa.array([number], pa.int32()), wrap(rows), wrap(c), wrap(rows[: s.k]), wrap(c[: s.k]), pa.array([c[0]]), pa.array([c[-1]])], ["term", "list", "rows", "c", "head_rows", "head_c", "most", "least"])

        held: list[tuple] = []
        for batch in batches:
            flat = [(col.flatten().to_numpy(), col.offsets.to_numpy()) for col in batch.columns[3:]]
            for k, key in enumerate(zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True)):
                if held and held[0][:2] != key[:2]:
                    yield out(held)
                    held = []
                held.append((*key, *[v[o[k] - o[0] : o[k + 1] - o[0]] for v, o in flat]))
        if held:
            yield out(held)

    arrays = "rows array<long>, c array<long>, head_rows array<long>, head_c array<long>"
    return written(ordered.mapInArrow(run, f"term binary, list int, {arrays}, most long, least long"), "search-lists")


def _best(rows: DataFrame, by: str, value: str, k: int, tie: str = "row") -> DataFrame:
    """The ``k`` rows of each ``by`` with the greatest value."""
    order = Window.partitionBy(by).orderBy(F.col(value).desc(), tie)
    return rows.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k)


def _kth(rows: DataFrame, value: str, k: int) -> dict[int, int]:
    """The k-th best value of each item that has so many rows; a row an item of the block comes to the driver."""
    return {r["item"]: r[value] for r in _best(rows.select("item", "row", value), "item", value, k).where(F.col("_rank") == k).select("item", value).collect()}


@dataclass
class Block:
    """The pairs of a block of items, sorted by item: number of the term and how often the item has it, the least contribution
    that is read, and the most that an unread posting may add (times q)."""

    items: np.ndarray
    first: np.ndarray
    term: np.ndarray
    q: np.ndarray
    need: np.ndarray
    rest: np.ndarray
    bound: np.ndarray


def _block(pairs: pa.Table, bounds: dict[int, int]) -> Block:
    """``pairs``: item, t, q, most, least, sorted by item; ``bounds``: lower bounds of the k-th best score."""
    item, term, q, most, low = (pairs[c].to_numpy() for c in ("item", "t", "q", "most", "least"))
    items, first, m = np.unique(item, return_index=True, return_counts=True)
    bound = np.array([bounds.get(int(i), 0) for i in items], np.int64)
    which = np.repeat(np.arange(len(items)), m)
    per = m[which] * q
    need = np.maximum(1, -(-bound[which] // per))
    rest = np.where(low >= need, 0, q * np.minimum(need - 1, most))
    return Block(items, np.append(first, len(item)), term, q, need, rest, bound)


def _sums(fetched: DataFrame, block, s: Settings) -> DataFrame:
    """item, row, seen (sum of what was read) and upper (the most it can be) of documents that may be among the best.

    ``fetched``: part (block of documents), t, rows, c.
    """

    def one(held: list[tuple]) -> pa.RecordBatch:
        b: Block = block.value
        t = np.array([h[0] for h in held])
        order = np.argsort(t, kind="stable")
        t = t[order]
        size = np.array([len(held[k][1]) for k in order])
        docs, at = np.unique(np.concatenate([held[k][1] for k in order]), return_inverse=True)
        c = np.concatenate([held[k][2] for k in order])
        edge = np.concatenate([[0], np.cumsum(size)])
        lo, hi = edge[np.searchsorted(t, b.term, "left")], edge[np.searchsorted(t, b.term, "right")]
        out = []
        for i in range(len(b.items)):
            seen, unread = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
            for p in range(b.first[i], b.first[i + 1]):
                if lo[p] == hi[p]:
                    continue
                own = c[lo[p] : hi[p]]
                read = own >= b.need[p]
                where = at[lo[p] : hi[p]][read]  # a document once in a term's postings
                seen[where] += b.q[p] * own[read]
                unread[where] -= b.rest[p]
            upper = seen + unread + b.rest[b.first[i] : b.first[i + 1]].sum()
            least = int(b.bound[i])
            if len(docs) >= s.k:
                least = max(least, int(np.partition(seen, len(seen) - s.k)[-s.k]))
            keep = np.flatnonzero((seen > 0) & (upper >= least))
            out.append((np.full(len(keep), b.items[i]), docs[keep], seen[keep], upper[keep]))
        return pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["item", "row", "seen", "upper"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, []
        for batch in batches:
            part, t = (batch.column(k).to_pylist() for k in range(2))
            flat = [(batch.column(k).flatten().to_numpy(), batch.column(k).offsets.to_numpy()) for k in (2, 3)]
            for k in range(batch.num_rows):
                if part[k] != here and held:
                    yield one(held)
                    held = []
                here = part[k]
                held.append((t[k], *[v[o[k] - o[0] : o[k + 1] - o[0]].copy() for v, o in flat]))
        if held:
            yield one(held)

    return fetched.repartition("part").sortWithinPartitions("part").mapInArrow(run, "item long, row long, seen long, upper long")


def _search(pairs: DataFrame, postings: DataFrame, n_docs: int, s: Settings) -> DataFrame:
    """item, row, score of every candidate of one block of items.  ``pairs``: item, term, t, q, most, least."""
    spark = pairs.sparkSession
    small = F.broadcast(pairs.select("item", "term", "q"))  # bounded by the size of a block
    heads = postings.join(F.broadcast(pairs.select("term").distinct()), "term", "left_semi").select("term", F.explode(F.arrays_zip("head_rows", "head_c")).alias("x")).select("term", F.col("x.head_rows").alias("row"), F.col("x.head_c").alias("c"))
    heads = _best(heads, "term", "c", s.k).join(small, "term").groupBy("item", "row").agg(F.sum(F.col("q") * F.col("c")).alias("seen"))
    table = pairs.select("item", "t", "q", "most", "least").orderBy("item", "t").toArrow()
    local = _block(table, _kth(heads, "seen", s.k))
    block = spark.sparkContext.broadcast(local)
    known = pairs.groupBy("term").agg(F.first("t").alias("t"))
    least = np.full(int(local.term.max(initial=-1)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, local.term, local.need)
    parts = max(1, -(-n_docs // s.documents))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, t in enumerate(batch.column(0).to_pylist()):
                c = batch.column(2)[k].values.to_numpy()
                n = int(np.searchsorted(-c, -least[t], "right"))  # the list is read down to here
                if not n:
                    continue
                rows, c = batch.column(1)[k].values.to_numpy()[:n], c[:n]
                part = ((rows >> 33) * 1_000_003 + (rows & ((1 << 33) - 1))) % parts
                order = np.argsort(part, kind="stable")
                part = part[order]
                first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
                cut = pa.array([*first, n], pa.int32())
                yield pa.record_batch([pa.array(part[first]), pa.array(np.full(len(first), t, np.int32)), *[pa.ListArray.from_arrays(cut, pa.array(x[order])) for x in (rows, c)]], ["part", "t", "rows", "c"])

    own = postings.join(F.broadcast(known), "term")
    fetched = own.select("t", "rows", "c").mapInArrow(fetch, "part long, t int, rows array<long>, c array<long>")
    near = written(_sums(fetched, block, s), "search-near")
    bounds = near.join(F.broadcast(spark.createDataFrame([(i, v) for i, v in _kth(near, "seen", s.k).items()], "item long, bound long")), "item", "left")
    candidates = written(bounds.where(F.col("upper") >= F.coalesce("bound", F.lit(0))).select("item", "row"), "search-candidates")
    wanted = _filter(candidates.select(F.col("row").alias("hash")).distinct(), s)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, c = (batch.column(k).flatten().to_numpy() for k in (1, 2))
            t = np.repeat(batch.column(0).to_numpy(), np.asarray(batch.column(1).value_lengths()))
            keep = bloom.contains(wanted.value, rows.view(np.uint64))
            yield pa.record_batch([pa.array(t[keep]), pa.array(rows[keep]), pa.array(c[keep])], ["t", "row", "c"])

    found = own.select("t", "rows", "c").mapInArrow(look_up, "t int, row long, c long")
    asked = candidates.join(F.broadcast(pairs.select("item", "t", "q")), "item")
    return written(asked.join(found, ["t", "row"]).groupBy("item", "row").agg(F.sum(F.col("q") * F.col("c")).alias("score")).where("score > 0"), "search-scores")


def search(docs: DataFrame, items: DataFrame, s: Settings = Settings()) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents with the highest scores above 0 for every item.

    Terms are runs of ASCII letters, digits and other than ASCII, A-Z lower-cased.  Null and empty texts have none, on
    both sides; items without a term that a document has give no rows.  Equal scores are ordered by
    doc_id, null first.  Repeated rows of ``docs`` are documents of their own; rows of ``items``
    equal in item_id and text are one item, other items with that item_id are ranked apart.  Texts are read whole, however long.
    Other columns are ignored; empty tables give no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    asked = item_terms(items)
    found = chunks(docs, _filter(asked.select("hash").distinct(), s), s)
    listed = found.where("term IS NULL").select(F.explode(F.arrays_zip("rows", "doc_ids", "n")).alias("x")).select(F.col("x.rows").alias("row"), F.col("x.doc_ids").alias("doc_id"), F.col("x.n").alias("n"))
    n_docs, n_terms = listed.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = found.where("term IS NOT NULL").groupBy("term").agg(F.sum(F.size("rows")).alias("df")).join(asked.select("term").distinct(), "term", "left_semi")
    weigh = F.udf(lambda n: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))), "long")  # once a term that an item has
    weights = written(df.withColumn("w", weigh("df")), "search-weights")
    postings = lists(found, weights, n_docs, max(n_terms, 1), s)
    ends = postings.groupBy("term").agg(F.max("most").alias("most"), F.min("least").alias("least"))
    pairs = written(asked.join(ends, "term").select("item", "item_id", "term", "q", "most", "least"), "search-pairs")
    n_pairs = pairs.count()
    blocks = -(-n_pairs // s.pairs)
    dealt = pairs.withColumn("block", F.pmod("item", F.lit(max(blocks, 1))).cast("int"))
    scored = []
    for k in range(blocks):
        own = dealt.where(F.col("block") == k)
        terms_ = own.select("term").distinct().withColumn("t", F.row_number().over(Window.orderBy("term")) - 1)
        scored.append(_search(written(own.join(terms_, "term"), "search-block"), postings, n_docs, s))
    kinds = f"item_id {dict(items.dtypes)['item_id']}, rank int, doc_id {dict(docs.dtypes)['doc_id']}, score long"
    if not scored:
        return spark.createDataFrame([], kinds)
    named = reduce(DataFrame.unionByName, scored).join(listed.select("row", "doc_id"), "row").join(asked.select("item", "item_id").distinct(), "item")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), "doc_id", "row")
    return named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= s.k).select("item_id", "rank", "doc_id", "score")
