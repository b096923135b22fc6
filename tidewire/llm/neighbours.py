"""Approximate nearest neighbours by multi-index hashing.

Vectors get binary codes: rotations learned by iterative quantisation on a
bounded sample, then signs.  A code is cut into substrings of 16 bits, and every block of
rows has a directory for each substring, from each of its 65,536 keys to the rows that hold
it.  A query looks up, in every directory, its own key and all keys up to ``flips`` bits
away.  By the pigeonhole principle a code within Hamming distance
substrings * (flips + 1) - 1 of the query agrees with it that well in some
substring, so every such code is retrieved; rows found are ranked by inner products of the
original vectors.  A query that finds fewer than k rows in all blocks together is
then ranked against every row.

Codes measure angles after one more component has made all rows equally long.  That length
is cut a little above the 99th percentile, so that a few very long vectors do not
make the codes of all others alike; longer rows are ranked for every query.

How many substrings and flips are needed is read off the sample: of the settings
that reach enough true neighbours, the one that touches fewest other rows.  The nearer
neighbours are, compared with other rows, the fewer rows are touched; a larger
table has nearer ones.

Blocks of queries meet blocks of rows in grouped tasks, so no side is
broadcast and both are read in blocks of bounded size.
"""

from __future__ import annotations

import itertools
import math
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small_batches, written

#: Bits of a substring.
WIDTH = 16


@dataclass(frozen=True)
class Settings:
    k: int = 20
    #: Bound on substrings, and flips of bits that are considered.
    substrings: int = 192
    flips: tuple[int, ...] = (0, 1, 2, 3)
    #: Bounds on the rows that the rotations and the calibration read.
    sample_rows: int = 8_192
    probe_queries: int = 256
    #: Share of true neighbours, in the sample, that probing must reach.
    reach: float = 0.96
    #: Below this share, in the sample, a warning is given.
    warn: float = 0.9
    #: Rows more than ``slack`` times as long as this share of rows are ranked for every query.
    usual: float = 0.99
    slack: float = 1.05
    #: Rows and queries of a block; below ``least_queries`` queries a block is not cut further for parallelism.
    row_block: int = 16_384
    query_block: int = 16_384
    least_queries: int = 128


@dataclass
class Coder:
    """Centre, rotations to signs, norm that codes reach up to, and how many bits of a substring may differ."""

    centre: np.ndarray
    rotation: np.ndarray
    norm: float
    flips: int = WIDTH
    predicted: dict = field(default_factory=dict)

    def encode(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """A row of 16-bit substrings for every vector."""
        # one more component makes all rows equally long, so that the largest inner product is the smallest angle
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.norm**2 - (x**2).sum(1), 0))
        length = np.sqrt((x**2).sum(1, keepdims=True)) if query else np.full((len(x), 1), self.norm)
        wide = np.concatenate([x, extra[:, None]], 1) / length - self.centre
        parts = [np.packbits(wide[i : i + 2048] @ self.rotation > 0, axis=1, bitorder="little").view(np.uint16) for i in range(0, len(wide), 2048)]
        return np.concatenate(parts) if parts else np.zeros((0, self.rotation.shape[1] // WIDTH), np.uint16)


def learn(x: np.ndarray, norm: float, substrings: int, rounds: int = 8, seed: int = 5) -> Coder:
    """Iterative quantisation: alternate between signs and the rotation that fits them best, from several starts."""
    rng = np.random.default_rng(seed)
    x = x[:2048]
    wide = np.concatenate([x, np.sqrt(np.maximum(norm**2 - (x**2).sum(1), 0))[:, None]], 1) / norm
    centre = wide.mean(0)
    centre[-1] = 0 if np.ptp(wide[:, -1]) > 1e-9 else centre[-1]
    v = wide - centre
    _, axes = np.linalg.eigh(v.T @ v)
    axes = axes[:, ::-1]
    parts = []
    left = substrings * WIDTH
    while left > 0:
        own = axes[:, : min(left, axes.shape[1])]
        p = v @ own
        r = np.linalg.qr(rng.normal(size=(own.shape[1], own.shape[1])))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(p @ r > 0, 1.0, -1.0).T @ p)
            r = (u @ w).T
        parts.append(own @ r)
        left -= own.shape[1]
    return Coder(centre, np.concatenate(parts, 1), norm)


def calibrate(coder: Coder, x: np.ndarray, total: int, s: Settings) -> Coder:
    """Keep as many substrings, and allow as many flips, as the sample ``x`` asks for.

    A true neighbour in the sample has the same rank there, in proportion, as one of the k nearest of
    all ``total`` rows.  If no setting reaches enough of them, the most thorough one is taken.
    """
    q = x[: s.probe_queries]
    scores = q @ x.T
    scores[np.arange(len(q)), np.arange(len(q))] = -np.inf
    near = min(max(1, round(s.k * len(x) / max(total, 1))), max(len(x) - 1, 1))
    best = np.argpartition(-scores, near - 1, 1)[:, :near] if len(x) > near else np.argsort(-scores, 1)[:, :near]
    rows, asks = coder.encode(x), coder.encode(q, query=True)
    other = rows[np.linspace(0, len(x) - 1, min(len(x), 1024)).astype(np.int64)]
    options = []
    for flips in s.flips:
        reached = np.stack([(np.bitwise_count(a ^ rows[b]) <= flips) for a, b in zip(asks, best, strict=True)])
        touched = np.stack([(np.bitwise_count(a ^ other) <= flips) for a in asks[:64]])
        found = np.logical_or.accumulate(reached, 2).mean((0, 1))
        met = np.logical_or.accumulate(touched, 2).mean((0, 1))
        at = int(np.argmax(found >= s.reach)) if (found >= s.reach).any() else len(found) - 1
        options.append((found[at] < s.reach, met[at] if found[at] >= s.reach else -found[at], at + 1, flips, found[at], met[at]))
    _, _, m, coder.flips, found, met = min(options)
    coder.rotation = np.ascontiguousarray(coder.rotation[:, : m * WIDTH])
    coder.predicted = {"recall": float(found), "touched": float(met)}
    return coder


def near_keys(flips: int) -> np.ndarray:
    """What to flip in a key: nothing, and every choice of up to ``flips`` of its bits."""
    return np.array([sum(1 << b for b in bits) for n in range(flips + 1) for bits in itertools.combinations(range(WIDTH), n)], np.uint16)


class Block:
    """Vectors of some rows (at most 65,535) with a directory for each substring of their codes."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, flips: int, norm: float = math.inf) -> None:
        self.ids, self.x = ids, x
        self.long = np.flatnonzero((x**2).sum(1) > norm**2 * (1 + 1e-12))  # no code tells how near these are
        self.order = np.argsort(codes.T, axis=1, kind="stable").astype(np.uint16)
        self.first = np.zeros((codes.shape[1], (1 << WIDTH) + 1), np.uint16)
        for k in range(codes.shape[1]):
            np.cumsum(np.bincount(codes[:, k], minlength=1 << WIDTH), out=self.first[k, 1:], dtype=np.uint16)
        self.keys = near_keys(flips)
        self.touched = 0

    def probe(self, codes: np.ndarray) -> np.ndarray:
        """For every query code, which rows agree with it in some substring but for ``flips`` bits, or are longer than codes reach."""
        seen = np.zeros((len(codes), len(self.ids)), bool)
        seen[:, self.long] = True
        for k in range(codes.shape[1]):
            key = (codes[:, k][:, None] ^ self.keys).astype(np.int64)
            begin, end = self.first[k][key].ravel().astype(np.int64), self.first[k][key + 1].ravel().astype(np.int64)
            some = np.flatnonzero(end > begin)
            begin, size = begin[some], end[some] - begin[some]
            at = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
            seen[np.repeat(some // len(self.keys), size), self.order[k][at]] = True
        return seen

    def nearest(self, own: np.ndarray, vectors: np.ndarray, codes: np.ndarray, k: int, every: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The k best rows found for each query (fewer, where fewer are found; of all rows if ``every``), by inner product."""
        for a in range(0, len(codes), 64):
            seen = np.ones((len(codes[a : a + 64]), len(self.ids)), bool) if every else self.probe(codes[a : a + 64])
            self.touched += int(seen.sum())
            for i, v, found in zip(own[a : a + 64], vectors[a : a + 64], seen, strict=True):
                rows = np.flatnonzero(found & (self.ids != i))
                if len(rows) > k:
                    rough = self.x[rows] @ v
                    least = np.partition(rough, len(rows) - k)[len(rows) - k]
                    rows = rows[rough >= least - 1e-9 * (1 + abs(least))]
                exact = (self.x[rows] * v).sum(1)  # in one order for every row, so that equal vectors tie
                best = np.lexsort((self.ids[rows], -exact))[:k]
                yield self.ids[rows[best]], exact[best]


def usable(rows: DataFrame) -> DataFrame:
    """Rows with an id and a vector without null or non-finite components that is not zero."""
    v = F.col("embedding")
    fine = F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.where(F.coalesce(fine, F.lit(False)))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def search(vectors: DataFrame, is_query: Column, s: Settings = Settings()) -> DataFrame:
    """For every id where ``is_query`` holds, its ``k`` nearest others: query_id, rank, vec_id, score.

    ``vectors``: vec_id, embedding (others are ignored); ``is_query`` is a condition on vec_id.  Vectors
    that are null, zero, or hold null or non-finite components, and rows without a vec_id,
    take no part.  Of rows that share a vec_id the least vector counts, component by component, and
    the id is one query and one candidate.  Vectors of different lengths have no
    inner product: each length is searched on its own.  Ties go to the smaller vec_id.  A
    query with no candidate has no rows; an empty table gives none.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    lean = usable(vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    lean = written(lean.withColumns({"asks": is_query, "d": F.size("embedding")}), "vectors")
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    norm = F.least(F.max(length), F.percentile_approx(length, s.usual, 1_000) * s.slack)
    sizes = lean.groupBy("d").agg(F.count(F.lit(1)).alias("total"), F.count_if("asks").alias("asking"), norm.alias("norm")).where("asking > 0").orderBy("d").collect()
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for r in sizes:
        out = out.unionByName(_search(lean.where(F.col("d") == r["d"]), r["total"], r["asking"], r["norm"], s))
    return out


def fitted(lean: DataFrame, total: int, norm: float, s: Settings) -> Coder:
    """Rotations and calibration from a sample of at most ``sample_rows`` rows, chosen by a hash of their ids.

    Rows longer than ``norm`` are found anyway and are left out of it.  Where no setting
    reaches ``warn`` in the sample a warning tells what the one taken reaches.
    """
    chosen = F.pmod(F.xxhash64(F.lit(3), "vec_id"), F.lit(1 << 30)) < int(min(1.0, 1.2 * s.sample_rows / total) * (1 << 30))
    sample = _matrix(lean.where(chosen).select("embedding").limit(s.sample_rows).toArrow().column(0))
    sample = sample if len(sample) else _matrix(lean.select("embedding").limit(s.sample_rows).toArrow().column(0))
    usual = sample[(sample**2).sum(1) <= norm**2 * (1 + 1e-12)]
    sample = usual if len(usual) else sample
    coder = calibrate(learn(sample, norm, s.substrings), sample, total, s)
    if coder.predicted["recall"] < s.warn:
        warnings.warn(f"probing finds {coder.predicted['recall']:.2f} of the nearest rows in the sample, and touches {coder.predicted['touched']:.2f} of all", stacklevel=3)
    return coder


def _search(lean: DataFrame, total: int, asking: int, norm: float, s: Settings) -> DataFrame:
    shared = lean.sparkSession.sparkContext.broadcast(fitted(lean, total, norm, s))
    n_rows = math.ceil(total / s.row_block * 1.1)

    def encode(query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column(1))
                codes = shared.value.encode(x, query) if len(x) else []
                yield pa.record_batch([batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([v.tobytes() for v in x], pa.binary())], ["vec_id", "code", "vector"])

        return run

    kinds = "vec_id long, code binary, vector binary"
    out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
    block = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "vec_id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def best(queries: DataFrame, asking: int, every: bool) -> DataFrame:
        """The k best rows of each of ``queries``, out of those probing finds or of all."""
        n_asks = max(math.ceil(asking / s.query_block), min(8, math.ceil(asking / s.least_queries)))
        rows = lean.select("vec_id", "embedding").mapInArrow(encode(False), kinds).withColumn("rb", block(n_rows, 1)).withColumn("qb", each(n_asks))
        asks = queries.select("vec_id", "embedding").mapInArrow(encode(True), kinds).withColumn("qb", block(n_asks, 2)).withColumn("rb", each(n_rows))

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            if not len(left) or not len(right):
                return out.empty_table()
            stacked = lambda t, c, kind: np.frombuffer(b"".join(t[c].to_pylist()), kind).reshape(len(t), -1)
            unpack = lambda t: (t["vec_id"].to_numpy(), stacked(t, "vector", np.float64), stacked(t, "code", np.uint16))
            ids, x, codes = unpack(right)
            found = []
            for a in range(0, len(left), 60_000):  # a block is larger only if hashes deal very unevenly
                met = Block(*unpack(left.slice(a, 60_000)), shared.value.flips, shared.value.norm)
                found += zip(ids, met.nearest(ids, x, codes, s.k, every), strict=True)
            return pa.table([np.repeat([i for i, _ in found], [len(f[0]) for _, f in found]), np.concatenate([f[0] for _, f in found]), np.concatenate([f[1] for _, f in found])], schema=out)

        near = rows.groupBy("rb", "qb").cogroup(asks.groupBy("rb", "qb")).applyInArrow(meet, "query_id long, vec_id long, score double")
        order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
        return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= s.k).select("query_id", "rank", "vec_id", "score")

    found = written(best(lean.where("asks"), asking, False), "neighbours")
    full = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min(s.k, total - 1)).withColumnRenamed("query_id", "vec_id")
    short = written(lean.where("asks").join(full, "vec_id", "left_anti"), "short-queries")
    few = short.count()
    if not few:
        return found
    return found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(best(short, few, True))
