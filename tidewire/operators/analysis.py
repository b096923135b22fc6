"""Feature analysis: correlation, leakage, stability, importance and selection.

Statistics are distributed; what comes to the driver is one row a feature, or
one a pair of features.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import finite, near_zero, safe_ratio
from ..functions.stats import correlation_p
from ..functions import ordering
from ..functions.ordering import PIECE_ROWS, cuts, numbered, running, with_piece
from .dataset import stack


def value_counts(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """feature, value, n: how often each value of each feature stands; nulls are not counted."""
    return stack(rows, [], names).where("value IS NOT NULL").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))


def ranked(rows: DataFrame, names: Sequence[str], counts: DataFrame) -> DataFrame:
    """Average ranks of ``names`` in place of their values; a null has no rank.

    All features are ranked together, one row a feature and value: ``counts`` (``value_counts``, read several times) are summed up in order, the
    ranks joined back and put side by side again.  Values with a thousandth of all cells or more are a thousand at most; their ranks are broadcast.
    """
    long = stack(rows.withColumn("_row", F.monotonically_increasing_id()), ["_row"], names).where("value IS NOT NULL")
    ranks = running(counts, "value", {"_upto": F.col("n")}, ["feature"]).select("feature", "value", "n", (F.col("_upto") - F.col("n") / 2 + 0.5).alias("_r"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    often = F.broadcast(ranks.where(F.col("n") * 1_000 >= total).drop("n"))
    rare = long.join(often.drop("_r"), ["feature", "value"], "left_anti").join(ranks.where(F.col("n") * 1_000 < total).drop("n"), ["feature", "value"])
    both = long.join(often, ["feature", "value"]).unionByName(rare)
    return both.groupBy("_row").agg(*[F.max(F.when(F.col("feature") == c, F.col("_r"))).alias(c) for c in names]).drop("_row")


def sampled(rows: DataFrame, size: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """``size`` rows in the order of a hash of their ``keys``, or all if they are fewer: a sample for correlations.

    Only rows below a threshold of the hash, a little more than are wanted, are put in order.
    """
    n = rows.count()
    if n <= size:
        return rows
    share = min(1.0, 1.1 * size / n + 10 / n**0.5 * (size / n) ** 0.5 + 20 / n)
    return rows.withColumn("_h", F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 40))).where(F.col("_h") < int(share * (1 << 40))).orderBy("_h", *keys).limit(size).drop("_h")


class Merging(NamedTuple):
    """A user's correlation in three steps, so that it can read all rows.

    ``map`` turns the two value arrays of some rows into an array of numbers, ``merge`` joins two such
    arrays into one, ``finish`` gives the correlation, or None.  ``merge`` must not care about the order of rows.
    """

    map: Callable[[np.ndarray, np.ndarray], Sequence[float]]
    merge: Callable[[np.ndarray, np.ndarray], Sequence[float]]
    finish: Callable[[np.ndarray], float | None]


def merged(rows: DataFrame, names: Sequence[str], pairs: Sequence[tuple[str, str]], steps: Merging) -> list[tuple[str, str, float | None]]:
    """Correlations of pairs by ``steps`` over all rows without a null or NaN in either feature; null for a pair without such rows.

    A task maps its Arrow batches and holds one array a pair; the arrays of a pair are merged by another
    task, in the order of partitions, and only the result comes to the driver.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            values = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
            for k, (a, b) in enumerate(pairs):
                good = ~(np.isnan(values[a]) | np.isnan(values[b]))
                if good.any():
                    x = np.asarray(steps.map(values[a][good], values[b][good]), float)
                    held[k] = np.asarray(steps.merge(held[k], x), float) if k in held else x
        part = TaskContext.get().partitionId()
        yield pa.record_batch([pa.array(list(held), pa.int32()), pa.array([part] * len(held), pa.int32()), pa.array([x.tolist() for x in held.values()], pa.list_(pa.float64()))], ["pair", "part", "held"])

    def finish(t: pa.Table) -> pa.Table:
        t = t.sort_by("part")
        arrays = iter(t["held"].to_pylist())
        all_ = np.array(next(arrays), float)
        for x in arrays:
            all_ = np.asarray(steps.merge(all_, np.array(x, float)), float)
        r = steps.finish(all_)
        return pa.table({"pair": pa.array([t["pair"][0].as_py()], pa.int32()), "corr": pa.array([None if r is None else float(r)], pa.float64())})

    doubles = rows.select(*[F.col(c).cast("double").alias(c) for c in names])
    found = doubles.mapInArrow(gather, "pair int, part int, held array<double>").groupBy("pair").applyInArrow(finish, "pair int, corr double").collect()
    by_pair = {r["pair"]: r["corr"] for r in found}
    return [(a, b, by_pair.get(k)) for k, (a, b) in enumerate(pairs)]


def correlations(rows: DataFrame, names: Sequence[str], method: str | Callable | Merging = "spearman", block_size: int | None = None, sample_size: int = 5_000) -> DataFrame:
    """feature_a, feature_b, corr for all ordered pairs of different features.

    Null where a feature is constant.  One pass gives the sums of all pairs.
    ``block_size`` limits pairs to blocks of neighbouring features.  Plain callables
    get the two value arrays of a pair and work on a sample of ``sample_size`` rows; callables in steps (``Merging``) and the
    other methods read all rows.
    """
    spark = rows.sparkSession
    pairs = [(a, b) for a, b in itertools.combinations(names, 2) if block_size is None or names.index(a) // block_size == names.index(b) // block_size]
    if method == "kendall":
        out = kendall(rows, names, pairs)
    elif isinstance(method, Merging):
        out = merged(rows, names, pairs, method)
    elif callable(method):
        found = sampled(rows.select(*names), sample_size, names).toArrow()
        out = [(a, b, float(method(found[a].to_numpy(), found[b].to_numpy()))) for a, b in pairs]
    else:
        counts = value_counts(rows, names).persist(StorageLevel.MEMORY_AND_DISK) if method == "spearman" else None
        try:
            x = rows if counts is None else ranked(rows, names, counts)
            # centred sums avoid cancellation and the error that corr raises for constants
            mean = x.agg(*[F.avg(c).alias(f"_m_{c}") for c in names])
            c = x.crossJoin(F.broadcast(mean.limit(1))).select(*[(F.col(n) - F.col(f"_m_{n}")).alias(n) for n in names])
            sums = c.agg(*[F.sum(F.col(n) * F.col(n)).alias(f"s_{k}") for k, n in enumerate(names)], *[F.sum(F.col(a) * F.col(b)).alias(f"p_{k}") for k, (a, b) in enumerate(pairs)]).first()
        finally:
            if counts is not None:
                counts.unpersist()
        own = {n: sums[f"s_{k}"] or 0.0 for k, n in enumerate(names)}
        out = [(a, b, sums[f"p_{k}"] / (own[a] * own[b]) ** 0.5 if own[a] > 1e-30 and own[b] > 1e-30 else None) for k, (a, b) in enumerate(pairs)]
    return spark.createDataFrame([*out, *((b, a, r) for a, b, r in out)], "feature_a string, feature_b string, corr double")


def inversions(x: np.ndarray, y: np.ndarray) -> int:
    """Pairs with x below and y above, by merging sorted halves."""
    y = y[np.lexsort((y, x))]

    def count(v: np.ndarray) -> tuple[int, np.ndarray]:
        if len(v) <= 64:
            return int(np.triu(v[:, None] > v, 1).sum()), np.sort(v)
        (n, left), (m, right) = count(v[: len(v) // 2]), count(v[len(v) // 2 :])
        across = len(left) * len(right) - int(np.searchsorted(left, right, "right").sum())
        return n + m + across, np.sort(np.concatenate([left, right]), kind="stable")

    return count(y)[0]


def kendall(rows: DataFrame, names: Sequence[str], pairs: Sequence[tuple[str, str]]) -> list[tuple[str, str, float | None]]:
    """Kendall's tau-b of pairs of features over all rows without a null or NaN in either; null where a feature is constant.

    Each feature is cut into pieces at quantiles, ties together.  Discordant pairs lie in one piece of the first feature
    (counted there by merging), in different pieces of the first and one of the second (counted there, with the piece in
    the first feature's place), or in different pieces of both (counted from the table of piece by piece).  One shuffle a feature.
    """
    names = [c for c in names if any(c in p for p in pairs)]
    lean = rows.select(*[F.col(c).cast("double").alias(c) for c in names])
    n = lean.count()
    whole = lean
    for c in names:
        whole = with_piece(whole, c, cuts(lean, c, n)).withColumnRenamed("_piece", f"_p_{c}")
    whole = whole.persist(StorageLevel.MEMORY_AND_DISK)
    inside: Counter = Counter()
    try:
        for c in names:
            own = [(a, b) for a, b in pairs if c in (a, b)]
            others = sorted({x for p in own for x in p if x != c})
            columns = [f"_p_{c}", c, *others, *[f"_p_{x}" for x in others]]

            def run(batches: Iterator[pa.RecordBatch], c=c, own=own, columns=columns) -> Iterator[pa.RecordBatch]:
                held = pa.Table.from_batches(list(batches), None) if (batches := list(batches)) else None
                found = Counter()
                if held is not None and len(held):
                    t = {k: held[k].to_numpy() for k in columns}
                    order = np.argsort(t[f"_p_{c}"], kind="stable")
                    for part in np.split(order, np.flatnonzero(np.diff(t[f"_p_{c}"][order])) + 1):
                        for a, b in own:
                            x, y = t[a][part], t[b][part]
                            good = ~(np.isnan(x) | np.isnan(y))
                            first = x if a == c else t[f"_p_{a}"][part]
                            found[a, b] += inversions(first[good], y[good])
                yield pa.record_batch([pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["a", "b", "n"])

            dealt = whole.select(*columns).repartition(max(1, -(-n // PIECE_ROWS)), f"_p_{c}")
            for r in dealt.mapInArrow(run, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect():
                inside[r["a"], r["b"]] += r["n"]
        out = []
        choose = lambda x: F.coalesce(F.sum(x.cast("decimal(20,0)") * (x.cast("decimal(20,0)") - 1) / 2), F.lit(0)).cast("decimal(38,0)")
        for a, b in pairs:
            own = whole.where(~(F.isnan(a) | F.isnan(b)) & F.col(a).isNotNull() & F.col(b).isNotNull())
            both = own.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
            t_xy, total = both.agg(choose(F.col("n")), F.coalesce(F.sum("n"), F.lit(0))).first()
            t_x, t_y = (both.groupBy(c).agg(F.sum("n").alias("n")).agg(choose(F.col("n"))).first()[0] for c in (a, b))
            cells = {(r[0], r[1]): r[2] for r in own.groupBy(f"_p_{a}", f"_p_{b}").count().collect()}
            table = np.zeros((max((i for i, _ in cells), default=0) + 1, max((j for _, j in cells), default=0) + 1), object)
            for at, v in cells.items():
                table[at] = v
            right = np.cumsum(np.cumsum(table[::-1], 0)[::-1], 1)  # rows from i on, columns up to j
            across = sum(int(v) * int(right[i + 1, j - 1]) for (i, j), v in cells.items() if i + 1 < table.shape[0] and j)
            discordant, every = inside[a, b] + across, total * (total - 1) // 2
            under = (every - int(t_x)) * (every - int(t_y))
            out.append((a, b, (every - int(t_x) - int(t_y) + int(t_xy) - 2 * discordant) / math.sqrt(under) if under else None))
        return out
    finally:
        whole.unpersist()


def neighbours(corr: DataFrame, least: float = 0.5) -> DataFrame:
    """feature and its correlated others, strongest first."""
    strong = corr.where(finite(F.col("corr")) & (F.abs("corr") > least) & (F.col("feature_a") != F.col("feature_b")))
    ordered = F.sort_array(F.collect_list(F.struct(-F.abs("corr"), F.col("feature_b").alias("feature"), F.col("corr").alias("corr"))))
    return strong.groupBy(F.col("feature_a").alias("feature")).agg(F.transform(ordered, lambda x: F.struct(x["feature"].alias("feature"), x["corr"].alias("corr"))).alias("others"))


def correlation_bands(corr: DataFrame) -> DataFrame:
    """Pairs by strength: above 0.8, 0.5 to 0.8, up to 0.5."""
    r = F.abs("corr")
    band = F.when(r > 0.8, "high").when(r > 0.5, "moderate").otherwise("low")
    return corr.where(finite(F.col("corr")) & (F.col("feature_a") < F.col("feature_b"))).groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"))


def redundant_pairs(corr: DataFrame, threshold: float = 0.95) -> DataFrame:
    return corr.where((F.col("feature_a") < F.col("feature_b")) & finite(F.col("corr")) & (F.abs("corr") > threshold))


def binned_information(rows: DataFrame, names: Sequence[str], label: str = "label", bins: int = 20) -> DataFrame:
    """feature, mutual_info: plug-in mutual information, in nats, of equal-width bins with the label."""
    long = stack(rows, [label], names)
    ends = long.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    width = F.col("hi") - F.col("lo")
    place = F.when(width > 0, F.least(F.floor((F.col("value") - F.col("lo")) / F.when(width > 0, width) * bins), F.lit(bins - 1))).otherwise(0)
    cells = long.join(ends, "feature").groupBy("feature", place.alias("bin"), label).agg(F.count(F.lit(1)).alias("n"))
    by_bin, by_label, every = Window.partitionBy("feature", "bin"), Window.partitionBy("feature", label), Window.partitionBy("feature")
    total = F.sum("n").over(every)
    part = cells.withColumn("v", F.col("n") / total * F.log(F.col("n") * total / (F.sum("n").over(by_bin) * F.sum("n").over(by_label))))
    return part.groupBy("feature").agg(F.greatest(F.sum("v"), F.lit(0.0)).alias("mutual_info"))


def _digamma(n: Column) -> Column:
    """Digamma of whole numbers from 1: the asymptotic series 8 places on, and the recurrence back."""
    z = n + F.lit(8.0)
    out = F.log(z) - 1 / (2 * z) - 1 / (12 * z**2) + 1 / (120 * z**4) - 1 / (252 * z**6)
    for k in range(8):
        out = out - 1 / (n + F.lit(float(k)))
    return out


def digammas(n: np.ndarray) -> np.ndarray:
    """The same for an array."""
    z = n + 8.0
    return np.log(z) - 1 / (2 * z) - 1 / (12 * z**2) + 1 / (120 * z**4) - 1 / (252 * z**6) - sum(1 / (n + float(k)) for k in range(8))


def _reach(v: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper end of the reach of values to their ``most``-th nearest.

    A row of ``v`` has a value in its middle and, in order, the values of its class on either side, NaN where there are none.
    """
    k = v.shape[1] // 2
    own = v[:, k]
    far, low, high = np.full(len(v), np.inf), np.full(len(v), np.inf), np.full(len(v), np.inf)
    # the nearest lie in one run around the value, some of them below it
    for m in range(1, k + 1):
        for below in range(m + 1):
            b, a = v[:, k - below], v[:, k + m - below]
            r = np.maximum(own - b, a - own)
            better = (most == m) & ((r < far) | ((r == far) & ((b < low) | ((b == low) & (a < high)))))
            far, low, high = np.where(better, r, far), np.where(better, b, low), np.where(better, a, high)
    # the neighbour that sets the reach is the end itself, so that rounding can't let it in
    return np.where(own - low == far, low, own - far), np.where(high - own == far, high, own + far)


def _settled(t: pa.Table, k: int) -> pa.Table:
    """A row for each feature of a piece (feature, _y, x, _piece, _of): sums over the values whose reach stays inside, all values in order,
    the reaches that leave it, and the ends of its classes, of which ``asks`` still need their neighbours."""

    def listed(columns: dict[str, pa.Array]) -> pa.Array:
        made = pa.StructArray.from_arrays(list(columns.values()), list(columns))
        return pa.ListArray.from_arrays(pa.array([0, len(made)], pa.int32()), made)

    out = []
    feature = t["feature"].combine_chunks().dictionary_encode()
    for f, name in enumerate(feature.dictionary.to_pylist()):
        own = t.filter(pa.array(feature.indices.to_numpy() == f))
        x, size, y = own["x"].to_numpy(), own["_of"].to_numpy(), own["_y"].combine_chunks()
        code = y.dictionary_encode().indices.fill_null(-1).to_numpy()
        line, order = np.sort(x), np.lexsort((x, code))
        low, high, inner = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x), bool)
        shown, asks = [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        for part in np.split(order, np.flatnonzero(np.diff(code[order])) + 1):
            if code[part[0]] < 0:
                continue  # without a class: counted, but not judged
            mid, at = part[k : max(k, len(part) - k)], np.arange(len(part))
            if len(mid):
                low[mid], high[mid] = _reach(sliding_window_view(x[part], 2 * k + 1), np.full(len(mid), k))
                inner[mid] = True
            near = (at < 2 * k) | (at >= len(part) - 2 * k)
            shown.append(part[near])
            asks.append(~inner[part[near]])
        here = inner & (low >= line[0]) & (high <= line[-1])
        inside = np.maximum(np.searchsorted(line, high[here], "left") - np.searchsorted(line, low[here], "right"), 1)
        away, edge = np.flatnonzero(inner & ~here), np.concatenate(shown)
        out.append(pa.table({
            "feature": pa.array([name]), "piece": t["_piece"].slice(0, 1).combine_chunks(), "n": pa.array([len(x)], pa.int64()), "done": pa.array([int(here.sum())], pa.int64()),
            "of_sum": pa.array([float(digammas(size[here]).sum())]), "inside_sum": pa.array([float(digammas(inside).sum())]), "line": pa.array([line.tobytes()], pa.binary()),
            "marks": listed({"k": pa.array(np.full(len(away), k)), "of": pa.array(size[away].astype(np.int64)), "lower": pa.array(low[away]), "upper": pa.array(high[away])}),
            "ends": listed({"_y": y.take(pa.array(edge)), "x": pa.array(x[edge]), "asks": pa.array(np.concatenate(asks))}),
        }))
    return pa.concat_tables(out)


def neighbour_information(rows: DataFrame, names: Sequence[str], keys: Sequence[str], label: str = "label", k: int = 3, seed: int = 42) -> DataFrame:
    """feature, mutual_info by nearest neighbours, over all rows; nulls and values that are not finite take no part.

    For every value: the distance to its k-th nearest of the same class, and how many values
    of any class lie nearer.  Values get a noise of 1e-10 of their mean size, the same for
    the same ``keys`` (which tell rows apart) on every run, so that equal values have an order.

    The values are shuffled once, into pieces between quantiles, and settled piece by piece where the reach stays inside.  The first and last
    values of a class in a piece meet their neighbours in the order of all pieces, and ends of reaches beyond a piece are looked up in the
    ordered values of the piece where they lie.  One row a feature comes to the driver.
    """
    spark = rows.sparkSession
    # cut from their plans, which would be worked out again for every branch below
    stored = lambda df: df.localCheckpoint(storageLevel=StorageLevel.MEMORY_AND_DISK)
    long = stack(rows, [*keys, label], names).where(finite(F.col("value")))
    sizes = stored(long.groupBy(F.col("feature").alias("_f"), F.col(label).alias("_c")).agg(F.count(F.lit(1)).alias("_of"), F.sum(F.abs("value")).alias("_sum")))
    mean = {r["_f"]: (r["n"], r["s"] / r["n"]) for r in sizes.groupBy("_f").agg(F.sum("_of").alias("n"), F.sum("_sum").alias("s")).collect()}
    sized = sizes.drop("_sum")
    sized = F.broadcast(sized) if sizes.count() <= 100_000 else sized
    of_class = (F.col("feature") == F.col("_f")) & (F.col("_y") == F.col("_c"))
    scale = F.coalesce(*[F.when(F.col("feature") == c, 1e-10 * max(1.0, m)) for c, (_, m) in mean.items()], F.lit(0.0))
    u = lambda salt: (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), F.col("feature"), *keys), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    every = long.select("feature", F.col(label).alias("_y"), (F.col("value") + scale * F.sqrt(-2 * F.log(u(1))) * F.cos(2 * math.pi * u(2))).alias("x"))
    at = cuts(every, "x", sum(n for n, _ in mean.values()))

    kind = dict(every.dtypes)["_y"]
    line = with_piece(every, "x", at).join(sized, of_class, "left").select("feature", "_y", "x", "_piece", "_of").repartition(len(at) // 4 + 1, "_piece")
    pieces = stored(line.groupBy("_piece").applyInArrow(lambda t: _settled(t, k), f"feature string, piece int, n long, done long, of_sum double, inside_sum double, line binary, marks array<struct<k: long, of: long, lower: double, upper: double>>, ends array<struct<_y: {kind}, x: double, asks: boolean>>"))

    # the first and last of a class in a piece, in the order of all pieces
    w = Window.partitionBy("feature", "_y").orderBy("x", "piece")
    around = F.array(*[F.lag("x", j).over(w) for j in range(k, 0, -1)], F.col("x"), *[F.lead("x", j).over(w) for j in range(1, k + 1)])
    ends = pieces.select("feature", "piece", F.inline("ends")).withColumn("v", around).where("asks").join(sized, of_class).where("_of > 1")

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            low, high = _reach(b.column(3).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, 2 * k + 1), b.column(1).to_numpy())
            yield pa.record_batch([*b.columns[:3], pa.array(low), pa.array(high)], ["feature", "k", "of", "lower", "upper"])

    ends = ends.select("feature", F.least(F.lit(k), F.col("_of") - 1).cast("long").alias("k"), F.col("_of").alias("of"), "v").mapInArrow(reached, "feature string, k long, of long, lower double, upper double")
    left = stored(pieces.select("feature", F.inline("marks")).unionByName(ends).withColumn("_id", F.monotonically_increasing_id()))

    # values below the upper end less those up to the lower one: all of the pieces before, and some of the piece where the end lies
    side = lambda c, sign: left.select("_id", "feature", "k", "of", F.col(c).alias("p"), F.lit(sign).alias("sign"))
    marks = with_piece(side("upper", 1).unionByName(side("lower", -1)), "p", at).withColumnRenamed("_piece", "piece")
    counts = pieces.select("feature", "piece", "n", F.lit(0).cast("long").alias("m")).unionByName(marks.groupBy("feature", "piece").agg(F.lit(0).cast("long").alias("n"), F.count(F.lit(1)).alias("m")))
    before = Window.partitionBy("feature").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    # where very many ends lie in one piece it is copied, and they are dealt to the copies
    counts = counts.groupBy("feature", "piece").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).where("m > 0")
    counts = stored(counts.select("feature", "piece", "start", F.ceil(F.col("m") / ordering.PIECE_ROWS).alias("copies")))
    lines = counts.join(pieces.select("feature", "piece", "line"), ["feature", "piece"], "left").select(F.col("feature").alias("_f"), F.col("piece").alias("_p"), "start", "line", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("_copy"))
    marks = marks.join(counts.drop("start"), ["feature", "piece"]).withColumn("copy", F.pmod("_id", "copies"))

    def looked_up(a: pa.Table, b: pa.Table) -> pa.Table:
        x, p, sign = np.frombuffer(a["line"][0].as_py() or b"", np.float64), b["p"].to_numpy(), b["sign"].to_numpy()
        below = np.where(sign > 0, np.searchsorted(x, p, "left"), np.searchsorted(x, p, "right")) + a["start"][0].as_py()
        return b.select(["_id", "feature", "k", "of"]).append_column("c", pa.array(sign * below, pa.int64()))

    found = lines.groupBy("_f", "_p", "_copy").cogroup(marks.groupBy("feature", "piece", "copy")).applyInArrow(looked_up, "_id long, feature string, k long, of long, c long")
    each = found.groupBy("_id").agg(F.first("feature").alias("feature"), F.first("k").cast("double").alias("k"), F.first("of").cast("double").alias("of"), F.greatest(F.sum("c"), F.lit(1)).cast("double").alias("inside"))
    parts = each.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), *[F.sum(_digamma(F.col(c))).alias(c) for c in ("k", "of", "inside")])
    parts = parts.unionByName(pieces.select("feature", F.col("done").alias("n"), (F.col("done") * float(digammas(np.array(k)))).alias("k"), F.col("of_sum").alias("of"), F.col("inside_sum").alias("inside")))
    total = parts.groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("n", "k", "of", "inside")]).where("n > 0")
    mi = _digamma(F.col("n").cast("double")) + (F.col("k") - F.col("of") - F.col("inside")) / F.col("n")
    found = {r[0]: r[1] for r in total.select("feature", F.greatest(mi, F.lit(0.0))).collect()} if mean else {}
    return spark.createDataFrame([(c, found.get(c, 0.0)) for c in names], "feature string, mutual_info double")


def leakage(rows: DataFrame, names: Sequence[str], label: str = "label", information: DataFrame | None = None) -> DataFrame:
    """feature, correlation, mutual_info, p_value: point-biserial correlation with the label, strongest first.

    A constant feature or label has no correlation.  The p-value comes from Student's
    t, computed on the driver for one row a feature.
    """
    long = stack(rows, [label], names)
    mean = long.groupBy("feature").agg(F.avg("value").alias("mx"), F.avg(label).alias("my"))
    dx, dy = F.col("value") - F.col("mx"), F.col(label) - F.col("my")
    sums = long.join(mean, "feature").groupBy("feature").agg(F.sum(dx * dx).alias("xx"), F.sum(dy * dy).alias("yy"), F.sum(dx * dy).alias("xy"), F.count(F.lit(1)).alias("n"))
    r = sums.select("feature", "n", safe_ratio(F.col("xy"), F.sqrt(F.col("xx") * F.col("yy")), float("nan")).alias("correlation")).withColumn("correlation", F.when(~F.isnan("correlation"), F.col("correlation")))
    info = information if information is not None else binned_information(rows, names, label)
    found = r.join(info, "feature", "left").collect()
    out = [(x["feature"], x["correlation"], x["mutual_info"], None if x["correlation"] is None else correlation_p(x["correlation"], x["n"])) for x in found]
    return rows.sparkSession.createDataFrame(out, "feature string, correlation double, mutual_info double, p_value double").orderBy(F.abs("correlation").desc_nulls_last(), "feature")


def leaky(found: DataFrame, threshold: float = 0.9, information: float | None = None) -> DataFrame:
    """Features whose correlation or information is above the threshold, both being finite."""
    r, mi = F.col("correlation"), F.col("mutual_info")
    return found.where(finite(r) & finite(mi) & ((F.abs(r) > threshold) | (mi > (threshold if information is None else information))))


def stability(rows: DataFrame, names: Sequence[str], order: str, size: int = 1_000) -> DataFrame:
    """feature, score: how much mean and deviation move over tumbling windows of ``size`` rows.

    The last window is left out if it is not followed by another row; with no
    window the score is null.
    """
    n = rows.count()
    numbered = numbered_rows(rows, order)
    kept = stack(numbered.withColumn("_w", F.floor(F.col("_n") / size)).where(F.col("_w") < (n - 1) // size if n else F.lit(False)), ["_w"], names)
    each = kept.groupBy("feature", "_w").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    over = each.groupBy("feature").agg(F.avg("m").alias("mm"), F.stddev_pop("m").alias("sm"), F.avg("s").alias("ms"), F.stddev_pop("s").alias("ss"))
    part = lambda s, m: F.when(near_zero(F.col(m)), 0.0).otherwise(F.col(s) / F.when(near_zero(F.col(m)), 1.0).otherwise(F.col(m)))
    scores = over.select("feature", F.greatest(part("sm", "mm"), part("ss", "ms")).alias("score"))
    every = rows.sparkSession.createDataFrame([(x,) for x in names], "feature string")
    return every.join(scores, "feature", "left")


def numbered_rows(rows: DataFrame, order: str) -> DataFrame:
    """``_n`` from 0 in the order of a column; no task sees all rows."""
    return numbered(rows, [], [order])


def summary(scores: DataFrame, column: str = "score") -> DataFrame:
    """mean, sd, lo, hi of the finite scores."""
    return scores.where(finite(F.col(column))).agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("sd"), F.min(column).alias("lo"), F.max(column).alias("hi"))


def importance(stable: DataFrame, leaks: DataFrame, corr: DataFrame) -> DataFrame:
    """feature, importance = 1 / (1 + stability) + |leakage correlation| + largest |correlation| with a neighbour."""
    near = corr.where(finite(F.col("corr")) & (F.abs("corr") > 0.5)).groupBy(F.col("feature_a").alias("feature")).agg(F.max(F.abs("corr")).alias("near"))
    rows = stable.join(leaks.select("feature", "correlation"), "feature", "left").join(near, "feature", "left")
    steady = F.when(F.col("score").isNotNull() & ~F.isnan("score"), 1 / (1 + F.col("score"))).otherwise(0.0)
    return rows.select("feature", (steady + F.coalesce(F.abs("correlation"), F.lit(0.0)) + F.coalesce("near", F.lit(0.0))).alias("importance"))


def select(rows: DataFrame, names: Sequence[str], order: str, label: str = "label", redundancy: float = 0.95, leak: float = 0.9, method: str = "spearman", window: int = 1_000) -> dict:
    """Drop leaky features, then of every redundant pair the less stable one.

    Ties, and scores that are missing, drop the second.  Returns the selected names with their
    importance, the least important first, what was removed and why, and the tables behind it.
    """
    leaks = leakage(rows, names, label)
    out_leaky = [r["feature"] for r in leaky(leaks, leak).collect()]
    left = [c for c in names if c not in set(out_leaky)]
    scores = {r["feature"]: r["score"] for r in stability(rows, left, order, window).collect()}
    corr = correlations(rows, left, method)
    gone: list[str] = []
    at = {c: k for k, c in enumerate(left)}
    pairs = sorted(((at[r["feature_a"]], at[r["feature_b"]]) for r in corr.where(finite(F.col("corr")) & (F.abs("corr") > redundancy)).collect() if at[r["feature_a"]] < at[r["feature_b"]]))
    for i, j in pairs:
        a, b = left[i], left[j]
        if a in gone or b in gone:
            continue
        sa, sb = scores.get(a), scores.get(b)
        gone.append(a if sa is not None and sb is not None and sa > sb else b)
    kept = [c for c in left if c not in set(gone)]
    stable = rows.sparkSession.createDataFrame(list(scores.items()), "feature string, score double") if scores else None
    ranks = importance(stable.where(F.col("feature").isin(kept)), leaks, corr).orderBy("importance", "feature").collect() if kept else []
    return {
        "selected": kept, "n_original": len(names), "n_selected": len(kept), "removed": {"leakage": out_leaky, "redundant": gone, "low_stability": []}, "redundant_pairs": [(left[i], left[j]) for i, j in pairs],
        "importance": {r["feature"]: r["importance"] for r in ranks}, "leakage": leaks, "stability": scores, "correlations": corr,
    }
