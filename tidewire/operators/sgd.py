"""Linear models by stochastic gradient steps, many candidates in one pass over the rows.

The rows are dealt to partitions by a hash, so every partition looks like the whole.  In an epoch each partition
takes shuffled mini-batches and steps from the common weights; a weighted average of the partitions' weights
begins the next epoch.  A task takes several partitions side by side: their steps are the same as one after another, but a step of
NumPy serves all of them.  All candidates (settings, and folds that they leave out) share the pass: their weights
are one matrix, so an epoch is one job whatever their number.  Penalties are proximal steps, which give exact zeros
under l1 and elastic net for every loss.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ClassifierError
from ..functions.stats import log_grid, random_grid

LOSSES = ("modified_huber", "log_loss", "hinge")
PENALTIES = ("l2", "l1", "elasticnet")
SCHEDULES = ("constant", "invscaling", "adaptive")

#: Rows of a partition: results depend on it, and not on the cluster.
PARTITION_ROWS = 65_536

#: Rows that are shuffled together; results depend on it.
BLOCK_ROWS = 10_000

#: Partitions that a task takes side by side at most, and partitions times candidates; results do not depend on it.
LANES = 32


@dataclass(frozen=True)
class Settings:
    """One candidate.  ``average`` returns the mean of the iterates since the last power of two of epochs."""

    loss: str = "modified_huber"
    penalty: str = "l2"
    alpha: float = 1e-4
    l1_ratio: float = 0.15
    schedule: str = "constant"
    eta0: float = 0.1
    power: float = 0.5
    average: bool = False
    #: Rows of this fold are left out of the fit; they judge it.
    fold: int | None = None

    def __post_init__(self) -> None:
        for value, known in ((self.loss, LOSSES), (self.penalty, PENALTIES), (self.schedule, SCHEDULES)):
            if value not in known:
                raise ClassifierError(f"{value!r} is none of {known}")

    @property
    def mix(self) -> float:
        """Share of the penalty that is l1."""
        return {"l2": 0.0, "l1": 1.0, "elasticnet": self.l1_ratio}[self.penalty]


@dataclass
class Fit:
    """Weights (the intercept last), epochs and mean loss of every candidate."""

    weights: np.ndarray
    epochs: np.ndarray
    losses: np.ndarray


def losses(z: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Loss and its slope at the margins ``z`` = y * score, a column for each candidate; ``kinds``: numbers in ``LOSSES``.

    Modified Huber: max(0, 1 - z)^2 from z = -1 on, -4 z below; logistic: log(1 + exp(-z)); hinge: max(0, 1 - z).
    """
    return _each(_VALUES, z, kinds), _each(_SLOPES, z, kinds)


#: In the order of ``LOSSES``.
_VALUES = (lambda z: np.where(z < -1, -4 * z, np.maximum(0.0, 1.0 - z) ** 2), lambda z: np.logaddexp(0, -z), lambda z: np.maximum(0.0, 1.0 - z))
_SLOPES = (lambda z: np.where(z < -1, -4.0, -2 * np.maximum(0.0, 1.0 - z)), lambda z: -0.5 * (1 - np.tanh(z / 2)), lambda z: -(z < 1).astype(float))


def _each(functions: tuple, z: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """The function of its kind for every candidate, in the last axis of ``z``; one that no candidate has is not worked out."""
    found = sorted(set(kinds.tolist()))
    if len(found) == 1:
        return functions[found[0]](z)
    out = np.empty_like(z)
    for k in found:
        out[..., kinds == k] = functions[k](z[..., kinds == k])
    return out


def shrink(w: np.ndarray, eta: np.ndarray, alpha: np.ndarray, mix: np.ndarray) -> np.ndarray:
    """The proximal step of the penalty, on all but the intercept; candidates and features are the last two axes of ``w``."""
    step, body = (eta * alpha)[:, None], w[..., :-1]
    if mix.any():
        body = np.sign(body) * np.maximum(0.0, np.abs(body) - step * mix[:, None])
    return np.concatenate([body / (1 + step * (1 - mix[:, None])), w[..., -1:]], -1)


def penalised(w: np.ndarray, s: Settings) -> float:
    """The penalty of weights."""
    return s.alpha * ((1 - s.mix) / 2 * float((w[:-1] ** 2).sum()) + s.mix * float(np.abs(w[:-1]).sum()))


def dealt(rows: DataFrame, names: Sequence[str], label: str = "label", fold: str | None = None, seed: int = 42) -> DataFrame:
    """x (the features and 1), y (-1 or 1) and fold of every row, in an order that a hash gives (persisted).

    A null or non-finite feature is an error of the caller's: such rows are left out.
    """
    x = F.array(*[F.col(c).cast("double") for c in names], F.lit(1.0))
    own = rows.select(x.alias("x"), F.when(F.col(label) > 0, 1.0).otherwise(-1.0).alias("y"), (F.col(fold).cast("int") if fold else F.lit(-1)).alias("fold"))
    own = own.where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))).withColumn("_h", F.xxhash64(F.lit(seed), "x", "y", "fold"))
    n = own.count()
    parts = max(1, -(-n // PARTITION_ROWS))
    # equal rows would share a partition: they are dealt by their place among the rows of their task as well
    own = own.withColumn("_deal", F.pmod(F.xxhash64("_h", F.monotonically_increasing_id() if n > PARTITION_ROWS else F.lit(0)), F.lit(parts)))
    return own.repartitionById(parts, F.col("_deal").cast("int")).sortWithinPartitions("_h").select("x", "y", "fold").persist(StorageLevel.MEMORY_AND_DISK)


def balance(rows: DataFrame, candidates: Sequence[Settings]) -> np.ndarray:
    """Weights of the two classes for every candidate, n / (2 n of the class) over the rows it fits; a row a fold and class comes to the driver."""
    counts = {(r["fold"], r["y"]): r["count"] for r in rows.groupBy("fold", "y").count().collect()}
    out = np.zeros((len(candidates), 2))
    for k, s in enumerate(candidates):
        n = [sum(v for (f, y), v in counts.items() if (y > 0) == bool(c) and f != s.fold) for c in (0, 1)]
        if not all(n):
            raise ClassifierError("two classes are needed")
        out[k] = [sum(n) / (2 * v) for v in n]
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            yield batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1), batch.column(1).to_numpy(), batch.column(2).to_numpy()


def _packed(rows: DataFrame, width: int, lanes: int) -> DataFrame:
    """lane (the partition), block, and x, y and fold of ``BLOCK_ROWS`` rows as bytes, so that an epoch turns no single rows; ``lanes`` partitions share a task, block by block."""
    size = max(1, min(BLOCK_ROWS, (16 << 20) // (8 * width)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, number, lane = [], 0, 0, None

        def block(parts: list, number: int) -> pa.RecordBatch:
            x, y, fold = (np.concatenate(c) for c in zip(*parts, strict=True))
            return pa.record_batch([pa.array([lane], pa.int32()), pa.array([number], pa.int32()), *(pa.array([np.ascontiguousarray(c, t).tobytes()], pa.binary()) for c, t in ((x, np.float64), (y, np.int8), (fold, np.int32)))], ["lane", "block", "x", "y", "fold"])

        for batch in batches:
            if batch.num_rows:
                lane = batch.column(3)[0].as_py()
            for x, y, fold in _blocks(iter([batch])):
                while len(x):
                    take = size - n
                    held.append((x[:take], y[:take], fold[:take]))
                    n += len(held[-1][0])
                    x, y, fold = x[take:], y[take:], fold[take:]
                    if n == size:
                        yield block(held, number)
                        held, n, number = [], 0, number + 1
        if held:
            yield block(held, number)

    parts = rows.rdd.getNumPartitions()
    out = rows.select("x", "y", "fold", F.spark_partition_id().alias("lane")).mapInArrow(pack, "lane int, block int, x binary, y binary, fold binary")
    return out.coalesce(max(1, -(-parts // lanes))).sortWithinPartitions("block", "lane").persist(StorageLevel.MEMORY_AND_DISK)


def _rounds(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
    """Blocks of one number of all lanes of a task: lane, x, y and fold, the longest first."""
    held, last = [], None
    for batch in batches:
        lane, number = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for k in range(batch.num_rows):
            if held and number[k] != last:
                yield sorted(held, key=lambda b: -len(b[2]))
                held = []
            x, y, fold = (np.frombuffer(batch.column(c)[k].as_buffer(), t) for c, t in ((2, np.float64), (3, np.int8), (4, np.int32)))
            held.append((lane[k], x.reshape(len(y), -1), y, fold))
            last = number[k]
    if held:
        yield sorted(held, key=lambda b: -len(b[2]))


def _epoch(blocks: DataFrame, number: int, start: np.ndarray, candidates: list[Settings], eta: np.ndarray, weights: np.ndarray, batch_rows: int, seed: int) -> dict[int, dict]:
    """One epoch of the candidates over ``_packed`` rows: end and mean of the weights, summed loss and weight of each."""
    kinds = np.array([LOSSES.index(s.loss) for s in candidates])
    alpha, mix, out = (np.array(x) for x in ([s.alpha for s in candidates], [s.mix for s in candidates], [-2 if s.fold is None else s.fold for s in candidates]))
    count, width = start.shape

    def walk(group: list, state: dict) -> None:
        """The steps of one block of every lane; a lane that has no rows left keeps its weights."""
        steps = np.array([-(-len(y) // batch_rows) for _, _, y, _ in group])
        shape = (len(group), steps[0] * batch_rows)
        x, y = np.zeros((*shape, width)), np.zeros(shape)
        share, size = np.zeros((*shape, count)), np.ones((len(group), steps[0], count))
        for k, (lane, a, b, fold) in enumerate(group):
            order = state[lane]["rng"].permutation(len(b))
            part = fold[order][:, None] != out
            x[k, : len(b)], y[k, : len(b)] = a[order], b[order]
            share[k, : len(b)] = weights.T[(b[order] > 0).astype(int)] * part
            size[k, : steps[k]] = np.maximum(np.add.reduceat(part, np.arange(0, len(b), batch_rows), 0, dtype=np.int64), 1)
        # steps first, so that one step of all lanes lies together
        x, y, share = (np.ascontiguousarray(v.reshape(len(group), steps[0], batch_rows, -1).swapaxes(0, 1)) for v in (x, y, share))
        size, pull, margin = size.swapaxes(0, 1)[..., None], share * y, np.zeros(share.shape)
        w, mean = (np.stack([state[lane][c] for lane, *_ in group]) for c in ("w", "mean"))
        for t in range(steps[0]):
            on = int((steps > t).sum())
            at, z = x[t, :on], margin[t, :on]
            np.multiply(at @ w[:on].swapaxes(1, 2), y[t, :on], out=z)
            gradient = (pull[t, :on] * _each(_SLOPES, z, kinds)).swapaxes(1, 2) @ at / size[t, :on]
            w[:on] = shrink(w[:on] - eta[:, None] * gradient, eta, alpha, mix)
            mean[:on] += w[:on]
        loss, total = (share * _each(_VALUES, margin, kinds)).sum((0, 2)), share.sum((0, 2))
        for k, (lane, *_) in enumerate(group):
            own = state[lane]
            own.update(w=w[k], mean=mean[k], steps=own["steps"] + steps[k], loss=own["loss"] + loss[k], total=own["total"] + total[k])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[int, dict] = {}
        for group in _rounds(batches):
            for lane, *_ in group:
                if lane not in state:
                    state[lane] = {"rng": np.random.default_rng([seed, number, lane]), "w": start, "mean": np.zeros_like(start), "steps": 0, "loss": 0.0, "total": 0.0}
            walk(group, state)
        for own in state.values():
            both = np.hstack([own["w"], own["mean"] / own["steps"]])
            yield pa.record_batch([pa.array(np.arange(count), pa.int32()), pa.FixedSizeListArray.from_arrays(pa.array(both.ravel()), both.shape[1]).cast(pa.list_(pa.float64())), pa.array(own["loss"]), pa.array(own["total"])], ["k", "w", "loss", "n"])

    found = blocks.mapInArrow(run, "k int, w array<double>, loss double, n double").where("n > 0")
    mean = Summarizer.mean(array_to_vector("w"), F.col("n"))
    return {r["k"]: r for r in found.groupBy("k").agg(vector_to_array(mean).alias("w"), F.sum("loss").alias("loss"), F.sum("n").alias("n")).collect()}


def _zeroed(rows: DataFrame, candidates: list[Settings], w: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """``w`` with those coefficients at 0 that the l1 penalty holds there.

    Steps of mini-batches and means over partitions leave such coefficients a little off 0.  One pass gives the full gradient and
    the curvature along each feature; a coefficient goes to 0 if the best value along its feature is 0.
    """
    kinds = np.array([LOSSES.index(s.loss) for s in candidates])
    out = np.array([-2 if s.fold is None else s.fold for s in candidates])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gradient, curve, total = np.zeros_like(w), np.zeros_like(w), np.zeros(len(w))
        for x, y, fold in _blocks(batches):
            for lo in range(0, len(x), 4096):
                a, b = x[lo : lo + 4096], y[lo : lo + 4096][:, None]
                share = weights[:, (b[:, 0] > 0).astype(int)].T * (fold[lo : lo + 4096][:, None] != out)
                z = (a @ w.T) * b
                _, slope = losses(z, kinds)
                bend = np.choose(kinds, [2.0 * ((z < 1) & (z >= -1)), 0.25 / np.cosh(z / 2) ** 2, 1.0 * (np.abs(z - 1) < 0.5)])  # for hinge, the change of the slope near its kink
                gradient += (share * slope * b).T @ a
                curve += (share * bend).T @ (a * a)
                total += share.sum(0)
        both = np.hstack([gradient, curve, total[:, None]])
        yield pa.record_batch([pa.array(np.arange(len(w)), pa.int32()), pa.FixedSizeListArray.from_arrays(pa.array(both.ravel()), both.shape[1]).cast(pa.list_(pa.float64()))], ["k", "v"])

    sums = rows.mapInArrow(run, "k int, v array<double>").groupBy("k").agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v"))
    found = np.array([r["v"] for r in sums.orderBy("k").collect()])
    gradient, curve = (found[:, k * w.shape[1] : (k + 1) * w.shape[1]] / found[:, -1:] for k in range(2))
    held = np.abs(gradient - curve * w) <= np.array([s.alpha * s.mix for s in candidates])[:, None]
    held[:, -1] = False
    return np.where(held, 0.0, w)


def fit_many(rows: DataFrame, candidates: Sequence[Settings], epochs: int = 100, tol: float = 1e-3, patience: int = 5, batch_rows: int = 32, seed: int = 42) -> Fit:
    """Fits all candidates on ``rows`` (from ``dealt``), one job an epoch.

    A candidate stops once ``patience`` epochs in a row have not brought its mean loss ``tol`` below its best;
    the schedule ``adaptive`` divides its step by 5 instead until that is below 1e-6.
    What comes to the driver grows with candidates and features only.
    """
    width = len(rows.first()["x"])
    every, share = list(candidates), balance(rows, candidates)
    w, ends = np.zeros((len(every), width)), np.zeros((len(every), width))
    eta = np.array([s.eta0 for s in every])
    best, bad = np.full(len(every), np.inf), np.zeros(len(every), int)
    last, ran, averaged = np.full(len(every), np.inf), np.zeros(len(every), int), np.zeros(len(every), int)
    active = list(range(len(every)))
    spread = -(-rows.rdd.getNumPartitions() // rows.sparkSession.sparkContext.defaultParallelism)
    blocks = _packed(rows, width, max(1, min(LANES, 2 * LANES // len(every), spread, (64 << 20) // (8 * width * BLOCK_ROWS))))
    for number in range(1, epochs + 1):
        step = np.array([eta[k] / number ** every[k].power if every[k].schedule == "invscaling" else eta[k] for k in active])
        got = _epoch(blocks, number, w[active], [every[k] for k in active], step, share[active], batch_rows, seed)
        going = []
        for at, k in enumerate(active):
            if at not in got:
                blocks.unpersist()
                raise ClassifierError("a candidate has no rows")
            both = np.array(got[at]["w"])
            w[k], mean = both[:width], both[width:]
            if number & (number - 1) == 0:
                averaged[k] = 0
            ends[k] = (ends[k] * averaged[k] + mean) / (averaged[k] + 1)
            averaged[k] += 1
            last[k], ran[k] = got[at]["loss"] / got[at]["n"], number
            bad[k] = bad[k] + 1 if last[k] > best[k] - tol else 0
            best[k] = min(best[k], last[k])
            if bad[k] >= patience and every[k].schedule == "adaptive" and eta[k] > 1e-6:
                eta[k], bad[k] = eta[k] / 5, 0
            if bad[k] < patience:
                going.append(k)
        active = going
        if not active:
            break
    blocks.unpersist()
    final = np.where(np.array([s.average for s in every])[:, None], ends, w)
    thin = [k for k, s in enumerate(every) if s.mix]
    if thin:
        final[thin] = _zeroed(rows, [every[k] for k in thin], final[thin], share[thin])
    return Fit(final, ran, last)


def accuracies(rows: DataFrame, candidates: Sequence[Settings], weights: np.ndarray) -> list[float]:
    """Share of rows right of every candidate, over the fold it left out (over all rows without one); one job."""
    out = np.array([-2 if s.fold is None else s.fold for s in candidates])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right, n = np.zeros(len(out), np.int64), np.zeros(len(out), np.int64)
        for x, y, fold in _blocks(batches):
            for lo in range(0, len(x), 4096):
                part = (fold[lo : lo + 4096][:, None] == out) | (out == -2)
                right += (part & ((x[lo : lo + 4096] @ weights.T > 0) == (y[lo : lo + 4096] > 0)[:, None])).sum(0)
                n += part.sum(0)
        yield pa.record_batch([pa.array(np.arange(len(out)), pa.int32()), pa.array(right), pa.array(n)], ["k", "right", "n"])

    found = {r["k"]: r for r in rows.mapInArrow(run, "k int, right long, n long").groupBy("k").agg(F.sum("right").alias("right"), F.sum("n").alias("n")).collect()}
    return [found[k]["right"] / found[k]["n"] if k in found and found[k]["n"] else float("nan") for k in range(len(out))]


#: What a search draws from.
AXES = {"loss": ["modified_huber", "log_loss"], "penalty": list(PENALTIES), "alpha": log_grid(1e-5, 1e-1, 20), "eta0": log_grid(0.01, 1.0, 20)}


def search(rows: DataFrame, folds: Sequence[int], trials: int = 25, axes: dict[str, list] | None = None, base: Settings = Settings(), seed: int = 42, **fitting) -> list[dict]:
    """The drawn settings with their accuracy over left-out folds (its mean, and that of each fold), the best first.

    ``rows`` come from ``dealt`` with folds.  All trials on all folds are fitted together.
    """
    points = random_grid(axes or AXES, trials, seed)
    candidates = [replace(base, **p, fold=f) for p in points for f in folds]
    fit = fit_many(rows, candidates, seed=seed, **fitting)
    scores = np.array(accuracies(rows, candidates, fit.weights)).reshape(len(points), len(folds))
    table = [{**p, "accuracy": float(np.nanmean(x)), "folds": x.tolist(), "epochs": e.tolist()} for p, x, e in zip(points, scores, fit.epochs.reshape(len(points), len(folds)), strict=True)]
    return sorted(table, key=lambda r: -r["accuracy"])


def as_dict(s: Settings) -> dict:
    return {k: v for k, v in asdict(s).items() if k != "fold"}
