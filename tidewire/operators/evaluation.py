"""Evaluation: confusion, rates, curves, bootstrap and group cross-validation.

Predictions are rows of y (0 or 1), pred and prob.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import EvaluationError
from ..functions.columns import safe_ratio
from ..functions.ordering import cuts, running, with_piece
from ..functions.stats import interval
from .dataset import group_folds, leaking, split_groups

METRICS = ["accuracy", "precision", "recall", "f1"]


def confusion(rows: DataFrame) -> DataFrame:
    """y, pred, n and the share of n among rows of that y."""
    counts = rows.groupBy("y", "pred").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("y")))


def rates(rows: DataFrame, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """accuracy, precision, recall and F1, each 0 where its denominator is; by group if asked."""
    w = F.col(weight) if weight else F.lit(1)
    cell = lambda y, p: F.sum(F.when((F.col("y") == y) & (F.col("pred") == p), w).otherwise(0))
    t = rows.groupBy(*by).agg(cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(0, 0).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return t.select(*by, safe_ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), safe_ratio(tp, tp + fp).alias("precision"), safe_ratio(tp, tp + fn).alias("recall"), safe_ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def _by_score(rows: DataFrame) -> DataFrame:
    """One row a distinct score: positives, all, and both summed over scores at least as high."""
    each = rows.groupBy("prob").agg(F.sum("y").cast("long").alias("p"), F.count(F.lit(1)).alias("n"))
    total = each.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("pos"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    return running(each, "prob", {"tp": F.col("p"), "taken": F.col("n")}, descending=True).crossJoin(F.broadcast(total.limit(1)))


def roc(rows: DataFrame) -> DataFrame:
    """threshold, fpr, tpr for every distinct score, from (0, 0) on."""
    t = _by_score(rows)
    points = t.select(F.col("prob").alias("threshold"), safe_ratio(F.col("taken") - F.col("tp"), F.col("total") - F.col("pos")).alias("fpr"), safe_ratio(F.col("tp"), F.col("pos")).alias("tpr"))
    start = rows.sparkSession.createDataFrame([(float("inf"), 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return start.unionByName(points)


def roc_auc(rows: DataFrame) -> DataFrame:
    """Area under the ROC curve: the chance that a positive scores above a negative, ties counting half."""
    t = _by_score(rows)
    above = F.col("tp") - F.col("p")
    wins = F.sum((F.col("n") - F.col("p")) * (above + F.col("p") / 2.0))
    return t.agg(safe_ratio(wins, F.max("pos") * (F.max("total") - F.max("pos")), float("nan")).alias("roc_auc"))


def precision_recall(rows: DataFrame) -> DataFrame:
    t = _by_score(rows)
    return t.select(F.col("prob").alias("threshold"), safe_ratio(F.col("tp"), F.col("taken")).alias("precision"), safe_ratio(F.col("tp"), F.col("pos")).alias("recall"))


def average_precision(rows: DataFrame) -> DataFrame:
    """Sum over thresholds of precision times the gain in recall: steps, not trapezoids."""
    t = _by_score(rows)
    return t.agg(F.sum(F.when(F.col("pos") > 0, F.col("p") / F.col("pos") * (F.col("tp") / F.col("taken"))).otherwise(0.0)).alias("average_precision"))


def on_grid(curve: DataFrame, x: str, y: str, points: int = 100) -> DataFrame:
    """The curve at ``points`` even places of [0, 1], linear in between; of equal x the largest y counts.

    Of all points between two places only the first and the last matter, so at most two for each
    place are put in order.
    """
    spark = curve.sparkSession
    grid = spark.range(points).select((F.col("id") / (points - 1)).alias("gx"))
    known = curve.groupBy(F.col(x).alias("x")).agg(F.max(y).alias("y"))
    ends = known.groupBy(F.floor(F.col("x") * (points - 1)).alias("cell")).agg(F.min(F.struct("x", "y")).alias("a"), F.max(F.struct("x", "y")).alias("b"))
    known = ends.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("e")).select("e.*")
    both = known.select("x", "y", F.lit(0).alias("g")).unionByName(grid.select(F.col("gx").alias("x"), F.lit(None).cast("double").alias("y"), F.lit(1).alias("g")))
    # at a place that is a point itself, the point counts on both sides
    back, ahead = Window.orderBy("x", "g").rowsBetween(Window.unboundedPreceding, 0), Window.orderBy(F.col("x").desc(), "g").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.when(F.col("g") == 0, F.struct("x", "y"))
    near = both.withColumns({"a": F.last(seen, ignorenulls=True).over(back), "b": F.last(seen, ignorenulls=True).over(ahead)}).where("g = 1")
    span = F.col("b.x") - F.col("a.x")
    value = F.when(F.col("a").isNull(), F.col("b.y")).when(F.col("b").isNull() | (span == 0), F.col("a.y")).otherwise(F.col("a.y") + (F.col("x") - F.col("a.x")) / F.when(span != 0, span) * (F.col("b.y") - F.col("a.y")))
    return near.select("x", value.alias("y"))


def fold_curves(rows: DataFrame, folds: Sequence[int]) -> DataFrame:
    """fold, kind (roc or pr), x and y at 100 even places, for predictions with ``fold``.

    The precision-recall curve begins with precision 1 at recall 0.
    """
    parts = []
    for k in folds:
        own = rows.where(F.col("fold") == k)
        start = rows.sparkSession.createDataFrame([(0.0, 1.0)], "recall double, precision double")
        pr = precision_recall(own).select("recall", "precision").unionByName(start)
        for kind, curve in (("roc", on_grid(roc(own), "fpr", "tpr")), ("pr", on_grid(pr, "recall", "precision"))):
            parts.append(curve.select(F.lit(k).alias("fold"), F.lit(kind).alias("kind"), "x", "y"))
    return reduce(DataFrame.unionByName, parts)


def mean_curves(curves: DataFrame) -> DataFrame:
    """kind, x, mean of y over folds and its deviation."""
    return curves.groupBy("kind", "x").agg(F.avg("y").alias("y"), F.stddev_pop("y").alias("sd"))


def bootstrap(rows: DataFrame, draws: int = 1_000, seed: int = 42) -> DataFrame:
    """draw and the four rates of each resample.

    Every row takes part Poisson(1) times in a draw.  The rates depend on the four
    counts only, so the counts are resampled: each draw is one row for each cell.
    """
    import numpy as np

    cells = {(r["y"], r["pred"]): r["n"] for r in rows.groupBy("y", "pred").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = [cells.get(k, 0) for k in ((1, 1), (0, 1), (1, 0), (0, 0))]
    if not sum(n):
        raise EvaluationError("no predictions")
    rng = np.random.default_rng(seed)
    drawn = rng.multinomial(sum(n), np.array(n) / sum(n), draws)
    table = rows.sparkSession.createDataFrame([(k, *map(int, d)) for k, d in enumerate(drawn)], "draw int, tp long, fp long, fn long, tn long")
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return table.select("draw", safe_ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), safe_ratio(tp, tp + fp).alias("precision"), safe_ratio(tp, tp + fn).alias("recall"), safe_ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def bootstrap_all(rows: DataFrame, draws: int = 1_000, seed: int = 42) -> DataFrame:
    """draw, the four rates and ROC AUC of each resample, all from the same Poisson(1) weights.

    Rows of one score, class and prediction are drawn together, as Poisson of their number.  The scores are cut into pieces; a
    task goes down its pieces with one array a count, an entry a draw, and sums over pieces tell how many positives
    are above a piece.  No row is copied for a draw.
    """
    cell = lambda y, p: F.count_if((F.col("y") == y) & (F.col("pred") == p))
    each = rows.groupBy(F.col("prob").cast("double").alias("prob")).agg(cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(0, 0).alias("tn"))
    at = cuts(each, "prob", each.count())
    ordered = with_piece(each, "prob", at).select("_piece", "prob", "tp", "fp", "fn", "tn")
    ordered = ordered.repartition(len(at) + 1, "_piece").sortWithinPartitions("_piece", F.col("prob").desc())

    def run(batches):
        import numpy as np
        import pyarrow as pa

        here, sums, wins, step = None, None, None, 0

        def done():
            values = [*sums, wins]
            return pa.record_batch([pa.array([here], pa.int32()), *[pa.array([v], pa.list_(pa.float64())) for v in values]], ["piece", "tp", "fp", "fn", "tn", "wins"])

        for batch in batches:
            pieces, counts = batch.column(0).to_numpy(), np.stack([c.to_numpy() for c in batch.columns[2:]], 1)
            edges = [*np.flatnonzero(np.diff(pieces, prepend=-1)), len(pieces)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if pieces[lo] != here:
                    if here is not None:
                        yield done()
                    here, sums, wins, step = int(pieces[lo]), np.zeros((4, draws)), np.zeros(draws), 0
                for a in range(lo, hi, 256):
                    part = counts[a : min(a + 256, hi)]
                    drawn = np.random.default_rng([seed, here, step]).poisson(part[:, :, None], (*part.shape, draws))
                    p, n = drawn[:, 0] + drawn[:, 2], drawn[:, 1] + drawn[:, 3]
                    wins += (n * (sums[0] + sums[2] + np.cumsum(p, 0) - p / 2)).sum(0)
                    sums += drawn.sum(0)
                    step += 1
        if here is not None:
            yield done()

    arrays = ", ".join(f"{c} array<double>" for c in ("tp", "fp", "fn", "tn", "wins"))
    found = ordered.mapInArrow(run, f"piece int, {arrays}").select("piece", F.posexplode(F.arrays_zip("tp", "fp", "fn", "tn", "wins")).alias("draw", "x")).select("piece", "draw", "x.*")
    above = Window.partitionBy("draw").orderBy(F.col("piece").desc()).rowsBetween(Window.unboundedPreceding, -1)
    pos = F.col("tp") + F.col("fn")
    t = found.withColumn("above", F.coalesce(F.sum(pos).over(above), F.lit(0.0))).groupBy("draw").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")], F.sum(F.col("wins") + (F.col("fp") + F.col("tn")) * F.col("above")).alias("wins"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    rate = {"accuracy": safe_ratio(tp + tn, tp + fp + fn + tn), "precision": safe_ratio(tp, tp + fp), "recall": safe_ratio(tp, tp + fn), "f1": safe_ratio(2 * tp, 2 * tp + fp + fn)}
    return t.select("draw", *[v.alias(k) for k, v in rate.items()], safe_ratio(F.col("wins"), (tp + fn) * (fp + tn), float("nan")).alias("roc_auc"))


def bootstrap_auc(rows: DataFrame, draws: int = 1_000, seed: int = 42) -> DataFrame:
    """draw and ROC AUC of ``bootstrap_all``; ``rows`` need no ``pred``."""
    return bootstrap_all(rows if "pred" in rows.columns else rows.withColumn("pred", F.lit(0)), draws, seed).select("draw", "roc_auc")


def intervals(draws: DataFrame, names: Sequence[str] = tuple(METRICS), confidence: float = 0.95, kind: str = "t") -> DataFrame:
    """metric, mean, sd, ci_lower, ci_upper: a t-interval of the mean, or percentiles of the draws."""
    tail = (1 - confidence) / 2
    s = draws.agg(*[f(c).alias(f"{p}_{c}") for c in names for p, f in (("m", F.avg), ("s", F.stddev_samp), ("n", F.count))], *[F.percentile(c, F.array(F.lit(tail), F.lit(1 - tail))).alias(f"q_{c}") for c in names]).first()
    out = []
    for c in names:
        lo, hi = interval(s[f"m_{c}"], s[f"s_{c}"] or 0.0, s[f"n_{c}"], confidence) if kind == "t" else s[f"q_{c}"]
        out.append((c, s[f"m_{c}"], s[f"s_{c}"], float(lo), float(hi)))
    return draws.sparkSession.createDataFrame(out, "metric string, mean double, sd double, ci_lower double, ci_upper double")


def fold_averages(scores: DataFrame) -> DataFrame:
    """``scores``: fold, metric, value.  metric, mean, sd (population), lo, hi."""
    return scores.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.min("value").alias("lo"), F.max("value").alias("hi"))


def fold_intervals(scores: DataFrame, confidence: float = 0.95, by: str = "metric") -> DataFrame:
    """``by``, mean, sd (population), a t-interval of the mean, lo and hi of ``value``; one row for each name comes to the driver."""
    s = scores.groupBy(by).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.stddev_samp("value").alias("s"), F.count("value").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    out = [(r[by], r["mean"], r["sd"], *map(float, interval(r["mean"], r["s"] or 0.0, r["n"], confidence)), r["lo"], r["hi"]) for r in s.collect()]
    return scores.sparkSession.createDataFrame(out, f"{by} string, mean double, sd double, ci_lower double, ci_upper double, lo double, hi double")


def evaluate(rows: DataFrame, draws: int = 1_000, confidence: float = 0.95) -> dict:
    """All figures of one set of predictions, ROC AUC among the bootstrap metrics; tables are small."""
    out = {k: v for k, v in rates(rows).first().asDict().items()}
    out |= roc_auc(rows).first().asDict() | average_precision(rows).first().asDict()
    out["confusion"] = [r.asDict() for r in confusion(rows).orderBy("y", "pred").collect()]
    if not rows.limit(1).count():
        raise EvaluationError("no predictions")
    out["intervals"] = [r.asDict() for r in intervals(bootstrap_all(rows, draws), [*METRICS, "roc_auc"], confidence).collect()]
    out["curves"] = [r.asDict() for r in fold_curves(rows.withColumn("fold", F.lit(0)), [0]).orderBy("kind", "x").collect()]
    return out


def cross_validated(rows: DataFrame, group: str, trainer: Callable[[DataFrame], object], folds: int = 5, seed: int = 42) -> dict[str, DataFrame]:
    """Scores (fold, metric, value), curves (fold, kind, x, y) and importance (fold, feature, value) of every fold.

    ``trainer(rows)`` returns something with ``predict(rows)`` giving pred and prob, and
    maybe ``coefficients()``.  Groups never cross folds, which is checked.
    """
    if folds < 2:
        raise EvaluationError("at least two folds")
    plan = group_folds(rows, group, "label", folds, seed)
    rows = rows.join(plan, group).persist()
    scores, curves, weights = [], [], []
    try:
        if leaking(rows, group, "fold").limit(1).count():
            raise EvaluationError("a group is in several folds")
        for k in range(folds):
            train, test = rows.where(F.col("fold") != k).drop("fold"), rows.where(F.col("fold") == k)
            if not test.limit(1).count():
                continue
            model = trainer(train)
            done = model.predict(test).select(F.col("label").cast("int").alias("y"), "pred", "prob", "fold").persist()
            got = rates(done).first().asDict() | roc_auc(done).first().asDict() | average_precision(done).first().asDict()
            scores += [(k, m, float(v)) for m, v in got.items() if v is not None]
            curves += [tuple(r) for r in fold_curves(done, [k]).collect()]  # 200 rows
            if hasattr(model, "coefficients"):
                weights += [(k, c, float(abs(w))) for c, w in model.coefficients().items()]
            done.unpersist()
    finally:
        rows.unpersist()
    make = rows.sparkSession.createDataFrame
    return {"scores": make(scores, "fold int, metric string, value double"), "curves": make(curves, "fold int, kind string, x double, y double"), "importance": make(weights, "fold int, feature string, value double")}


def cross_validate(rows: DataFrame, group: str, trainer: Callable[[DataFrame], object], folds: int = 5, seed: int = 42) -> DataFrame:
    """fold, metric, value of ``cross_validated``."""
    return cross_validated(rows, group, trainer, folds, seed)["scores"]


def holdout(rows: DataFrame, group: str, **shares) -> dict[str, DataFrame]:
    """train, validation and test rows; whole groups only."""
    plan = split_groups(rows, group, **shares)
    both = rows.join(plan, group)
    return {k: both.where(F.col("split") == k).drop("split") for k in ("train", "validation", "test")}
