"""Stochastic linear models against plain NumPy fits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.errors import ClassifierError
from tidewire.operators import dataset, sgd
from tidewire.operators.classifier import AnomalyClassifier
from tidewire.plans import catalog

SF = "/root/testdata/sf0.01"


def value(w, x, y, share, s):
    loss, _ = sgd.losses((x @ w * y)[:, None], np.array([sgd.LOSSES.index(s.loss)]))
    return float((loss[:, 0] * share).sum() / share.sum()) + sgd.penalised(w, s)


def plain_fit(x, y, share, s, steps=6_000):
    """Full proximal gradient steps."""
    w = np.zeros((1, x.shape[1]))
    kind, best = np.array([sgd.LOSSES.index(s.loss)]), None
    for k in range(steps):
        _, slope = sgd.losses((x @ w.T) * y[:, None], kind)
        g = (slope[:, 0] * share * y) @ x / share.sum()
        eta = np.array([0.1 if s.loss != "hinge" else 0.5 / (1 + k) ** 0.6])
        w = sgd.shrink(w - eta[:, None] * g, eta, np.array([s.alpha]), np.array([s.mix]))
        now = value(w[0], x, y, share, s)
        best = (now, w[0].copy()) if best is None or now < best[0] else best
    return best


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    y = np.where(rng.random(3_000) < 0.3, 1.0, -1.0)
    x = rng.normal(size=(3_000, 6)) + y[:, None] * np.array([0.8, -0.5, 0.2, 0, 0, 0])
    rows = spark.createDataFrame([(*map(float, v), float(c > 0), k % 3) for k, (v, c) in enumerate(zip(x, y, strict=True))], ", ".join(f"f{k} double" for k in range(6)) + ", label double, fold int")
    share = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))
    return rows.repartition(4).persist(), np.hstack([x, np.ones((3_000, 1))]), y, share


NAMES = [f"f{k}" for k in range(6)]


def test_every_loss_and_penalty_comes_near_a_plain_fit(table, monkeypatch):
    """All nine in one go, on three partitions."""
    rows, x, y, share = table
    monkeypatch.setattr(sgd, "PARTITION_ROWS", 1_000)
    dealt = sgd.dealt(rows, NAMES)
    assert dealt.rdd.getNumPartitions() == 3 and dealt.count() == 3_000
    every = [sgd.Settings(loss=a, penalty=p, alpha=0.02, l1_ratio=0.4, schedule="adaptive", average=True) for a in sgd.LOSSES for p in sgd.PENALTIES]
    fit = sgd.fit_many(dealt, every, epochs=60, tol=1e-4)
    for s, w in zip(every, fit.weights, strict=True):
        assert value(w, x, y, share, s) <= plain_fit(x, y, share, s)[0] + 1e-3, s
    sparse = sgd.fit_many(dealt, [sgd.Settings(penalty="l1", alpha=0.1, eta0=0.05)], epochs=15).weights[0]
    assert (sparse[3:6] == 0).sum() >= 2 and sparse[0] > 0 > sparse[1]


def test_many_candidates_equal_single_fits(table):
    rows, *_ = table
    dealt = sgd.dealt(rows, NAMES, fold="fold")
    every = [sgd.Settings(loss=a, penalty=p, alpha=0.01, eta0=e, fold=f) for a, p, e, f in (("modified_huber", "l2", 0.1, 0), ("log_loss", "l1", 0.3, 1), ("hinge", "elasticnet", 0.05, None))]
    both = sgd.fit_many(dealt, every, epochs=8)
    alone = [sgd.fit_many(dealt, [s], epochs=8) for s in every]
    assert np.allclose(both.weights, np.concatenate([a.weights for a in alone]), atol=1e-9)
    assert both.epochs.tolist() == [int(a.epochs[0]) for a in alone]
    assert sgd.accuracies(dealt, every, both.weights) == pytest.approx([sgd.accuracies(dealt, [s], a.weights)[0] for s, a in zip(every, alone, strict=True)])


def test_a_fit_leaves_its_fold_out(table):
    rows, x, y, _ = table
    dealt = sgd.dealt(rows, NAMES, fold="fold")
    fit = sgd.fit_many(dealt, [sgd.Settings(fold=1)], epochs=6)
    without = sgd.fit_many(sgd.dealt(rows.where("fold <> 1"), NAMES, fold="fold"), [sgd.Settings()], epochs=6)
    held = np.arange(len(y)) % 3 == 1
    right = ((x[held] @ fit.weights[0] > 0) == (y[held] > 0)).mean()
    assert sgd.accuracies(dealt, [sgd.Settings(fold=1)], fit.weights)[0] == pytest.approx(right)
    assert np.abs(fit.weights - without.weights).max() < 0.5 and right > 0.7


def test_an_epoch_is_one_job_for_any_number_of_candidates(spark, table):
    dealt = sgd.dealt(table[0], NAMES, fold="fold")
    dealt.count()
    tracker, context = spark.sparkContext.statusTracker(), spark.sparkContext

    def jobs(n):
        context.setJobGroup(f"sgd-{n}", "")
        sgd.fit_many(dealt, [sgd.Settings(alpha=10.0**-k) for k in range(1, n + 1)], epochs=3, patience=9)
        return len(tracker.getJobIdsForGroup(f"sgd-{n}"))

    assert jobs(1) == jobs(6)


def test_search_draws_every_axis_and_orders_by_accuracy(table):
    dealt = sgd.dealt(table[0], NAMES, fold="fold")
    found = sgd.search(dealt, range(3), trials=8, epochs=5)
    assert len(found) == 8 and all(set(sgd.AXES) <= r.keys() and len(r["folds"]) == 3 for r in found)
    assert [r["accuracy"] for r in found] == sorted((r["accuracy"] for r in found), reverse=True)
    assert len({r["loss"] for r in found}) == 2 and len({r["eta0"] for r in found}) > 3


def test_bad_settings_and_single_classes_are_refused(table):
    for bad in ({"loss": "square"}, {"penalty": "l3"}, {"schedule": "never"}):
        with pytest.raises(ClassifierError):
            sgd.Settings(**bad)
    with pytest.raises(ClassifierError):
        sgd.fit_many(sgd.dealt(table[0].where("label = 1"), NAMES), [sgd.Settings()])


def test_classifier_searches_the_huber_loss(table, tmp_path):
    rows = table[0]
    model = AnomalyClassifier(NAMES, "modified_huber").fit(rows, True, trials=3, fold="fold", max_iter=6)
    assert {*sgd.AXES, "accuracy", "coefficients"} <= model.best.keys() and model.best["accuracy"] > 0.7
    model.save(str(tmp_path))
    again = AnomalyClassifier.load(str(tmp_path))
    assert again.best == model.best and again.loss == model.loss
    assert again.predict(rows).exceptAll(model.predict(rows)).count() == 0
    hinge = AnomalyClassifier(NAMES, "hinge", sgd=sgd.Settings(loss="hinge", penalty="l1", alpha=0.1)).fit(rows, max_iter=10)
    assert 0 in hinge.coefficients().values()


def test_huber_query_against_a_plain_fit(spark):
    names = ["size", "payload", "qos"]
    got = catalog.QUERIES["huber_scores"](spark, SF).orderBy("seq").toPandas()
    rows = catalog.standardised_rows(spark, SF, names).orderBy("seq").toPandas()
    x, y = np.hstack([rows[names].to_numpy(), np.ones((len(rows), 1))]), np.where(rows["label"] > 0, 1.0, -1.0)
    share = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))
    w = np.linalg.lstsq(x, got["score"].to_numpy(), rcond=None)[0]
    assert np.abs(x @ w - got["score"]).max() < 2e-3  # a linear score, rounded
    s = sgd.Settings()
    assert value(w, x, y, share, s) <= plain_fit(x, y, share, s, 2_000)[0] + 1e-3
    clear = got["score"].abs() > 0.001
    assert ((got["score"] > 0) == (got["pred"] == 1))[clear].all()


def test_partitions_side_by_side_equal_one_after_another(table, monkeypatch):
    """Partitions are even; what shares a task does not change an epoch, which equals plain steps partition by partition."""
    monkeypatch.setattr(sgd, "PARTITION_ROWS", 200)
    monkeypatch.setattr(sgd, "BLOCK_ROWS", 70)
    dealt = sgd.dealt(table[0], NAMES, fold="fold")
    parts: dict = {}
    for r in dealt.select("x", "y", "fold", F.spark_partition_id().alias("p")).collect():
        parts.setdefault(r["p"], []).append((r["x"], r["y"], r["fold"]))
    assert sorted(parts) == list(range(15)) and max(map(len, parts.values())) < 300
    every = [sgd.Settings(penalty="elasticnet", alpha=0.05, fold=1), sgd.Settings(loss="hinge", eta0=0.02)]
    got = []
    for lanes in (1, 2):
        monkeypatch.setattr(sgd, "LANES", lanes)
        got.append(sgd.fit_many(dealt, every, epochs=1).weights)
    assert np.allclose(*got, rtol=0, atol=1e-9)
    share = sgd.balance(dealt, every)
    for k, s in enumerate(every):
        ends, n = [], []
        for p, rows in parts.items():
            x, y, fold = (np.array(c) for c in zip(*rows, strict=True))
            rng, w, total = np.random.default_rng([42, 1, p]), np.zeros((1, 7)), 0.0
            for a in range(0, len(y), 70):
                order = a + rng.permutation(len(y[a : a + 70]))
                for at in (order[lo : lo + 32] for lo in range(0, len(order), 32)):
                    part = fold[at] != s.fold
                    c = share[k, (y[at] > 0).astype(int)] * part
                    _, slope = sgd.losses((x[at] @ w.T) * y[at][:, None], np.array([sgd.LOSSES.index(s.loss)]))
                    w = sgd.shrink(w - s.eta0 * ((c * slope[:, 0] * y[at]) @ x[at] / max(part.sum(), 1)), np.array([s.eta0]), np.array([s.alpha]), np.array([s.mix]))
                    total += c.sum()
            ends.append(w[0])
            n.append(total)
        plain = np.average(ends, axis=0, weights=n)
        assert np.allclose(got[0][k][-1], plain[-1], atol=1e-9) and np.allclose(np.where(got[0][k] == 0, 0, plain), got[0][k], atol=1e-9)
