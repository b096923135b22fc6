"""The training path from rows to a saved classifier, and the parts it is made of."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.config import TrainConfig
from tidewire.errors import ClassifierError, EvaluationError, LoadingError
from tidewire.functions import ordering, stats
from tidewire.operators import analysis, dataset, evaluation
from tidewire.operators.classifier import AnomalyClassifier
from tidewire.plans import catalog, train


@pytest.fixture(scope="module")
def rows(spark):
    """Two informative features, a copy of one of them, a constant, noise and a leak; 12 captures."""
    rng = np.random.default_rng(7)
    out = []
    for k in range(1200):
        y = int(rng.random() < 0.4)
        a, b = rng.normal(1.2 * y, 1), rng.normal(-0.8 * y, 1)
        out.append((k % 12, k, y, a, b, 2 * a + 1, 3.0, rng.normal(), y * 10.0, "tcp" if y else rng.choice(["udp", "tcp"])))
    df = spark.createDataFrame([tuple(x.item() if hasattr(x, "item") else x for x in r) for r in out], "file_no int, packet_count long, label_1 int, a double, b double, twice double, same double, noise double, leak double, proto string")
    return df.repartition(4).persist()


@pytest.fixture(scope="module")
def labelled(rows):
    return rows.withColumn("label", F.col("label_1").cast("double")).withColumn("seq", F.col("packet_count"))


def test_a_training_run_from_rows_to_a_saved_classifier(spark, rows, tmp_path):
    cfg = TrainConfig(folds=2, trials=1, bootstrap=60, mqtt_only=False, stability_rows=100)
    got = train.run(rows, "file_no", "packet_count", str(tmp_path), cfg)
    assert got["removed"]["leakage"] == ["leak"] and len({"a", "twice"} & set(got["selected"])) == 1 and {"b", "noise", "proto"} <= set(got["selected"])
    assert list(got["importance"].values()) == sorted(got["importance"].values()) and set(got["importance"]) == set(got["selected"])
    assert 0.7 < got["summary"]["roc_auc"] <= 1 and got["summary"]["features"] == len(got["selected"])
    assert {m["metric"] for m in got["test"]["intervals"]} == {*evaluation.METRICS, "roc_auc"}
    assert all(m["ci_lower"] <= m["mean"] <= m["ci_upper"] for m in got["test"]["intervals"] + got["folds"])
    assert {(c["kind"], round(c["x"] * 99)) for c in got["curves"]} == {(k, i) for k in ("roc", "pr") for i in range(100)}
    assert {r["feature"] for r in got["fold_importance"]} == set(got["selected"]) == set(got["coefficients"])
    assert {"regParam", "elasticNetParam", "accuracy"} == set(got["best"])
    assert {r["feature"] for r in got["leakage"]} >= set(got["selected"]) and got["stability_summary"]["hi"] >= got["stability_summary"]["lo"]
    record = json.loads("".join(r[0] for r in spark.read.text(f"{tmp_path}/results").collect()))
    assert record["selected"] == got["selected"]
    back = AnomalyClassifier.load(f"{tmp_path}/classifier")
    assert back.names == got["selected"] and back.best == got["best"] and back.coefficients() == pytest.approx(got["coefficients"])


@pytest.mark.parametrize("loss", ["log_loss", "hinge", "modified_huber"])
def test_losses_and_saving(labelled, tmp_path, loss):
    model = AnomalyClassifier(["a", "b"], loss).fit(labelled, max_iter=30)
    done = model.predict(labelled).persist()
    assert done.where("pred = label_1").count() / done.count() > 0.75
    assert done.where("prob < 0 OR prob > 1 OR (prob > 0.5 AND pred = 0) OR (prob < 0.5 AND pred = 1)").count() == 0
    assert list(model.coefficients()) == ["a", "b"] and model.coefficients()["b"] < 0 < model.coefficients()["a"]
    model.save(f"{tmp_path}/m")
    again = AnomalyClassifier.load(f"{tmp_path}/m").predict(labelled)
    assert done.select("packet_count", "pred", "prob").exceptAll(again.select("packet_count", "pred", "prob")).count() == 0
    done.unpersist()


def test_a_search_takes_the_best_of_its_draws(labelled):
    part = labelled.join(dataset.group_folds(labelled, "file_no", "label", 3), "file_no")
    model = AnomalyClassifier(["a", "b"], "hinge").fit(part, True, trials=2, fold="fold", folds=3, max_iter=5)
    assert model.best["regParam"] in stats.log_grid(1e-6, 1e-1, 20) and 0.7 < model.best["accuracy"] <= 1
    with pytest.raises(ClassifierError):
        AnomalyClassifier(["a"]).fit(labelled.where("label = 0"))
    with pytest.raises(ClassifierError):
        AnomalyClassifier(["a"], "square").fit(labelled)
    with pytest.raises(ClassifierError):
        AnomalyClassifier(["a"]).predict(labelled)


class Threshold:
    """A stand-in for a classifier: remembers what it was trained on."""

    seen: list = []

    def __init__(self, rows):
        self.seen.append({r[0] for r in rows.select("file_no").distinct().collect()})

    def predict(self, rows):
        return rows.withColumns({"prob": 1 / (1 + F.exp(-F.col("a"))), "pred": (F.col("a") > 0).cast("int")})


def test_cross_validation_against_plain_folds(labelled):
    Threshold.seen.clear()
    got = evaluation.cross_validated(labelled, "file_no", Threshold, 3)
    plan = {r["file_no"]: r["fold"] for r in dataset.group_folds(labelled, "file_no", "label", 3).collect()}
    assert sorted(map(sorted, Threshold.seen)) == sorted(sorted(g for g in plan if plan[g] != k) for k in range(3))
    data = [(plan[r["file_no"]], r["label_1"], r["a"]) for r in labelled.collect()]
    score = {(r["fold"], r["metric"]): r["value"] for r in got["scores"].collect()}
    for k in range(3):
        own = [(y, a) for f, y, a in data if f == k]
        assert score[k, "accuracy"] == pytest.approx(np.mean([(a > 0) == y for y, a in own]))
        pos, neg = [a for y, a in own if y], [a for y, a in own if not y]
        assert score[k, "roc_auc"] == pytest.approx(np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg]))
    assert got["curves"].count() == 600
    with pytest.raises(EvaluationError):
        evaluation.cross_validate(labelled, "file_no", Threshold, 1)


def test_group_folds_spread_the_classes(spark):
    rng = random.Random(1)
    data = [(g, float(rng.random() < 0.3)) for g in range(40) for _ in range(rng.randrange(20, 60))]
    df = spark.createDataFrame(data, "g int, label double")
    plan = {r["g"]: r["fold"] for r in dataset.group_folds(df, "g", "label", 4).collect()}
    assert set(plan) == set(range(40)) and set(plan.values()) == set(range(4))
    share = [sum(y for g, y in data if plan[g] == k) / sum(1 for g, _ in data if plan[g] == k) for k in range(4)]
    assert max(share) - min(share) < 0.05


def test_bootstrap_of_the_area(spark):
    rng = np.random.default_rng(2)
    y = rng.random(400) < 0.4
    p = np.round(np.clip(rng.normal(0.4 + 0.2 * y, 0.15), 0, 1), 3)
    df = spark.createDataFrame([(k, int(a), float(b)) for k, (a, b) in enumerate(zip(y, p, strict=True))], "row int, y int, prob double")
    area = np.mean([(a > b) + 0.5 * (a == b) for a in p[y] for b in p[~y]])
    got = [r[1] for r in evaluation.bootstrap_auc(df, 100).collect()]
    assert len(got) == 100 and abs(np.mean(got) - area) < 0.02 and 0.01 < np.std(got) < 0.05


def test_p_values_by_numeric_integration(spark):
    rng = np.random.default_rng(4)
    data = [(float(y), float(rng.normal(0.15 * y))) for y in (rng.random(300) < 0.5)]
    got = analysis.leakage(spark.createDataFrame(data, "label double, x double"), ["x"]).first()
    x, y = np.array([d[1] for d in data]), np.array([d[0] for d in data])
    r = np.corrcoef(x, y)[0, 1]
    t, df = abs(r) * math.sqrt(298 / (1 - r * r)), 298
    grid = np.linspace(-t, t, 200_001)
    density = np.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi) * (1 + grid**2 / df) ** (-(df + 1) / 2)
    assert got["correlation"] == pytest.approx(r) and got["p_value"] == pytest.approx(1 - np.trapezoid(density, grid), abs=1e-6)


def plain_information(x, y, k):
    psi = lambda n: -0.5772156649015329 + sum(1 / i for i in range(1, n))
    terms = []
    for i in range(len(x)):
        own = np.sort(np.abs(x[(y == y[i])] - x[i]))
        if len(own) < 2:
            continue
        kk = min(k, len(own) - 1)
        terms.append((psi(kk), psi(len(own)), psi(max(1, int((np.abs(x - x[i]) < own[kk]).sum())))))
    a, b, c = np.mean(terms, 0)
    return max(0.0, psi(len(terms)) + a - b - c)


@pytest.mark.parametrize("piece", [100_000, 50])
def test_nearest_neighbour_information_over_all_rows(spark, monkeypatch, piece):
    monkeypatch.setattr(ordering, "PIECE_ROWS", piece)
    rng = np.random.default_rng(6)
    y = np.concatenate([rng.integers(0, 2, 160), [5, 7, 7]])
    x = np.stack([rng.normal(y, 1), rng.normal(0, 1, 163), y * 100 + rng.normal(0, 1, 163)], 1)
    df = spark.createDataFrame([(k, int(c), *map(float, v)) for k, (c, v) in enumerate(zip(y, x, strict=True))], "seq int, label int, p double, q double, r double")
    got = {r["feature"]: r["mutual_info"] for r in analysis.neighbour_information(df, ["p", "q", "r"], ["seq"]).collect()}
    for j, c in enumerate("pqr"):
        assert got[c] == pytest.approx(plain_information(x[:, j], y, 3), abs=1e-6)


def test_running_sums_and_numbers_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(ordering, "PIECE_ROWS", 40)
    rng = random.Random(3)
    data = [(k, k % 3, float(rng.randrange(60)), rng.randrange(9)) for k in range(500)]
    df = spark.createDataFrame(data, "id int, g int, v double, w int")
    for way in (False, True):
        got = ordering.running(df, "v", {"s": F.col("w")}, ["g"], ["id"], way).collect()
        for r in got:
            want = sum(w for i, g, v, w in data if g == r["g"] and ((v, -i) > (r["v"], -r["id"]) if way else (v, i) < (r["v"], r["id"])) or i == r["id"])
            assert r["s"] == want
    number = {r["id"]: r["_n"] for r in ordering.numbered(df, [], ["v", "id"]).collect()}
    assert [i for i, _ in sorted(number.items(), key=lambda x: x[1])] == [d[0] for d in sorted(data, key=lambda d: (d[2], d[0]))]


def test_callables_in_steps_read_all_rows(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=5_000) + 1e4, rng.normal(size=5_000)
    c = a + b
    data = [(float(x), float(y) if i % 7 else None, float(z) if i % 5 else float("nan"), 1.0, None) for i, (x, y, z) in enumerate(zip(a, b, c, strict=True))]
    df = spark.createDataFrame(data, "a double, b double, c double, one double, none double").repartition(6)
    got = {(r[0], r[1]): r[2] for r in analysis.correlations(df, ["a", "b", "c", "one", "none"], catalog.OWN_PEARSON).collect()}
    i = np.arange(5_000)
    for x, y, keep, pair in ((a, b, i % 7 > 0, "ab"), (a, c, i % 5 > 0, "ac"), (b, c, (i % 7 > 0) & (i % 5 > 0), "bc")):
        assert got[pair[0], pair[1]] == got[pair[1], pair[0]] == pytest.approx(np.corrcoef(x[keep], y[keep])[0, 1], abs=1e-9)
    assert got["a", "one"] is None and got["a", "none"] is None
    counted = analysis.Merging(lambda x, y: [len(x)], lambda p, q: [p[0] + q[0]], lambda p: p[0])
    assert analysis.correlations(df, ["a", "b"], counted).first()["corr"] == (i % 7 > 0).sum()
    assert analysis.correlations(df.limit(0), ["a", "b"], counted).first()["corr"] is None


@pytest.mark.parametrize("piece", [100_000, 50])
def test_ranks_of_all_features_together(spark, monkeypatch, piece):
    monkeypatch.setattr(ordering, "PIECE_ROWS", piece)
    rng = np.random.default_rng(4)
    table = np.stack([rng.normal(size=400), rng.integers(0, 4, 400), rng.integers(0, 200, 400) * 1e6, np.zeros(400)], 1)
    df = spark.createDataFrame([tuple(map(float, r)) for r in table] + [(None, 1.0, 0.0, 0.0)], "a double, b double, c double, d double")
    got = analysis.ranked(df, ["a", "b", "c", "d"], analysis.value_counts(df, ["a", "b", "c", "d"])).collect()
    full = np.concatenate([table, [[np.nan, 1.0, 0.0, 0.0]]])
    mean = lambda v: np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
    want = np.stack([mean(full[:, k]) for k in range(4)], 1)
    want[-1, 0] = -1
    assert sorted(tuple(-1 if x is None else x for x in r) for r in got) == sorted(map(tuple, want.tolist()))


def test_reconciled_columns(spark):
    rows = spark.createDataFrame([(7, 1, 2.0, 0, "x")], "seq long, b int, a double, label int, word string")
    assert dataset.reconciled(rows.drop("word"), ["a", "b"]).columns == ["seq", "label", "a", "b"]
    assert dataset.reconciled(rows, ["b"], extra=True).columns == ["seq", "label", "b"]
    for names, said in ((["a", "b"], "unknown: word"), (["a", "b", "c", "word"], "missing: c; no numbers: word"), (["a", "a", "b", "word"], "twice: a")):
        with pytest.raises(LoadingError, match=said):
            dataset.reconciled(rows, names)


def test_kendall_and_callables_on_a_sample(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 20, 300)
    b = a + rng.integers(0, 12, 300)
    df = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b, strict=True)], "a int, b int")
    s, t = np.sign(a[:, None] - a), np.sign(b[:, None] - b)
    tau = (s * t).sum() / math.sqrt((s * s).sum() * (t * t).sum())
    assert analysis.correlations(df, ["a", "b"], "kendall").first()["corr"] == pytest.approx(tau)
    assert analysis.correlations(df, ["a", "b"], lambda x, y: float(len(x)), sample_size=100).first()["corr"] == 100
    assert analysis.sampled(df, 100, ["a", "b"]).count() == 100 and analysis.sampled(df, 1000, ["a"]).count() == 300
    blocks = analysis.correlations(df.withColumn("c", F.col("a") * 2), ["a", "b", "c"], "pearson", block_size=2)
    assert {(r[0], r[1]) for r in blocks.collect()} == {("a", "b"), ("b", "a")}


def test_neighbours_in_pieces(spark, monkeypatch):
    """Also where pieces have fewer rows of a key than neighbours are asked for, or none."""
    monkeypatch.setattr(ordering, "PIECE_ROWS", 9)
    rng = random.Random(8)
    data = [(k, rng.choice("aab") if k else "c", rng.gauss(0, 5)) for k in range(200)]
    got = ordering.neighbouring(spark.createDataFrame(data, "id int, g string, v double"), "v", 3, ["g"]).collect()
    assert len(got) == 200
    for r in got:
        own = sorted(v for _, g, v in data if g == r["g"])
        at = own.index(r["v"])
        assert [r[f"_b{j}"] for j in (1, 2, 3)] == [own[at - j] if at >= j else None for j in (1, 2, 3)]
        assert [r[f"_a{j}"] for j in (1, 2, 3)] == [own[at + j] if at + j < len(own) else None for j in (1, 2, 3)]


def test_pieces_are_not_capped(spark):
    at = ordering.cuts(spark.range(30_000).withColumn("v", F.col("id") / 7), "v", 30_000 * 100_000 // 10)
    assert len(at) > 500
    found = ordering.with_piece(spark.createDataFrame([(1.0,), (5.0,), (None,), (float("nan"),), (-1e9,), (9.0,)], "v double"), "v", [1.0, 5.0]).collect()
    assert [r["_piece"] for r in found] == [1, 2, 0, 2, 0, 2]


@pytest.mark.parametrize("piece", [100_000, 60])
def test_kendall_over_all_rows(spark, monkeypatch, piece):
    """Ties, nulls and a constant; in one piece and in several."""
    monkeypatch.setattr(ordering, "PIECE_ROWS", piece)
    rng = np.random.default_rng(9)
    a = rng.integers(0, 40, 500)
    b = np.round(a / 4 + rng.normal(0, 3, 500), 1)
    c = rng.normal(size=500)
    rows = [(float(x), None if k % 50 == 0 else float(y), float(z), 2.0) for k, (x, y, z) in enumerate(zip(a, b, c, strict=True))]
    df = spark.createDataFrame(rows, "a double, b double, c double, same double")
    got = {(r["feature_a"], r["feature_b"]): r["corr"] for r in analysis.correlations(df, ["a", "b", "c", "same"], "kendall").collect()}
    columns = dict(zip(["a", "b", "c", "same"], zip(*rows, strict=True), strict=True))
    for (p, q), tau in got.items():
        both = np.array([(x, y) for x, y in zip(columns[p], columns[q], strict=True) if x is not None and y is not None])
        s, t = (np.sign(v[:, None] - v) for v in both.T)
        under = math.sqrt((s * s).sum() * (t * t).sum())
        assert tau == (pytest.approx((s * t).sum() / under, abs=1e-12) if under else None)
    assert analysis.inversions(np.arange(300), -np.arange(300)) == 300 * 299 // 2


@pytest.mark.parametrize("piece", [100_000, 40])
def test_bootstrap_of_all_metrics_against_plain_resampling(spark, monkeypatch, piece):
    monkeypatch.setattr(ordering, "PIECE_ROWS", piece)
    rng = np.random.default_rng(5)
    y = rng.random(300) < 0.4
    p = np.round(np.clip(rng.normal(0.4 + 0.25 * y, 0.2), 0, 1), 2)
    df = spark.createDataFrame([(int(a), int(b >= 0.5), float(b)) for a, b in zip(y, p, strict=True)], "y int, pred int, prob double")
    got = evaluation.bootstrap_all(df).toPandas()
    plain = []
    for _ in range(1_000):
        k = rng.integers(0, 300, 300)
        u, v = y[k], p[k]
        hit = v >= 0.5
        area = (v[u][:, None] > v[~u]).mean() + 0.5 * (v[u][:, None] == v[~u]).mean()
        plain.append((np.mean(hit == u), (hit & u).sum() / hit.sum(), (hit & u).sum() / u.sum(), 2 * (hit & u).sum() / (hit.sum() + u.sum()), area))
    assert len(got) == 1_000
    for name, want in zip([*evaluation.METRICS, "roc_auc"], np.array(plain).T, strict=True):
        assert got[name].mean() == pytest.approx(want.mean(), abs=4 * want.std() / 1_000**0.5 + 0.002), name
        assert got[name].std() == pytest.approx(want.std(), rel=0.15), name


def test_row_samples_are_those_of_the_hash_order(spark):
    import hashlib

    rows = [(g, k) for g, n in (("a", 700), ("b", 3), (None, 40), ("c", 1)) for k in range(n)]
    df = spark.createDataFrame(rows, "g string, k int")
    for share in (0.0, 0.3, 0.5, 1.0):
        got = sorted((r["g"] or "", r["k"]) for r in dataset.sample_rows(df, "g", "k", share).collect())
        want = []
        for name in ("a", "b", None, "c"):
            own = sorted(((hashlib.md5("|".join(x for x in (name, str(k), "42") if x is not None).encode()).hexdigest(), k) for g, k in rows if g == name))
            want += [(name or "", k) for _, k in own[: math.floor(share * len(own))]]
        assert got == sorted(want)


def test_nearest_neighbour_information_without_nulls_and_in_small_pieces(spark, monkeypatch):
    """Nulls, NaN and infinite values take no part; reaches of a rare class end in far pieces, of which some are copied."""
    monkeypatch.setattr(ordering, "PIECE_ROWS", 20)
    rng = np.random.default_rng(8)
    y = np.concatenate([rng.integers(0, 40, 120), np.full(60, 50)])
    x = np.where(np.arange(180) < 120, rng.normal(0, 1, 180), rng.normal(9, 0.01, 180))
    odd = [(200, 1, None), (201, 0, float("nan")), (202, 1, float("inf"))]
    df = spark.createDataFrame([(k, int(c), float(v)) for k, (c, v) in enumerate(zip(y, x, strict=True))] + odd, "seq int, label int, p double")
    got = analysis.neighbour_information(df, ["p"], ["seq"]).first()["mutual_info"]
    assert got == pytest.approx(plain_information(x, y, 3), abs=1e-6) and got > 0
