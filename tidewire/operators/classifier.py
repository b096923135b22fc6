"""Linear classifiers, on Spark ML or by stochastic steps: building, tuning, fitting, scoring and saving."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, replace

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ClassifierError
from ..functions.columns import sigmoid
from ..functions.stats import log_grid, random_grid
from . import sgd
from .dataset import class_weights, moments

LOSSES = ("log_loss", "hinge", "modified_huber")


def create(loss: str = "log_loss", penalty: float = 1e-4, mixing: float = 0.0, max_iter: int = 100) -> LogisticRegression | LinearSVC:
    """A Spark ML estimator for a loss; other losses and penalties go through ``operators.sgd``."""
    if loss == "log_loss":
        return LogisticRegression(regParam=penalty, elasticNetParam=mixing, maxIter=max_iter, weightCol="weight", standardization=False, rawPredictionCol="margin")
    if loss == "hinge":
        return LinearSVC(regParam=penalty, maxIter=max_iter, weightCol="weight", standardization=False, rawPredictionCol="margin")
    raise ClassifierError(f"no estimator for loss {loss!r}; choose one of {LOSSES}")


def scaler(rows: DataFrame, names: Sequence[str]) -> SQLTransformer:
    """A standardiser by population moments, as a stage that is saved with the model.  One row comes to the driver."""
    m = moments(rows, names).first()
    parts = [f"(`{c}` - ({m[f'mean_{c}'] or 0.0!r})) / {m[f'sd_{c}'] or 1.0!r} AS `z_{c}`" for c in names]
    return SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__")


@dataclass
class AnomalyClassifier:
    """Standardiser and linear model in one pipeline; scores batches and streams.

    ``fit`` takes rows with ``label`` and the features.  ``best`` holds the chosen parameters.  ``modified_huber`` is
    fitted by stochastic steps, and so is every loss with ``sgd`` settings; a search then draws loss, penalty,
    alpha and eta0, and else the parameters of the Spark ML estimator.
    """

    names: list[str]
    loss: str = "log_loss"
    seed: int = 42
    sgd: sgd.Settings | None = None
    best: dict = field(default_factory=dict)
    model: PipelineModel | None = None

    def stages(self, rows: DataFrame) -> list[Transformer]:
        return [scaler(rows, self.names), VectorAssembler(inputCols=[f"z_{c}" for c in self.names], outputCol="features", handleInvalid="error")]

    def fit(self, rows: DataFrame, optimise: bool = False, trials: int = 25, fold: str | None = None, folds: int = 5, max_iter: int = 100, parallelism: int = 4) -> AnomalyClassifier:
        if rows.select("label").distinct().limit(3).count() != 2:
            raise ClassifierError("two classes are needed")
        prepared = class_weights(rows)
        head = Pipeline(stages=self.stages(prepared)).fit(prepared)
        ready = head.transform(prepared).persist()
        try:
            if self.sgd or self.loss == "modified_huber":
                last: Transformer = self._stochastic(ready, optimise, trials, fold, folds, max_iter)
            else:
                estimator = create(self.loss, max_iter=max_iter)
                if optimise:
                    estimator = self._search(estimator, ready, trials, fold, folds, parallelism)
                last = estimator.fit(ready)
            self.model = PipelineModel([*head.stages, last])
        finally:
            ready.unpersist()
        return self

    def _stochastic(self, ready: DataFrame, optimise: bool, trials: int, fold: str | None, folds: int, epochs: int) -> SQLTransformer:
        chosen = self.sgd or sgd.Settings(loss=self.loss)
        if optimise and not fold:
            ready = ready.withColumn("_fold", F.pmod(F.xxhash64(*self.names, "label", F.lit(self.seed)), F.lit(folds)).cast("int"))
        rows = sgd.dealt(ready, [f"z_{c}" for c in self.names], fold=(fold or "_fold") if optimise else None, seed=self.seed)
        try:
            if optimise:
                numbers = [r[0] for r in rows.select("fold").distinct().orderBy("fold").collect()]
                top = sgd.search(rows, numbers, trials, base=chosen, seed=self.seed, epochs=epochs)[0]
                chosen = replace(chosen, **{k: top[k] for k in sgd.AXES})
                self.best = sgd.as_dict(chosen) | {"accuracy": top["accuracy"]}
            fit = sgd.fit_many(rows, [chosen], epochs, seed=self.seed)
        finally:
            rows.unpersist()
        self.loss = chosen.loss
        *w, b = fit.weights[0].tolist()
        self.best = (self.best or sgd.as_dict(chosen)) | {"coefficients": w, "intercept": b, "epochs": int(fit.epochs[0])}
        margin = " + ".join([f"({b!r})", *(f"`z_{c}` * ({x!r})" for c, x in zip(self.names, w, strict=True))])
        return SQLTransformer(statement=f"SELECT *, {margin} AS score, CAST({margin} > 0 AS DOUBLE) AS prediction FROM __THIS__")

    def _search(self, estimator, ready: DataFrame, trials: int, fold: str | None, folds: int, parallelism: int):
        axes = {"regParam": log_grid(1e-6, 1e-1, 20)} | ({"elasticNetParam": [0.0, 0.15, 0.5, 1.0]} if self.loss == "log_loss" else {})
        points = random_grid(axes, trials, self.seed)
        maps = [{estimator.getParam(k): v for k, v in p.items()} for p in points]
        evaluator = MulticlassClassificationEvaluator(metricName="accuracy")
        cv = CrossValidator(estimator=estimator, estimatorParamMaps=maps, evaluator=evaluator, numFolds=folds, seed=self.seed, parallelism=parallelism, foldCol=fold or "")
        found = cv.fit(ready)
        top = max(range(len(points)), key=lambda k: found.avgMetrics[k])
        self.best = points[top] | {"accuracy": found.avgMetrics[top]}
        return estimator.copy(maps[top])

    def predict(self, rows: DataFrame) -> DataFrame:
        """Rows with ``pred`` (int) and ``prob``: the model's probability, or the sigmoid of its margin; that of
        modified Huber is the margin cut to -1 to 1 and moved to 0 to 1."""
        if self.model is None:
            raise ClassifierError("not fitted")
        out = self.model.transform(rows)
        if "probability" in out.columns:
            prob = vector_to_array("probability")[1]
        elif self.loss == "modified_huber":
            prob = (F.least(F.greatest("score", F.lit(-1.0)), F.lit(1.0)) + 1) / 2
        else:
            prob = sigmoid(F.col("score") if "score" in out.columns else vector_to_array("margin")[1])
        return out.select(*rows.columns, F.col("prediction").cast("int").alias("pred"), prob.alias("prob"))

    def coefficients(self) -> dict[str, float]:
        """Coefficient of every feature, the largest in size first."""
        if self.model is None:
            raise ClassifierError("not fitted")
        w = self.best["coefficients"] if "coefficients" in self.best else list(self.model.stages[-1].coefficients)
        return dict(sorted(zip(self.names, map(float, w), strict=True), key=lambda x: -abs(x[1])))

    def save(self, path: str) -> None:
        """The pipeline under ``path``/model and a record under ``path``/record, both written by Spark."""
        if self.model is None:
            raise ClassifierError("not fitted")
        self.model.write().overwrite().save(f"{path}/model")
        record = json.dumps({"names": self.names, "loss": self.loss, "seed": self.seed, "best": self.best, "sgd": self.sgd and asdict(self.sgd)})
        SparkSession.active().createDataFrame([(record,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/record")

    @classmethod
    def load(cls, path: str) -> AnomalyClassifier:
        record = json.loads(SparkSession.active().read.text(f"{path}/record").first()[0])
        return cls(record["names"], record["loss"], record["seed"], record.get("sgd") and sgd.Settings(**record["sgd"]), record["best"], PipelineModel.load(f"{path}/model"))
