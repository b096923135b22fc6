"""Training: feature rows to a saved and evaluated classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import TrainConfig, as_json
from ..errors import EngineError, PipelineError
from ..operators import analysis, dataset, evaluation
from ..operators.classifier import AnomalyClassifier
from ..sources.feature_files import write_report


def prepare(rows: DataFrame, group: str, order: str, cfg: TrainConfig = TrainConfig(), label: str = "label_1", names: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """group, ``seq``, label, split and scaled features.

    Text columns become codes over the whole table.  The scaler is fitted on a share of the
    rows of every group, of training groups only unless the settings say otherwise.
    """
    rows = dataset.mqtt_only(rows) if cfg.mqtt_only and "is_mqtt" in rows.columns else rows
    names = names or [c for c in dataset.feature_names(rows.columns) if c not in (group, order)]
    kinds = dict(rows.dtypes)
    rows = rows.withColumns({"seq": F.col(order).cast("long"), "label": F.col(label).cast("double")})
    for c in names:
        if kinds.get(c) == "string":
            rows = dataset.encode_category(rows, c)
    rows = dataset.conform(rows.select("seq", "label", F.col(group).alias("file_no"), *[c for c in names if c in kinds]), names, cfg.impute)
    rows = rows.join(dataset.split_groups(rows, "file_no", cfg.test_share, cfg.validation_share, cfg.seed), "file_no")
    base = rows.where("split = 'train'") if cfg.scale_on_train_only else rows
    fitted = dataset.extremes(dataset.sample_rows(base, "file_no", "seq", cfg.scaler_share, cfg.seed), names)
    return dataset.min_max(rows, fitted, names), names


def run(rows: DataFrame, group: str, order: str, target: str | None = None, cfg: TrainConfig = TrainConfig(), label: str = "label_1", loss: str = "log_loss", names: list[str] | None = None, optimise: bool = True) -> dict:
    """Prepare, select, cross-validate, fit on training rows, evaluate on test rows, save."""
    try:
        ready, names = prepare(rows, group, order, cfg, label, names)
        ready = ready.persist()
        train = ready.where("split = 'train'")
        chosen = analysis.select(train, names, "seq", "label", cfg.redundancy, cfg.leakage, window=cfg.stability_rows)
        kept = chosen["selected"] or names
        search = optimise

        def fit(part: DataFrame) -> AnomalyClassifier:
            """Tuned on group folds of the rows given, so every outer fold judges what is saved in the end."""
            if search:
                part = part.join(dataset.group_folds(part, "file_no", "label", cfg.folds, cfg.seed), "file_no")
            return AnomalyClassifier(list(kept), loss, cfg.seed).fit(part, search, cfg.trials, "fold" if search else None, cfg.folds)

        crossed = evaluation.cross_validated(train, "file_no", fit, cfg.folds, cfg.seed)
        final = fit(train)
        done = final.predict(ready.where("split = 'test'")).select(F.col("label").cast("int").alias("y"), "pred", "prob").persist()
        rows_of = lambda df: [r.asDict() for r in df.collect()]
        report = {
            "config": as_json(cfg), "selected": kept, "removed": chosen["removed"], "redundant_pairs": chosen["redundant_pairs"], "importance": chosen["importance"],
            "leakage": rows_of(chosen["leakage"]), "stability": chosen["stability"], "stability_summary": rows_of(analysis.summary(train.sparkSession.createDataFrame(list(chosen["stability"].items()), "feature string, score double")))[0] if chosen["stability"] else {},
            "folds": rows_of(evaluation.fold_intervals(crossed["scores"], cfg.confidence)), "curves": rows_of(evaluation.mean_curves(crossed["curves"]).orderBy("kind", "x")), "fold_importance": rows_of(evaluation.fold_intervals(crossed["importance"], cfg.confidence, "feature")),
            "test": evaluation.evaluate(done, cfg.bootstrap, cfg.confidence), "coefficients": final.coefficients(), "best": final.best,
        }
        report["summary"] = {k: report["test"][k] for k in (*evaluation.METRICS, "roc_auc", "average_precision")} | {"features": len(kept), "best": final.best}
        if target:
            final.save(f"{target}/classifier")
            write_report(rows.sparkSession, report, f"{target}/results")
        done.unpersist()
        ready.unpersist()
        return report
    except EngineError:
        raise
    except Exception as e:
        raise PipelineError(f"training failed: {e}") from e
