"""Fit, save and evaluate in one call."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import evaluation
from ..operators.importance import feature_importance
from ..operators.scoring import score
from ..operators.training import Fitted, fit_risk_model
from ..sources.model_store import save_model
from ..sources.sinks import write_importances


@dataclass(frozen=True)
class FitReport:
    """A fit with the tables of its held-out rows. `points` reads the staged rows; the others do not,
    so that `fitted.release()` may be called once the points are not needed."""

    fitted: Fitted
    importances: DataFrame
    metrics: DataFrame
    residuals: DataFrame
    errors: DataFrame
    points: DataFrame


def fit_and_report(patients: DataFrame, path: str | None = None, *, target: str = "risk_score", **options) -> FitReport:
    """Fits the individual model and evaluates it on the rows it did not see; runs jobs.

    With `path` the model is saved under `path/model` and its importances under `path/importances`.
    `options` are those of `fit_risk_model`.
    """
    spark = patients.sparkSession
    fitted = fit_risk_model(patients, target=target, **options)
    importances = feature_importance(fitted.model.weights(spark), "sum")
    if path is not None:
        save_model(spark, fitted.model, f"{path}/model")
        write_importances(importances, f"{path}/importances")
    held = score(fitted.rows.where("is_test"), fitted.model)
    metrics = evaluation.regression_metrics(held, target)
    return FitReport(
        fitted, importances,
        spark.createDataFrame(metrics.collect(), metrics.schema),
        evaluation.residual_histogram(held, target),
        evaluation.error_by_range(held, target),
        evaluation.prediction_points(held, target),
    )
