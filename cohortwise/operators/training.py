"""Fitting the individual and the population model (M1, M2)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import OneHotEncoder, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import sql_text
from ..functions.numbers import not_nan
from .evaluation import regression_metrics
from .features import (
    INDIVIDUAL, POPULATION, FeatureSpec, category_text, filled_sql, is_scorable,
    prepare_groups, prepare_patients, read_categories, require_features, robust_scale_fit, standard_scale_fit,
)
from .model import Layer, RiskModel
from .population import group_population
from .scoring import scaled_sql, score
from .splits import random_split, stratified_split
from .staging import release, stage

RIDGE = 1e-3
MAX_ITERATIONS = 500
NORMAL_FEATURES = 4096  # the exact solver's own limit


@dataclass(frozen=True)
class Fitted:
    """A model with the rows it was fitted on and its errors."""

    model: RiskModel
    rows: DataFrame  # prepared rows with the `is_test` flag
    feature_count: int
    train: Mapping[str, float]
    test: Mapping[str, float]
    staged: DataFrame  # what `rows` reads

    def release(self) -> None:
        """Deletes the staged rows; `rows` cannot be read any more, the model and errors stay."""
        release(self.staged)


def _filled(spec: FeatureSpec, means: Mapping[str, float]) -> dict[str, str]:
    return {c: filled_sql(c, sql_text.number(means[c])) for c in spec.numeric}


def fit_preparation(df: DataFrame, spec: FeatureSpec) -> RiskModel:
    """Means, scaling and categories of the rows, as a model whose weights are all zero.

    Means and extremes come from one aggregate, categories from another. A filled column keeps the
    extremes of its values, as their mean lies between them, so the scaler needs no pass to find them.
    """
    measures = [F.count("*").alias("n")]
    for i, c in enumerate(spec.numeric):
        value = not_nan(F.col(c).cast("double"))
        measures += [F.avg(value).alias(f"m{i}"), F.min(value).alias(f"lo{i}"), F.max(value).alias(f"hi{i}")]
    row = df.agg(*measures).collect()[0]
    means = {c: row[f"m{i}"] for i, c in enumerate(spec.numeric)}
    empty = [c for c, m in means.items() if m is None]
    if empty:
        raise ValueError(f"columns without a single value: {', '.join(empty)}")
    columns = {c: F.expr(text) for c, text in _filled(spec, means).items()}
    if spec.scaler == "robust":
        known = {(0, c): (row["n"], row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(spec.numeric)}
        scaling = robust_scale_fit(df, columns, known)
    else:
        scaling = standard_scale_fit(df, columns)
    categories = read_categories(df, spec)
    width = len(spec.numeric) + sum(len(v) for v in categories.values())
    return RiskModel(spec, means, scaling, categories, (Layer(np.zeros((width, 1)), np.zeros(1)),))


def feature_vectors(df: DataFrame, model: RiskModel, output: str = "features") -> DataFrame:
    """The rows with a sparse feature vector in the model's feature order."""
    filled = _filled(model.spec, model.means)
    numbers = F.expr(f"array({', '.join(scaled_sql(model, c, filled[c]) for c in model.spec.numeric)})")
    columns = [c for c in model.spec.categorical if model.categories[c]]
    texts = {f"_text_{i}": category_text(df, model.spec, c) for i, c in enumerate(columns)}
    df = df.withColumns(texts).withColumn("_numbers", array_to_vector(numbers))
    encoded = [f"_hot_{i}" for i in range(len(columns))]
    # `keep` gives unseen and null values a last index of their own; dropping the last index of the
    # encoder makes them all zeros.
    for i, c in enumerate(columns):
        df = StringIndexerModel.from_labels(
            list(model.categories[c]), inputCol=f"_text_{i}", outputCol=f"_index_{i}", handleInvalid="keep"
        ).transform(df)
    if columns:
        indexed = [f"_index_{i}" for i in range(len(columns))]
        df = OneHotEncoder(inputCols=indexed, outputCols=encoded, dropLast=True).fit(df).transform(df)
    assembler = VectorAssembler(inputCols=["_numbers", *encoded], outputCol=output)
    helpers = [c for c in df.columns if c.startswith(("_text_", "_index_", "_hot_"))]
    return assembler.transform(df).drop("_numbers", *helpers)


def _fit_linear(train: DataFrame, prepared: RiskModel, target: str, ridge: float, solver: str, max_iterations: int) -> tuple[Layer, ...]:
    if solver == "normal" and len(prepared.feature_names) > NORMAL_FEATURES:
        raise ValueError(f"{len(prepared.feature_names)} features are too many for the exact solver ({NORMAL_FEATURES}); use solver='l-bfgs'")
    fitted = LinearRegression(
        featuresCol="features", labelCol="_label", regParam=ridge, elasticNetParam=0.0,
        standardization=False, solver=solver, maxIter=max_iterations, tol=1e-12,
    ).fit(feature_vectors(train, prepared).select("features", F.col(target).cast("double").alias("_label")))
    if solver != "normal" and fitted.summary.totalIterations >= max_iterations:
        raise ValueError(f"no convergence in {max_iterations} iterations; raise max_iterations or the ridge")
    weights = np.asarray(fitted.coefficients.toArray(), dtype=float).reshape(-1, 1)
    return (Layer(weights, np.array([float(fitted.intercept)])),)


def _fit(rows: DataFrame, staged: DataFrame, spec: FeatureSpec, target: str, fit_on: str, trainer) -> Fitted:
    if fit_on not in ("train", "all"):
        raise ValueError(f"unknown fit_on {fit_on!r}")
    train = rows.where(~F.col("is_test"))
    try:
        prepared = fit_preparation(train if fit_on == "train" else rows, spec)
        found = trainer(train, prepared, target)
        model = RiskModel(spec, prepared.means, prepared.scaling, prepared.categories, found) if isinstance(found, tuple) else found
        errors = {
            row["is_test"]: row for row in _errors(score(rows, model), target)
        }
    except BaseException:
        release(staged)
        raise
    return Fitted(model, rows, len(model.feature_names), errors.get(False, {}), errors.get(True, {}), staged)


def _errors(scored: DataFrame, target: str) -> list[dict]:
    error = F.col(target) - F.col("score")
    found = scored.groupBy("is_test").agg(
        F.count(error).alias("n"), F.avg(error * error).alias("mse"), F.avg(F.abs(error)).alias("mae")
    )
    return [row.asDict() for row in found.collect()]


def _trainer(trainer, ridge, solver, max_iterations):
    if trainer != "linear":
        return trainer
    return lambda train, prepared, target: _fit_linear(train, prepared, target, ridge, solver, max_iterations)


def fit_risk_model(
    patients: DataFrame,
    *,
    spec: FeatureSpec = INDIVIDUAL,
    target: str = "risk_score",
    as_of=None,
    test_fraction: float = 0.2,
    seed: int = 42,
    row_key: Sequence[str] | None = None,
    order: Column | None = None,
    fit_on: str = "train",
    trainer="linear",
    ridge: float = RIDGE,
    solver: str = "normal",
    max_iterations: int = MAX_ITERATIONS,
) -> Fitted:
    """The individual model: prepare, split by target bins, fit, evaluate.

    Means, scaler and categories come from the training rows only, so the test rows stay unseen
    (`fit_on="all"` uses all rows). `row_key` and `order` are those of `stratified_split`. `trainer` is "linear" or a function
    (train rows, prepared model, target) -> layers, or -> a model that has `score_rows`. `solver` is that of the linear one: "normal" is
    exact, takes one scan and up to 4,096 features; "l-bfgs" takes any number and fails if it has
    not converged. The prepared rows are staged once because several jobs read them; `release` the
    result when they are no longer needed.
    """
    rows = prepare_patients(patients, as_of)
    require_features(rows, spec)
    keep = [c for c in dict.fromkeys([*(row_key or ()), *spec.numeric, *spec.categorical, target]) if c in rows.columns]
    rows = rows.where(F.col(target).isNotNull()).where(is_scorable(rows, spec)).select(*keep)
    rows = stage(rows, "fit-rows")
    split = stratified_split(rows, target, test_fraction=test_fraction, seed=seed, row_key=row_key, order=order)
    return _fit(split, rows, spec, target, fit_on, _trainer(trainer, ridge, solver, max_iterations))


def fit_population_model(
    patients: DataFrame,
    municipalities: DataFrame,
    *,
    spec: FeatureSpec = POPULATION,
    target: str = "risk_score",
    test_fraction: float = 0.2,
    seed: int = 42,
    uniform: Column | None = None,
    fit_on: str = "train",
    trainer="linear",
    ridge: float = RIDGE,
    solver: str = "normal",
    max_iterations: int = MAX_ITERATIONS,
) -> Fitted:
    """The population model: group the patients, split the groups, fit, evaluate.

    `uniform` is that of `random_split`; the other options are those of `fit_risk_model`.
    """
    groups = prepare_groups(group_population(patients, municipalities))
    groups = stage(groups.where(F.col(target).isNotNull()), "population-groups")
    split = random_split(groups, test_fraction, seed, uniform=uniform)
    return _fit(split, groups, spec, target, fit_on, _trainer(trainer, ridge, solver, max_iterations))


def holdout_metrics(fitted: Fitted, target: str = "risk_score") -> DataFrame:
    """Error measures on the rows the fit held out."""
    return regression_metrics(score(fitted.rows.where("is_test"), fitted.model), target)
