import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from brute import SPEC, small_patients, to_spark
from cohortwise.operators import training
from cohortwise.operators.features import FeatureSpec
from cohortwise.operators.scoring import score
from cohortwise.operators.training import (
    feature_vectors, fit_population_model, fit_preparation, fit_risk_model, holdout_metrics,
)
from cohortwise.plans.fit_report import fit_and_report
from cohortwise.sources import read_importances
from cohortwise.sources.model_store import load_model, save_model
from cohortwise.plans.driver_views import AS_OF, municipalities, patients

SF = "/root/testdata/sf0.001"
RIDGE = 1e-3


@pytest.fixture(scope="module")
def fitted(spark):
    df = to_spark(spark, small_patients(600))
    return fit_risk_model(df, spec=SPEC, as_of=AS_OF, row_key=["id"], ridge=RIDGE)


def parts(fitted):
    frame = fitted.rows.toPandas()
    return frame[~frame.is_test], frame[frame.is_test]


def test_rows_are_complete_and_split(fitted):
    train, test = parts(fitted)
    assert len(test) == int(np.ceil(0.2 * (len(train) + len(test))))
    assert fitted.rows.where("occupation IS NULL").count() == 0


def test_preparation_uses_the_training_rows_only(fitted):
    train, _ = parts(fitted)
    model = fitted.model
    for c in SPEC.numeric:
        mean = train[c].mean()
        x = train[c].fillna(mean)
        q1, q2, q3 = np.percentile(x, [25, 50, 75])
        assert model.means[c] == pytest.approx(mean)
        assert model.scaling[c] == pytest.approx((q2, q3 - q1))
    assert list(model.categories["occupation"]) == sorted(train.occupation.unique())


def test_fit_solves_the_ridge_equations(fitted):
    train, test = parts(fitted)
    model = fitted.model
    x = brute.matrix(train, model, model.means)
    y = train.risk_score.to_numpy(dtype=float)
    xc, yc = x - x.mean(axis=0), y - y.mean()
    # Spark measures the penalty on the standardised label.
    penalty = RIDGE / y.std(ddof=1)
    w = np.linalg.solve(xc.T @ xc / len(y) + penalty * np.eye(x.shape[1]), xc.T @ yc / len(y))
    assert model.layers[0].weights[:, 0] == pytest.approx(w, abs=1e-6)
    assert model.layers[0].bias[0] == pytest.approx(y.mean() - x.mean(axis=0) @ w, abs=1e-6)
    for rows, errors in ((train, fitted.train), (test, fitted.test)):
        e = rows.risk_score.to_numpy(dtype=float) - brute.forward(model, brute.matrix(rows, model, model.means))
        assert errors["n"] == len(rows)
        assert errors["mse"] == pytest.approx(np.mean(e**2))
        assert errors["mae"] == pytest.approx(np.mean(np.abs(e)))
    row = holdout_metrics(fitted).first()
    assert (row.n, row.mse) == (len(test), pytest.approx(fitted.test["mse"]))


def test_vectors_follow_the_feature_order(fitted):
    model = fitted.model
    rows = feature_vectors(fitted.rows, model).orderBy("id").collect()
    frame = fitted.rows.toPandas().sort_values("id")
    x = brute.matrix(frame, model, model.means)
    assert np.array([r.features.toArray() for r in rows]) == pytest.approx(x)


def test_unseen_and_null_categories_are_zeros(spark, fitted):
    new = spark.createDataFrame(
        [(50.0, 27.0, 190.0, "Z", None, "Astronaut")],
        "age double, bmi double, total_cholesterol double, department string, sex string, occupation string",
    )
    vector = feature_vectors(new, fitted.model).first().features.toArray()
    assert vector[3:].tolist() == [0.0] * (len(fitted.model.feature_names) - 3)


def test_empty_numeric_column_is_an_error(spark):
    df = spark.createDataFrame([(None, "A")], "x double, c string")
    with pytest.raises(ValueError, match="x"):
        fit_preparation(df, FeatureSpec(("x",), ("c",), "robust"))


def test_fit_is_repeatable(spark, fitted):
    df = to_spark(spark, small_patients(600)).repartition(7, F.rand())
    again = fit_risk_model(df, spec=SPEC, as_of=AS_OF, row_key=["id"], ridge=RIDGE)
    assert again.model.layers[0].weights == pytest.approx(fitted.model.layers[0].weights, abs=1e-9)


def test_population_fit(spark):
    found = fit_population_model(patients(spark, SF), municipalities(spark, SF))
    assert found.feature_count == len(found.model.feature_names) > 18
    assert found.train["mse"] < found.rows.agg(F.var_pop("risk_score")).first()[0]
    assert score(found.rows, found.model).where("score IS NULL").count() == 0


def test_wide_models_say_when_they_do_not_converge(spark):
    df = to_spark(spark, small_patients(300))
    exact = fit_risk_model(df, spec=SPEC, as_of=AS_OF, row_key=["id"], ridge=RIDGE)
    close = fit_risk_model(df, spec=SPEC, as_of=AS_OF, row_key=["id"], ridge=RIDGE, solver="l-bfgs")
    assert close.model.layers[0].weights == pytest.approx(exact.model.layers[0].weights, abs=1e-4)
    with pytest.raises(ValueError, match="max_iterations"):
        fit_risk_model(df, spec=SPEC, as_of=AS_OF, row_key=["id"], ridge=RIDGE, solver="l-bfgs", max_iterations=1)


def test_fit_and_report_writes_and_evaluates(spark, tmp_path):
    df = to_spark(spark, small_patients(400))
    found = fit_and_report(df, str(tmp_path), spec=SPEC, as_of=AS_OF, row_key=["id"])
    held = found.fitted.rows.where("is_test").count()
    assert found.metrics.first().n == found.points.count() == held
    assert found.errors.agg(F.sum("n")).first()[0] == held
    assert found.residuals.where("variable = 'residual'").agg(F.sum("n")).first()[0] == held
    found.fitted.release()
    assert found.metrics.first().mse == pytest.approx(found.fitted.test["mse"])
    assert found.errors.count() <= 5
    again = load_model(spark, f"{tmp_path}/model")
    assert again.layers[0].weights.tolist() == found.fitted.model.layers[0].weights.tolist()
    assert read_importances(spark, f"{tmp_path}/importances").count() == found.fitted.feature_count


def test_a_save_that_fails_midway_leaves_the_model_before(spark, tmp_path, fitted):
    path = str(tmp_path / "m")
    save_model(spark, fitted.model, path)
    # A second save that got as far as its scaler.
    spark.createDataFrame([(0, "age", 0.0, 0.0, 1.0)], "position int, column string, mean double, center double, scale double").write.parquet(
        f"{path}/version-000002/scaler")
    assert load_model(spark, path).feature_names == fitted.model.feature_names
    save_model(spark, fitted.model, path)
    assert load_model(spark, path).means == fitted.model.means
    with pytest.raises(ValueError, match="no complete model"):
        load_model(spark, str(tmp_path / "none"))


def test_individual_fit_finds_the_signal(spark):
    """The view's body mass index is a linear function of the risk."""
    found = fit_risk_model(patients(spark, SF), as_of=AS_OF, row_key=["patient_id"])
    assert found.test["mse"] < 1e-3
    assert found.model.by_feature("sum").argmax() == found.model.feature_names.index("bmi")


def test_columns_with_very_many_values(spark):
    from cohortwise.operators import features
    from cohortwise.operators.training import fit_preparation

    spec = features.FeatureSpec(("x",), ("kind", "name"), "standard")
    df = spark.range(200_000).select(F.col("id").cast("double").alias("x"), (F.col("id") % 3).cast("string").alias("kind"), F.col("id").cast("string").alias("name"))
    values = features.category_values(df, spec)
    assert values.groupBy("column").count().orderBy("column").collect() == [("kind", 3), ("name", 200_000)]
    assert "collect_set" not in values._jdf.queryExecution().toString()
    with pytest.raises(ValueError, match=r"more categories than a model holds \(100000\): name \(200000\), kind \(3\)"):
        fit_preparation(df, spec)
    some = df.where("x < 5000")
    assert len(features.read_categories(some, spec)["name"]) == 5000
    with pytest.raises(ValueError, match="use solver='l-bfgs'"):
        training._fit_linear(some, fit_preparation(some, spec), "x", 0.1, "normal", 5)
    assert features.read_categories(df.limit(0), spec) == {"kind": [], "name": []}
