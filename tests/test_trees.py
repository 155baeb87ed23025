"""Tree models: scores and importance against the library's own, nodes stored and read."""

import numpy as np
import pytest
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from cohortwise.operators import trees as T
from cohortwise.operators.features import FeatureSpec
from cohortwise.operators.importance import importance_report
from cohortwise.operators.scoring import score
from cohortwise.operators.training import feature_vectors, fit_preparation, fit_risk_model

SPEC = FeatureSpec(("age", "bmi"), ("sex", "occupation"), "robust")


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.Generator(np.random.PCG64(21))
    rows = []
    for k in range(800):
        age, bmi, sex, job = float(rng.integers(20, 80)), float(rng.normal(26, 4)), "FM"[k % 2], str(rng.choice(["x", "y", "it's"]))
        y = 0.3 * (age > 50) + 0.2 * (bmi > 27) * (sex == "M") + 0.4 * (job == "it's") + float(rng.normal(0, 0.01))
        rows.append((k, None if k % 50 == 0 else age, bmi, sex, job, y))
    return spark.createDataFrame(rows, "id long, age double, bmi double, sex string, occupation string, risk_score double")


@pytest.fixture(scope="module")
def fitted(people):
    prepared = fit_preparation(people, SPEC)
    vectors = feature_vectors(people, prepared)
    model = GBTRegressor(featuresCol="features", labelCol="risk_score", maxIter=6, maxDepth=4, stepSize=0.3, seed=1).fit(vectors)
    return prepared, model, T.TreeModel(prepared, T.nodes_of(model))


def test_scores_equal_the_librarys(people, fitted):
    prepared, model, ours = fitted
    wanted = {r["id"]: r["prediction"] for r in model.transform(feature_vectors(people, prepared)).select("id", "prediction").collect()}
    found = {r["id"]: r["score"] for r in score(people, ours).select("id", "score").collect()}
    assert found.keys() == wanted.keys() and all(abs(found[k] - wanted[k]) < 1e-12 for k in wanted)
    # A category nobody has seen is in none; a null one is not scored.
    odd = people.limit(1).withColumn("occupation", F.lit("new")).union(people.limit(1).withColumn("occupation", F.lit(None).cast("string")))
    kinds = [r["score"] is None for r in score(odd, ours).orderBy(F.col("occupation").isNull()).collect()]
    assert kinds == [False, True]


def test_importance_equals_the_librarys(spark, fitted):
    _, model, ours = fitted
    found = {r["feature_idx"]: r["importance"] for r in T.tree_importance(ours, spark).collect()}
    assert np.allclose([found[i] for i in range(len(found))], model.featureImportances.toArray())
    assert importance_report(T.tree_importance(ours, spark), top=2).count() == 2


def test_nodes_are_trees(spark, fitted):
    ours = fitted[2]
    for tree in {n.tree for n in ours.nodes}:
        own = {n.node: n for n in ours.nodes if n.tree == tree}
        children = [c for n in own.values() if n.feature >= 0 for c in (n.left, n.right)]
        assert sorted([0, *children]) == sorted(own)
        assert all(own[n.left].n + own[n.right].n == n.n for n in own.values() if n.feature >= 0)
    table = ours.node_table(spark)
    assert table.count() == len(ours.nodes) and table.where("feature_idx < 0 and feature is not null").isEmpty()


def test_saved_and_loaded(spark, people, fitted, tmp_path):
    ours = fitted[2]
    T.save_trees(spark, ours, str(tmp_path / "m"))
    T.save_trees(spark, ours, str(tmp_path / "m"))
    loaded = T.load_trees(spark, str(tmp_path / "m"))
    assert loaded.nodes == ours.nodes
    assert score(people, loaded).select("id", "score").exceptAll(score(people, ours).select("id", "score")).isEmpty()


def test_fit(people):
    fitted = fit_risk_model(people, spec=SPEC, row_key=["id"], trainer=T.tree_trainer(trees=6, depth=4, rate=0.4))
    assert isinstance(fitted.model, T.TreeModel) and fitted.feature_count == 7
    assert fitted.test["mse"] < 0.2 * people.agg(F.var_pop("risk_score")).first()[0]
    fitted.release()
