import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import brute
from brute import brute_cohorts, small_patients, small_spec_model, to_spark, two_layer_model
from cohortwise.operators import cohorts, scoring
from cohortwise.operators.cohorts import cohort_summary
from cohortwise.operators.importance import feature_importance, with_importance
from cohortwise.operators.scoring import explode_factors, score, top_factors_per_row


def check(found, wanted):
    rows = {r[0]: r for r in found.collect()}
    assert set(rows) == set(wanted)
    for key, (n, risk, factors) in wanted.items():
        assert rows[key].n_patients == n
        if np.isnan(risk):  # no survivor, or a number that no row of the cohort has
            assert rows[key].avg_risk is None
            continue
        assert rows[key].avg_risk == pytest.approx(risk, abs=5.1e-5)
        got = [(f.feature, f.value) for f in rows[key].top_factors]
        assert [f for f, _ in got] == [f for f, _ in factors]
        assert [v for _, v in got] == pytest.approx([v for _, v in factors])


@pytest.mark.parametrize("scope", ["cohort", "training"])
@pytest.mark.parametrize("key", ["department", "occupation", "municipality"])
@pytest.mark.parametrize("make", [small_spec_model, two_layer_model])
def test_one_pass_equals_row_by_row(spark, make, key, scope):
    frame, model = small_patients(), make()
    found = cohort_summary(to_spark(spark, frame), key, model, impute_scope=scope, factors=3)
    check(found, brute_cohorts(frame, key, model, scope=scope))


def test_result_does_not_depend_on_partitioning(spark):
    df, model = to_spark(spark, small_patients()), small_spec_model()
    def run(part):
        rows = cohort_summary(part, ["department", "sex"], model, factors=2).collect()
        return sorted((*r[:5], *[(f.feature, round(f.value, 9)) for f in r.top_factors]) for r in rows)
    assert run(df.coalesce(1)) == run(df.repartition(13, F.rand()))


def test_hot_cohort(spark):
    """A cohort with most of the rows next to many tiny ones."""
    rng = np.random.default_rng(2)
    frame = small_patients(2000)
    frame["municipality"] = ["hot" if rng.random() < 0.7 else f"m{rng.integers(0, 300)}" for _ in range(2000)]
    model = small_spec_model()
    check(cohort_summary(to_spark(spark, frame), "municipality", model, factors=3, min_rows=2),
          brute_cohorts(frame, "municipality", model, min_rows=2))


@pytest.mark.parametrize("make", [small_spec_model, two_layer_model])
def test_long_category_lists(spark, monkeypatch, make):
    """The joined and separately counted form gives what the mapped form gives."""
    frame, model = small_patients(), make()
    df = to_spark(spark, frame)
    short = cohort_summary(df, "municipality", model, factors=8).collect()
    for module in (scoring, cohorts):
        monkeypatch.setattr(module, "MAP_CATEGORIES", 2)
    long = cohort_summary(df, "municipality", model, factors=8).collect()
    def plain(rows):
        return {r.municipality: (r.n_patients, r.avg_risk, [(f.feature, pytest.approx(f.value)) for f in r.top_factors]) for r in rows}
    assert plain(long) == plain(short)


@pytest.mark.parametrize("make", [small_spec_model, two_layer_model])
def test_long_lists_can_be_combined(spark, monkeypatch, make):
    """Sums of sums with long lists, and with cohorts whose rows do not survive."""
    df, model = to_spark(spark, small_patients()), make()
    wanted = cohort_summary(df, "sex", model, factors=6, impute_scope="training").collect()
    for module in (scoring, cohorts):
        monkeypatch.setattr(module, "MAP_CATEGORIES", 1)
    sums = cohorts.CohortSums(model, "training", factors=6)
    fine = sums.aggregate(df, ["sex", "municipality"])
    found = sums.finish(sums.combine(fine, ["sex"]), ["sex"]).collect()
    def plain(rows):
        return {r.sex: (r.n_patients, r.avg_risk, [(f.feature, pytest.approx(f.value)) for f in r.top_factors]) for r in rows}
    assert plain(found) == plain(wanted)
    none = sums.finish(sums.combine(fine, ["sex"], F.lit(False)), ["sex"]).collect()
    assert all(r.avg_risk is None and r.top_factors == [] for r in none)


def test_raw_count_and_surviving_mean(spark):
    """Ten rows, one with a null category: ten are counted, nine are scored."""
    frame = small_patients(10)
    frame["occupation"] = [None] + ["Employed"] * 9
    frame["department"] = "A"
    model = small_spec_model()
    row = cohort_summary(to_spark(spark, frame), "department", model).first()
    scored = score(to_spark(spark, frame), model, "cohort", ["department"])
    assert scored.where("is_scorable").count() == 9
    assert row.n_patients == 10
    assert row.avg_risk == pytest.approx(scored.agg(F.avg("score")).first()[0], abs=5e-5)


def test_small_groups_and_null_keys(spark):
    frame = small_patients(24)
    frame["department"] = ["A"] * 9 + ["B"] * 10 + [None] * 5
    model = small_spec_model()
    df = to_spark(spark, frame)
    assert [r.department for r in cohort_summary(df, "department", model).collect()] == ["B"]
    assert sorted(r.department for r in cohort_summary(df, "department", model, min_rows=None).collect()) == ["A", "B"]


def test_cohort_without_survivors(spark):
    frame = small_patients(12)
    frame["occupation"] = None
    frame["department"] = "A"
    row = cohort_summary(to_spark(spark, frame), "department", small_spec_model(), factors=3).first()
    assert (row.n_patients, row.avg_risk, row.risk_band, row.top_factors) == (12, None, None, [])


def test_column_empty_within_a_cohort(spark):
    """A number no row of the cohort has leaves no mean to fill in: no score."""
    frame = small_patients(30)
    frame["department"] = ["A"] * 15 + ["B"] * 15
    frame["bmi"] = [None] * 15 + [25.0] * 15
    found = {r.department: r.avg_risk for r in cohort_summary(to_spark(spark, frame), "department", small_spec_model()).collect()}
    assert found["A"] is None and found["B"] is not None


def test_measures_and_extra_requirements(spark):
    frame = small_patients()
    df = to_spark(spark, frame)
    model = small_spec_model()
    found = cohort_summary(df, "sex", model, averages={"avg_bmi": "bmi"}, percentages={"smokers": "is_smoker"})
    for row in found.collect():
        group = frame[frame.sex == row.sex]
        assert row.avg_bmi == pytest.approx(pd.to_numeric(group.bmi).mean(), abs=0.0051)
        assert row.smokers == pytest.approx(group.is_smoker.astype(float).mean() * 100, abs=0.0051)
    strict = cohort_summary(df, "sex", model, impute_scope="training", also_required=["bmi"])
    kept = score(df.where("bmi IS NOT NULL"), model).groupBy("sex").agg(F.avg("score").alias("s"))
    wanted = {r.sex: r.s for r in kept.collect()}
    for row in strict.collect():
        assert row.avg_risk == pytest.approx(wanted[row.sex], abs=5e-5)
        assert row.n_patients == int((frame.sex == row.sex).sum())


def test_factor_ties_go_to_the_lower_number(spark):
    """Without any category present all their activations are zero."""
    frame = small_patients(10)
    frame["occupation"], frame["sex"], frame["department"] = "Student", "X", "A"
    for c, (center, _) in small_spec_model().scaling.items():
        frame[c] = center
    row = cohort_summary(to_spark(spark, frame), "department", small_spec_model(), factors=5).first()
    assert [f.feature for f in row.top_factors] == ["age", "bmi", "total_cholesterol", "sex_F", "sex_M"]


# --- rows -----------------------------------------------------------------------------------


@pytest.mark.parametrize("make", [small_spec_model, two_layer_model])
@pytest.mark.parametrize("limit", [64, 1])
def test_scores_match_numpy(spark, monkeypatch, make, limit):
    monkeypatch.setattr(scoring, "MAP_CATEGORIES", limit)
    frame, model = small_patients(80), make()
    wanted = brute.forward(model, brute.matrix(frame, model, model.means))
    alive = brute.survivors(frame, model).to_numpy()
    rows = score(to_spark(spark, frame), model).orderBy("id").collect()
    assert [r.is_scorable for r in rows] == alive.tolist()
    for row, value in zip(rows, wanted):
        assert (row.score is None) if not row.is_scorable else row.score == pytest.approx(value)
    assert rows[0].asDict().keys() - set(frame.columns) == {"is_scorable", "score"}


@pytest.mark.parametrize("limit", [64, 1])
@pytest.mark.parametrize("n", [1, 5, 11])
def test_row_factors_match_the_full_row(spark, monkeypatch, n, limit):
    monkeypatch.setattr(scoring, "MAP_CATEGORIES", limit)
    frame, model = small_patients(60), two_layer_model()
    x = brute.matrix(frame, model, model.means) * np.abs(model.layers[0].weights[:, 0])
    rows = top_factors_per_row(to_spark(spark, frame), model, n).orderBy("id").collect()
    for row, values in zip(rows, x):
        order = sorted(range(len(values)), key=lambda i: (-values[i], i))[:n]
        assert [f.feature for f in row.top_factors] == [model.feature_names[i] for i in order]
        assert [f.value for f in row.top_factors] == pytest.approx([values[i] for i in order])


def test_explode_factors_and_activation_join(spark):
    model = small_spec_model()
    df = cohort_summary(to_spark(spark, small_patients()), "department", model, factors=2)
    long = explode_factors(df, ["department"])
    assert [tuple(r)[:2] for r in long.orderBy("department", "rank").collect()] == [
        (d, k) for d in ("A", "B", "C") for k in (1, 2)]
    importances = feature_importance(model.weights(spark))
    activations = spark.createDataFrame([(0, 2.0), (4, 0.5)], "feature_idx int, activation double")
    got = {r.feature_idx: r.value for r in with_importance(activations, importances).collect()}
    size = model.by_feature("mean")
    assert got == {0: pytest.approx(2 * size[0]), 4: pytest.approx(0.5 * size[4])}
