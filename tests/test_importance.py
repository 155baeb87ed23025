import numpy as np
import pytest

from cohortwise.operators.importance import (
    feature_importance, geo_importance, importance_by_category, importance_report, importance_statistics,
    importance_summary, least_important, top_n,
)

NAMES = [
    "age", "bmi", "has_sewage", "diagnosis_year", "sex_F", "sex_M", "occupation_Employed", "rural_area_U",
    "diagnosis_trimester_T1", "department_Caldas", "department_Quindio", "municipality_Bello", "municipality_La Ceja",
]
VALUES = [4.0, 3.0, 0.5, 1.0, 1.0, 1.25, 0.75, 0.25, 0.125, 0.5, 0.25, 0.375, 0.0625]


@pytest.fixture(scope="module")
def importances(spark):
    rows = [(i, n, v) for i, (n, v) in enumerate(zip(NAMES, VALUES))]
    return spark.createDataFrame(rows, "feature_idx int, feature string, importance double").repartition(3).cache()


def test_three_definitions(spark):
    rows = [(0, "a", 0, 1.0), (0, "a", 1, -3.0), (1, "b", 0, -2.0), (1, "b", 1, 0.0)]
    weights = spark.createDataFrame(rows, "feature_idx int, feature string, unit int, weight double")
    def got(how):
        return {r.feature: r.importance for r in feature_importance(weights, how).collect()}
    assert got("mean") == {"a": 2.0, "b": 1.0}
    assert got("sum") == {"a": 4.0, "b": 2.0}
    assert got("first") == {"a": 1.0, "b": 2.0}
    with pytest.raises(ValueError):
        feature_importance(weights, "max")


def test_report_cuts_before_the_threshold(importances):
    names = [r.feature for r in importance_report(importances, 4, 1.1).collect()]
    assert sorted(names) == ["age", "bmi", "sex_M"]
    assert importance_report(importances).count() == 9
    assert importance_report(importances, exclude_geo=False).count() == 13
    row = importance_summary(importance_report(importances, 4)).first()
    assert tuple(row) == (4, 4.0, 1.0, (4 + 3 + 1.25 + 1) / 4)


def test_ties_take_the_lower_number(importances):
    assert [r.feature for r in top_n(importances, "importance", 4).collect()] == ["age", "bmi", "sex_M", "diagnosis_year"]
    assert [r.feature for r in least_important(importances, 2).collect()] == ["diagnosis_trimester_T1", "rural_area_U"]


def test_geography(importances):
    rows = geo_importance(importances, "municipality_", 1).collect()
    assert [(r.name, r.importance, r.total) for r in rows] == [("Bello", 0.375, 2)]
    assert [r.name for r in geo_importance(importances, "department_").collect()] == ["Caldas", "Quindio"]


def test_statistics(importances):
    row = importance_statistics(importances).first()
    kept = VALUES[:9]
    assert (row.min, row.max, row.total_features) == (0.125, 4.0, 9)
    assert row["mean"] == pytest.approx(np.mean(kept))
    assert (row.percentile_25, row.median, row.percentile_75) == pytest.approx(np.percentile(kept, [25, 50, 75]))


def test_categories(importances):
    def got(include_geo):
        return {r.category: r.total for r in importance_by_category(importances, include_geo).collect()}
    geo = 0.5 + 0.25 + 0.375 + 0.0625
    base = {"Medical_Factors": 7.0, "Social_Conditions": 0.75, "Infrastructure": 0.75, "Other_Demographic": 3.25}
    assert got(False) == {**base, "Others": 0.125 + geo}
    assert got(True) == {**base, "Others": 0.125, "Environmental/Geographical": geo}
    total = sum(r.share for r in importance_by_category(importances).collect())
    assert total == pytest.approx(1.0, abs=5e-4)
