"""The SQL functions against the column functions they stand for, on edge rows, and reports as SQL text."""

import pytest
from pyspark.sql import functions as F

from cohortwise import functions as C
from cohortwise.functions.sql_names import definitions, register_functions
from cohortwise.operators.features import prepare_patients
from cohortwise.operators.scoring import score
from cohortwise.plans import driver_model as M, reports
from cohortwise.plans.driver_views import AS_OF, patients

SF = "/root/testdata/sf0.001"
NAN = float("nan")
SCORES = [None, NAN, -0.1, 0.1999, 0.2, 0.4, 0.6, 0.8, 1.1, 17.0, 18.0, 75.0, 119.0, 120.0]
TEXTS = [None, "", "1000-1500", "1200", "1-2-6", "-5", "abc", "nan", "1.5f", " 7 ", "Sex_M", "sex_m", "Sex_"]


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    assert register_functions(spark) == register_functions(spark) == [f"cohort_{n}" for n in definitions()]


def same(df, expression, column):
    rows = df.select(F.expr(expression).alias("a"), column.alias("b")).collect()
    assert [repr(r["a"]) for r in rows] == [repr(r["b"]) for r in rows]


def test_numbers(spark):
    df = spark.createDataFrame([(s,) for s in SCORES], "x double")
    same(df, "cohort_risk_band(x)", C.risk_band(F.col("x")))
    same(df, "cohort_cut(x, array(0D, 18D, 75D, 120D), array('a', 'b', 'c'))", C.cut(F.col("x"), [0, 18, 75, 120], ["a", "b", "c"], right=False))
    same(df, "cohort_digitize(x, array(0D, 0.2D, 0.6D))", C.digitize(F.col("x"), [0, 0.2, 0.6]))
    kept = df.where("NOT isnan(x)")
    same(kept, "cohort_decade_bin(x)", C.decade_bin(F.col("x")))
    same(kept, "cohort_round_to(x / 7)", C.round_to(F.col("x") / 7, 4))


def test_texts(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    same(df, "cohort_range_mean(t)", C.parse_range_mean(F.col("t")))
    same(df, "cohort_ieq(t, ' SEX_M')", C.ieq(F.col("t"), " SEX_M"))
    same(df, "cohort_strip_prefix(t, 'Sex_')", C.strip_prefix(F.col("t"), "Sex_"))


def test_labels(spark):
    df = spark.createDataFrame([(a, b) for a in (None, 0, 1, 2) for b in (None, 0, 1)], "a int, b int")
    same(df, "cohort_combo_label(a, b)", C.combo_label(F.col("a"), F.col("b")))
    same(df, "cohort_code_label(a, map(1, 'one'), 'other')", C.code_label(F.col("a"), {1: "one"}, "other"))


@pytest.mark.parametrize("report, key, having", [
    (reports.summary_by_department, "department", ""),
    (reports.summary_by_occupation, "occupation", ""),
    (reports.summary_by_municipality, "municipality", ""),
])
def test_reports_as_sql(spark, report, key, having):
    people, model = patients(spark, SF), M.individual_model()
    scored = score(prepare_patients(people, AS_OF), model, impute_scope="cohort", keys=[key])
    by_api = report(people, model, as_of=AS_OF)
    names = [c for c in ("n_patients", "avg_risk", "risk_band") if c in by_api.columns]
    assert len(names) == 3 and key in by_api.columns
    by_sql = spark.sql(
        f"SELECT {key}, count(*) AS n_patients, cohort_round_to(avg(score)) AS avg_risk, cohort_risk_band(avg(score)) AS risk_band "
        f"FROM {{scored}} WHERE {key} IS NOT NULL GROUP BY {key} {having}", scored=scored)
    rows = lambda df: sorted((r[0], r[1], round(r[2], 3), r[3]) for r in df.select(key, *names).collect())
    assert rows(by_sql) == rows(by_api) and rows(by_api)
