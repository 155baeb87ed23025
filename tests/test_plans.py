"""What the physical plans must look like at any size."""

import re

import pytest
from pyspark.sql import functions as F

from cohortwise.operators.cohorts import cohort_summary
from cohortwise.operators.features import prepare_patients
from cohortwise.operators.population import group_population
from cohortwise.operators.scoring import score
from cohortwise.plans import driver_model as M, reports
from cohortwise.plans.driver_views import AS_OF, municipalities, patients

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Patients and places as tables of their own, as a user has them."""
    folder = tmp_path_factory.mktemp("stored")
    patients(spark, SF).write.parquet(str(folder / "patients"))
    municipalities(spark, SF).write.parquet(str(folder / "places"))
    return spark.read.parquet(str(folder / "patients")), spark.read.parquet(str(folder / "places"))


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df) -> int:
    return len(re.findall(r"Exchange hashpartitioning", plan(df)))


@pytest.mark.parametrize("factors", [0, 5])
def test_cohort_report_shuffles_only_partial_sums(stored, factors):
    rows = prepare_patients(stored[0], AS_OF)
    text = plan(cohort_summary(rows, "department", M.individual_model(), factors=factors))
    assert text.count("Exchange hashpartitioning") == 1
    assert "Join" not in text and "Python" not in text and "Window" not in text
    below = text[text.index("Exchange hashpartitioning"):]
    assert "partial_count" in below


def test_long_lists_cost_no_more_scans(stored, monkeypatch):
    """One scan of the patients and one shuffle of sums more, however long the lists are."""
    from cohortwise.operators import cohorts, scoring

    def scans(limit):
        for module in (cohorts, scoring):
            monkeypatch.setattr(module, "MAP_CATEGORIES", limit)
        return plan(reports.summary_by_department(stored[0], M.individual_model(), as_of=AS_OF)).count("FileScan")

    assert scans(64) == scans(3) == scans(1) == 1


def test_factors_of_combined_cohorts_do_not_depend_on_list_length(stored, monkeypatch):
    from cohortwise.operators import cohorts, scoring

    def found(limit):
        for module in (cohorts, scoring):
            monkeypatch.setattr(module, "MAP_CATEGORIES", limit)
        df = reports.profile_by_infrastructure(stored[0], M.individual_model(), as_of=AS_OF, factors=3)
        return [(r.indicator, r.access_code, [(f.feature, round(f.value, 9)) for f in r.top_factors]) for r in df.collect()]

    assert found(64) == found(3)


def test_scoring_a_linear_model_moves_nothing(stored):
    text = plan(score(prepare_patients(stored[0], AS_OF), M.individual_model()))
    assert "Exchange" not in text and "Python" not in text


def test_network_ships_only_its_inputs(stored):
    text = plan(score(prepare_patients(stored[0], AS_OF), M.network_model()))
    assert text.count("ArrowEvalPython") >= 1 and "Exchange" not in text


def test_place_report_joins_sums_not_patients(stored):
    text = plan(reports.profile_by_temperature(*stored, M.individual_model(), as_of=AS_OF))
    join = text.index("Join")
    assert "total_cholesterol" not in text[:join].replace("m_sum_", "")
    assert "HashAggregate" in text[join:]


def test_population_groups_join_after_grouping(stored):
    text = plan(group_population(*stored))
    assert text.index("Join") < text.index("partial_avg")


def test_unused_columns_are_not_read(stored):
    text = plan(reports.patients_per_year(stored[0]))
    assert re.search(r"ReadSchema: struct<diagnosis_date:timestamp\w*>", text)
    text = plan(reports.distribution_by_year(stored[0], "occupation"))
    assert set(re.findall(r"ReadSchema: struct<([^>]*)>", text)) == {"occupation:string,diagnosis_date:timestamp_ntz"}
    assert "Window" not in text


def test_filter_reaches_the_scan(stored):
    text = plan(cohort_summary(prepare_patients(stored[0], AS_OF), "occupation", M.individual_model()))
    assert re.search(r"PushedFilters: \[IsNotNull\(occupation\)\]", text)


def test_view_joins_only_what_it_reads(spark):
    assert "Join" not in plan(patients(spark, SF, ["patient_id", "age", "has_gas"]))
    assert plan(patients(spark, SF, ["occupation"])).count("Join") == 1


def test_no_cross_join_anywhere(stored):
    rows = prepare_patients(stored[0], AS_OF)
    for df in (
        reports.risk_distribution(stored[0], M.individual_model(), as_of=AS_OF),
        score(rows, M.individual_model(), "cohort", ["department"]),
    ):
        assert "Cartesian" not in plan(df) and "NestedLoop" not in plan(df)
