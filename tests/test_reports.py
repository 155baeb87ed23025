import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortwise.operators import joins
from cohortwise.operators.benchmark import benchmark_compare
from cohortwise.operators.evaluation import (
    equal_width_edges, error_by_range, histograms, prediction_points, regression_metrics, residual_histogram,
)
from cohortwise.operators.filters import has_date, match_profile
from cohortwise.operators.joins import duplicate_municipalities, unique_municipalities, with_geography
from cohortwise.operators.population import group_population, population_risk, population_risk_of, score_groups
from cohortwise.operators.features import prepare_patients
from cohortwise.operators.scoring import score, score_patients_explained
from cohortwise.plans import driver_model as M, reports
from cohortwise.plans.driver_views import AS_OF, municipalities, patients

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def people(spark):
    return patients(spark, SF).cache()


@pytest.fixture(scope="module")
def places(spark):
    return municipalities(spark, SF).cache()


LINEAR, NETWORK = M.individual_model(), M.network_model()


@pytest.mark.parametrize("model", [LINEAR, NETWORK], ids=["linear", "network"])
@pytest.mark.parametrize("scope", ["cohort", "training"])
def test_place_reports_equal_the_row_join(spark, people, places, model, scope):
    """Summing per municipality and joining the sums gives what joining the patients gives."""
    found = reports.profile_by_temperature(people, places, model, impute_scope=scope, as_of=AS_OF).collect()
    rows = prepare_patients(with_geography(people, places), AS_OF)
    columns = [c for c in places.columns if c not in ("department", "municipality")]
    label = reports.cut(F.col("average_temperature"), (10, 15, 20, 25, 30), ["10-15°C", "15-20°C", "20-25°C", "25-30°C"], include_lowest=True)
    rows = rows.withColumn("bin", label).where("bin IS NOT NULL")
    scored = score(rows, model, scope, ["bin"], also_required=columns)
    wanted = {r.bin: r for r in scored.groupBy("bin").agg(
        F.count("*").alias("n"), F.avg("score").alias("risk"), F.avg("bmi").alias("bmi")).collect()}
    assert [r.temperature_range for r in found] == ["10-15°C", "15-20°C", "20-25°C", "25-30°C"]
    for r in found:
        assert r.n_patients == wanted[r.temperature_range].n
        assert r.avg_risk == pytest.approx(wanted[r.temperature_range].risk, abs=5e-5)
        assert r.avg_bmi == pytest.approx(wanted[r.temperature_range].bmi, abs=5e-3)


@pytest.mark.parametrize("scope", ["cohort", "training"])
def test_precipitation_network_equals_linear_counts(people, places, scope):
    one = reports.profile_by_precipitation(people, places, LINEAR, impute_scope=scope, as_of=AS_OF).collect()
    two = reports.profile_by_precipitation(people, places, NETWORK, impute_scope=scope, as_of=AS_OF).collect()
    seen = [[(r.precipitation_range, r.n_patients, r.avg_temperature, r.avg_altitude) for r in rows] for rows in (one, two)]
    assert seen[0] == seen[1]
    # Places lie in four bins, on both sides of the edges 500, 1000 and 2500.
    assert [r[0] for r in seen[0]] == ["500-1000mm", "1000-1500mm", "1500-2000mm", "2000-2500mm"]


def test_infrastructure_paths_agree(people):
    """The network's unpivoted rows and the linear model's unpivoted sums count the same people."""
    def sizes(model, scope):
        found = reports.profile_by_infrastructure(people, model, impute_scope=scope, as_of=AS_OF)
        return [(r.indicator, r.access_code, r.n_patients, r.avg_bmi, r.access) for r in found.collect()]
    assert sizes(LINEAR, "cohort") == sizes(NETWORK, "cohort") == sizes(LINEAR, "training")
    assert len(sizes(LINEAR, "cohort")) == 8


def test_missing_flag_leaves_only_its_own_report(people):
    some = people.withColumn("has_gas", F.when(F.col("patient_id") % 3 != 0, F.col("has_gas")))
    found = reports.profile_by_infrastructure(some, LINEAR, as_of=AS_OF).groupBy("indicator").agg(F.sum("n_patients").alias("n"))
    sizes = {r.indicator: r.n for r in found.collect()}
    assert sizes["has_internet"] == people.count()
    assert sizes["has_gas"] == some.where("has_gas IS NOT NULL").count()


def test_column_check_comes_first(people):
    with pytest.raises(ValueError, match="has_gas"):
        reports.profile_by_infrastructure(people.drop("has_gas"), LINEAR)
    with pytest.raises(ValueError, match="occupation"):
        reports.summary_by_occupation(people.drop("occupation"), LINEAR)


def test_distribution_sums_to_hundred(people):
    long = reports.distribution_by_year(people, "occupation")
    for r in long.groupBy("diagnosis_year").agg(F.sum("percentage").alias("p")).collect():
        assert r.p == pytest.approx(100, abs=0.05)
    nested = reports.distribution_map_by_year(people, "occupation").collect()
    flat = {(r.diagnosis_year, r.value): r.percentage for r in long.collect()}
    assert {(r.diagnosis_year, k): v for r in nested for k, v in r.percentages.items()} == flat
    numbers = reports.distribution_map_by_year(people, "heart_rate").collect()
    assert all(sum(r.percentages.values()) == pytest.approx(100, abs=0.5) for r in numbers)


def test_bands_cover_everybody(people):
    assert reports.summary_by_age_band(people, LINEAR, as_of=AS_OF).agg(F.sum("n_patients")).first()[0] == people.count()
    assert reports.patients_per_year(people).agg(F.sum("n_patients")).first()[0] == has_date(people).count()


def test_risk_distribution_outside_all_bins(people):
    rows = reports.risk_distribution(people, LINEAR, edges=[5.0, 6.0, 7.0], as_of=AS_OF).collect()
    assert [(r.risk_range, r.n, r.percentage) for r in rows] == [("5-6", 0, 0.0), ("6-7", 0, 0.0)]


def test_municipality_names_can_be_kept_apart(people):
    doubled = people.unionByName(people.withColumn("department", F.lit("OTHER")))
    merged = reports.summary_by_municipality(doubled, LINEAR, as_of=AS_OF)
    apart = reports.summary_by_municipality(doubled, LINEAR, with_department=True, as_of=AS_OF)
    assert apart.count() == 2 * merged.count()


# --- geography ------------------------------------------------------------------------------


def test_duplicate_places_do_not_fan_out(spark):
    rows = [("A", "x", 2.0), ("A", "x", 1.0), ("B", "y", 3.0)]
    dimension = spark.createDataFrame(rows, "Department string, Municipality string, average_temperature double")
    people = spark.createDataFrame([(1, "A", "x"), (2, "B", "y"), (3, "C", "z")], "id int, department string, municipality string")
    assert sorted(map(tuple, unique_municipalities(dimension).collect())) == [("A", "x", 1.0), ("B", "y", 3.0)]
    assert [tuple(r) for r in duplicate_municipalities(dimension).collect()] == [("A", "x", 2)]
    assert sorted((r.id, r.average_temperature) for r in with_geography(people, dimension).collect()) == [(1, 1.0), (2, 3.0), (3, None)]


def test_population_groups(spark, people, places):
    groups = group_population(people, places)
    joined = with_geography(people, places).where("climate_classification IS NOT NULL")
    assert groups.agg(F.sum("n_patients")).first()[0] == joined.count()
    assert groups.where("annual_precipitation IS NULL").count() > 0
    risk = {r.municipality: r for r in population_risk(groups, M.population_model()).collect()}
    for scope in ("cohort", "training"):
        scored = score_groups(groups, M.population_model(), scope)
        plain = scored.groupBy("municipality").agg(F.count("*").alias("n"), F.avg("risk_estimate").alias("r"))
        fast = {r.municipality: r for r in population_risk(groups, M.population_model(), scope).collect()}
        for r in plain.collect():
            assert fast[r.municipality].n_groups == r.n
            if r.r is None:
                assert fast[r.municipality].avg_risk is None
            else:
                assert fast[r.municipality].avg_risk == pytest.approx(r.r, abs=5e-5)
    one = population_risk_of(groups, " nation_20 ", M.population_model())
    assert one.count() == risk["NATION_20"].n_groups
    assert one.columns[-1] == "risk_estimate"


# --- benchmark ------------------------------------------------------------------------------


def test_benchmark(spark):
    population = spark.createDataFrame(
        [("M", 30.0 + i % 10, 2, 0.5) for i in range(12)] + [("F", 35.0, 2, 0.9)] * 5
        + [("M", 39.5, 2, 100.0), ("M", 35.0, 2, None)],
        "sex string, age double, socioeconomic_status int, risk_score double",
    )
    asked = spark.createDataFrame(
        [(1, "masculino", 34, 2, 0.7), (2, "F", 31, 2, 0.2), (3, "M", 80, 2, 0.3)],
        "id int, sex string, age int, socioeconomic_status int, score double",
    )
    rows = {r.id: r for r in benchmark_compare(asked, population).collect()}
    assert (rows[1].n_peers, rows[1].benchmark_risk, rows[1].difference) == (12, 0.5, 0.2)
    assert rows[1].benchmark_group == "Masculino, edad 30-39, estrato 2"
    assert (rows[1].patient_band, rows[1].benchmark_band) == ("Alto", "Moderado")
    assert (rows[2].n_peers, rows[2].benchmark_risk, rows[2].difference) == (5, None, None)
    assert (rows[3].n_peers, rows[3].benchmark_risk) == (0, None)
    everybody = {r.id: r for r in benchmark_compare(asked, population, False, False, False).collect()}
    assert everybody[3].n_peers == 18 and everybody[3].benchmark_group == "All patients"
    assert match_profile(population, "M", 34, 2).count() == 13
    assert match_profile(population).count() == population.count()


# --- evaluation -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def predictions(spark):
    rng = np.random.default_rng(4)
    y = rng.random(1500)
    p = y + rng.normal(0, 0.1, 1500)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(y, p))] + [(-1, 0.5, None), (-2, None, 0.5)]
    return spark.createDataFrame(rows, "id int, risk_score double, score double").cache(), y, p


def test_metrics(spark, predictions):
    df, y, p = predictions
    row = regression_metrics(df).first()
    assert row.n == 1500
    assert row.mse == pytest.approx(np.mean((y - p) ** 2))
    assert row.mae == pytest.approx(np.mean(np.abs(y - p)))
    assert row.r2 == pytest.approx(1 - np.sum((y - p) ** 2) / np.sum((y - y.mean()) ** 2))
    flat = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "risk_score double, score double")
    assert regression_metrics(flat).first().r2 == 1.0


def test_histograms_match_numpy(predictions):
    df, y, p = predictions
    found = residual_histogram(df, n=30).orderBy("variable", "bin").collect()
    for name, x in (("residual", y - p), ("truth", y), ("prediction", p)):
        counts, edges = np.histogram(x, 30)
        rows = [r for r in found if r.variable == name]
        assert [r.n for r in rows] == counts.tolist()
        assert [r.low for r in rows] == pytest.approx(edges[:-1])


def test_histogram_of_one_value_and_of_none(spark):
    df = spark.createDataFrame([(3.0, None), (3.0, None)], "x double, y double")
    rows = histograms(df, {"x": F.col("x"), "y": F.col("y")}, 4).orderBy("bin").collect()
    assert [(r.variable, r.n) for r in rows] == [("x", 0), ("x", 0), ("x", 2), ("x", 0)]
    assert [r.n for r in rows] == np.histogram([3.0, 3.0], 4)[0].tolist()


@pytest.mark.parametrize("options", [{}, {"read_out_rows": 7}])
def test_error_by_range_matches_pandas(predictions, options):
    df, y, p = predictions
    frame = pd.DataFrame({"y": y, "e": np.abs(y - p)})
    frame["range"] = pd.cut(frame.y, bins=5, include_lowest=True).cat.codes
    found = error_by_range(df, **options).orderBy("range_idx").collect()
    for r, (code, group) in zip(found, frame.groupby("range"), strict=True):
        q1, median, q3 = np.percentile(group.e, [25, 50, 75])
        inside = group.e[(group.e >= q1 - 1.5 * (q3 - q1)) & (group.e <= q3 + 1.5 * (q3 - q1))]
        assert (r.range_idx, r.n, r.n_outliers) == (code, len(group), len(group) - len(inside))
        assert (r.q1, r.median, r.q3) == pytest.approx((q1, median, q3))
        assert (r.whisker_low, r.whisker_high) == pytest.approx((inside.min(), inside.max()))
        assert (r.min_error, r.max_error) == pytest.approx((group.e.min(), group.e.max()))


def test_equal_width_edges_match_pandas():
    for x in ([0.0, 10.0], [4.0, 4.0], [0.0, 0.0]):
        _, edges = pd.cut(x, bins=5, retbins=True, include_lowest=True)
        assert equal_width_edges(min(x), max(x), 5, True) == pytest.approx(edges)


def test_points(predictions):
    df, y, _ = predictions
    assert prediction_points(df).count() == 1500
    some = prediction_points(df, fraction=0.3, row_key=["id"])
    again = prediction_points(df.repartition(5), fraction=0.3, row_key=["id"])
    assert 350 < some.count() < 550
    assert {r.id for r in some.collect()} == {r.id for r in again.collect()}


# --- explanation ----------------------------------------------------------------------------


def test_explained_rows(people):
    rows = score_patients_explained(prepare_patients(people, AS_OF), LINEAR)
    assert rows.count() == people.count()
    assert rows.where("NOT is_scorable AND (score IS NOT NULL OR top_factors IS NOT NULL)").count() == 0
    assert rows.where("is_scorable AND size(top_factors) = 5").count() == rows.where("is_scorable").count()
