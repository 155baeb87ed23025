"""The registered queries over the supplied tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from ..fixed_values import AGE_EDGES, AGE_LABELS, EDUCATION_LABELS, TARGET_EDGES, UNKNOWN_LABEL
from ..functions import (
    code_label, combo_label, cut, date_parts, decade_bin, digitize, parse_date, parse_range_mean,
    period_flag, risk_band, round_to, sql_text,
)
from ..operators import evaluation, features, filters, importance, population, scoring, splits, training
from ..operators.benchmark import benchmark_compare
from ..operators.cohorts import cohort_summary
from ..operators.filters import match_profile
from ..operators.joins import duplicate_municipalities, with_geography
from ..schemas import PATIENTS as PATIENTS_SCHEMA
from ..sources.readers import apply_schema, require_columns, with_defaults
from . import driver_model as M, driver_sql as S, reports
from .fit_report import fit_and_report
from .driver_views import AS_OF, municipalities, patients

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run
    return register


def _rows(spark, sf_dir, columns=None) -> DataFrame:
    return features.prepare_patients(patients(spark, sf_dir, columns), AS_OF)


# --- counts and distributions ---------------------------------------------------------------


@query("patients_per_year", S.with_(S.PATIENTS) + (
    "SELECT CAST(year(diagnosis_date) AS INT) AS diagnosis_year, CAST(count(*) AS BIGINT) AS n_patients "
    "FROM patients_v WHERE diagnosis_date IS NOT NULL GROUP BY 1"
))
def patients_per_year(spark, sf_dir):
    return reports.patients_per_year(patients(spark, sf_dir, ["diagnosis_date"]))


def _distribution_sql(feature: str) -> str:
    return S.with_(S.BASE, (
        f"counts AS (SELECT diagnosis_year, CAST({feature} AS VARCHAR) AS value, CAST(count(*) AS BIGINT) AS n "
        f"FROM prep WHERE diagnosis_year IS NOT NULL AND {feature} IS NOT NULL GROUP BY ALL)"
    )) + (
        "SELECT diagnosis_year, value, n, "
        "round(n / CAST(sum(n) OVER (PARTITION BY diagnosis_year) AS DOUBLE) * 100.0, 2) AS percentage FROM counts"
    )


@query("distribution_by_year", _distribution_sql("occupation"))
def distribution_by_year(spark, sf_dir):
    return reports.distribution_by_year(patients(spark, sf_dir, ["occupation", "diagnosis_date"]), "occupation")


@query("distribution_by_year_heart_rate", _distribution_sql("heart_rate"))
def distribution_by_year_heart_rate(spark, sf_dir):
    return reports.distribution_by_year(patients(spark, sf_dir, ["heart_rate", "diagnosis_date"]), "heart_rate")


@query("distribution_map_by_year", S.with_(S.BASE, (
    "counts AS (SELECT diagnosis_year, sex AS value, count(*) AS n FROM prep WHERE diagnosis_year IS NOT NULL GROUP BY ALL)"
)) + (
    "SELECT diagnosis_year, round(sum(CASE WHEN value = 'F' THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE) * 100.0, 2) AS f_share, "
    "round(sum(CASE WHEN value = 'M' THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE) * 100.0, 2) AS m_share "
    "FROM counts GROUP BY diagnosis_year"
))
def distribution_map_by_year(spark, sf_dir):
    nested = reports.distribution_map_by_year(patients(spark, sf_dir, ["sex", "diagnosis_date"]), "sex")
    return nested.select(
        "diagnosis_year", F.col("percentages")["F"].alias("f_share"), F.col("percentages")["M"].alias("m_share")
    )


# --- cohort summaries -----------------------------------------------------------------------


def _summary(name: str, report, sql: str, network: bool = False, **options):
    @query(name, sql)
    def run(spark, sf_dir):
        model = M.network_model() if network else M.individual_model()
        return report(patients(spark, sf_dir), model, as_of=AS_OF, **options)


_summary("cohort_by_occupation", reports.summary_by_occupation, S.cohort_sql(["occupation"]))
_summary("cohort_by_stratum", reports.summary_by_stratum, S.cohort_sql(["socioeconomic_status"]))
_summary("cohort_by_education", reports.summary_by_education, S.cohort_sql(["education_level"]))
_summary("cohort_by_age_band", reports.summary_by_age_band, S.cohort_sql(["age_band"], S.AGE_BAND, min_rows=0))
_summary("cohort_by_quarter", reports.summary_by_quarter, S.cohort_sql(["diagnosis_trimester"], min_rows=0))
_summary("cohort_by_year", reports.summary_by_year, S.cohort_sql(["diagnosis_year"], min_rows=0))
_summary(
    "cohort_by_department_year", reports.summary_by_place_and_year,
    S.cohort_sql(["department", "diagnosis_year"], min_rows=0), level="department",
)
_summary(
    "cohort_by_municipality_year", reports.summary_by_place_and_year,
    S.cohort_sql(["municipality", "diagnosis_year"], min_rows=0), level="municipality",
)
_summary(
    "cohort_by_year_of_department", reports.summary_by_year,
    S.with_(S.BASE, "keyed AS (SELECT * FROM prep WHERE upper(trim(department)) = 'ASIA')",
            S.scored("keyed", "diagnosis_year"))
    + f"SELECT diagnosis_year, {S.RISK} FROM scored WHERE diagnosis_year IS NOT NULL GROUP BY diagnosis_year",
    department=" asia ",
)
_summary(
    "cohort_by_year_of_municipality", reports.summary_by_year,
    S.with_(S.BASE, "keyed AS (SELECT * FROM prep WHERE upper(trim(municipality)) = 'NATION_3')",
            S.scored("keyed", "diagnosis_year"))
    + f"SELECT diagnosis_year, {S.RISK} FROM scored WHERE diagnosis_year IS NOT NULL GROUP BY diagnosis_year",
    municipality="nation_3",
)


def _scores_by(name: str, key: str, scope: str, network: bool = False):
    sql = S.cohort_sql([key], cohort=scope == "cohort", network=network)

    @query(name, sql)
    def run(spark, sf_dir):
        model = M.network_model() if network else M.individual_model()
        return cohort_summary(_rows(spark, sf_dir), key, model, impute_scope=scope)


_summary(
    "cohort_by_municipality_year_large", reports.summary_by_place_and_year,
    S.cohort_sql(["municipality", "diagnosis_year"], min_rows=80), level="municipality", min_rows=80,
)
_scores_by("linear_score_by_department", "department", "cohort")
_scores_by("linear_score_by_municipality", "municipality", "cohort")
_scores_by("linear_score_by_department_training", "department", "training")
_scores_by("network_score_by_department", "department", "cohort", network=True)
_scores_by("network_score_by_municipality_training", "municipality", "training", network=True)

# --- profiles -------------------------------------------------------------------------------

_summary("profile_by_stratum", reports.profile_by_stratum, S.cohort_sql(["socioeconomic_status"], measures=S.PROFILE))
_summary(
    "profile_by_education", reports.profile_by_education,
    S.cohort_sql(["education_level"], measures=S.PROFILE, more=f"{S.EDUCATION} AS education_label"),
)
_summary("profile_by_infrastructure", reports.profile_by_infrastructure, S.infrastructure_sql())
_summary(
    "profile_by_area", reports.profile_by_area,
    S.cohort_sql(["rural_area"], measures=S.PROFILE, more="CASE rural_area WHEN 'U' THEN 'Urbano' ELSE 'Rural' END AS area"),
)
_summary(
    "profile_by_smoker_diabetes", reports.profile_by_smoker_diabetes,
    S.cohort_sql(
        ["smoker_diabetes"],
        "CASE WHEN is_smoker = 1 THEN 'Fumador' ELSE 'No Fumador' END || ' / ' || "
        "CASE WHEN diabetes = 1 THEN 'Diabético' ELSE 'No Diabético' END", measures=S.PROFILE_AVG,
    ),
)


@query("profile_by_temperature", S.place_sql("average_temperature", "temperature_range", *S.TEMPERATURE, S.PROFILE, False))
def profile_by_temperature(spark, sf_dir):
    return reports.profile_by_temperature(
        patients(spark, sf_dir), municipalities(spark, sf_dir), M.individual_model(), as_of=AS_OF
    )


@query("profile_by_precipitation", S.place_sql(
    "annual_precipitation", "precipitation_range", *S.PRECIPITATION,
    "round(avg(average_temperature), 2) AS avg_temperature, round(avg(average_altitude), 2) AS avg_altitude", True,
))
def profile_by_precipitation(spark, sf_dir):
    return reports.profile_by_precipitation(
        patients(spark, sf_dir), municipalities(spark, sf_dir), M.individual_model(), as_of=AS_OF
    )


def _risk_distribution_sql(department: str | None) -> str:
    where = f"WHERE upper(department) = '{department.upper()}'" if department else ""
    return S.with_(
        S.BASE, f"keyed AS (SELECT * FROM prep {where})", S.scored("keyed", ""),
        f"binned AS (SELECT {S.bins('score', (0.2, 0.4, 0.6, 0.8), (0, 1, 2))} AS bin FROM scored)",
        "labels AS (SELECT * FROM (VALUES (0, '0.2-0.4'), (1, '0.4-0.6'), (2, '0.6-0.8')) t(bin, risk_range))",
        "counts AS (SELECT bin, count(*) AS n FROM binned WHERE bin IS NOT NULL GROUP BY bin)",
    ) + (
        f"SELECT '{department or 'Global'}' AS department, CAST(labels.bin AS INT) AS bin, risk_range, "
        "CAST(coalesce(n, 0) AS BIGINT) AS n, "
        "round(coalesce(n, 0) * 100.0 / (SELECT CAST(sum(n) AS DOUBLE) FROM counts), 2) AS percentage "
        "FROM labels LEFT JOIN counts USING (bin)"
    )


_summary("risk_distribution", reports.risk_distribution, _risk_distribution_sql(None))
_summary("risk_distribution_of_department", reports.risk_distribution, _risk_distribution_sql("EUROPE"), department="EUROPE")

# --- factors --------------------------------------------------------------------------------


def _top_factors(name: str, report, key: str):
    @query(name, S.factors_sql(key, 5))
    def run(spark, sf_dir):
        found = report(patients(spark, sf_dir), M.individual_model(), as_of=AS_OF)
        return scoring.explode_factors(found, [key]).withColumn("value", round_to(F.col("value"), 4))


_top_factors("top_factors_by_department", reports.summary_by_department, "department")
_top_factors("top_factors_by_municipality", reports.summary_by_municipality, "municipality")


_LONG = "concat('B', CAST(patient_id % 97 AS VARCHAR(5)))"


@query("top_factors_of_long_lists", S.factors_sql(
    "department", 40, categories=M.LONG_CATEGORY_WEIGHTS, replaced=f"{_LONG} AS occupation"
))
def top_factors_of_long_lists(spark, sf_dir):
    people = patients(spark, sf_dir).withColumn("occupation", F.expr(_LONG))
    found = reports.summary_by_department(people, M.long_list_model(), top=40, as_of=AS_OF)
    return scoring.explode_factors(found, ["department"]).withColumn("value", round_to(F.col("value"), 4))


@query("factors_of_department", S.factors_sql("place", 10, "upper(trim(department)) = 'AFRICA'", "upper(department)"))
def factors_of_department(spark, sf_dir):
    found = reports.factors_by_place(
        patients(spark, sf_dir), M.individual_model(), "department", "africa", as_of=AS_OF
    )
    return found.withColumn("value", round_to(F.col("value"), 4))


@query("factors_of_municipality", S.factors_sql("place", 10, "upper(trim(municipality)) = 'NATION_21'", "upper(municipality)"))
def factors_of_municipality(spark, sf_dir):
    found = reports.factors_by_place(
        patients(spark, sf_dir), M.individual_model(), "municipality", "Nation_21", as_of=AS_OF
    )
    return found.withColumn("value", round_to(F.col("value"), 4))


@query("patient_explained", S.explained_sql())
def patient_explained(spark, sf_dir):
    explained = scoring.score_patients_explained(_rows(spark, sf_dir), M.individual_model())
    return scoring.explode_factors(explained, ["patient_id", "score", "risk_band"])


# --- benchmark ------------------------------------------------------------------------------


def _benchmark(name: str, by_sex: bool, by_age_group: bool, by_status: bool, min_rows: int = 10):
    keys, text = [], []
    if by_sex:
        keys.append("sex")
        text.append("sex")
    if by_age_group:
        keys.append("decade")
        text.append("'edad ' || decade || '-' || (decade + 9)")
    if by_status:
        keys.append("socioeconomic_status")
        text.append("'estrato ' || socioeconomic_status")
    label = f"concat_ws(', ', {', '.join(text)})"
    label = f"upper({label}[1]) || lower({label}[2:])" if text else "'All patients'"
    group = f"GROUP BY {', '.join(keys)}" if keys else ""
    chosen = "".join(f"{k}, " for k in keys)
    join = f"LEFT JOIN peers USING ({', '.join(keys)})" if keys else "LEFT JOIN peers ON TRUE"
    enough = f"CASE WHEN n_peers >= {min_rows} THEN peer_risk END"
    sql = S.with_(
        S.BASE, S.scored("prep", None),
        "aged AS (SELECT *, CAST(floor(age / 10) * 10 AS INT) AS decade FROM scored)",
        f"peers AS (SELECT {chosen}count(*) AS n_peers, avg(risk_score) AS peer_risk FROM aged WHERE risk_score IS NOT NULL {group})",
    ) + (
        f"SELECT patient_id, round(score, 4) AS score, {S.band('score')} AS patient_band, {label} AS benchmark_group, "
        f"round({enough}, 4) AS benchmark_risk, {S.band('(' + enough + ')')} AS benchmark_band, "
        f"CAST(coalesce(n_peers, 0) AS BIGINT) AS n_peers, round(score - {enough}, 4) + 0.0 AS difference FROM aged {join}"
    )

    @query(name, sql)
    def run(spark, sf_dir):
        scored = scoring.score(_rows(spark, sf_dir), M.individual_model())
        people = patients(spark, sf_dir, ["sex", "age", "socioeconomic_status", "risk_score"])
        return benchmark_compare(scored, people, by_sex, by_age_group, by_status, min_rows).select(
            "patient_id", "score", "patient_band", "benchmark_group", "benchmark_risk", "benchmark_band",
            "n_peers", "difference",
        )


_benchmark("benchmark_compare", True, True, True)
_benchmark("benchmark_compare_large_groups", True, True, True, 100)
_benchmark("benchmark_compare_by_age", False, True, False)
_benchmark("benchmark_compare_with_all", False, False, False)


@query("match_profile", S.with_(S.PATIENTS) + (
    "SELECT CAST(count(*) AS BIGINT) AS n_peers, round(avg(risk_score), 4) AS avg_risk FROM patients_v "
    "WHERE sex = 'F' AND age BETWEEN 30 AND 39 AND socioeconomic_status = 2"
))
def profile_match(spark, sf_dir):
    people = patients(spark, sf_dir, ["sex", "age", "socioeconomic_status", "risk_score"])
    return match_profile(people, "F", 34, 2).agg(
        F.count("*").alias("n_peers"), round_to(F.avg("risk_score"), 4).alias("avg_risk")
    )


# --- population -----------------------------------------------------------------------------

_ROUNDED = ", ".join(f"round({c}, 4) AS {c}" for c in S.GROUP_MEANS)


@query("population_groups", S.with_(S.groups()) + (
    f"SELECT {S.GROUP_KEYS}, {_ROUNDED}, {', '.join(S.GROUP_PLACE)}, n_patients FROM grouped"
))
def population_groups(spark, sf_dir):
    groups = population.group_population(patients(spark, sf_dir), municipalities(spark, sf_dir))
    return groups.withColumns({c: round_to(F.col(c), 4) for c in S.GROUP_MEANS})


@query("population_risk", S.with_(S.population_scored()) + (
    "SELECT municipality, CAST(count(*) AS BIGINT) AS n_groups, round(avg(risk_estimate), 4) AS avg_risk, "
    f"{S.band('avg(risk_estimate)')} AS risk_band FROM gscored GROUP BY municipality"
))
def population_risk(spark, sf_dir):
    groups = population.group_population(patients(spark, sf_dir), municipalities(spark, sf_dir))
    return population.population_risk(groups, M.population_model())


@query("population_risk_of_municipality", S.with_(S.population_scored()) + (
    "SELECT rural_area, socioeconomic_status, ethnicity, occupation, education_level, climate_classification, "
    "round(risk_estimate, 4) AS risk_estimate FROM gscored WHERE municipality = 'NATION_20'"
))
def population_risk_of_municipality(spark, sf_dir):
    groups = population.group_population(patients(spark, sf_dir), municipalities(spark, sf_dir))
    found = population.population_risk_of(groups, " nation_20", M.population_model())
    return found.withColumn("risk_estimate", round_to(F.col("risk_estimate"), 4))


@query("patients_with_geography", S.with_(S.PATIENTS, S.MUNICIPALITIES) + (
    "SELECT patient_id, department, municipality, average_temperature, climate_classification "
    "FROM patients_v LEFT JOIN municipalities_v USING (department, municipality)"
))
def patients_with_geography(spark, sf_dir):
    people = patients(spark, sf_dir, ["patient_id", "department", "municipality"])
    return with_geography(people, municipalities(spark, sf_dir)).select(
        "patient_id", "department", "municipality", "average_temperature", "climate_classification"
    )


# --- columns --------------------------------------------------------------------------------


@query("patient_columns", S.with_(S.BASE) + (
    "SELECT patient_id, CAST(diagnosis_year AS VARCHAR) AS diagnosis_year, CAST(diagnosis_month AS VARCHAR) AS diagnosis_month, "
    "diagnosis_trimester, CAST(days_since_diagnosis AS VARCHAR) AS days_since_diagnosis, pandemic_period, "
    f"CASE WHEN diagnosis_year IN (1996, 1999) THEN 1 ELSE 0 END AS period, {S.band('risk_score')} AS band, "
    f"{S.AGE_BAND} AS age_band, {S.target_bin('risk_score')} AS target_bin, CAST(floor(age / 10) * 10 AS INT) AS decade, "
    "CASE WHEN is_smoker = 1 THEN 'Fumador' ELSE 'No Fumador' END || ' / ' || "
    f"CASE WHEN diabetes = 1 THEN 'Diabético' ELSE 'No Diabético' END AS combo, {S.EDUCATION} AS education FROM prep"
))
def patient_columns(spark, sf_dir):
    rows = _rows(spark, sf_dir, [
        "patient_id", "diagnosis_date", "risk_score", "age", "is_smoker", "diabetes", "education_level",
    ])
    return rows.select(
        "patient_id", F.col("diagnosis_year").cast("string"), F.col("diagnosis_month").cast("string"),
        "diagnosis_trimester", F.col("days_since_diagnosis").cast("string"),
        "pandemic_period", period_flag(F.col("diagnosis_year"), (1996, 1999)).alias("period"),
        risk_band(F.col("risk_score")).alias("band"),
        cut(F.col("age"), AGE_EDGES, AGE_LABELS, right=False).alias("age_band"),
        digitize(F.col("risk_score"), TARGET_EDGES).alias("target_bin"),
        decade_bin(F.col("age")).alias("decade"),
        combo_label(F.col("is_smoker"), F.col("diabetes")).alias("combo"),
        code_label(F.col("education_level"), EDUCATION_LABELS, UNKNOWN_LABEL).alias("education"),
    )


_RANGE_TEXT = (
    "CASE o_orderkey % 7 WHEN 0 THEN concat(CAST(o_custkey AS VARCHAR(20)), '-', CAST(o_custkey + 501 AS VARCHAR(20))) "
    "WHEN 1 THEN concat(' ', CAST(o_custkey AS VARCHAR(20)), ' ') WHEN 2 THEN '' WHEN 3 THEN 'abc' WHEN 4 THEN '-5' "
    "WHEN 5 THEN concat('1-2-', CAST(o_custkey AS VARCHAR(20))) ELSE NULL END"
)


@query("ranges_parsed", (
    f"WITH texts AS (SELECT o_orderkey AS id, {_RANGE_TEXT} AS text FROM orders), "
    "parts AS (SELECT *, list_transform(string_split(trim(text), '-'), lambda p: TRY_CAST(trim(p) AS DOUBLE)) AS ps FROM texts) "
    "SELECT id, round(CASE WHEN len(list_filter(ps, lambda p: p IS NULL)) = 0 THEN list_sum(ps) / len(ps) END, 4) AS mean FROM parts"
))
def ranges_parsed(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select(
        F.col("o_orderkey").alias("id"), round_to(parse_range_mean(F.expr(_RANGE_TEXT)), 4).alias("mean")
    )


_DATE_TEXT = (
    "CASE o_orderkey % 5 WHEN 0 THEN 'not-a-date' WHEN 1 THEN '' WHEN 2 THEN NULL "
    "ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR(20)) END"
)


@query("dates_parsed", (
    f"WITH texts AS (SELECT o_orderkey AS id, TRY_CAST({_DATE_TEXT} AS TIMESTAMP) AS d FROM orders) "
    "SELECT id, CAST(year(d) AS VARCHAR) AS diagnosis_year, 'T' || CAST(quarter(d) AS VARCHAR) AS diagnosis_trimester, "
    f"CAST(date_diff('day', d, TIMESTAMP '{AS_OF}') AS VARCHAR) AS days_since_diagnosis FROM texts"
))
def dates_parsed(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    parts = date_parts(parse_date(F.expr(_DATE_TEXT)), AS_OF)
    return orders.select(F.col("o_orderkey").alias("id"), *[
        parts[c].cast("string").alias(c) for c in ("diagnosis_year", "diagnosis_trimester", "days_since_diagnosis")
    ])


# --- feature engineering --------------------------------------------------------------------

_SCALED = ("age", "bmi", "heart_rate", "total_cholesterol", "has_internet")


@query("robust_scaled", S.with_(S.PATIENTS, "fit AS (SELECT {} FROM patients_v)".format(", ".join(
    f"quantile_cont({c}, 0.5) AS c_{c}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS s_{c}" for c in _SCALED
))) + "SELECT patient_id, {} FROM patients_v, fit".format(", ".join(
    f"round(({c} - c_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END, 4) + 0.0 AS {c}" for c in _SCALED
)))
def robust_scaled(spark, sf_dir):
    rows = patients(spark, sf_dir, ["patient_id", *_SCALED])
    out = features.scale_apply(rows, features.robust_scale_fit(rows, _SCALED))
    return out.withColumns({c: round_to(F.col(c), 4) for c in _SCALED})


@query("standard_scaled", S.with_(S.PATIENTS, "fit AS (SELECT {} FROM patients_v)".format(", ".join(
    f"avg({c}) AS c_{c}, stddev_pop({c}) AS s_{c}" for c in _SCALED
))) + "SELECT patient_id, {} FROM patients_v, fit".format(", ".join(
    f"round(({c} - c_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END, 4) + 0.0 AS {c}" for c in _SCALED
)))
def standard_scaled(spark, sf_dir):
    rows = patients(spark, sf_dir, ["patient_id", *_SCALED])
    out = features.scale_apply(rows, features.standard_scale_fit(rows, _SCALED))
    return out.withColumns({c: round_to(F.col(c), 4) for c in _SCALED})


@query("impute_cohort", S.with_(S.PATIENTS) + (
    "SELECT patient_id, department, "
    "round(coalesce(total_cholesterol, avg(total_cholesterol) OVER (PARTITION BY department)), 4) AS total_cholesterol, "
    "round(coalesce(glucose, avg(glucose) OVER (PARTITION BY department)), 4) AS glucose FROM patients_v"
))
def impute_cohort(spark, sf_dir):
    rows = patients(spark, sf_dir, ["patient_id", "department", "total_cholesterol", "glucose"])
    out = features.impute_mean(rows, ["total_cholesterol", "glucose"], "cohort", keys=["department"])
    return out.select(
        "patient_id", "department", round_to(F.col("total_cholesterol"), 4).alias("total_cholesterol"),
        round_to(F.col("glucose"), 4).alias("glucose"),
    )


@query("impute_training", S.with_(S.PATIENTS) + (
    "SELECT patient_id, round(coalesce(total_cholesterol, avg(total_cholesterol) OVER ()), 4) AS total_cholesterol, "
    "round(coalesce(glucose, avg(glucose) OVER ()), 4) AS glucose FROM patients_v"
))
def impute_training(spark, sf_dir):
    rows = patients(spark, sf_dir, ["patient_id", "total_cholesterol", "glucose"])
    out = features.impute_mean(rows, ["total_cholesterol", "glucose"])
    return out.withColumns({c: round_to(F.col(c), 4) for c in ("total_cholesterol", "glucose")})


_ALIGNED = (
    "age", "sex_F", "sex_M", "occupation_BUILDING", "occupation_RETIRED", "education_level_1",
    "education_level_10", "marital_status_Single",
)


@query("one_hot_aligned", S.with_(S.PATIENTS) + "SELECT patient_id, age, {}, CAST(0.0 AS DOUBLE) AS \"occupation_RETIRED\" FROM patients_v".format(", ".join(
    f"CAST(CASE WHEN CAST({c} AS VARCHAR) = '{v}' THEN 1 ELSE 0 END AS DOUBLE) AS \"{c}_{v}\"" for c, v in (
        ("sex", "F"), ("sex", "M"), ("occupation", "BUILDING"), ("education_level", "1"),
        ("education_level", "10"), ("marital_status", "Single"),
    )
)))
def one_hot_aligned(spark, sf_dir):
    rows = patients(spark, sf_dir, ["patient_id", "age", "sex", "occupation", "education_level", "marital_status"])
    spec = features.FeatureSpec(("age",), ("sex", "occupation", "education_level", "marital_status"), "robust")
    hot = features.one_hot_apply(rows, spec, features.one_hot_fit(rows, spec))
    return features.align_features(hot, _ALIGNED, keep=["patient_id"])


@query("one_hot_categories", S.with_(S.PATIENTS) + " UNION ".join(
    f"SELECT '{c}_' || CAST({c} AS VARCHAR) AS feature FROM patients_v WHERE {c} IS NOT NULL"
    for c in ("municipality", "occupation", "education_level", "marital_status", "ethnicity")
))
def one_hot_categories(spark, sf_dir):
    columns = ("municipality", "occupation", "education_level", "marital_status", "ethnicity")
    spec = features.FeatureSpec((), columns, "robust")
    values = features.category_values(patients(spark, sf_dir, columns), spec)
    return values.select(F.concat_ws("_", "column", "value").alias("feature"))


# Of n draws the mean lies within five standard errors and the deviation within a tenth; a third of
# the rows lie outside one deviation.
_NOISE = (
    "CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN copy = 0 THEN 0 ELSE 1 END) AS BIGINT) AS n_changed, "
    "TRUE AS mean_ok, TRUE AS deviation_ok, TRUE AS tails_ok"
)


def _noise_measures(moved, std: float) -> list:
    n, drawn = F.count("*"), F.any_value(F.col("copy")) > 0
    outside = F.count_if(F.abs(moved) > std) / n
    return [
        n.alias("n"), F.count_if(moved != 0).alias("n_changed"),
        (F.abs(F.avg(moved)) <= 5 * std / F.sqrt(n)).alias("mean_ok"),
        (~drawn | (F.abs(F.stddev_pop(moved) / std - 1) < 0.1)).alias("deviation_ok"),
        (~drawn | outside.between(0.25, 0.39)).alias("tails_ok"),
    ]


@query("augment_noise", S.with_(S.PATIENTS) + f"SELECT CAST(copy AS INT) AS copy, {_NOISE} FROM patients_v, range(0, 3) t(copy) GROUP BY copy")
def augment_noise(spark, sf_dir):
    rows = patients(spark, sf_dir, ["patient_id", "age"]).withColumn("noisy", F.col("age"))
    out = features.augment_noise(rows, ["noisy"], std=0.01, factor=2, row_key=["patient_id"])
    return out.groupBy("copy").agg(*_noise_measures(F.col("noisy") - F.col("age"), 0.01))


@query("perturb", S.with_(S.PATIENTS) + f"SELECT {_NOISE.replace('copy', '1')} FROM patients_v")
def perturb(spark, sf_dir):
    rows = patients(spark, sf_dir, ["patient_id", "age"]).withColumns({"noisy": F.col("age"), "copy": F.lit(1)})
    out = features.perturb(rows, ["noisy"], std=0.5, row_key=["patient_id"])
    return out.agg(*_noise_measures(F.col("noisy") - F.col("age"), 0.5))


@query("missing_categories", S.with_(S.BASE) + (
    "SELECT marital, quarter, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN marital = 'Missing' THEN 1 ELSE 0 END) AS BIGINT) AS hot "
    "FROM (SELECT coalesce(marital_status, 'Missing') AS marital, coalesce(diagnosis_trimester, 'Missing') AS quarter FROM prep) GROUP BY ALL"
))
def missing_categories(spark, sf_dir):
    rows = _rows(spark, sf_dir, ["patient_id", "marital_status", "diagnosis_date"])
    spec = features.FeatureSpec((), ("marital_status", "diagnosis_trimester"), "standard", missing_category="Missing")
    hot = features.one_hot_apply(rows, spec, features.one_hot_fit(rows, spec))
    full = features.fill_missing(hot, ["marital_status", "diagnosis_trimester"], spec.missing_category)
    return full.groupBy(F.col("marital_status").alias("marital"), F.col("diagnosis_trimester").alias("quarter")).agg(
        F.count("*").alias("n"), F.sum("marital_status_Missing").cast("bigint").alias("hot")
    )


@query("usable_patients", S.with_(S.BASE) + (
    "SELECT department, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT marital_status) AS BIGINT) AS statuses FROM prep "
    f"WHERE diagnosis_date IS NOT NULL AND glucose IS NOT NULL AND {S.alive()} GROUP BY department"
))
def usable_patients(spark, sf_dir):
    rows = filters.has_date(filters.scorable(_rows(spark, sf_dir), [*S.NEEDED, "glucose"]))
    return rows.groupBy("department").agg(F.count("*").alias("n"), F.count_distinct("marital_status").alias("statuses"))


@query("duplicate_places", (
    "SELECT r_name AS department, n_name AS municipality, CAST(count(*) AS BIGINT) AS n_rows FROM supplier "
    "JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL HAVING count(*) > 1"
))
def duplicate_places(spark, sf_dir):
    """A dimension with a row per supplier: places that have several."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    places = read("supplier").join(read("nation"), F.expr("s_nationkey = n_nationkey")).join(read("region"), F.expr("n_regionkey = r_regionkey"))
    return duplicate_municipalities(places.select(F.col("r_name").alias("Department"), F.col("n_name").alias("Municipality")))


# Patients as a text table would hold them: upper-case names, numbers as text, a column left out.
_AS_TEXT = {
    "PATIENT_ID": "CAST(patient_id AS VARCHAR(20))", "AGE": "concat(' ', CAST(age AS VARCHAR(20)))",
    "BMI": "CASE WHEN patient_id % 7 = 0 THEN 'NA' WHEN patient_id % 7 = 1 THEN 'n/k' ELSE CAST(bmi AS VARCHAR(40)) END",
    "EDUCATION_LEVEL": "CAST(education_level AS VARCHAR(20))", "RISK_SCORE": "CAST(risk_score AS VARCHAR(40))",
    "DIAGNOSIS_DATE": "CASE WHEN patient_id % 5 = 0 THEN 'soon' ELSE CAST(CAST(diagnosis_date AS DATE) AS VARCHAR(20)) END",
}


@query("patients_from_text", S.with_(S.PATIENTS) + (
    "SELECT CAST(patient_id AS BIGINT) AS patient_id, round(age, 4) AS age, CASE WHEN patient_id % 7 > 1 THEN round(bmi, 8) END AS bmi, "
    "education_level, round(risk_score, 8) AS target_score, "
    "CASE WHEN patient_id % 5 > 0 THEN CAST(year(diagnosis_date) AS VARCHAR) END AS year, 0.25 AS heart_rate FROM patients_v"
).replace("0.25 AS heart_rate", "CAST(0.25 AS DOUBLE) AS heart_rate"))
def patients_from_text(spark, sf_dir):
    text = patients(spark, sf_dir).select(*[F.expr(e).alias(name) for name, e in _AS_TEXT.items()])
    rows = apply_schema(text, PATIENTS_SCHEMA)
    rows = require_columns(with_defaults(rows, {"heart_rate": 0.25, "age": -1.0}), ("age", "heart_rate"))
    return features.rename_targets(rows).select(
        F.col("patient_id").cast("bigint").alias("patient_id"), round_to(F.col("age"), 4).alias("age"), round_to(F.col("bmi"), 8).alias("bmi"),
        "education_level", round_to(F.col("target_score"), 8).alias("target_score"), F.year("diagnosis_date").cast("string").alias("year"), "heart_rate",
    )


def _in_order(report: DataFrame) -> DataFrame:
    """A report, which has a row per cohort, with the position of every row in it."""
    rows = report.collect()
    schema = T.StructType([T.StructField("position", T.IntegerType()), *report.schema])
    return report.sparkSession.createDataFrame([(i + 1, *row) for i, row in enumerate(rows)], schema)


def _ordered(name: str, key: str, report, order: str, key_text: str | None = None):
    sql = S.cohort_sql([key], key_text)

    @query(name, f"SELECT CAST(row_number() OVER (ORDER BY {order}) AS INT) AS position, {key}, n_patients FROM ({sql})")
    def run(spark, sf_dir):
        return _in_order(report(patients(spark, sf_dir), M.individual_model(), as_of=AS_OF).select(key, "n_patients"))


_ordered("order_of_municipalities", "municipality", reports.summary_by_municipality, "municipality")
_ordered("order_of_education", "education_level", reports.summary_by_education, "education_level")


# --- splits ---------------------------------------------------------------------------------

# A scramble of the key that both engines compute alike.
_ORDER_TEXT = "(patient_id * 2654435761) % 4294967296"


@query("split_stratified", S.with_(S.PATIENTS, S.parted("patients_v", _ORDER_TEXT)) + (
    "SELECT patient_id, bin AS target_bin, is_test FROM parted"
))
def split_stratified(spark, sf_dir):
    rows = patients(spark, sf_dir, ["patient_id", "risk_score"])
    out = splits.stratified_split(rows, order=F.expr(_ORDER_TEXT))
    return out.select("patient_id", digitize(F.col("risk_score"), TARGET_EDGES).alias("target_bin"), "is_test")


@query("split_random", S.with_(S.PATIENTS) + (
    f"SELECT patient_id, ({_ORDER_TEXT}) / CAST(4294967296 AS DOUBLE) < 0.2 AS is_test FROM patients_v"
))
def split_random(spark, sf_dir):
    rows = patients(spark, sf_dir, ["patient_id"])
    uniform = F.expr(_ORDER_TEXT) / F.lit(4294967296.0)
    return splits.random_split(rows, uniform=uniform)


# --- evaluation -----------------------------------------------------------------------------


def _scored(spark, sf_dir) -> DataFrame:
    return scoring.score(_rows(spark, sf_dir), M.individual_model())


@query("regression_metrics", S.with_(S.BASE, S.scored("prep", None)) + (
    "SELECT CAST(count(score) AS BIGINT) AS n, round(avg((risk_score - score) * (risk_score - score)), 4) AS mse, "
    "round(avg(abs(risk_score - score)), 4) AS mae, "
    "round(1 - sum((risk_score - score) * (risk_score - score)) / (var_pop(risk_score) * count(*)), 4) AS r2 "
    "FROM scored WHERE score IS NOT NULL"
))
def regression_metrics(spark, sf_dir):
    out = evaluation.regression_metrics(_scored(spark, sf_dir))
    return out.withColumns({c: round_to(F.col(c), 4) for c in ("mse", "mae", "r2")})


@query("residual_histogram", S.with_(
    S.BASE, S.scored("prep", None),
    "long AS (SELECT 'residual' AS variable, risk_score - score AS x FROM scored WHERE score IS NOT NULL "
    "UNION ALL SELECT 'truth', risk_score FROM scored WHERE score IS NOT NULL "
    "UNION ALL SELECT 'prediction', score FROM scored WHERE score IS NOT NULL)",
    "ends AS (SELECT variable, min(x) AS lo, max(x) AS hi FROM long GROUP BY variable)",
    "counts AS (SELECT variable, least(30, CAST(floor(30 * (x - lo) / (hi - lo)) AS INT) + 1) AS bin, count(*) AS n "
    "FROM long JOIN ends USING (variable) GROUP BY ALL)",
) + (
    "SELECT variable, CAST(b.bin AS INT) AS bin, round(lo + (b.bin - 1) * (hi - lo) / 30, 4) AS low, "
    "round(lo + b.bin * (hi - lo) / 30, 4) AS high, CAST(coalesce(n, 0) AS BIGINT) AS n "
    "FROM ends CROSS JOIN range(1, 31) b(bin) LEFT JOIN counts USING (variable, bin)"
))
def residual_histogram(spark, sf_dir):
    out = evaluation.residual_histogram(_scored(spark, sf_dir))
    return out.withColumns({c: round_to(F.col(c), 4) for c in ("low", "high")})


@query("error_by_range", S.with_(
    S.BASE, S.scored("prep", None),
    "errors AS (SELECT risk_score AS y, abs(risk_score - score) AS e FROM scored WHERE score IS NOT NULL)",
    "ends AS (SELECT min(y) AS lo, max(y) AS hi FROM errors)",
    "binned AS (SELECT e, CAST(y > lo + (hi - lo) / 5 AS INT) + CAST(y > lo + 2 * (hi - lo) / 5 AS INT) "
    "+ CAST(y > lo + 3 * (hi - lo) / 5 AS INT) + CAST(y > lo + 4 * (hi - lo) / 5 AS INT) AS range_idx FROM errors, ends)",
    "boxes AS (SELECT range_idx, quantile_cont(e, 0.25) AS q1, quantile_cont(e, 0.5) AS median, quantile_cont(e, 0.75) AS q3 FROM binned GROUP BY range_idx)",
) + (
    "SELECT CAST(range_idx AS INT) AS range_idx, CAST(count(*) AS BIGINT) AS n, round(any_value(q1), 4) AS q1, "
    "round(any_value(lo) + range_idx * any_value(hi - lo) / 5 - CASE WHEN range_idx = 0 THEN 0.001 * any_value(hi - lo) ELSE 0 END, 4) AS low, "
    "round(any_value(lo) + (range_idx + 1) * any_value(hi - lo) / 5, 4) AS high, "
    "round(any_value(median), 4) AS median, round(any_value(q3), 4) AS q3, round(min(e), 4) AS min_error, round(max(e), 4) AS max_error, "
    "round(min(CASE WHEN e >= q1 - 1.5 * (q3 - q1) THEN e END), 4) AS whisker_low, "
    "round(max(CASE WHEN e <= q3 + 1.5 * (q3 - q1) THEN e END), 4) AS whisker_high, "
    "CAST(sum(CASE WHEN e < q1 - 1.5 * (q3 - q1) OR e > q3 + 1.5 * (q3 - q1) THEN 1 ELSE 0 END) AS BIGINT) AS n_outliers "
    "FROM binned JOIN boxes USING (range_idx), ends GROUP BY range_idx"
))
def error_by_range(spark, sf_dir):
    out = evaluation.error_by_range(_scored(spark, sf_dir))
    numbers = ("low", "high", "q1", "median", "q3", "min_error", "max_error", "whisker_low", "whisker_high")
    return out.withColumns({c: round_to(F.col(c), 4) for c in numbers})


@query("prediction_points", S.with_(S.BASE, S.scored("prep", None)) + (
    "SELECT patient_id, round(risk_score, 4) AS truth, round(score, 4) AS prediction, round(risk_score - score, 4) + 0.0 AS residual "
    "FROM scored WHERE score IS NOT NULL"
))
def prediction_points(spark, sf_dir):
    out = evaluation.prediction_points(_scored(spark, sf_dir), row_key=["patient_id"])
    return out.withColumns({c: round_to(F.col(c), 4) for c in ("truth", "prediction", "residual")})


@query("prediction_sample", S.with_(S.BASE, S.scored("prep", None)) + (
    "SELECT TRUE AS share_ok, TRUE AS within_whole, TRUE AS repeatable FROM scored WHERE score IS NOT NULL LIMIT 1"
))
def prediction_sample(spark, sf_dir):
    """A quarter of the points: how many, whether they are points, whether a second draw is equal."""
    scored = _scored(spark, sf_dir)
    points = evaluation.prediction_points(scored, row_key=["patient_id"]).select("patient_id", "truth", "prediction")
    part = evaluation.prediction_points(scored, fraction=0.25, row_key=["patient_id"])
    again = evaluation.prediction_points(scored.repartition(5, "age"), fraction=0.25, row_key=["patient_id"])
    counts = lambda df, name: df.agg(F.count("*").alias(name), F.sum("patient_id").alias(f"{name}_sum"))
    one = counts(points, "whole").crossJoin(counts(part, "part")).crossJoin(counts(again, "again")).crossJoin(
        counts(part.join(points, ["patient_id", "truth", "prediction"], "left_semi"), "inside"))
    return one.select(
        (F.abs(F.col("part") / F.col("whole") - 0.25) < 3 / F.sqrt("whole")).alias("share_ok"),
        (F.col("inside") == F.col("part")).alias("within_whole"),
        ((F.col("again") == F.col("part")) & (F.col("again_sum") == F.col("part_sum"))).alias("repeatable"),
    )


# --- importance -----------------------------------------------------------------------------
# The weights are measured on the patients: per sex (the units), the correlation of a number with
# the risk, and for a category how far its mean risk lies from the unit's.

_CATEGORIES = ("department", "municipality", "marital_status", "occupation", "education_level", "ethnicity")
_NUMBERS = ("age", "heart_rate", "total_cholesterol", "glucose", "is_smoker", "diabetes", "has_gas", "has_internet", "diagnosis_month")


def marginal_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir).withColumn("unit", (F.col("sex") == "M").cast("int"))
    # Every row adds to its unit (place -1) and to each of its categories, in one aggregate.
    entry = F.struct
    pairs = F.array(entry(F.lit(-1).alias("place"), F.lit("").alias("column"), F.lit("").alias("value")), *[
        entry(F.lit(i).alias("place"), F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
        for i, c in enumerate(_CATEGORIES)
    ])
    own = F.col("p.place") == -1
    found = (
        rows.select("unit", "risk_score", *_NUMBERS, F.explode(pairs).alias("p")).where("p.value IS NOT NULL")
        .groupBy("unit", "p.place", "p.column", "p.value").agg(
            F.avg("risk_score").alias("mean"),
            *[F.corr(F.when(own, F.col(c).cast("double")), F.when(own, F.col("risk_score"))).alias(f"corr_{c}") for c in _NUMBERS])
    )
    # Windows over the model's features only.
    order, unit = Window.orderBy("place", "value"), Window.partitionBy("unit")
    ranked = found.withColumns({
        "feature_idx": F.dense_rank().over(order) + len(_NUMBERS) - 2,
        "unit_mean": F.max(F.when(F.col("place") == -1, F.col("mean"))).over(unit),
    })
    numbers = F.array(*[
        entry(F.lit(i).alias("feature_idx"), F.lit(c).alias("feature"), F.col(f"corr_{c}").alias("weight")) for i, c in enumerate(_NUMBERS)
    ])
    category = F.array(entry(
        F.col("feature_idx"), F.concat_ws("_", "column", "value").alias("feature"), (F.col("mean") - F.col("unit_mean")).alias("weight")))
    weights = ranked.select("unit", F.explode(F.when(F.col("place") == -1, numbers).otherwise(category)).alias("e"))
    return weights.select("e.feature_idx", "e.feature", "unit", round_to(F.col("e.weight"), 6).alias("weight"))


_WEIGHTS_SQL = (
    S.BASE + ", unit_rows AS (SELECT *, CASE WHEN sex = 'M' THEN 1 ELSE 0 END AS unit FROM prep), "
    "unit_means AS (SELECT unit, avg(risk_score) AS m FROM unit_rows GROUP BY unit), "
    "long_values AS (" + " UNION ALL ".join(
        f"SELECT unit, {i} AS place, '{c}_' || CAST({c} AS VARCHAR) AS feature, CAST({c} AS VARCHAR) AS value, avg(risk_score) AS m "
        f"FROM unit_rows WHERE {c} IS NOT NULL GROUP BY unit, {c}" for i, c in enumerate(_CATEGORIES)
    ) + "), weights_v AS (" + " UNION ALL ".join(
        f"SELECT {i} AS feature_idx, '{c}' AS feature, unit, round(corr({c}, risk_score), 6) AS weight FROM unit_rows GROUP BY unit"
        for i, c in enumerate(_NUMBERS)
    ) + " UNION ALL SELECT dense_rank() OVER (ORDER BY place, value) "
    f"+ {len(_NUMBERS) - 1} AS feature_idx, feature, unit, round(v.m - u.m, 6) AS weight FROM long_values v JOIN unit_means u USING (unit)), "
    "imp AS (SELECT feature_idx, feature, avg(abs(weight)) AS importance FROM weights_v GROUP BY feature_idx, feature), "
    "nongeo AS (SELECT * FROM imp WHERE NOT starts_with(feature, 'department_') AND NOT starts_with(feature, 'municipality_'))"
)
_I = "CAST(feature_idx AS INT) AS feature_idx"


def _importances(spark, sf_dir, how="mean") -> DataFrame:
    return importance.feature_importance(marginal_weights(spark, sf_dir), how)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: round_to(F.col(c), 4) for c in columns})


def _importance_query(how: str, measure: str, where: str = ""):
    @query(f"importance_{how}", S.with_(_WEIGHTS_SQL) + (
        f"SELECT {_I}, feature, round({measure}, 4) AS importance FROM weights_v {where} GROUP BY feature_idx, feature"
    ))
    def run(spark, sf_dir):
        return _rounded(_importances(spark, sf_dir, how), "importance")


_importance_query("mean", "avg(abs(weight))")
_importance_query("sum", "sum(abs(weight))")
_importance_query("first", "max(abs(weight))", "WHERE unit = 0")


@query("importance_report", S.with_(
    _WEIGHTS_SQL, "cut AS (SELECT * FROM nongeo ORDER BY importance DESC, feature_idx LIMIT 12)"
) + f"SELECT {_I}, feature, round(importance, 4) AS importance FROM cut WHERE importance >= 0.004")
def importance_report(spark, sf_dir):
    return _rounded(importance.importance_report(_importances(spark, sf_dir), 12, 0.004), "importance")


@query("importance_summary", S.with_(_WEIGHTS_SQL) + (
    "SELECT CAST(count(*) AS BIGINT) AS count, round(max(importance), 4) AS max, round(min(importance), 4) AS min, "
    "round(avg(importance), 4) AS mean FROM imp WHERE importance >= 0.003"
))
def importance_summary(spark, sf_dir):
    report = importance.importance_report(_importances(spark, sf_dir), threshold=0.003, exclude_geo=False)
    return _rounded(importance.importance_summary(report), "max", "min", "mean")


def _geo(name: str, prefix: str, top: int):
    @query(name, S.with_(_WEIGHTS_SQL) + (
        f"SELECT {_I}, replace(feature, '{prefix}', '') AS name, round(importance, 4) AS importance, "
        f"(SELECT CAST(count(*) AS BIGINT) FROM imp WHERE starts_with(feature, '{prefix}')) AS total "
        f"FROM (SELECT * FROM imp WHERE starts_with(feature, '{prefix}') ORDER BY importance DESC, feature_idx LIMIT {top})"
    ))
    def run(spark, sf_dir):
        return _rounded(importance.geo_importance(_importances(spark, sf_dir), prefix, top), "importance")


_geo("importance_of_municipalities", "municipality_", 10)
_geo("importance_of_departments", "department_", 3)


@query("importance_statistics", S.with_(_WEIGHTS_SQL) + (
    "SELECT round(min(importance), 4) AS min, round(max(importance), 4) AS max, round(avg(importance), 4) AS mean, "
    "round(quantile_cont(importance, 0.5), 4) AS median, round(quantile_cont(importance, 0.25), 4) AS percentile_25, "
    "round(quantile_cont(importance, 0.75), 4) AS percentile_75, CAST(count(*) AS BIGINT) AS total_features FROM nongeo"
))
def importance_statistics(spark, sf_dir):
    return _rounded(
        importance.importance_statistics(_importances(spark, sf_dir)),
        "min", "max", "mean", "median", "percentile_25", "percentile_75",
    )


@query("importance_least", S.with_(_WEIGHTS_SQL) + (
    f"SELECT {_I}, feature, round(importance, 4) AS importance FROM (SELECT * FROM nongeo ORDER BY importance, feature_idx LIMIT 10)"
))
def importance_least(spark, sf_dir):
    return _rounded(importance.least_important(_importances(spark, sf_dir)), "importance")


def _by_category(name: str, include_geo: bool):
    @query(name, S.with_(
        _WEIGHTS_SQL, f"grouped AS (SELECT {S.group_of('feature', include_geo)} AS category, sum(importance) AS t FROM imp GROUP BY ALL)"
    ) + "SELECT category, round(t, 4) AS total, round(t / (SELECT sum(t) FROM grouped), 4) AS share FROM grouped")
    def run(spark, sf_dir):
        return _rounded(importance.importance_by_category(_importances(spark, sf_dir), include_geo), "total")


_by_category("importance_by_category", False)
_by_category("importance_by_category_with_geo", True)

# --- fits -----------------------------------------------------------------------------------

_FIT_SPEC = features.FeatureSpec(("total_cholesterol", "glucose"), (), "robust")


_TWO_FEATURES = S.with_(
    S.PATIENTS, S.parted("patients_v", _ORDER_TEXT),
    "means AS (SELECT avg(total_cholesterol) AS mt, avg(glucose) AS mg FROM parted WHERE NOT is_test)",
    "filled AS (SELECT is_test, risk_score AS y, coalesce(total_cholesterol, mt) AS t, coalesce(glucose, mg) AS g FROM parted, means)",
    "scale AS (SELECT quantile_cont(t, 0.5) AS ct, quantile_cont(t, 0.75) - quantile_cont(t, 0.25) AS st, "
    "quantile_cont(g, 0.5) AS cg, quantile_cont(g, 0.75) - quantile_cont(g, 0.25) AS sg FROM filled WHERE NOT is_test)",
    "x AS (SELECT is_test, y, (t - ct) / st AS a, (g - cg) / sg AS b FROM filled, scale)",
    "moments AS (SELECT var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS by_, "
    "avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM x WHERE NOT is_test)",
    "slopes AS (SELECT (bb * ay - ab * by_) / (aa * bb - ab * ab) AS wa, (aa * by_ - ab * ay) / (aa * bb - ab * ab) AS wb, ma, mb, my FROM moments)",
    "line AS (SELECT wa, wb, my - wa * ma - wb * mb AS w0 FROM slopes)",
    "errors AS (SELECT is_test, y, y - (w0 + wa * a + wb * b) AS e FROM x, line)",
)


def _fit_two(spark, sf_dir):
    rows = patients(spark, sf_dir, ["patient_id", "risk_score", "total_cholesterol", "glucose", "diagnosis_date"])
    return training.fit_risk_model(
        rows, spec=_FIT_SPEC, as_of=AS_OF, row_key=["patient_id"], order=F.expr(_ORDER_TEXT), ridge=0.0
    )


@query("fit_two_features", _TWO_FEATURES + (
    "SELECT is_test, CAST(count(*) AS BIGINT) AS n, round(avg(e * e), 6) AS mse, round(avg(abs(e)), 6) AS mae, "
    "round(any_value(wa), 6) AS weight_cholesterol, round(any_value(wb), 6) AS weight_glucose, round(any_value(w0), 6) AS intercept "
    "FROM errors, line GROUP BY is_test"
))
def fit_two_features(spark, sf_dir):
    fitted = _fit_two(spark, sf_dir)
    fitted.release()
    layer = fitted.model.layers[0]
    table = [
        (flag, errors["n"], errors["mse"], errors["mae"], float(layer.weights[0, 0]), float(layer.weights[1, 0]), float(layer.bias[0]))
        for flag, errors in ((False, fitted.train), (True, fitted.test))
    ]
    names = ("mse", "mae", "weight_cholesterol", "weight_glucose", "intercept")
    out = spark.createDataFrame(table, "is_test boolean, n bigint, " + ", ".join(f"{c} double" for c in names))
    return out.withColumns({c: round_to(F.col(c), 6) for c in names})


@query("holdout_metrics", _TWO_FEATURES + (
    "SELECT CAST(count(*) AS BIGINT) AS n, round(avg(e * e), 6) AS mse, round(avg(abs(e)), 6) AS mae, "
    "round(1 - avg(e * e) / var_pop(y), 6) AS r2 FROM errors WHERE is_test"
))
def holdout_metrics(spark, sf_dir):
    fitted = _fit_two(spark, sf_dir)
    # One row, read at once so that the staged rows can go.
    found = training.holdout_metrics(fitted)
    out = spark.createDataFrame(found.collect(), found.schema)
    fitted.release()
    return out.withColumns({c: round_to(F.col(c), 6) for c in ("mse", "mae", "r2")})


@query("fit_report_errors", _TWO_FEATURES.rstrip() + (
    ", held AS (SELECT y, abs(e) AS e FROM errors WHERE is_test), held_ends AS (SELECT min(y) AS lo, max(y) AS hi FROM held), "
    "held_binned AS (SELECT e, CAST(y > lo + (hi - lo) / 5 AS INT) + CAST(y > lo + 2 * (hi - lo) / 5 AS INT) "
    "+ CAST(y > lo + 3 * (hi - lo) / 5 AS INT) + CAST(y > lo + 4 * (hi - lo) / 5 AS INT) AS range_idx FROM held, held_ends) "
    "SELECT CAST(range_idx AS INT) AS range_idx, CAST(count(*) AS BIGINT) AS n, round(quantile_cont(e, 0.5), 6) AS median, "
    "round(max(e), 6) AS max_error FROM held_binned GROUP BY range_idx"
))
def fit_report_errors(spark, sf_dir):
    rows = patients(spark, sf_dir, ["patient_id", "risk_score", "total_cholesterol", "glucose", "diagnosis_date"])
    report = fit_and_report(rows, spec=_FIT_SPEC, as_of=AS_OF, row_key=["patient_id"], order=F.expr(_ORDER_TEXT), ridge=0.0)
    report.fitted.release()
    return report.errors.select("range_idx", "n", *[round_to(F.col(c), 6).alias(c) for c in ("median", "max_error")])


def _solved(spark: SparkSession, fitted: training.Fitted, target: str = "risk_score") -> DataFrame:
    """Per feature of a ridge fit: the training rows that have it, its training mean, and the
    gradient of the ridge problem, taken from the raw columns and the rows' scores."""
    model, weights = fitted.model, fitted.model.layers[0].weights[:, 0]
    rows = scoring.score(fitted.rows.where(~F.col("is_test")), model).withColumn("_e", F.col("score") - F.col(target))
    measures = []
    for i, c in enumerate(model.spec.numeric):
        x = scoring.scaled_sql(model, c, features.filled_sql(c, sql_text.number(model.means[c])))
        measures += [F.expr(f"count({sql_text.name(c)}) AS n{i}"), F.expr(f"avg({x} * _e) AS g{i}")]
    # Spark measures the penalty on the standardised label.
    sums = rows.agg(F.count("*").alias("n"), F.stddev_samp(target).alias("spread"), *measures).collect()[0]
    active = {c: (sums[f"n{i}"], sums[f"g{i}"]) for i, c in enumerate(model.spec.numeric)}
    # A row adds its error to each of its categories.
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.expr(features.category_sql(rows, model.spec, c)).alias("value")) for c in model.spec.categorical])
    per_value = rows.select(F.explode(pairs).alias("pair"), "_e").groupBy("pair").agg(F.count("*").alias("n"), F.sum("_e").alias("e"))
    active |= {f"{r['pair']['column']}_{r['pair']['value']}": (r["n"], r["e"] / sums["n"]) for r in per_value.collect()}
    table = [
        (name, active[name][0], float(model.means[name]) if name in model.means else None,
         active[name][1] + training.RIDGE / sums["spread"] * float(weights[i]))
        for i, name in enumerate(model.feature_names)
    ]
    fitted.release()
    out = spark.createDataFrame(table, "feature string, n_active bigint, mean double, gradient double")
    return out.withColumns({"mean": round_to(F.col("mean"), 4), "gradient": F.abs(round_to(F.col("gradient"), 4))})


@query("fit_risk_model", S.with_(
    S.BASE, f"usable AS (SELECT * FROM prep WHERE {S.alive()})", S.parted("usable", _ORDER_TEXT),
    "train AS (SELECT * FROM parted WHERE NOT is_test)",
) + S.fitted_sql(features.INDIVIDUAL.numeric, features.INDIVIDUAL.categorical))
def fit_risk_model(spark, sf_dir):
    return _solved(spark, training.fit_risk_model(
        patients(spark, sf_dir), as_of=AS_OF, row_key=["patient_id"], order=F.expr(_ORDER_TEXT)
    ))


_GROUP_UNIFORM = (
    "((CAST(education_level AS INT) * 31 + CAST(socioeconomic_status AS INT) * 17 + length(occupation) * 13 "
    "+ length(municipality) * 7 + length(ethnicity) * 3 + ascii(rural_area)) % 10) / CAST(10 AS DOUBLE)"
)


@query("fit_population_model", S.with_(
    S.groups(), f"train AS (SELECT * FROM grouped WHERE risk_score IS NOT NULL AND NOT {_GROUP_UNIFORM} < 0.2)",
) + S.fitted_sql(features.POPULATION.numeric, features.POPULATION.categorical, "Missing"))
def fit_population_model(spark, sf_dir):
    return _solved(spark, training.fit_population_model(
        patients(spark, sf_dir), municipalities(spark, sf_dir), uniform=F.expr(_GROUP_UNIFORM)
    ))
