"""Cohort reports.

Every report takes raw patients (and the dimension, where it needs one) plus a fitted model and
returns one row per cohort, sorted by its key. `options` are those of `cohort_summary`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..fixed_values import (
    ACCESS_LABELS, AGE_EDGES, AGE_LABELS, AREA_LABELS, EDUCATION_LABELS, GEO_KEYS,
    INFRASTRUCTURE_COLUMNS, MIN_PATIENTS, PRECIPITATION_EDGES, PRECIPITATION_UNIT, RISK_EDGES,
    TEMPERATURE_EDGES, TEMPERATURE_UNIT, TOP_FACTORS, UNKNOWN_LABEL,
)
from ..functions import code_label, combo_label, cut, ieq, parse_range_mean, range_labels, round_to
from ..functions.bins import bin_conditions
from ..operators.cohorts import CohortSums, cohort_summary
from ..operators.features import prepare_patients
from ..operators.filters import not_null, optional_eq
from ..operators.joins import unique_municipalities, with_geography, with_group_total
from ..operators.model import RiskModel
from ..operators.scoring import explode_factors, score
from ..sources.readers import lowercase_columns, require_columns

PROFILE_AVERAGES = {"avg_bmi": "bmi", "avg_age": "age"}
PROFILE_PERCENTAGES = {"smoking_percentage": "is_smoker", "diabetes_percentage": "diabetes"}


def _rows(patients: DataFrame, needed: Sequence[str], as_of=None) -> DataFrame:
    return prepare_patients(require_columns(lowercase_columns(patients), needed), as_of)


def _by(patients, model, keys, as_of=None, **options) -> DataFrame:
    return cohort_summary(_rows(patients, keys, as_of), keys, model, **options).orderBy(*keys)


# --- summaries ------------------------------------------------------------------------------


def summary_by_department(patients: DataFrame, model: RiskModel, top: int = TOP_FACTORS, as_of=None, **options) -> DataFrame:
    return _by(patients, model, ["department"], as_of, factors=top, **options)


def summary_by_municipality(
    patients: DataFrame, model: RiskModel, top: int = TOP_FACTORS, with_department: bool = False,
    as_of=None, **options,
) -> DataFrame:
    """By municipality name; `with_department` keeps places that share a name apart."""
    keys = list(GEO_KEYS) if with_department else ["municipality"]
    return _by(patients, model, keys, as_of, factors=top, **options)


def summary_by_occupation(patients: DataFrame, model: RiskModel, as_of=None, **options) -> DataFrame:
    return _by(patients, model, ["occupation"], as_of, **options)


def summary_by_age_band(patients: DataFrame, model: RiskModel, as_of=None, **options) -> DataFrame:
    """By `[a, b)` age band. The band of an 18-year-old is labelled 19-30."""
    rows = _rows(patients, ["age"], as_of)
    rows = rows.withColumn("age_band", cut(F.col("age"), AGE_EDGES, AGE_LABELS, right=False))
    options.setdefault("min_rows", None)
    return cohort_summary(rows, "age_band", model, **options).orderBy("age_band")


def summary_by_education(patients: DataFrame, model: RiskModel, as_of=None, **options) -> DataFrame:
    return _by(patients, model, ["education_level"], as_of, **options)


def summary_by_stratum(patients: DataFrame, model: RiskModel, as_of=None, **options) -> DataFrame:
    return _by(patients, model, ["socioeconomic_status"], as_of, **options)


def summary_by_year(
    patients: DataFrame, model: RiskModel, department: str | None = None,
    municipality: str | None = None, as_of=None, **options,
) -> DataFrame:
    """By diagnosis year, optionally of one department or municipality."""
    rows = _rows(patients, [], as_of)
    rows = optional_eq(rows, "department", department)
    rows = optional_eq(rows, "municipality", municipality)
    options.setdefault("min_rows", None)
    return cohort_summary(rows, "diagnosis_year", model, **options).orderBy("diagnosis_year")


def summary_by_place_and_year(
    patients: DataFrame, model: RiskModel, level: str = "department", as_of=None, **options
) -> DataFrame:
    """By diagnosis year for every department (or municipality) at once."""
    options.setdefault("min_rows", None)
    keys = [level, "diagnosis_year"]
    return cohort_summary(_rows(patients, [level], as_of), keys, model, **options).orderBy(*keys)


def summary_by_quarter(patients: DataFrame, model: RiskModel, as_of=None, **options) -> DataFrame:
    """By quarter `T1`..`T4` over all years."""
    options.setdefault("min_rows", None)
    rows = _rows(patients, [], as_of)
    return cohort_summary(rows, "diagnosis_trimester", model, **options).orderBy("diagnosis_trimester")


def patients_per_year(patients: DataFrame) -> DataFrame:
    """Patients per diagnosis year; no model needed."""
    rows = _rows(patients, ["diagnosis_date"])
    return (
        not_null(rows, "diagnosis_year").groupBy("diagnosis_year")
        .agg(F.count("*").alias("n_patients")).orderBy("diagnosis_year")
    )


def distribution_by_year(patients: DataFrame, feature: str) -> DataFrame:
    """Count and percentage of every value of a feature within its diagnosis year."""
    rows = not_null(_rows(patients, [feature, "diagnosis_date"]), [feature, "diagnosis_year"])
    counts = rows.groupBy("diagnosis_year", F.col(feature).cast("string").alias("value")).agg(
        F.count("*").alias("n")
    )
    return with_group_total(counts, "diagnosis_year").select(
        "diagnosis_year", "value", "n",
        round_to(F.col("n") / F.col("total") * F.lit(100.0), 2).alias("percentage"),
    ).orderBy("diagnosis_year", "value")


def distribution_map_by_year(patients: DataFrame, feature: str) -> DataFrame:
    """One map value -> percentage per year, for any column.

    A map holds a year's distinct values in one row; `distribution_by_year` has one row per value and
    is the form for a column of unbounded precision.
    """
    long = distribution_by_year(patients, feature)
    return long.groupBy("diagnosis_year").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("value", "percentage")))).alias("percentages")
    ).orderBy("diagnosis_year")


# --- social and environmental profiles ------------------------------------------------------


def _profile(rows: DataFrame, keys: Sequence[str], model: RiskModel, **options) -> DataFrame:
    return cohort_summary(
        rows, keys, model, averages=PROFILE_AVERAGES, percentages=PROFILE_PERCENTAGES, **options
    )


def profile_by_stratum(patients: DataFrame, model: RiskModel, as_of=None, **options) -> DataFrame:
    keys = ["socioeconomic_status"]
    return _profile(_rows(patients, keys, as_of), keys, model, **options).orderBy(*keys)


def profile_by_education(patients: DataFrame, model: RiskModel, as_of=None, **options) -> DataFrame:
    """By education code, with its label."""
    keys = ["education_level"]
    out = _profile(_rows(patients, keys, as_of), keys, model, **options)
    label = code_label(F.col("education_level").cast("int"), EDUCATION_LABELS, UNKNOWN_LABEL)
    return out.withColumn("education_label", label).orderBy(*keys)


def profile_by_infrastructure(patients: DataFrame, model: RiskModel, as_of=None, **options) -> DataFrame:
    """By access to each of four services on its own, in one scan.

    The rows are first summed per combination of the four flags (at most 3^4 = 81 of them); only
    those sums are unpivoted. With means per cohort known to a network only after grouping, its rows
    are unpivoted instead.
    """
    flags = list(INFRASTRUCTURE_COLUMNS)
    rows = _rows(patients, flags, as_of)
    min_rows = options.pop("min_rows", MIN_PATIENTS)
    sums = CohortSums(
        model, averages=PROFILE_AVERAGES, percentages=PROFILE_PERCENTAGES, **options
    )
    keys = ["indicator", "access_code"]
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("indicator"), F.col(c).cast("int").alias("access_code")) for c in flags
    ])).alias("_pair")
    if sums.score_first and sums.scope == "cohort":
        long = rows.select("*", pairs).select("*", "_pair.indicator", "_pair.access_code").drop("_pair")
        grouped = sums.aggregate(long, keys)
    else:
        # Null flags form combinations of their own here and leave with the unpivoted null keys.
        marked = rows.withColumns({f"_{c}": F.coalesce(F.col(c).cast("int"), F.lit(-1)) for c in flags})
        fine = sums.aggregate(marked, [f"_{c}" for c in flags])
        pairs = F.explode(F.array(*[
            F.struct(F.lit(c).alias("indicator"), F.nullif(F.col(f"_{c}"), F.lit(-1)).alias("access_code"))
            for c in flags
        ])).alias("_pair")
        long = fine.select("*", pairs).select("*", "_pair.indicator", "_pair.access_code")
        grouped = sums.combine(long.drop("_pair", *[f"_{c}" for c in flags]), keys)
    label = F.when(F.col("access_code") == 1, F.lit(ACCESS_LABELS[1])).otherwise(F.lit(ACCESS_LABELS[0]))
    return sums.finish(grouped, keys, min_rows).withColumn("access", label).orderBy(*keys)


def profile_by_area(patients: DataFrame, model: RiskModel, as_of=None, **options) -> DataFrame:
    """Urban against rural."""
    keys = ["rural_area"]
    out = _profile(_rows(patients, keys, as_of), keys, model, **options)
    return out.withColumn("area", code_label(F.col("rural_area"), AREA_LABELS, AREA_LABELS["R"])).orderBy(*keys)


def profile_by_smoker_diabetes(patients: DataFrame, model: RiskModel, as_of=None, **options) -> DataFrame:
    """By the four combinations of smoking and diabetes."""
    rows = not_null(_rows(patients, ["is_smoker", "diabetes"], as_of), ["is_smoker", "diabetes"])
    rows = rows.withColumn("smoker_diabetes", combo_label(F.col("is_smoker"), F.col("diabetes")))
    return cohort_summary(rows, "smoker_diabetes", model, averages=PROFILE_AVERAGES, **options).orderBy("smoker_diabetes")


def _by_place_value(
    patients: DataFrame, municipalities: DataFrame, model: RiskModel, key: str, bin_of: Column,
    places: DataFrame, as_of, averages, percentages, place_averages, impute_scope, min_rows,
) -> DataFrame:
    """Cohorts by a bin of a municipality column.

    The patients are summed per municipality first and the sums, not the patients, are joined with
    the dimension and added up per bin: nothing about the join depends on the number of patients
    or on how they spread over municipalities. Patients of a municipality with a null in any of its
    columns count, but their rows do not survive cleaning.
    """
    columns = [c for c in places.columns if c not in GEO_KEYS]
    places = places.withColumn(key, bin_of)
    sums = CohortSums(model, impute_scope, averages, percentages)
    rows = _rows(patients, GEO_KEYS, as_of)
    if sums.score_first and impute_scope == "cohort":
        tagged = with_geography(rows, places)
        sums = CohortSums(model, impute_scope, {**averages, **place_averages}, percentages, also_required=columns)
        return sums.finish(sums.aggregate(tagged, [key]), [key], min_rows)
    whole = F.lit(True)
    for c in columns:
        whole = whole & F.col(c).isNotNull()
    flagged = places.withColumn("_whole", whole).select(
        *GEO_KEYS, key, "_whole", *[c for c in place_averages.values()]
    )
    fine = sums.aggregate(rows, list(GEO_KEYS)).join(flagged, list(GEO_KEYS))
    fine = fine.withColumns({
        f"m_{part}_{c}": col for c in place_averages.values() for part, col in (
            ("sum", F.col(c) * F.col("n")), ("cnt", F.when(F.col(c).isNotNull(), F.col("n")).otherwise(F.lit(0)))
        )
    })
    grouped = sums.combine(fine, [key], F.col("_whole"))
    sums.averages = {**averages, **place_averages}
    return sums.finish(grouped, [key], min_rows)


def profile_by_temperature(
    patients: DataFrame, municipalities: DataFrame, model: RiskModel,
    edges: Sequence[float] = TEMPERATURE_EDGES, min_rows: int | None = MIN_PATIENTS,
    impute_scope: str = "cohort", as_of=None,
) -> DataFrame:
    """By temperature range of the municipality: `(a, b]`, the first range closed."""
    places = unique_municipalities(require_columns(lowercase_columns(municipalities), ["average_temperature"]))
    bin_of = cut(F.col("average_temperature"), edges, range_labels(edges, TEMPERATURE_UNIT), include_lowest=True)
    out = _by_place_value(
        patients, municipalities, model, "temperature_range", bin_of, places, as_of,
        PROFILE_AVERAGES, PROFILE_PERCENTAGES, {}, impute_scope, min_rows,
    )
    return _in_bin_order(out, "temperature_range", range_labels(edges, TEMPERATURE_UNIT))


def profile_by_precipitation(
    patients: DataFrame, municipalities: DataFrame, model: RiskModel,
    edges: Sequence[float] = PRECIPITATION_EDGES, min_rows: int | None = MIN_PATIENTS,
    impute_scope: str = "cohort", as_of=None,
) -> DataFrame:
    """By precipitation range, with mean temperature and altitude over the patients."""
    needed = ["annual_precipitation", "average_temperature", "average_altitude"]
    places = unique_municipalities(require_columns(lowercase_columns(municipalities), needed))
    places = places.withColumn("annual_precipitation", parse_range_mean(F.col("annual_precipitation")))
    bin_of = cut(F.col("annual_precipitation"), edges, range_labels(edges, PRECIPITATION_UNIT), include_lowest=True)
    out = _by_place_value(
        patients, municipalities, model, "precipitation_range", bin_of, places, as_of, {}, {},
        {"avg_temperature": "average_temperature", "avg_altitude": "average_altitude"}, impute_scope, min_rows,
    )
    return _in_bin_order(out, "precipitation_range", range_labels(edges, PRECIPITATION_UNIT))


def _in_bin_order(df: DataFrame, key: str, labels: Sequence[str]) -> DataFrame:
    """Sorted by bin, not by the label's text."""
    return df.orderBy(F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(key)))


def risk_distribution(
    patients: DataFrame, model: RiskModel, edges: Sequence[float] = RISK_EDGES,
    department: str | None = None, impute_scope: str = "cohort", as_of=None,
) -> DataFrame:
    """Predicted scores per bin, empty bins included; shares of the rows inside the bins.

    All bins are counted in one aggregate row, which is then unfolded.
    """
    rows = optional_eq(_rows(patients, ["department"] if department else [], as_of), "department", department)
    scored = score(rows, model, impute_scope)
    labels = range_labels(edges)
    tests = bin_conditions(F.col("score"), edges, include_lowest=True)
    counts = scored.agg(*[F.count_if(test).alias(f"b{i}") for i, test in enumerate(tests)])
    total = sum((F.col(f"b{i}") for i in range(1, len(tests))), F.col("b0"))
    bins = F.array(*[F.struct(F.lit(x).alias("risk_range"), F.col(f"b{i}").alias("n")) for i, x in enumerate(labels)])
    return (
        counts.select(total.alias("total"), F.posexplode(bins).alias("bin", "cell"))
        .select(
            F.lit(department if department else "Global").alias("department"),
            "bin", "cell.risk_range", "cell.n",
            F.coalesce(
                round_to(F.try_divide(F.col("cell.n"), F.col("total")) * F.lit(100.0), 2), F.lit(0.0)
            ).alias("percentage"),
        ).orderBy("bin")
    )


# --- factors of one place -------------------------------------------------------------------


def factors_by_place(
    patients: DataFrame, model: RiskModel, level: str, value: str, n: int = 10,
    impute_scope: str = "cohort", as_of=None,
) -> DataFrame:
    """The driving factors of one department or municipality, in long form."""
    rows = _rows(patients, [level], as_of).where(ieq(F.col(level), value)).withColumn(
        "place", F.upper(F.trim(F.col(level)))
    )
    found = cohort_summary(rows, "place", model, factors=n, min_rows=None, impute_scope=impute_scope)
    return explode_factors(found, ["place"])

