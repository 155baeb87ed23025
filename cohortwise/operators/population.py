"""Population groups and their risk."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..fixed_values import (
    CLIMATE_FEATURE, GEO_KEYS, POPULATION_CATEGORICAL, POPULATION_GEOGRAPHY, POPULATION_KEYS,
    POPULATION_MEANS,
)
from ..functions import canonical_area, ieq, parse_range_mean
from ..functions.numbers import not_nan
from ..sources.readers import lowercase_columns, require_columns
from .cohorts import cohort_summary
from .features import prepare_groups
from .filters import not_null
from .joins import unique_municipalities
from .model import RiskModel
from .scoring import score


def group_population(patients: DataFrame, municipalities: DataFrame) -> DataFrame:
    """Patients grouped by eight keys: eleven means, eight municipality columns and the group size.

    The climate key and the municipality columns depend on (department, municipality) only, so the
    patients are grouped by their own seven keys first and the groups, not the patients, are joined
    with the dimension. Groups with a null key, such as those of an unknown municipality, have no
    place in the result.
    """
    patients = lowercase_columns(patients)
    own = [k for k in POPULATION_KEYS if k != CLIMATE_FEATURE]
    require_columns(patients, (*own, *POPULATION_MEANS))
    if "rural_area" in patients.columns:
        patients = patients.withColumn("rural_area", canonical_area(F.col("rural_area")))
    groups = not_null(patients, own).groupBy(*own).agg(
        *[F.avg(not_nan(F.col(c).cast("double"))).alias(c) for c in POPULATION_MEANS],
        F.count("*").alias("n_patients"),
    )
    places = unique_municipalities(require_columns(
        lowercase_columns(municipalities), (CLIMATE_FEATURE, *POPULATION_GEOGRAPHY)
    )).withColumn("annual_precipitation", parse_range_mean(F.col("annual_precipitation")))
    places = not_null(places, [CLIMATE_FEATURE]).select(*GEO_KEYS, CLIMATE_FEATURE, *POPULATION_GEOGRAPHY)
    return groups.join(places, list(GEO_KEYS)).select(
        *POPULATION_KEYS, *POPULATION_MEANS, *POPULATION_GEOGRAPHY, "n_patients"
    )


def score_groups(groups: DataFrame, model: RiskModel, impute_scope: str = "cohort") -> DataFrame:
    """Population groups with `risk_estimate`; a null is filled with its municipality's mean."""
    return score(prepare_groups(groups), model, impute_scope, ("municipality",), "risk_estimate")


def population_risk(
    groups: DataFrame, model: RiskModel, impute_scope: str = "cohort"
) -> DataFrame:
    """Group count, unweighted mean estimated risk and band for every municipality.

    The cohort core does it: the rows are population groups here and the cohorts municipalities.
    """
    found = cohort_summary(
        prepare_groups(groups), "municipality", model, impute_scope=impute_scope, min_rows=None
    )
    return found.withColumnRenamed("n_patients", "n_groups")


def population_risk_of(
    groups: DataFrame, municipality: str, model: RiskModel, impute_scope: str = "cohort"
) -> DataFrame:
    """The groups of one municipality with their estimated risk."""
    chosen = groups.where(ieq(F.col("municipality"), municipality))
    return score_groups(chosen, model, impute_scope).select(*POPULATION_CATEGORICAL, "risk_estimate")
