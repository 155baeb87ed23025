"""Feature preparation (E1-E8): a fit is an aggregate job, a transform is a set of expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..fixed_values import (
    CATEGORICAL_FEATURES, CLIMATE_FEATURE, DEFAULT_PATIENT_COLUMNS, NUMERIC_FEATURES,
    POPULATION_CATEGORICAL, POPULATION_GEOGRAPHY, POPULATION_MEANS,
)
from ..functions import sql_text
from ..functions import (
    canonical_area, canonical_sex, date_parts, hash_normal, parse_date, parse_range_mean,
    to_numeric,
)
from ..functions.numbers import not_nan
from ..sources.readers import lowercase_columns, require_columns, with_defaults
from .joins import join_counted
from .quantiles import exact_percentiles

ABSENT_CATEGORY = "missing"


@dataclass(frozen=True)
class FeatureSpec:
    """Which columns a model reads and how they are prepared."""

    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    scaler: str                          # "robust" or "standard"
    missing_category: str | None = None  # None: a null category makes the row unscorable
    nullable_categories: tuple[str, ...] = ()

    def with_columns(self, numeric: Sequence[str] = (), categorical: Sequence[str] = ()) -> FeatureSpec:
        return replace(
            self, numeric=self.numeric + tuple(numeric), categorical=self.categorical + tuple(categorical)
        )


# A null date leaves the quarter label null, which is coded as all zeros and keeps the row.
INDIVIDUAL = FeatureSpec(
    NUMERIC_FEATURES, CATEGORICAL_FEATURES, "robust", nullable_categories=("diagnosis_trimester",)
)
INDIVIDUAL_WITH_CLIMATE = INDIVIDUAL.with_columns(categorical=(CLIMATE_FEATURE,))
INDIVIDUAL_WITH_SEWAGE = INDIVIDUAL.with_columns(numeric=("has_sewage",))
POPULATION = FeatureSpec(
    tuple(c for c in POPULATION_MEANS if c != "risk_score") + POPULATION_GEOGRAPHY,
    POPULATION_CATEGORICAL, "standard", missing_category="Missing",
)


def rename_targets(df: DataFrame) -> DataFrame:
    """`risk_score` and `cardiovascular_risk` under their names as training targets."""
    return df.withColumnsRenamed(
        {"risk_score": "target_score", "cardiovascular_risk": "target_risk_category"}
    )


# Categories of all columns that a model holds, in its own lists and on the driver.
MODEL_CATEGORIES = 100_000


def prepare_patients(df: DataFrame, as_of=None, date_formats: Sequence[str] = ()) -> DataFrame:
    """Raw patient rows with lower-case names, defaults, parsed types and date parts.

    Row count never changes here. `as_of` is the day `days_since_diagnosis` counts to.
    """
    df = with_defaults(lowercase_columns(df), DEFAULT_PATIENT_COLUMNS)
    kinds = {field.name: field.dataType for field in df.schema}
    changed: dict[str, Column] = {}
    for name in NUMERIC_FEATURES + ("has_sewage", "risk_score"):
        if isinstance(kinds.get(name), T.StringType):
            changed[name] = to_numeric(F.col(name))
        elif isinstance(kinds.get(name), (T.DoubleType, T.FloatType)):
            changed[name] = not_nan(F.col(name))
    if "sex" in kinds:
        changed["sex"] = canonical_sex(F.col("sex"))
    if "rural_area" in kinds:
        changed["rural_area"] = canonical_area(F.col("rural_area"))
    if isinstance(kinds["diagnosis_date"], T.StringType):
        changed["diagnosis_date"] = parse_date(F.col("diagnosis_date"), date_formats)
    return df.withColumns(changed).withColumns(date_parts(F.col("diagnosis_date"), as_of))


def prepare_groups(df: DataFrame) -> DataFrame:
    """Population groups with lower-case names and numeric precipitation."""
    df = lowercase_columns(df)
    kinds = {field.name: field.dataType for field in df.schema}
    if isinstance(kinds.get("annual_precipitation"), T.StringType):
        df = df.withColumn("annual_precipitation", parse_range_mean(F.col("annual_precipitation")))
    return df


def category_sql(df: DataFrame, spec: FeatureSpec, column: str) -> str:
    """SQL text of a category, with the spec's stand-in for nulls and for an absent column."""
    if column not in df.columns:
        return sql_text.text(ABSENT_CATEGORY)
    value = f"CAST({sql_text.name(column)} AS STRING)"
    return f"coalesce({value}, {sql_text.text(spec.missing_category)})" if spec.missing_category else value


def category_text(df: DataFrame, spec: FeatureSpec, column: str) -> Column:
    """A category as a text column."""
    return F.expr(category_sql(df, spec, column))


def scorable_sql(df: DataFrame, spec: FeatureSpec, also: Sequence[str] = ()) -> str:
    """SQL text of the test whether a row survives cleaning: no null left once numbers are imputed."""
    needed = list(also)
    if spec.missing_category is None:
        needed += [c for c in spec.categorical if c not in spec.nullable_categories]
    return sql_text.all_present(c for c in dict.fromkeys(needed) if c in df.columns)


def is_scorable(df: DataFrame, spec: FeatureSpec, also: Sequence[str] = ()) -> Column:
    return F.expr(scorable_sql(df, spec, also))


# --- E1, E2 ---------------------------------------------------------------------------------


def column_means(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Mean of every column over the whole table, in one aggregate."""
    row = df.agg(*[F.avg(not_nan(F.col(c).cast("double"))).alias(c) for c in columns]).collect()[0]
    return row.asDict()


def fill_values(
    df: DataFrame,
    columns: Sequence[str],
    scope: str = "training",
    means: Mapping[str, float | None] | None = None,
    keys: Sequence[str] = (),
) -> tuple[DataFrame, dict[str, str]]:
    """The table and, per column, the SQL text of the value that stands for a null.

    `training` takes the stored `means` (or those of this table). `cohort` takes the mean of the
    row's own cohort: one aggregate per `keys`, joined back as helper columns `_mean_*`. It is never
    a window over the raw rows, because a cohort may hold a third of the table. Without keys the
    cohort is the whole table.
    """
    if scope not in ("training", "cohort"):
        raise ValueError(f"unknown impute scope {scope!r}")
    if scope == "training" or not keys:
        means = column_means(df, columns) if means is None or scope == "cohort" else means
        return df, {
            c: "CAST(NULL AS DOUBLE)" if means[c] is None else sql_text.number(means[c]) for c in columns
        }
    cohort = df.groupBy(*keys).agg(*[F.avg(c).alias(f"_mean_{c}") for c in columns])
    return join_counted(df, cohort, keys), {c: sql_text.name(f"_mean_{c}") for c in columns}


def impute_mean(
    df: DataFrame,
    columns: Sequence[str],
    scope: str = "training",
    means: Mapping[str, float | None] | None = None,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Numeric nulls filled with a mean; the scopes are those of `fill_values`."""
    columns = list(columns)
    df, fills = fill_values(df, columns, scope, means, keys)
    filled = {c: F.expr(filled_sql(c, fills[c])) for c in columns}
    return df.withColumns(filled).drop(*[f"_mean_{c}" for c in columns])


def filled_sql(column: str, fill: str) -> str:
    return f"coalesce(CAST({sql_text.name(column)} AS DOUBLE), {fill})"


def fill_missing(df: DataFrame, columns: Sequence[str], value: str = "Missing") -> DataFrame:
    """Null categories filled with a placeholder; the columns become text."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(value)) for c in columns})


# --- E3, E4 ---------------------------------------------------------------------------------


def robust_scale_fit(
    df: DataFrame, columns: Mapping[str, Column] | Sequence[str],
    known: Mapping[tuple[object, str], tuple[int, float, float]] | None = None,
) -> dict[str, tuple[float, float]]:
    """(median, interquartile range) per column, exact; a zero range is replaced by 1.

    Runs jobs; `known` is that of `exact_percentiles`.
    """
    if not isinstance(columns, Mapping):
        columns = {c: F.col(c) for c in columns}
    found = exact_percentiles(df, columns, (0.25, 0.5, 0.75), known=known)
    out = {}
    for name in columns:
        low, median, high = found[0, name]
        if median is None:
            raise ValueError(f"column {name} has no value to fit a scaler on")
        out[name] = (median, (high - low) or 1.0)
    return out


def standard_scale_fit(df: DataFrame, columns: Mapping[str, Column] | Sequence[str]) -> dict[str, tuple[float, float]]:
    """(mean, population standard deviation) per column; a zero deviation is replaced by 1."""
    if not isinstance(columns, Mapping):
        columns = {c: F.col(c) for c in columns}
    measures = []
    for i, col in enumerate(columns.values()):
        value = not_nan(col.cast("double"))
        measures += [F.avg(value).alias(f"m{i}"), F.stddev_pop(value).alias(f"s{i}")]
    row = df.agg(*measures).collect()[0]
    out = {}
    for i, name in enumerate(columns):
        if row[f"m{i}"] is None:
            raise ValueError(f"column {name} has no value to fit a scaler on")
        out[name] = (row[f"m{i}"], row[f"s{i}"] or 1.0)
    return out


def scale_apply(df: DataFrame, params: Mapping[str, tuple[float, float]]) -> DataFrame:
    """`(x - center) / scale` for every fitted column."""
    return df.withColumns({
        name: (F.col(name) - F.lit(center)) / F.lit(scale) for name, (center, scale) in params.items()
    })


# --- E5, E6, E7 -----------------------------------------------------------------------------


def category_values(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    """The distinct values of every categorical column, one row (column, value) each.

    A row gives a pair per column; equal pairs are one before they leave an executor, so a value that most
    rows have costs nothing, and a column with very many values is spread over all tasks.
    """
    pairs = [F.struct(F.lit(c).alias("column"), category_text(df, spec, c).alias("value")) for c in spec.categorical if c in df.columns]
    if not pairs:
        return df.sparkSession.createDataFrame([], "column string, value string")
    return df.select(F.explode(F.array(*pairs)).alias("pair")).select("pair.*").where(F.col("value").isNotNull()).distinct()


def read_categories(df: DataFrame, spec: FeatureSpec, limit: int = MODEL_CATEGORIES) -> dict[str, list[str]]:
    """The values of every categorical column, sorted. They become the model's own lists, so at most `limit`
    of them are read; more are an error that tells how many each column has."""
    values = category_values(df, spec)
    found = values.limit(limit + 1).collect()
    if len(found) > limit:
        counts = {r["column"]: r["n"] for r in values.groupBy("column").agg(F.count("*").alias("n")).collect()}
        listed = ", ".join(f"{c} ({n})" for c, n in sorted(counts.items(), key=lambda p: -p[1]))
        raise ValueError(f"more categories than a model holds ({limit}): {listed}")
    lists: dict[str, list[str]] = {}
    for r in found:
        lists.setdefault(r["column"], []).append(r["value"])
    return sorted_categories(df, spec, lists)


def one_hot_fit(df: DataFrame, spec: FeatureSpec) -> dict[str, list[str]]:
    """The values of every categorical column, sorted; one pass over the rows, run at once.

    Whole-number columns are sorted by number, so that `10` follows `9`.
    """
    return read_categories(df, spec)


def sorted_categories(df: DataFrame, spec: FeatureSpec, found: Mapping[str, Sequence[str]]) -> dict[str, list[str]]:
    whole = {f.name for f in df.schema if isinstance(f.dataType, T.IntegralType)}

    def place(column: str, text: str) -> tuple:
        return (0, int(text), "") if column in whole and text.lstrip("-").isdigit() else (1, 0, text)

    return {c: sorted(found.get(c, ()), key=lambda text: place(c, text)) for c in spec.categorical}


def one_hot_names(categories: Mapping[str, Sequence[str]]) -> list[str]:
    return [f"{column}_{value}" for column, values in categories.items() for value in values]


def one_hot_apply(
    df: DataFrame, spec: FeatureSpec, categories: Mapping[str, Sequence[str]]
) -> DataFrame:
    """0/1 columns named `column_value`; a null or unseen value gives zeros only."""
    flags = {}
    for column, values in categories.items():
        text = category_text(df, spec, column)
        for value in values:
            flags[f"{column}_{value}"] = F.coalesce(text == F.lit(value), F.lit(False)).cast("double")
    return df.withColumns(flags)


def align_features(df: DataFrame, feature_names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The features in their trained order: absent ones as 0, unknown ones dropped."""
    have = set(df.columns)
    return df.select(*keep, *[
        F.col(f"`{name}`").cast("double").alias(name) if name in have else F.lit(0.0).alias(name)
        for name in feature_names
    ])


# --- E8 -------------------------------------------------------------------------------------


def augment_noise(
    df: DataFrame,
    columns: Sequence[str],
    std: float = 0.01,
    factor: int = 1,
    seed: int = 42,
    row_key: Sequence[str] | None = None,
) -> DataFrame:
    """The rows plus `factor` copies with Gaussian noise on the named columns.

    `copy` is 0 for the original row. The noise comes from a hash of the row, the copy and the
    column, so a task that runs twice gives the same rows; no shuffle is needed. Without `row_key`
    the whole row is hashed, and identical rows then get identical noise.
    """
    key = [F.col(c) for c in (row_key or df.columns)]
    copies = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(factor))))
    return _with_noise(copies, columns, std, seed, key, F.col("copy"))


def perturb(
    df: DataFrame, columns: Sequence[str], std: float = 0.01, seed: int = 42,
    row_key: Sequence[str] | None = None,
) -> DataFrame:
    """Gaussian noise added in place, without copies (the population form)."""
    return _with_noise(df, columns, std, seed, [F.col(c) for c in (row_key or df.columns)], F.lit(1))


def _with_noise(df, columns, std, seed, key, copy):
    return df.withColumns({
        c: F.when(copy == 0, F.col(c).cast("double")).otherwise(
            F.col(c) + F.lit(std) * hash_normal(seed, F.lit(c), copy, *key)
        )
        for c in columns
    })


def require_features(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    """An error that names the numeric inputs the table lacks."""
    return require_columns(df, spec.numeric)
