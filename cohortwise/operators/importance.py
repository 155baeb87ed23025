"""Feature-importance operators over the weights table.

The table has one row per model feature and unit, so its size is the model's, not the data's.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..fixed_values import (
    FEATURE_GROUPS, GEO_FEATURE_GROUP, OTHER_FEATURE_GROUP,
)
from ..functions import round_to, strip_prefix
from .filters import exclude_prefixes, min_value
from .joins import BROADCAST_ROWS, join_counted

TOP_FEATURES = 10


def feature_importance(weights: DataFrame, how: str = "mean") -> DataFrame:
    """Importance per feature: `mean` or `sum` of |w| over units, or `first` for unit 0."""
    size = F.abs("weight")
    if how == "first":
        return weights.where(F.col("unit") == 0).select("feature_idx", "feature", size.alias("importance"))
    measure = {"mean": F.avg, "sum": F.sum}.get(how)
    if measure is None:
        raise ValueError(f"unknown importance {how!r}")
    return weights.groupBy("feature_idx", "feature").agg(measure(size).alias("importance"))


def top_n(df: DataFrame, column: str, n: int, asc: bool = False, tie: str = "feature_idx") -> DataFrame:
    """The `n` highest (or lowest) rows; equal values are taken in `tie` order."""
    order = F.col(column).asc() if asc else F.col(column).desc()
    return df.orderBy(order, F.col(tie).asc()).limit(n)


def importance_report(
    importances: DataFrame, top: int | None = None, threshold: float | None = None, exclude_geo: bool = True
) -> DataFrame:
    """Features after the optional geography filter, top cut and threshold, in this order."""
    kept = exclude_prefixes(importances) if exclude_geo else importances
    return min_value(top_n(kept, "importance", top) if top else kept, "importance", threshold)


def importance_summary(report: DataFrame) -> DataFrame:
    """Count, maximum, minimum and mean of a report's importances."""
    return report.agg(
        F.count("*").alias("count"), F.max("importance").alias("max"),
        F.min("importance").alias("min"), F.avg("importance").alias("mean"),
    )


def geo_importance(importances: DataFrame, prefix: str, top: int = TOP_FEATURES) -> DataFrame:
    """The most important features under a prefix, named without it, with their total number."""
    # At most one row per feature, so this window over all of them stays small.
    under = importances.where(F.col("feature").startswith(prefix)).withColumn(
        "total", F.count("*").over(Window.partitionBy()))
    return top_n(under, "importance", top).select(
        "feature_idx", strip_prefix(F.col("feature"), prefix).alias("name"), "importance", "total",
    )


def importance_statistics(importances: DataFrame, exclude_geo: bool = True) -> DataFrame:
    """Extremes, mean, linear-interpolated quartiles and number of the importances."""
    kept = exclude_prefixes(importances) if exclude_geo else importances
    quarter = F.percentile("importance", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return kept.agg(
        F.min("importance").alias("min"), F.max("importance").alias("max"),
        F.avg("importance").alias("mean"), quarter.alias("_q"), F.count("*").alias("total_features"),
    ).select(
        "min", "max", "mean", F.get("_q", F.lit(1)).alias("median"),
        F.get("_q", F.lit(0)).alias("percentile_25"), F.get("_q", F.lit(2)).alias("percentile_75"),
        "total_features",
    )


def least_important(importances: DataFrame, top: int = TOP_FEATURES, exclude_geo: bool = True) -> DataFrame:
    """The least important features, in ascending order."""
    kept = exclude_prefixes(importances) if exclude_geo else importances
    return top_n(kept, "importance", top, asc=True)


def feature_group(
    feature: Column, include_geo: bool = False, groups: Mapping[str, Sequence[str]] = FEATURE_GROUPS
) -> Column:
    """Group of a feature by name prefix, the first match in order; the rest is `Others`.

    With geography switched off its features are not dropped but counted in `Others`.
    """
    label = None
    for name, prefixes in groups.items():
        if name == GEO_FEATURE_GROUP and not include_geo:
            continue
        for prefix in prefixes:
            test = feature.startswith(prefix)
            label = F.when(test, F.lit(name)) if label is None else label.when(test, F.lit(name))
    return label.otherwise(F.lit(OTHER_FEATURE_GROUP))


def importance_by_category(importances: DataFrame, include_geo: bool = False) -> DataFrame:
    """Total importance per feature group and its share of the whole."""
    totals = importances.groupBy(feature_group(F.col("feature"), include_geo).alias("category")).agg(
        F.sum("importance").alias("total")
    )
    # At most one row per feature group, so this window over all of them stays tiny.
    whole = F.sum("total").over(Window.partitionBy())
    return totals.select(
        "category", "total", round_to(F.try_divide(F.col("total"), whole), 4).alias("share")
    )


def with_importance(
    activations: DataFrame, importances: DataFrame, by: str = "feature_idx", how: str = "inner", max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Activations times importance, matched by feature (J3); `value` is their product.

    The importances are as many as the model has features; up to `max_rows` of them are broadcast.
    """
    matched = join_counted(activations, importances, [by], how, max_rows)
    return matched.withColumn("value", F.col("activation") * F.col("importance")).drop("importance")
