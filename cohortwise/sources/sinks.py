"""Importance table sink and reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas
from .readers import read_csv


def write_importances(importances: DataFrame, path: str) -> None:
    """`Feature,Importance` CSV, most important first.

    The table has one row per model feature, so one sorted file is the right size whatever the
    number of patients.
    """
    tie = [F.col("feature_idx")] if "feature_idx" in importances.columns else [F.col("feature")]
    (
        importances.orderBy(F.col("importance").desc(), *tie)
        .select(F.col("feature").alias("Feature"), F.col("importance").alias("Importance"))
        .coalesce(1)
        .write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)
    )


def read_importances(spark: SparkSession, path: str) -> DataFrame:
    """The table `write_importances` wrote."""
    raw = read_csv(spark, path)
    return raw.select(
        F.col("Feature").alias(schemas.IMPORTANCES[0].name),
        F.col("Importance").try_cast("double").alias(schemas.IMPORTANCES[1].name),
    )
