"""The supplied order tables seen as patients and municipalities.

The expressions are plain SQL that Spark and the checking engine read alike: they define the input,
not the operators. A view joins only the tables its wanted columns come from, so a report over
order columns does not shuffle for customer columns it never reads. The joins are left ones, so the
view has the rows of `orders` whatever columns are wanted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

AS_OF = "2024-01-01"


def _flag(test: str) -> str:
    return f"CASE WHEN {test} THEN 1 ELSE 0 END"


# name -> (expression, last table of the chain orders -> customer -> nation -> region it needs)
PATIENT_COLUMNS = {
    "patient_id": ("o_orderkey", "orders"),
    "department": ("r_name", "region"),
    "municipality": ("n_name", "nation"),
    "risk_score": ("o_totalprice / 500000", "orders"),
    "age": ("CAST(1 + o_custkey % 95 AS DOUBLE)", "orders"),
    "bmi": ("18 + o_totalprice / 25000", "orders"),
    "heart_rate": ("CAST(55 + o_orderkey % 50 AS INT)", "orders"),
    "total_cholesterol": (
        "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(150 + o_orderkey % 100 AS DOUBLE) END", "orders"),
    "glucose": (
        "CASE WHEN o_orderkey % 17 = 3 THEN NULL ELSE CAST(70 + o_custkey % 90 AS DOUBLE) END", "orders"),
    "is_smoker": (_flag("o_orderstatus = 'P'"), "orders"),
    "bpm_meds": (_flag("o_orderkey % 4 = 0"), "orders"),
    "diabetes": (_flag("o_orderpriority = '1-URGENT'"), "orders"),
    "family_history": (_flag("(o_custkey + o_orderkey) % 3 = 0"), "orders"),
    "has_electricity": (_flag("o_custkey % 2 = 1"), "orders"),
    "has_water_supply": (_flag("o_custkey % 3 = 0"), "orders"),
    "has_sewage": (_flag("o_custkey % 4 <> 0"), "orders"),
    "has_gas": (_flag("o_custkey % 5 = 0"), "orders"),
    "has_internet": (_flag("o_custkey % 7 = 0"), "orders"),
    "sex": ("CASE WHEN o_orderkey % 2 = 0 THEN 'M' ELSE 'F' END", "orders"),
    "marital_status": (
        "CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_custkey % 4 = 0 THEN 'Single' "
        "WHEN o_custkey % 4 = 1 THEN 'Married' WHEN o_custkey % 4 = 2 THEN 'Divorced' ELSE 'Widowed' END",
        "orders"),
    "ethnicity": (
        "CASE WHEN o_custkey % 5 = 0 THEN 'Afrocolombian' WHEN o_custkey % 5 = 1 THEN 'Indigenous' "
        "WHEN o_custkey % 5 = 2 THEN 'Other' ELSE 'Mestizo/White' END", "orders"),
    "rural_area": ("CASE WHEN o_custkey % 2 = 0 THEN 'U' ELSE 'R' END", "orders"),
    "socioeconomic_status": ("CAST(substr(o_orderpriority, 1, 1) AS INT)", "orders"),
    "education_level": ("CAST(c_nationkey % 10 + 1 AS INT)", "customer"),
    "occupation": ("c_mktsegment", "customer"),
    "diagnosis_date": ("CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_orderdate END", "orders"),
}

MUNICIPALITY_COLUMNS = {
    "department": "r_name",
    "municipality": "n_name",
    "latitude": "CAST(n_nationkey AS DOUBLE) / 4",
    "longitude": "CAST(0 - 70 - n_nationkey AS DOUBLE)",
    "average_altitude": "CAST(100 * n_nationkey AS DOUBLE)",
    "average_temperature": "CAST(8 + n_nationkey AS DOUBLE)",
    "annual_precipitation": (
        "CASE n_nationkey % 11 WHEN 0 THEN '1000-1500' WHEN 1 THEN '1200' WHEN 2 THEN '' WHEN 3 THEN 'abc' WHEN 4 THEN '500' "
        "WHEN 5 THEN '1000' WHEN 6 THEN '2500' WHEN 7 THEN '1500 - 1900' WHEN 8 THEN '2000-2400' WHEN 9 THEN '300' ELSE NULL END"),
    "estimated_population": "CAST(1000 * (n_nationkey + 1) AS DOUBLE)",
    "literacy_rate": "CASE WHEN n_nationkey = 7 THEN NULL ELSE CAST(80 + n_nationkey % 20 AS DOUBLE) END",
    "poverty_rate": "CAST(40 - n_nationkey AS DOUBLE)",
    "climate_classification": (
        "CASE WHEN n_nationkey % 6 = 0 THEN NULL ELSE concat('C', CAST(n_nationkey % 3 AS VARCHAR(3))) END"),
}

_CHAIN = (
    ("customer", "o_custkey", "c_custkey"),
    ("nation", "c_nationkey", "n_nationkey"),
    ("region", "n_regionkey", "r_regionkey"),
)
_DEPTH = {"orders": 0, "customer": 1, "nation": 2, "region": 3}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def patients(spark: SparkSession, sf_dir: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The patients view, with all of its columns or the named ones."""
    columns = list(columns or PATIENT_COLUMNS)
    depth = max(_DEPTH[PATIENT_COLUMNS[c][1]] for c in columns)
    df = table(spark, sf_dir, "orders")
    for name, left, right in _CHAIN[:depth]:
        other = table(spark, sf_dir, name)
        df = df.join(other, F.col(left) == F.col(right), "left")
    return df.select(*[F.expr(PATIENT_COLUMNS[c][0]).alias(c) for c in columns])


def municipalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The municipalities view, 25 places at any scale."""
    df = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return df.select(*[F.expr(text).alias(c) for c, text in MUNICIPALITY_COLUMNS.items()])
