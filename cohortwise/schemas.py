"""Explicit schemas of the two input tables."""

from __future__ import annotations

from pyspark.sql import types as T

_TEXT = T.StringType()
_INT = T.IntegerType()
_NUM = T.DoubleType()


def _struct(**columns) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


PATIENTS = _struct(
    department=_TEXT, municipality=_TEXT,
    sex=_TEXT, marital_status=_TEXT, occupation=_TEXT, ethnicity=_TEXT, rural_area=_TEXT,
    education_level=_INT, socioeconomic_status=_INT,
    age=_NUM, bmi=_NUM, heart_rate=_INT, total_cholesterol=_NUM, glucose=_NUM,
    is_smoker=_INT, bpm_meds=_INT, diabetes=_INT, family_history=_INT,
    has_electricity=_INT, has_water_supply=_INT, has_sewage=_INT, has_gas=_INT, has_internet=_INT,
    diagnosis_date=T.TimestampType(), risk_score=_NUM, cardiovascular_risk=_TEXT,
)

MUNICIPALITIES = _struct(
    department=_TEXT, municipality=_TEXT,
    latitude=_NUM, longitude=_NUM, average_altitude=_NUM, average_temperature=_NUM,
    annual_precipitation=_TEXT, estimated_population=_NUM, literacy_rate=_NUM, poverty_rate=_NUM,
    climate_classification=_TEXT,
)

WEIGHTS = _struct(feature_idx=_INT, feature=_TEXT, unit=_INT, weight=_NUM)
IMPORTANCES = _struct(feature=_TEXT, importance=_NUM)
