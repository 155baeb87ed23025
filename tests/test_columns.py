import math

import pytest
from pyspark.sql import functions as F

from cohortwise.fixed_values import AGE_EDGES, AGE_LABELS, EDUCATION_LABELS, TARGET_EDGES, TEMPERATURE_EDGES
from cohortwise.functions import (
    canonical_area, canonical_sex, code_label, combo_label, cut, date_parts, days_since, decade_bin,
    digitize, hash_normal, hash_uniform, ieq, parse_date, parse_range_mean, period_flag,
    range_labels, risk_band, strip_prefix, to_numeric,
)


def values(spark, kind, inputs, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, x {kind}")
    return [r[0] for r in rows.select(make(F.col("x")).alias("y"), "i").orderBy("i").collect()]


def test_risk_band_edges(spark):
    got = values(spark, "double", [0.1999, 0.2, 0.4, 0.6, 0.8, None, math.nan], risk_band)
    assert got == ["Muy Bajo", "Bajo", "Moderado", "Alto", "Muy Alto", None, None]


def test_range_text(spark):
    texts = ["1000-1500", "1200", "1-2-6", "-5", "", "abc", "nan", None, " 10 - 20 ", "1.5f", "1e3"]
    assert values(spark, "string", texts, parse_range_mean) == [
        1250.0, 1200.0, 3.0, None, None, None, None, None, 15.0, None, 1000.0]


def test_to_numeric(spark):
    assert values(spark, "string", ["1", " 2.5 ", "x", "", "NaN", "3d", None], to_numeric) == [
        1.0, 2.5, None, None, None, None, None]


def test_age_bands_are_left_closed(spark):
    ages = [0.0, 17.0, 18.0, 30.0, 75.0, 119.0, 120.0, -1.0, None, math.nan]
    got = values(spark, "double", ages, lambda c: cut(c, AGE_EDGES, AGE_LABELS, right=False))
    assert got == ["0-18", "0-18", "19-30", "31-45", "76+", "76+", None, None, None, None]


def test_temperature_bins_are_right_closed(spark):
    labels = range_labels(TEMPERATURE_EDGES, "°C")
    got = values(spark, "double", [10.0, 15.0, 15.1, 30.0, 30.1, 9.9],
                 lambda c: cut(c, TEMPERATURE_EDGES, labels, include_lowest=True))
    assert got == ["10-15°C", "10-15°C", "15-20°C", "25-30°C", None, None]
    assert values(spark, "double", [10.0], lambda c: cut(c, TEMPERATURE_EDGES)) == [None]


def test_labels_print_whole_edges_without_decimals():
    assert range_labels([20.0, 10, 12.5]) == ["10-12.5", "12.5-20"]
    with pytest.raises(ValueError):
        range_labels([1, 1, 2])


def test_digitize(spark):
    got = values(spark, "double", [-0.1, 0.0, 0.3, 1.0, 1.1, None, math.nan], lambda c: digitize(c, TARGET_EDGES))
    assert got == [0, 1, 2, 5, 6, None, None]


def test_decade(spark):
    assert values(spark, "double", [0.0, 9.0, 10.0, 39.5, None], decade_bin) == [0, 0, 10, 30, None]


def test_dates(spark):
    texts = ["2021-05-17", "2019-12-31 23:00:00", "not-a-date", "", None]

    def part(name):
        return values(spark, "string", texts, lambda c: date_parts(parse_date(c), "2024-01-01")[name])

    assert part("diagnosis_year") == [2021, 2019, None, None, None]
    assert part("diagnosis_trimester") == ["T2", "T4", None, None, None]
    assert part("pandemic_period") == [1, 0, 0, 0, 0]
    assert part("days_since_diagnosis") == [959, 1461, None, None, None]


def test_days_since_rounds_down(spark):
    got = values(spark, "string", ["2024-01-01 01:00:00", "2024-01-02 01:00:00"],
                 lambda c: days_since(parse_date(c), "2024-01-02"))
    assert got == [0, -1]


def test_other_date_formats(spark):
    got = values(spark, "string", ["17/05/2021", "2021-05-17", "x"],
                 lambda c: F.year(parse_date(c, ("dd/MM/yyyy", "yyyy-MM-dd"))))
    assert got == [2021, 2021, None]


def test_period_flag(spark):
    assert values(spark, "int", [2019, 2020, None], lambda c: period_flag(c, [2020])) == [0, 1, 0]


def test_text_labels(spark):
    assert values(spark, "int", [1, 10, 11, None], lambda c: code_label(c, EDUCATION_LABELS, "Desconocido")) == [
        "Ninguno", "Especialización", "Desconocido", None]
    assert values(spark, "int", [1, 0], lambda c: combo_label(c, F.lit(0))) == [
        "Fumador / No Diabético", "No Fumador / No Diabético"]
    assert values(spark, "string", [" asia", "Asia", "Asian", None], lambda c: ieq(c, "ASIA ")) == [True, True, False, None]
    assert values(spark, "string", ["municipality_La Ceja", "age"], lambda c: strip_prefix(c, "municipality_")) == ["La Ceja", "age"]
    assert values(spark, "string", ["masculino", "M", "femenino", "X", None], canonical_sex) == ["M", "M", "F", "X", None]
    assert values(spark, "string", ["0", "u", "1", "R", None], canonical_area) == ["U", "U", "R", "R", None]


def test_hash_numbers_depend_on_values_only(spark):
    ids = spark.range(20_000)
    one = ids.select(F.avg(hash_uniform(1, "id")), F.stddev(hash_normal(1, "id")), F.avg(hash_normal(1, "id"))).first()
    two = ids.repartition(7, F.rand()).select(
        F.avg(hash_uniform(1, "id")), F.stddev(hash_normal(1, "id")), F.avg(hash_normal(1, "id"))).first()
    assert one[0] == pytest.approx(0.5, abs=0.01)
    assert one[1] == pytest.approx(1.0, abs=0.02)
    assert one[2] == pytest.approx(0.0, abs=0.03)
    assert tuple(one) == pytest.approx(tuple(two), abs=1e-9)
