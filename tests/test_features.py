import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import small_patients, to_spark
from cohortwise.operators import features
from cohortwise.operators.features import (
    FeatureSpec, align_features, augment_noise, fill_missing, impute_mean, one_hot_apply, one_hot_fit,
    perturb, prepare_patients, rename_targets, robust_scale_fit, scale_apply, standard_scale_fit,
)
from cohortwise.operators.splits import _test_sizes, random_split, stratified_split


def test_prepare_keeps_every_row(spark):
    df = spark.createDataFrame(
        [("masculino", "0", "2021-03-01", "41", float("nan")), ("F", "R", "bad", "x", 1.0)],
        "SEX string, rural_area string, diagnosis_date string, age string, bmi double",
    )
    rows = prepare_patients(df, "2022-03-01").orderBy("sex").collect()
    assert [(r.sex, r.rural_area, r.age, r.bmi, r.diagnosis_year, r.diagnosis_trimester, r.pandemic_period, r.days_since_diagnosis)
            for r in rows] == [("F", "R", None, 1.0, None, None, 0, None), ("M", "U", 41.0, None, 2021, "T1", 1, 365)]
    assert rows[0].risk_score == 0.0 and rows[0].cardiovascular_risk == 0


def test_default_date(spark):
    row = prepare_patients(spark.createDataFrame([(1,)], "age int"), "2024-01-02").first()
    assert (row.diagnosis_year, row.days_since_diagnosis) == (2024, 1)


def test_rename_targets(spark):
    df = rename_targets(spark.createDataFrame([(0.1, "x")], "risk_score double, cardiovascular_risk string"))
    assert df.columns == ["target_score", "target_risk_category"]


def test_impute_scopes_differ(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None), ("b", 10.0), ("b", None), ("c", None)], "k string, x double")
    def got(**options):
        return sorted((r.k, r.x) for r in impute_mean(df, ["x"], **options).where("x IS NOT NULL").collect())
    assert got(scope="cohort", keys=["k"]) == [("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 10.0), ("b", 10.0)]
    mean = 14 / 3
    assert got() == sorted([("a", 1.0), ("a", 3.0), ("a", mean), ("b", 10.0), ("b", mean), ("c", mean)])
    assert ("c", 7.0) in got(means={"x": 7.0})
    assert ("c", mean) in got(scope="cohort")


def test_impute_beyond_the_broadcast_limit(spark, monkeypatch):
    from cohortwise.operators import joins
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 10.0), ("b", None)], "k string, x double")
    cohort = df.groupBy("k").agg(F.avg("x").alias("m"))
    def joined(limit):
        return joins.join_counted(df, cohort, ["k"], max_rows=limit)
    small, large = joined(10), joined(1)
    assert "strategy=broadcast" in small._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" not in large._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))


def test_fill_missing(spark):
    df = spark.createDataFrame([(None, 3), ("x", None)], "a string, b int")
    assert sorted(map(tuple, fill_missing(df, ["a", "b"]).collect())) == [("Missing", "3"), ("x", "Missing")]


def test_constant_column_is_centred_not_divided(spark):
    df = spark.createDataFrame([(5.0,)] * 4, "x double")
    seven = spark.createDataFrame([(5.0,), (7.0,)], "x double")
    for fit in (robust_scale_fit, standard_scale_fit):
        params = fit(df, ["x"])
        assert params["x"] == (5.0, 1.0)
        assert sorted(r.x for r in scale_apply(seven, params).collect()) == [0.0, 2.0]


def test_scalers_match_numpy(spark):
    frame = small_patients(301)
    x = frame["age"].to_numpy(dtype=float)
    df = to_spark(spark, frame)
    q1, q2, q3 = np.percentile(x, [25, 50, 75])
    assert robust_scale_fit(df, ["age"])["age"] == pytest.approx((q2, q3 - q1))
    assert standard_scale_fit(df, ["age"])["age"] == pytest.approx((x.mean(), x.std()))
    scaled = scale_apply(df, robust_scale_fit(df, ["age"]))
    assert scaled.agg(F.percentile("age", F.lit(0.5))).first()[0] == pytest.approx(0.0)
    with pytest.raises(ValueError):
        robust_scale_fit(df.where("false"), ["age"])


SPEC = FeatureSpec(("x",), ("level", "sex", "gone"), "robust")


def test_one_hot_and_alignment(spark):
    df = spark.createDataFrame([(1.0, 10, "F"), (2.0, 9, None), (3.0, 1, "M")], "x double, level int, sex string")
    categories = one_hot_fit(df, SPEC)
    assert categories == {"level": ["1", "9", "10"], "sex": ["F", "M"], "gone": []}
    new = spark.createDataFrame([(5.0, 9, "X"), (6.0, None, "M")], "x double, level int, sex string")
    hot = one_hot_apply(new, SPEC, categories)
    names = ["x", "level_1", "level_9", "sex_M", "sex_Z"]
    rows = [tuple(r) for r in align_features(hot, names).orderBy("x").collect()]
    assert rows == [(5.0, 0.0, 1.0, 0.0, 0.0), (6.0, 0.0, 0.0, 1.0, 0.0)]
    again = align_features(align_features(hot, names), names)
    assert [tuple(r) for r in again.orderBy("x").collect()] == rows


def test_missing_category_is_a_category_of_the_population_spec(spark):
    spec = FeatureSpec((), ("c",), "standard", missing_category="Missing")
    df = spark.createDataFrame([("a",), (None,)], "c string")
    assert one_hot_fit(df, spec) == {"c": ["Missing", "a"]}
    assert df.select(features.is_scorable(df, spec).alias("s")).where("s").count() == 2


def test_many_categories(spark):
    df = spark.range(30_000).select((F.col("id") % 20_011).cast("string").alias("c"), F.lit(None).cast("string").alias("d"))
    found = one_hot_fit(df, FeatureSpec((), ("c", "d", "absent"), "robust"))
    assert len(found["c"]) == 20_011 and found["d"] == found["absent"] == []


def test_noise_is_repeatable_and_leaves_originals(spark):
    df = spark.range(500).select("id", (F.col("id") % 90).cast("double").alias("age"), F.lit(1.0).alias("flag"))
    def copies(part):
        return {(r.id, r.copy): (r.age, r.flag) for r in augment_noise(part, ["age"], 0.5, 2, row_key=["id"]).collect()}
    one, two = copies(df), copies(df.repartition(9, F.rand()))
    assert one == two and len(one) == 1500
    assert all(one[i, 0] == (float(i % 90), 1.0) for i in range(500))
    moved = np.array([one[i, c][0] - i % 90 for i in range(500) for c in (1, 2)])
    assert moved.std() == pytest.approx(0.5, rel=0.1) and abs(moved.mean()) < 0.05
    assert all(one[i, 1][0] != one[i, 2][0] for i in range(500))
    assert perturb(df, ["age"], 0.5, row_key=["id"]).count() == 500


def test_stratified_split_is_exact_and_stable(spark):
    df = spark.range(4000).select("id", ((F.col("id") * 37 % 1000) / 1000.0 * F.col("id") / 4000).alias("risk_score"))
    def flags(part):
        return {r.id: r.is_test for r in stratified_split(part, row_key=["id"]).select("id", "is_test").collect()}
    one, two = flags(df), flags(df.repartition(11, F.rand()))
    assert one == two
    assert sum(one.values()) == 800
    bins = {r.id: sum(r.risk_score >= e for e in (0, .3, .5, .7, .9, 1.1)) for r in df.collect()}
    for b in set(bins.values()):
        ids = [i for i in bins if bins[i] == b]
        assert sum(one[i] for i in ids) == pytest.approx(0.2 * len(ids), abs=1)


def test_split_sizes_add_up():
    assert _test_sizes({1: 7, 2: 3, 3: 1}, 0.2) == {1: 2, 2: 1, 3: 0}
    assert sum(_test_sizes({1: 999, 2: 333, 5: 17}, 0.2).values()) == 270


def test_rows_without_target_are_in_neither_part(spark):
    df = spark.createDataFrame([(1, None), (2, 0.1), (3, 0.2)], "id int, risk_score double")
    flags = {r.id: r.is_test for r in stratified_split(df, row_key=["id"]).collect()}
    assert flags[1] is None and sorted([flags[2], flags[3]]) == [False, True]


def test_random_split_share(spark):
    df = random_split(spark.range(20_000), 0.2, row_key=["id"])
    assert df.where("is_test").count() == pytest.approx(4000, rel=0.06)
