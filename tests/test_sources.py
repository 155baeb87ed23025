import datetime as dt
import os
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import small_patients, small_spec_model, to_spark, two_layer_model
from cohortwise.operators.filters import exclude_prefixes, having_min, min_value, optional_eq, scorable
from cohortwise.operators.importance import feature_importance
from cohortwise.operators.scoring import score
from cohortwise.operators.staging import release, shared_folder, stage, working_folder
from cohortwise.sources import (
    lowercase_columns, read_importances, read_municipalities, read_patients, require_columns,
    with_defaults, write_importances,
)
from cohortwise.sources.model_store import load_model, save_model


def test_csv_is_typed_by_name(spark, tmp_path):
    path = tmp_path / "patients.csv"
    path.write_text(
        "AGE,Department,municipality,sex,education_level,diagnosis_date,bmi,extra\n"
        "41.5,Caldas,Manizales,M,3,2021-05-17,NA,a\n"
        "x,,Pereira,F,9.0,not-a-date,22.5,b\n"
    )
    df = read_patients(spark, str(path))
    assert df.columns == ["age", "department", "municipality", "sex", "education_level", "diagnosis_date", "bmi", "extra"]
    assert dict(df.dtypes)["education_level"] == "int"
    rows = df.orderBy("municipality").collect()
    assert tuple(rows[0]) == (41.5, "Caldas", "Manizales", "M", 3, dt.datetime(2021, 5, 17), None, "a")
    assert tuple(rows[1]) == (None, None, "Pereira", "F", 9, None, 22.5, "b")


def test_csv_quotes_and_line_breaks(spark, tmp_path):
    path = tmp_path / "patients.csv"
    path.write_text(
        'age,occupation,department,diagnosis_date\n30,"He said ""x"", y",A,2021-03-05\n31,"a\nb",B,2021-03-06\n32,C:\\x,"",2021-03-07\n')
    rows = read_patients(spark, str(path), multi_line=True).orderBy("age").collect()
    assert [(r.age, r.occupation, r.department, r.diagnosis_date.day) for r in rows] == [
        (30.0, 'He said "x", y', "A", 5), (31.0, "a\nb", "B", 6), (32.0, "C:\\x", None, 7)]
    for broken in ("age,occupation,department\n1,2\n", "age,occupation\n1,2,3\n", 'age,occupation\n1,"a\nb"\n'):
        path.write_text(broken)
        with pytest.raises(Exception, match="MALFORMED|malformed|Malformed"):
            read_patients(spark, str(path)).select("age").collect()


@pytest.mark.parametrize("text", ["2021-03-05", "2021/03/05", "03/05/2021", "Mar 5 2021", "March 5, 2021", "2021-03-05 10:00:00"])
def test_date_formats(spark, tmp_path, text):
    path = tmp_path / "patients.csv"
    path.write_text(f'age,diagnosis_date\n1,"{text}"\n2,\n3,nonsense\n')
    dates = [r.diagnosis_date for r in read_patients(spark, str(path)).orderBy("age").collect()]
    assert dates[0].date() == dt.date(2021, 3, 5) and dates[1:] == [None, None]


def test_a_date_column_without_a_date_is_an_error(spark, tmp_path):
    path = tmp_path / "patients.csv"
    path.write_text("age,diagnosis_date\n1,05.03.2021\n")
    with pytest.raises(ValueError, match="diagnosis_date"):
        read_patients(spark, str(path))
    assert read_patients(spark, str(path), date_formats=["dd.MM.yyyy"]).first().diagnosis_date == dt.datetime(2021, 3, 5)
    path.write_text("age,diagnosis_date\n1,\n")
    assert read_patients(spark, str(path)).first().diagnosis_date is None


def test_a_folder_of_csv_parts(spark, tmp_path):
    (tmp_path / "parts").mkdir()
    for i in range(2):
        (tmp_path / "parts" / f"part-{i}.csv").write_text(f"age\n{i}\n")
    assert sorted(r.age for r in read_patients(spark, str(tmp_path / "parts")).collect()) == [0.0, 1.0]


def test_importance_names_with_quotes(spark, tmp_path):
    df = spark.createDataFrame([(0, 'a "b", c', 1.0)], "feature_idx int, feature string, importance double")
    write_importances(df, str(tmp_path / "out"))
    assert read_importances(spark, str(tmp_path / "out")).first().feature == 'a "b", c'


def test_parquet_gets_the_same_types(spark, tmp_path):
    spark.createDataFrame([("Caldas", "Manizales", 1.5, "1000-1500")], "Department string, Municipality string, Latitude double, annual_precipitation string") \
        .write.parquet(str(tmp_path / "m"))
    row = read_municipalities(spark, str(tmp_path / "m")).first()
    assert row.department == "Caldas" and row.annual_precipitation == "1000-1500"
    spark.range(1).write.parquet(str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="department, municipality"):
        read_municipalities(spark, str(tmp_path / "bad"))


def test_schema_checks_and_defaults(spark):
    df = lowercase_columns(spark.createDataFrame([(1, 2)], "Age int, BMI int"))
    assert df.columns == ["age", "bmi"]
    with pytest.raises(ValueError, match="sex"):
        require_columns(df, ["age", "sex"])
    row = with_defaults(df, {"age": 9, "risk_score": 0.0}).first()
    assert (row.age, row.risk_score) == (1, 0.0)


def test_filters(spark):
    df = spark.createDataFrame([("department_A", 0.5, 12), ("age", 0.2, 9), ("my_department_x", 0.1, 10)], "feature string, v double, n_patients int")
    assert [r.feature for r in exclude_prefixes(df).collect()] == ["age", "my_department_x"]
    assert min_value(df, "v", 0.2).count() == 2
    assert min_value(df, "v", None).count() == min_value(df, "v", 0).count() == 3
    assert sorted(r.n_patients for r in having_min(df, 10).collect()) == [10, 12]
    assert having_min(df, None).count() == 3
    assert optional_eq(df, "feature", " AGE ").count() == 1
    assert optional_eq(df, "feature", None).count() == 3
    nulls = spark.createDataFrame([(1, None), (1, 2)], "a int, b int")
    assert scorable(nulls, ["a", "b"]).count() == 1


def test_importance_file_is_sorted(spark, tmp_path):
    importances = spark.createDataFrame(
        [(0, "sex_F", 0.5), (1, "age", 4.0), (2, "sex_M", 0.5), (3, "bmi", 0.7)], "feature_idx int, feature string, importance double"
    ).repartition(3)
    write_importances(importances, str(tmp_path / "out"))
    files = list((tmp_path / "out").glob("part-*.csv"))
    assert len(files) == 1
    lines = files[0].read_text().splitlines()
    assert lines[0] == "Feature,Importance"
    assert [line.split(",")[0] for line in lines[1:]] == ["age", "bmi", "sex_F", "sex_M"]
    back = {r.feature: r.importance for r in read_importances(spark, str(tmp_path / "out")).collect()}
    assert back == {"age": 4.0, "bmi": 0.7, "sex_F": 0.5, "sex_M": 0.5}


@pytest.mark.parametrize("make", [small_spec_model, two_layer_model])
def test_saved_model_scores_the_same(spark, tmp_path, make):
    model = make()
    save_model(spark, model, str(tmp_path / "model"))
    back = load_model(spark, str(tmp_path / "model"))
    assert back.spec == model.spec and back.feature_names == model.feature_names
    assert dict(back.means) == dict(model.means) and dict(back.scaling) == dict(model.scaling)
    for a, b in zip(model.layers, back.layers):
        assert np.array_equal(a.weights, b.weights) and np.array_equal(a.bias, b.bias)
        assert a.activation == b.activation and (a.scale is None) == (b.scale is None)
    df = to_spark(spark, small_patients(40))
    left = [r.score for r in score(df, model).orderBy("id").collect()]
    right = [r.score for r in score(df, back).orderBy("id").collect()]
    assert left == right
    assert feature_importance(back.weights(spark)).count() == len(model.feature_names)


def test_released_tables_are_gone(spark):
    staged = stage(spark.range(10), "unit")
    path = staged.inputFiles()[0].removeprefix("file:")
    assert os.path.exists(path)
    release(staged)
    assert not os.path.exists(path)


def test_stage_writes_to_the_shared_folder(spark):
    assert shared_folder(spark)
    staged = stage(spark.range(10).withColumn("x", F.col("id") * 2), "unit")
    assert "cohortwise/unit-" in staged.inputFiles()[0]
    assert staged.agg(F.sum("x")).first()[0] == 90


def test_a_plain_path_is_a_folder_the_cluster_shares():
    store = SimpleNamespace(get=lambda key, default: default)
    context = SimpleNamespace(master="local-cluster[2,1,1024]", _jsc=SimpleNamespace(hadoopConfiguration=lambda: store))
    cluster = SimpleNamespace(conf={"spark.checkpoint.dir": "/mnt/kept"}, sparkContext=context)
    assert shared_folder(cluster) == "/mnt/kept"
    assert working_folder(cluster, "model").startswith("/mnt/kept/cohortwise/model-")
    cluster.conf = {}
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        working_folder(cluster, "model")
