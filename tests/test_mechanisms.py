"""Sketches, joins by validity, lattice, maintained state and reads with rejects against plain Python."""

import datetime as dt
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cohortwise.functions import cut
from cohortwise.operators import lattice, sketches as K, temporal as J
from cohortwise.operators.cohorts import CohortSums, cohort_summary
from cohortwise.operators.features import prepare_patients, robust_scale_fit
from cohortwise.plans import driver_model as M
from cohortwise.plans.driver_views import AS_OF, patients
from cohortwise.schemas import PATIENTS
from cohortwise.sources.rejects import read_csv_with_rejects
from cohortwise.streaming.cohort_state import CohortState, maintain

SF = "/root/testdata/sf0.001"


# --- sketches


@pytest.mark.parametrize("k", [200, 1000])
def test_ranks_for_any_grouping(spark, k):
    rng = random.Random(k)
    values = [rng.gauss(0, 1) for _ in range(30_000)] + [5.0] * 3000 + [float("nan"), None, float("inf")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, x double")
    exact = sorted(v for v in values if v is not None and abs(v) < 1e9)
    for parts in (1, 7, 400):
        kept = K.sketches(df.withColumn("part", F.col("i") % parts), ["x"], ["part"], k)
        # Merged in two steps, by another grouping first.
        halves = K.merged(kept.withColumn("half", F.col("part") % 2), ["x"], ["half"])
        whole = K.merged(halves, ["x"], [])
        shares = [0.01, 0.25, 0.5, 0.75, 0.99]
        row = whole.select("n_x", K.percentiles(whole, "x", shares).alias("v")).first()
        assert row["n_x"] == len(exact)
        for p, v in zip(shares, row["v"]):
            low, high = sum(e < v for e in exact) / len(exact), sum(e <= v for e in exact) / len(exact)
            assert low - K.rank_error(k) <= p <= high + K.rank_error(k)


def test_scaling_from_sketches(spark):
    df = spark.createDataFrame([(float(i % 997), 3.0, i % 5) for i in range(5000)], "a double, b double, day int")
    exact, found = robust_scale_fit(df, ["a", "b"]), K.robust_scale_from(K.sketches(df, ["a", "b"], ["day"]), ["a", "b"])
    assert abs(found["a"][0] - exact["a"][0]) < 10 and abs(found["a"][1] - exact["a"][1]) < 20 and found["b"] == (3.0, 1.0)
    with pytest.raises(ValueError, match="without a single value: a"):
        K.robust_scale_from(K.sketches(df.withColumn("a", F.lit(None).cast("double")), ["a"], ["day"]), ["a"])


# --- joins by validity


PLACES = [("A", "x", dt.date(2000, 1, 1), 1.0), ("A", "x", dt.date(2000, 3, 1), 2.0), ("A", "x", dt.date(2010, 1, 1), 3.0), ("A", "x", None, 9.0),
          ("A", "y", dt.date(1990, 5, 5), 4.0), ("B", "x", dt.date(2030, 1, 1), 5.0), ("A", "x", dt.date(2000, 3, 1), None), (None, "x", dt.date(1999, 1, 1), 6.0)]


@pytest.mark.parametrize("days", [1, 30, 100_000])
def test_as_of(spark, days):
    rng = random.Random(days)
    rows = [(k, rng.choice(["A", "B", "C", None]), rng.choice("xy"), None if k % 9 == 0 else dt.datetime(1989 + k % 25, 1 + k % 12, 1 + k % 28, k % 24), "gone") for k in range(300)]
    rows += [(900, "A", "x", dt.datetime(2000, 3, 1), "at the start"), (901, "A", "x", dt.datetime(2000, 2, 29, 23, 59, 59), "just before")]
    df = spark.createDataFrame(rows, "id long, department string, municipality string, diagnosis_date timestamp, level string")
    places = spark.createDataFrame(PLACES, "department string, municipality string, valid_from date, level double")
    if days == 1:
        df = df.where("id > 250")  # as many buckets as days
    found = {r["id"]: (r["valid_from"], r["level"]) for r in J.with_geography_as_of(df, places, bucket_days=days).collect()}
    for k, d, m, date, _ in (r for r in rows if r[0] in found):
        own = [(p[2], p[3]) for p in PLACES if p[0] == d and p[1] == m and p[0] and p[2] and date and p[2] <= date.date() and p[3] is not None]
        assert found[k] == (max(own) if own else (None, None))
    assert len(found) == df.count()
    empty = J.with_geography_as_of(df.where("false"), places)
    assert empty.count() == 0 and empty.schema["level"].dataType.simpleString() == "double"
    plan = J.with_geography_as_of(df, places)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("right", [True, False])
def test_cut_by_table_equals_cut(spark, right):
    edges = [-1.0, 0.0, 2.5, 2.75, 40.0]
    labels = ["a", "b", "c", "d"]
    rows = [(k, "pq"[k % 2], v) for k, v in enumerate([-5.0, -1.0, -0.5, 0.0, 2.5, 2.6, 2.75, 3.0, 39.9, 40.0, 41.0, None, float("nan"), float("inf")] * 2)]
    df = spark.createDataFrame(rows, "id long, g string, x double")
    table = spark.createDataFrame([("p", lo, hi, name) for lo, hi, name in zip(edges, edges[1:], labels)] + [("q", None, 0.0, "low"), ("q", 0.0, None, "high")],
                                  "g string, low double, high double, label string")
    found = J.cut_by_table(df, "x", table, ["g"], 1.0, "bin", right)
    assert found.columns == ["id", "g", "x", "bin"]
    wanted = df.withColumn("bin", F.when(F.col("g") == "p", cut(F.col("x"), edges, labels, right)))
    for r, w in zip(sorted(found.collect()), sorted(wanted.collect())):
        if r["g"] == "p":
            assert r["bin"] == w["bin"]
        elif r["x"] is not None and abs(r["x"]) < 100:
            assert r["bin"] == ("low" if (r["x"] <= 0 if right else r["x"] < 0) else "high")
    assert "NestedLoop" not in found._jdf.queryExecution().toString()
    assert J.cut_by_table(df.where("x is null"), "x", table, ["g"], 1.0).where("label is not null").isEmpty()


# --- lattice


@pytest.mark.parametrize("scope", ["cohort", "training"])
def test_lattice_equals_single_reports(spark, scope):
    rows = prepare_patients(patients(spark, SF), AS_OF).withColumn("department", F.when(F.col("patient_id") % 3 > 0, F.col("department"))).cache()
    levels = [["department"], ["diagnosis_year"], ["department", "diagnosis_year"], ["sex", "department"]]
    sums = CohortSums(M.individual_model(), scope, {"avg_age": "age"}, factors=2)
    found = lattice.cohort_lattice(rows, levels, sums, min_rows=3)
    for level in levels:
        single = cohort_summary(rows, level, M.individual_model(), impute_scope=scope, averages={"avg_age": "age"}, factors=2, min_rows=3)
        own = found.where(F.col("level") == ",".join(level)).select(*single.columns)
        assert sorted(map(repr, own.collect())) == sorted(map(repr, single.collect()))
    assert found.where("level is null").isEmpty()
    rows.unpersist()
    with pytest.raises(ValueError, match="network"):
        lattice.cohort_lattice(rows, levels, CohortSums(M.network_model()))


# --- maintained state


def write(df, folder, name, arrival):
    df.withColumn("arrival", F.lit(arrival).cast("timestamp")).coalesce(1).write.parquet(f"{folder}/in/{name}")


def test_state_over_late_and_repeated_rows(spark, tmp_path):
    rows = patients(spark, SF)
    folder = str(tmp_path)
    sums = CohortSums(M.individual_model(), averages={"avg_bmi": "bmi"}, factors=2)
    state = CohortState(spark, f"{folder}/sums", sums, ["occupation"], AS_OF)
    with pytest.raises(ValueError, match="no batch"):
        state.current()
    schema = rows.withColumn("arrival", F.lit(None).cast("timestamp")).schema

    def run():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{folder}/in")
        maintain(stream, state, f"{folder}/checkpoint", ["patient_id"], "arrival", "5 days").awaitTermination()

    def same(seen):
        wanted = cohort_summary(prepare_patients(seen, AS_OF), "occupation", M.individual_model(), averages={"avg_bmi": "bmi"}, factors=2, min_rows=None)
        assert sorted(map(repr, state.report().collect())) == sorted(map(repr, wanted.collect()))

    write(rows.where("patient_id % 4 = 0"), folder, "a", "2024-01-05")
    run()
    same(rows.where("patient_id % 4 = 0"))
    write(rows.where("patient_id % 4 in (0, 1)"), folder, "b", "2024-01-06")  # some again
    run()
    write(rows.where("patient_id % 4 = 2"), folder, "c", "2024-01-02")  # late, but within the delay
    run()
    same(rows.where("patient_id % 4 < 3"))
    # A batch that runs again after a failure changes nothing, and few versions stay.
    last = state.versions()[-1]
    before = sorted(map(repr, state.report().collect()))
    extra = rows.where("patient_id % 4 = 3")
    state.merge(extra, last + 1)
    state.merge(extra, last + 1)
    same(rows)
    assert sorted(map(repr, state.report().collect())) != before and len(state.versions()) <= 2


# --- reads with rejects


def test_reads_with_rejects(spark, tmp_path):
    good = ['1,60,"a, b"', "2,,c", '3,70,"say ""x"""']
    bad = ["4,1", "5,6,7,8", '6,2,"a, b",c']
    path = tmp_path / "p.csv"
    path.write_text("\n".join(["id,heart_rate,occupation", *good, *bad]) + "\n")
    read = read_csv_with_rejects(spark, str(path), PATIENTS, str(tmp_path / "rejects"), limit=0.5)
    assert (read.n_kept, read.n_rejected) == (3, 3)
    assert [(r["id"], r["heart_rate"], r["occupation"]) for r in read.kept.orderBy("id").collect()] == [("1", 60, "a, b"), ("2", None, "c"), ("3", 70, 'say "x"')]
    found = {r["line"]: (r["n_values"], r["reason"], Path(r["file"]).name, r["block_start"]) for r in spark.read.parquet(str(tmp_path / "rejects")).collect()}
    assert found["4,1"] == (2, "too few values", "p.csv", 0) and found["5,6,7,8"] == (4, "too many values", "p.csv", 0)
    assert found['6,2,"a, b",c'][:2] == (4, "too many values")
    read.release()
    with pytest.raises(ValueError, match="3 of 6 lines"):
        read_csv_with_rejects(spark, str(path), PATIENTS, str(tmp_path / "none"), limit=0.4)
    assert not (tmp_path / "none").exists()


def test_one_bad_row_of_many(spark, tmp_path):
    path = tmp_path / "many.csv"
    path.write_text("id,heart_rate\n" + "".join(f"{k},{k % 90}\n" for k in range(50_000)) + "x\n")
    read = read_csv_with_rejects(spark, str(path), PATIENTS)
    assert (read.n_kept, read.n_rejected) == (50_000, 1) and read.kept.agg(F.sum("heart_rate")).first()[0] == sum(k % 90 for k in range(50_000))
    read.release()
