"""Registered queries of fits, trees, sketches, maintained state, joins by validity, lattices and files,
each with the SQL that checks it. Importing this module adds them to those of `driver_queries`.

What a query writes before it reads it back (a stream's files, a CSV, a model) goes to the shared folder and
is deleted once the result, a few rows per cohort, is known.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..fixed_values import AGE_EDGES, AGE_LABELS, EDUCATION_LABELS, TARGET_EDGES, UNKNOWN_LABEL
from ..functions import round_to
from ..functions.sql_names import register_functions
from ..functions.sql_text import number, text
from ..operators import importance, lattice, network_training, samples, scoring, sketches, temporal, training, trees
from ..operators.cohorts import CohortSums
from ..operators.features import prepare_patients
from ..operators.joins import join_counted
from ..operators.staging import delete_folder, working_folder
from ..sources.model_store import load_model, save_model
from ..sources.rejects import read_csv_with_rejects
from ..sources.readers import read_municipalities, read_patients
from ..sources.requests import score_requests
from ..sources.sinks import read_importances, write_importances
from ..schemas import PATIENTS
from ..streaming.cohort_state import CohortState, maintain
from . import driver_model as M, driver_sql as S, reports
from .driver_queries import ORACLES, _ORDER_TEXT, _importances, query
from .driver_views import AS_OF, municipalities, patients


def _known(spark: SparkSession, df: DataFrame) -> DataFrame:
    """The rows of a small result, so that what they were computed from can go."""
    return spark.createDataFrame(df.collect(), df.schema)


# --- fits -----------------------------------------------------------------------------------------

_SPLIT_SQL = S.with_(S.BASE, f"usable AS (SELECT * FROM prep WHERE {S.alive()})", S.parted("usable", _ORDER_TEXT)) + (
    "SELECT is_test, CAST(count(*) AS BIGINT) AS n, true AS learns FROM parted GROUP BY is_test"
)
SMALL_NETWORK = network_training.Training(
    hidden=(network_training.Dense(16, normalise=True), network_training.Dense(8)), penalty=1e-5, rate=0.02, epochs=5, steps=4, batch=64, momentum=0.9
)


def _learned(spark: SparkSession, sf_dir: str, trainer) -> DataFrame:
    """Per side of the split its rows, and whether the model beats the side's own mean by far."""
    fitted = training.fit_risk_model(patients(spark, sf_dir), as_of=AS_OF, row_key=["patient_id"], order=F.expr(_ORDER_TEXT), trainer=trainer)
    spread = {r["is_test"]: r["v"] for r in fitted.rows.groupBy("is_test").agg(F.var_pop("risk_score").alias("v")).collect()}
    fitted.release()
    rows = [(side, errors["n"], errors["mse"] < spread[side] / 2) for side, errors in ((False, fitted.train), (True, fitted.test))]
    return spark.createDataFrame(rows, "is_test boolean, n bigint, learns boolean")


@query("fit_network", _SPLIT_SQL)
def fit_network(spark, sf_dir):
    return _learned(spark, sf_dir, network_training.network_trainer(SMALL_NETWORK))


@query("fit_trees", _SPLIT_SQL)
def fit_trees(spark, sf_dir):
    return _learned(spark, sf_dir, trees.tree_trainer(trees=5, depth=4, rate=0.5))


# --- trees ----------------------------------------------------------------------------------------


def stated_trees() -> trees.TreeModel:
    """An ensemble by a rule. Leaf values and weights are small binary fractions, whose sums are exact."""
    prepared = M.individual_model()
    n_numeric, n_all = len(prepared.spec.numeric), len(prepared.feature_names)
    nodes = []
    for t in range(8):
        root, category, number = 2 * t % n_numeric, n_numeric + 5 * t % (n_all - n_numeric), (3 * t + 1) % n_numeric
        weight = 1.0 if t == 0 else 0.125
        nodes += [
            trees.Node(t, weight, 0, root, (t - 3) / 8, 1, 2, 0.0, 1.0, 4), trees.Node(t, weight, 1, category, 0.5, 3, 4, 0.0, 0.5, 2),
            trees.Node(t, weight, 2, number, 0.0625, 5, 6, 0.0, 0.25, 2),
            *[trees.Node(t, weight, 3 + k, -1, None, None, None, (k * 7 + t * 3) % 16 / 64, 0.0, 1) for k in range(4)],
        ]
    return trees.TreeModel(prepared, tuple(nodes))


def _tree_sql() -> str:
    model = stated_trees()
    number = lambda v: "NULL" if v is None else repr(v)
    nodes = ", ".join(f"({n.tree}, {n.weight!r}, {n.node}, {n.feature}, {number(n.threshold)}, {number(n.left)}, {number(n.right)}, {n.value!r})" for n in model.nodes)
    used = {n.feature for n in model.nodes if n.feature >= 0}
    values = " UNION ALL ".join(f"SELECT patient_id, {i} AS feature, CAST({text} AS DOUBLE) AS x FROM usable" for i, _, text, _ in S.feature_table() if i in used)
    ctes = S.with_(S.BASE, S.filled("prep", None), f"usable AS (SELECT * FROM filled WHERE {S.alive()})",
                   f"nodes(tree, weight, node, feature, threshold, l, r, value) AS (VALUES {nodes})", f"x AS ({values})",
                   "walk AS (SELECT patient_id, tree, 0 AS node FROM usable, (SELECT DISTINCT tree FROM nodes) UNION ALL "
                   "SELECT w.patient_id, w.tree, CASE WHEN x.x <= n.threshold THEN n.l ELSE n.r END FROM walk w JOIN nodes n ON w.tree = n.tree AND w.node = n.node "
                   "JOIN x ON x.patient_id = w.patient_id AND x.feature = n.feature)",
                   "sums AS (SELECT patient_id, sum(weight * value) AS score FROM walk JOIN nodes USING (tree, node) WHERE feature < 0 GROUP BY patient_id)")
    return ctes.replace("WITH ", "WITH RECURSIVE ", 1) + "SELECT patient_id, round(CAST(score AS DOUBLE), 6) AS score FROM prep LEFT JOIN sums USING (patient_id)"


@query("tree_scores", _tree_sql())
def tree_scores(spark, sf_dir):
    scored = scoring.score(prepare_patients(patients(spark, sf_dir), AS_OF), stated_trees())
    return scored.select("patient_id", round_to(F.col("score"), 6).alias("score"))


# --- sketches -------------------------------------------------------------------------------------

_SHARES = (0.25, 0.5, 0.75)


@query("sketched_percentiles", S.with_(S.PATIENTS, f"shares(p) AS (VALUES {', '.join(f'(CAST({p} AS DOUBLE))' for p in _SHARES)})") + (
    "SELECT department, p, CAST(count(bmi) AS BIGINT) AS n, true AS within FROM patients_v, shares GROUP BY department, p"
))
def sketched_percentiles(spark, sf_dir):
    """Percentiles per department from sketches per department and day of the week, each checked against the
    exact share of rows below it."""
    rows = patients(spark, sf_dir, ["department", "bmi", "diagnosis_date"])
    parts = sketches.sketches(rows.withColumn("day", F.dayofweek("diagnosis_date")), ["bmi"], ["department", "day"])
    whole = sketches.merged(parts, ["bmi"], ["department"])
    found = whole.select("department", "n_bmi", F.posexplode(sketches.percentiles(whole, "bmi", _SHARES)).alias("k", "value"))
    ranked = join_counted(rows.select("department", "bmi"), found, ["department"], "inner").groupBy("department", "k").agg(
        F.first("n_bmi").alias("n"), F.avg((F.col("bmi") < F.col("value")).cast("int")).alias("below"), F.avg((F.col("bmi") <= F.col("value")).cast("int")).alias("to"))
    p = F.element_at(F.array(*map(F.lit, _SHARES)), F.col("k") + 1)
    error = sketches.rank_error()
    return ranked.select("department", p.alias("p"), "n", ((F.col("below") - error <= p) & (F.col("to") + error >= p)).alias("within"))


# --- samples --------------------------------------------------------------------------------------

_SAMPLED = {b: 40 * b for b in range(len(TARGET_EDGES) + 1)}


@query("sample_by_target", S.with_(S.PATIENTS) + (
    "SELECT patient_id, stratum, n_stratum FROM (SELECT patient_id, CAST(bin AS INT) AS stratum, CAST(count(*) OVER (PARTITION BY bin) AS BIGINT) AS n_stratum, "
    f"row_number() OVER (PARTITION BY bin ORDER BY {_ORDER_TEXT}) AS rank FROM (SELECT *, {S.target_bin('risk_score')} AS bin FROM patients_v) WHERE bin IS NOT NULL) "
    "WHERE rank <= 40 * stratum"
))
def sample_by_target(spark, sf_dir):
    """A sample of stated size of every target bin, from parts of the patients that are sampled apart and merged."""
    rows = patients(spark, sf_dir, ["patient_id", "risk_score"])
    sizes, order = F.col("stratum") * 40, F.expr(_ORDER_TEXT)
    parts = [samples.stratified_sample(rows.where(F.col("patient_id") % 2 == k), _SAMPLED, order=order) for k in range(2)]
    whole = samples.merge_samples(parts, ["stratum"], sizes, order, total="n_stratum")
    return whole.select("patient_id", "stratum", "n_stratum")


# --- SQL text -------------------------------------------------------------------------------------

_EDGES = lambda edges: f"array({', '.join(number(e) for e in edges)})"
_COLUMNS_TEXT = f"""
SELECT patient_id, CAST(diagnosis_year AS STRING) AS diagnosis_year, CAST(diagnosis_month AS STRING) AS diagnosis_month,
    diagnosis_trimester, CAST(days_since_diagnosis AS STRING) AS days_since_diagnosis, pandemic_period,
    CASE WHEN diagnosis_year IN (1996, 1999) THEN 1 ELSE 0 END AS period,
    cohort_risk_band(risk_score) AS band,
    cohort_cut(age, {_EDGES(AGE_EDGES)}, array({', '.join(map(text, AGE_LABELS))})) AS age_band,
    cohort_digitize(risk_score, {_EDGES(TARGET_EDGES)}) AS target_bin,
    cohort_decade_bin(age) AS decade, cohort_combo_label(is_smoker, diabetes) AS combo,
    cohort_code_label(education_level, map({', '.join(f'{k}, {text(v)}' for k, v in EDUCATION_LABELS.items())}), {text(UNKNOWN_LABEL)}) AS education
FROM {{rows}}"""


@query("patient_columns_by_sql", ORACLES["patient_columns"])
def patient_columns_by_sql(spark, sf_dir):
    """The columns of `patient_columns`, written as SQL text over the library's SQL functions."""
    register_functions(spark)
    return spark.sql(_COLUMNS_TEXT, rows=prepare_patients(patients(spark, sf_dir), AS_OF))


# --- maintained state -----------------------------------------------------------------------------


@query("maintained_by_occupation", S.cohort_sql(["occupation"]))
def maintained_by_occupation(spark, sf_dir):
    """The report from sums that a stream keeps, with rows that arrive late and rows that arrive again."""
    folder = working_folder(spark, "stream")
    rows = patients(spark, sf_dir).withColumn("part", F.pmod(F.xxhash64("patient_id"), F.lit(4)).cast("int"))
    again = rows.where(F.pmod(F.col("patient_id"), F.lit(5)) == 0).withColumn("part", F.lit(4))
    # The last part of the rows arrives with the day of the first.
    arrival = F.timestamp_add("DAY", F.pmod(F.col("part"), F.lit(4)) + 1, F.lit("2024-01-01").cast("timestamp"))
    rows.unionByName(again).withColumn("arrival", arrival).write.partitionBy("part").parquet(f"{folder}/in")
    try:
        written = spark.read.parquet(f"{folder}/in")
        stream = spark.readStream.schema(written.schema).option("maxFilesPerTrigger", 3).parquet(f"{folder}/in").drop("part")
        state = CohortState(spark, f"{folder}/sums", CohortSums(M.individual_model()), ["occupation"], AS_OF)
        maintain(stream, state, f"{folder}/checkpoint", ["patient_id"], "arrival", "30 days").awaitTermination()
        return _known(spark, state.report(min_rows=10))
    finally:
        delete_folder(spark, folder)


# --- joins by validity ----------------------------------------------------------------------------

_STEP = "(400 + 10 * n_nationkey)"


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five versions of every place; the first starts after some of the diagnoses."""
    place = municipalities(spark, sf_dir)
    number = F.explode(F.array(*map(F.lit, range(5))))
    step = F.lit(400) + F.col("average_altitude").cast("int") / F.lit(10)
    return place.withColumn("version", number).select(
        "department", "municipality", F.date_add(F.lit("1992-06-01").cast("date"), (F.col("version") * step).cast("int")).alias("valid_from"),
        (F.col("average_temperature") + F.col("version")).alias("average_temperature"), "climate_classification")


@query("patients_as_of", S.with_(
    S.PATIENTS, S.MUNICIPALITIES,
    "history AS (SELECT department, municipality, CAST(DATE '1992-06-01' + CAST(version * (400 + CAST(average_altitude AS INT) / 10) AS INT) AS DATE) AS valid_from, "
    "average_temperature + version AS average_temperature, climate_classification FROM municipalities_v, range(5) t(version))",
) + (
    "SELECT patient_id, CAST(h.valid_from AS VARCHAR) AS valid_from, h.average_temperature, h.climate_classification FROM patients_v p ASOF LEFT JOIN history h "
    "ON p.department = h.department AND p.municipality = h.municipality AND p.diagnosis_date >= h.valid_from"
))
def patients_as_of(spark, sf_dir):
    rows = patients(spark, sf_dir, ["patient_id", "department", "municipality", "diagnosis_date"])
    joined = temporal.with_geography_as_of(rows, _history(spark, sf_dir))
    return joined.select("patient_id", F.col("valid_from").cast("string").alias("valid_from"), "average_temperature", "climate_classification")


_EDGES_SQL = (
    "edges AS (SELECT r_name AS department, CASE WHEN k = 0 THEN NULL ELSE 18.0 + 2 * k + r_regionkey END AS low, "
    "CASE WHEN k < 6 THEN 20.0 + 2 * k + r_regionkey END AS high, 'B' || k AS label FROM region, range(7) t(k))"
)


@query("bins_by_department", S.with_(S.PATIENTS, _EDGES_SQL) + (
    "SELECT p.department, e.label, CAST(count(*) AS BIGINT) AS n, round(avg(bmi), 4) AS avg_bmi FROM patients_v p LEFT JOIN edges e "
    "ON p.department = e.department AND (e.low IS NULL OR bmi > e.low) AND (e.high IS NULL OR bmi <= e.high) GROUP BY ALL"
))
def bins_by_department(spark, sf_dir):
    regions = spark.read.parquet(f"{sf_dir}/region.parquet").withColumn("k", F.explode(F.array(*map(F.lit, range(7)))))
    low = F.lit(18.0) + 2 * F.col("k") + F.col("r_regionkey")
    edges = regions.select(F.col("r_name").alias("department"), F.when(F.col("k") > 0, low).alias("low"),
                           F.when(F.col("k") < 6, low + 2).alias("high"), F.concat(F.lit("B"), F.col("k").cast("string")).alias("label"))
    binned = temporal.cut_by_table(patients(spark, sf_dir, ["department", "bmi"]), "bmi", edges, ["department"], width=2.0)
    return binned.groupBy("department", "label").agg(F.count("*").alias("n"), round_to(F.avg("bmi"), 4).alias("avg_bmi"))


# --- lattice --------------------------------------------------------------------------------------

LEVELS = (["department"], ["municipality"], ["diagnosis_year"], ["department", "diagnosis_year"], ["municipality", "diagnosis_year"])
_LATTICE_KEYS = ("department", "municipality", "diagnosis_year")


def _level_sql(level) -> str:
    keys = ", ".join(f"CAST({k if k in level else 'NULL'} AS VARCHAR) AS {k}" for k in _LATTICE_KEYS)
    return (f"SELECT '{','.join(level)}' AS level, {keys}, {S.RISK}, round(avg(bmi), 2) AS avg_bmi FROM scored "
            f"WHERE {' AND '.join(f'{k} IS NOT NULL' for k in level)} GROUP BY {', '.join(level)}")


@query("place_year_lattice", S.with_(S.BASE, S.scored("prep", None)) + " UNION ALL ".join(map(_level_sql, LEVELS)))
def place_year_lattice(spark, sf_dir):
    sums = CohortSums(M.individual_model(), "training", {"avg_bmi": "bmi"})
    found = lattice.cohort_lattice(prepare_patients(patients(spark, sf_dir), AS_OF), LEVELS, sums)
    return found.withColumn("diagnosis_year", F.col("diagnosis_year").cast("string"))


# --- files ----------------------------------------------------------------------------------------


def _write_lines(rows: DataFrame, names: list[str], path: str) -> None:
    """Lines with a header in every file, as a CSV export has it."""
    def with_header(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": [",".join(names)]})
        yield from batches

    rows.mapInPandas(with_header, "value string").write.text(path)


_REASON = "CASE WHEN patient_id % 97 = 5 THEN 'too many values' WHEN patient_id % 89 = 7 THEN 'too few values' END"


@query("patients_with_rejects", S.with_(S.PATIENTS, f"lines AS (SELECT *, {_REASON} AS reason FROM patients_v)") + (
    "SELECT reason, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN reason IS NULL THEN heart_rate ELSE 0 END) AS BIGINT) AS heart_rates, "
    "CAST(count(CASE WHEN reason IS NULL THEN total_cholesterol END) AS BIGINT) AS n_cholesterol FROM lines GROUP BY reason"
))
def patients_with_rejects(spark, sf_dir):
    folder = working_folder(spark, "rejects")
    names = ["patient_id", "heart_rate", "total_cholesterol", "occupation"]
    rows = patients(spark, sf_dir, names).withColumn("reason", F.expr(_REASON))
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names[:-1]] + [F.concat(F.lit('"'), F.coalesce("occupation", F.lit("")), F.lit(', Ltd"'))]
    line = F.concat_ws(",", *texts)
    bad = F.when(F.col("reason") == "too many values", F.concat(line, F.lit(",1"))).when(F.col("reason") == "too few values", F.concat_ws(",", *texts[:2]))
    try:
        _write_lines(rows.select(F.coalesce(bad, line).alias("value")), names, f"{folder}/csv")
        read = read_csv_with_rejects(spark, f"{folder}/csv", PATIENTS, f"{folder}/rejects", limit=0.05)
        kept = read.kept.agg(F.lit(None).cast("string").alias("reason"), F.count("*").alias("n"), F.sum("heart_rate").alias("heart_rates"), F.count("total_cholesterol").alias("n_cholesterol"))
        gone = spark.read.parquet(f"{folder}/rejects").groupBy("reason").agg(
            F.count("*").alias("n"), F.lit(0).cast("long").alias("heart_rates"), F.lit(0).cast("long").alias("n_cholesterol"))
        found = _known(spark, kept.union(gone))
        read.release()
        return found
    finally:
        delete_folder(spark, folder)


_ASKED = "CASE patient_id % 10 WHEN 0 THEN 'cut' WHEN 1 THEN 'no age' WHEN 2 THEN 'more' WHEN 3 THEN 'text' ELSE 'plain' END"


@query("requests_explained", S.with_(S.BASE, f"asked AS (SELECT *, {_ASKED} AS kind FROM prep)") + (
    "SELECT kind, CASE WHEN kind IN ('cut', 'text') THEN 'broken' WHEN kind = 'no age' THEN 'missing' ELSE 'ok' END AS status, CAST(count(*) AS BIGINT) AS n, "
    "CAST(sum(CASE WHEN kind = 'more' THEN 1 ELSE 0 END) AS BIGINT) AS n_extra, "
    f"CAST(sum(CASE WHEN kind IN ('more', 'plain') AND {S.alive()} THEN 1 ELSE 0 END) AS BIGINT) AS n_scored FROM asked GROUP BY kind"
))
def requests_explained(spark, sf_dir):
    rows = patients(spark, sf_dir).withColumn("kind", F.expr(_ASKED))
    held = F.struct(*[c for c in rows.columns if c not in ("patient_id", "kind", "age")], F.when(F.col("kind") != "no age", F.col("age")).alias("age"))
    body = F.to_json(held)
    body = F.when(F.col("kind") == "cut", F.substring(body, 1, 40)).when(F.col("kind") == "more", F.replace(body, F.lit("{"), F.lit('{"colour":"red",'))).when(
        F.col("kind") == "text", F.replace(body, F.lit('"age":'), F.lit('"age":"x","age":'))).otherwise(body)
    found = score_requests(rows.select("kind", body.alias("body")), M.individual_model(), keep=["kind"], as_of=AS_OF)
    return found.groupBy("kind", "status").agg(
        F.count("*").alias("n"), F.sum(F.when(F.size("extra") > 0, 1).otherwise(0)).alias("n_extra"), F.count("score").alias("n_scored"))


@query("cohort_from_csv", S.with_(S.PATIENTS, S.MUNICIPALITIES) + (
    "SELECT department, CAST(count(*) AS BIGINT) AS n, CAST(sum(heart_rate) AS BIGINT) AS heart_rates, CAST(count(diagnosis_date) AS BIGINT) AS n_dates, "
    "round(avg(average_temperature), 4) AS avg_temperature FROM patients_v LEFT JOIN municipalities_v USING (department, municipality) GROUP BY department"
))
def cohort_from_csv(spark, sf_dir):
    """Both input tables written as CSV and read back by the readers."""
    folder = working_folder(spark, "csv")
    try:
        for name, df in (("patients", patients(spark, sf_dir)), ("municipalities", municipalities(spark, sf_dir))):
            df.write.option("header", True).option("quote", '"').option("escape", '"').csv(f"{folder}/{name}.csv")
        rows = read_patients(spark, f"{folder}/patients.csv").join(
            read_municipalities(spark, f"{folder}/municipalities.csv").select("department", "municipality", "average_temperature"), ["department", "municipality"], "left")
        return _known(spark, rows.groupBy("department").agg(
            F.count("*").alias("n"), F.sum("heart_rate").alias("heart_rates"), F.count("diagnosis_date").alias("n_dates"),
            round_to(F.avg("average_temperature"), 4).alias("avg_temperature")))
    finally:
        delete_folder(spark, folder)


@query("cohort_by_saved_model", ORACLES["cohort_by_stratum"])
def cohort_by_saved_model(spark, sf_dir):
    folder = working_folder(spark, "model")
    try:
        save_model(spark, M.individual_model(), folder)
        model = load_model(spark, folder)
    finally:
        delete_folder(spark, folder)
    return reports.summary_by_stratum(patients(spark, sf_dir), model, as_of=AS_OF)


@query("importances_from_file", ORACLES["importance_mean"].replace("SELECT CAST(feature_idx AS INT) AS feature_idx, ", "SELECT "))
def importances_from_file(spark, sf_dir):
    folder = working_folder(spark, "importances")
    try:
        write_importances(_importances(spark, sf_dir), folder)
        return _known(spark, read_importances(spark, folder).withColumn("importance", round_to(F.col("importance"), 4)))
    finally:
        delete_folder(spark, folder)
