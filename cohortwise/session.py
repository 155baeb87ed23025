"""Spark session settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# UTC keeps date parts equal on every executor. AQE picks partition counts, turns small joins into
# broadcasts by their measured size and splits skewed join partitions. The JVM interprets methods
# above 8000 bytes of bytecode: a stage that would generate one is better run as several smaller
# generated functions, which is what Spark does beyond this limit.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name: str = "cohortwise", master: str | None = None, **settings) -> SparkSession:
    """A session with the settings above; `settings` override them.

    On a cluster leave `master` out: the submit command names it, together with
    `spark.checkpoint.dir` and the executor sizes.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Applies the settings above to a session somebody else started."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark
