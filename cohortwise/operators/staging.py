"""Intermediate tables that several jobs read."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str | None:
    """The folder the cluster names in `spark.checkpoint.dir`; None when it names none.

    Naming it says that all machines share it, as Spark's own checkpoints need it, whether it is a store or a
    mount, with a scheme or as a plain path.
    """
    return spark.conf.get("spark.checkpoint.dir", None) or None


def working_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own for a run, in the shared one; below the warehouse where none is named, which is
    refused on a cluster."""
    folder = shared_folder(spark)
    if folder is None:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        folder = spark.conf.get("spark.sql.warehouse.dir")
    return f"{folder.rstrip('/')}/cohortwise/{name}-{uuid.uuid4().hex}"


def delete_folder(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def stage(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """The table, computed once; `release` it when it is no longer read. Jobs that read single values of
    the column `by` read only those rows' files.

    With a shared folder it is written there as Parquet and read back: the lineage ends, each later
    job reads only its columns, and a lost executor costs nothing. Without one it is kept on the
    executors, where a lost block is computed again.
    """
    folder = shared_folder(df.sparkSession)
    if folder is None:
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    path = f"{folder.rstrip('/')}/cohortwise/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*[by] if by else []).parquet(path)
    staged = df.sparkSession.read.schema(df.schema).parquet(path)
    staged._staged_path = path
    return staged


def release(staged: DataFrame) -> None:
    """Deletes a staged table. DataFrames that read it cannot be computed any more."""
    path = getattr(staged, "_staged_path", None)
    if path is None:
        staged.unpersist()
        return
    context = staged.sparkSession.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
