"""CSV reads that survive malformed rows (S1, S2 with a reject table)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.dates import DATE_FORMATS
from ..operators.staging import release, stage
from .readers import apply_schema, check_dates

CORRUPT = "_corrupt"
REASONS = ("too few values", "too many values")


@dataclass
class Read:
    """Typed rows, rejected lines (file, block_start, line, n_values, reason), and how many of each."""

    kept: DataFrame
    rejected: DataFrame
    n_kept: int
    n_rejected: int

    def release(self) -> None:
        release(self._staged)


def read_csv_with_rejects(
    spark: SparkSession, path: str, schema: T.StructType, rejects: str | None = None, limit: float = 0.01, date_formats=DATE_FORMATS,
) -> Read:
    """A CSV table whose malformed lines go aside instead of ending the read.

    A line is malformed if it has more or fewer values than the header; a quote without an end is text, as
    Spark's reader takes it. Such lines are given with their file, the start of the block of the file Spark read them from, and a reason, and
    are appended as Parquet to `rejects` if that is named. More than `limit` (a share of all lines) of them is
    an error, raised before anything is written. Kept and rejected rows add up to the lines below the headers.
    """
    header = spark.read.option("header", True).option("inferSchema", False).csv(path).schema
    names = [f.name for f in header]
    full = T.StructType([*[T.StructField(n, T.StringType()) for n in names], T.StructField(CORRUPT, T.StringType())])
    raw = (
        spark.read.schema(full).option("header", True).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT).option("columnPruning", False).csv(path)
        .select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))
    )
    # Staged, because a query of the corrupt column alone would not parse the others.
    staged = stage(raw, "csv-rows")
    try:
        n_all, n_bad = staged.agg(F.count("*"), F.count(CORRUPT)).first()
        if n_bad > limit * n_all:
            raise ValueError(f"{n_bad} of {n_all} lines of {path} are malformed, more than {limit:g} of them")
        unquoted = F.regexp_replace(CORRUPT, r'"(?:[^"]|"")*"', "q")
        n_values = F.length(unquoted) - F.length(F.replace(unquoted, F.lit(","), F.lit(""))) + 1
        reason = F.when(n_values < len(names), REASONS[0]).otherwise(REASONS[1])
        rejected = staged.where(F.col(CORRUPT).isNotNull()).select(
            F.col("_file").alias("file"), F.col("_start").alias("block_start"), F.col(CORRUPT).alias("line"), n_values.cast("int").alias("n_values"), reason.alias("reason"))
        good = staged.where(F.col(CORRUPT).isNull()).select(*[F.col(f"`{n}`") for n in names])
        check_dates(good, schema, tuple(date_formats))
        if rejects and n_bad:
            rejected.write.mode("append").parquet(rejects)
    except BaseException:
        release(staged)
        raise
    out = Read(apply_schema(good, schema, date_formats), rejected, n_all - n_bad, n_bad)
    out._staged = staged
    return out
