"""Table readers and schema checks."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .. import schemas
from ..fixed_values import DEFAULT_PATIENT_COLUMNS, MISSING_TEXT
from ..functions import to_numeric
from ..functions.dates import DATE_FORMATS, parse_any_date
from ..functions.numbers import not_nan


def lowercase_columns(df: DataFrame) -> DataFrame:
    """Column names in lower case."""
    return df.toDF(*[name.lower() for name in df.columns])


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """The table itself, or an error that names every missing column; runs no job."""
    missing = [name for name in columns if name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def with_defaults(df: DataFrame, defaults: Mapping = DEFAULT_PATIENT_COLUMNS) -> DataFrame:
    """Adds the absent columns as constants; present columns are left alone."""
    absent = {name: F.lit(value) for name, value in defaults.items() if name not in df.columns}
    return df.withColumns(absent) if absent else df


def _typed(field: T.StructField, have: T.DataType, date_formats: Iterable[str] = DATE_FORMATS) -> Column:
    col = F.col(f"`{field.name}`")
    if isinstance(have, T.StringType):
        col = F.when(~F.trim(col).isin(*MISSING_TEXT), col)
        if isinstance(field.dataType, T.TimestampType):
            return parse_any_date(col, date_formats).alias(field.name)
        if isinstance(field.dataType, T.NumericType):
            return to_numeric(col).try_cast(field.dataType).alias(field.name)
        return col.alias(field.name)
    if isinstance(have, (T.DoubleType, T.FloatType)):
        col = not_nan(col)
    if have == field.dataType:
        return col.alias(field.name)
    return col.try_cast(field.dataType).alias(field.name)


def apply_schema(df: DataFrame, schema: T.StructType, date_formats: Iterable[str] = DATE_FORMATS) -> DataFrame:
    """Columns cast by name to `schema`; bad text becomes null, other columns are kept as they are.

    Columns the schema names but the table lacks stay absent: `require_columns` and `with_defaults`
    decide about those.
    """
    df = lowercase_columns(df)
    wanted, date_formats = {field.name: field for field in schema}, tuple(date_formats)
    return df.select(*[
        _typed(wanted[field.name], field.dataType, date_formats) if field.name in wanted else F.col(f"`{field.name}`")
        for field in df.schema
    ])


def check_dates(raw: DataFrame, schema: T.StructType, date_formats: Iterable[str] = DATE_FORMATS) -> None:
    """An error if a date column has text and none of it is a date; runs a job per text column.

    The job ends at the first date it finds, so it reads more than a few rows only if something is
    wrong.
    """
    raw = lowercase_columns(raw)
    dates = {f.name for f in schema if isinstance(f.dataType, T.TimestampType)}
    for field in raw.schema:
        if field.name not in dates or not isinstance(field.dataType, T.StringType):
            continue
        text = F.trim(F.col(f"`{field.name}`"))
        filled = raw.where(text.isNotNull() & ~text.isin(*MISSING_TEXT))
        if filled.where(parse_any_date(text, date_formats).isNotNull()).isEmpty() and not filled.isEmpty():
            raise ValueError(f"no value of {field.name} is a date in any of the formats ISO, {', '.join(date_formats)}")


def read_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """A CSV file or folder with a header, all columns as text.

    Quotes inside a quoted value are doubled. A row with too many or too few values is an error, so
    that values never move to another column. Values with line breaks need `multi_line`, which keeps
    Spark from splitting files.
    """
    return (
        spark.read.option("header", True).option("inferSchema", False).option("quote", '"').option("escape", '"')
        .option("multiLine", multi_line).option("mode", "FAILFAST").option("columnPruning", False).csv(path)
    )


def _source_of(spark: SparkSession, path: str) -> str:
    """`csv` or `parquet` by the path's ending; for a folder by the files in it."""
    named = str(path).lower().split("?")[0]
    if named.endswith((".csv", ".csv.gz")):
        return "csv"
    if named.endswith(".parquet"):
        return "parquet"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/*.csv*"))
    return "csv" if found is not None and len(found) else "parquet"


def read_table(
    spark: SparkSession, path: str, schema: T.StructType, source: str | None = None,
    date_formats: Iterable[str] = DATE_FORMATS, multi_line: bool = False,
) -> DataFrame:
    """A CSV or Parquet table, typed by column name.

    CSV columns are read as text under the names in the header, which costs no inference pass and
    does not depend on their order, and are then cast. `source` defaults to the path's ending, and
    for a folder to what it holds. Text dates are ISO or in one of `date_formats`; a date column none
    of whose values is a date is an error.
    """
    source = source or _source_of(spark, path)
    raw = read_csv(spark, path, multi_line) if source == "csv" else spark.read.format(source).load(path)
    check_dates(raw, schema, tuple(date_formats))
    return apply_schema(raw, schema, date_formats)


def read_patients(spark: SparkSession, path: str, source: str | None = None, **options) -> DataFrame:
    """The patients table, one row per diagnosis; `options` are those of `read_table`."""
    return read_table(spark, path, schemas.PATIENTS, source, **options)


def read_municipalities(spark: SparkSession, path: str, source: str | None = None, **options) -> DataFrame:
    """The municipalities dimension, with its keys checked; `options` are those of `read_table`."""
    return require_columns(
        read_table(spark, path, schemas.MUNICIPALITIES, source, **options), ("department", "municipality")
    )
