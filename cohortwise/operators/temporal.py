"""Joins by validity: the place as it was at the diagnosis (J1 as-of), bins from a table.

Both avoid a join by range. The line of time (or of values) is cut into buckets of equal width; each row of
the small side is filed under every bucket it reaches into, gathered to one sorted array per key and
bucket, and the large side meets it by an equality of keys and bucket. A large row never multiplies, hot
keys are split over their buckets and by AQE, and the last step picks from an array of a few entries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..fixed_values import GEO_KEYS
from ..sources.readers import lowercase_columns, require_columns

BUCKET_DAYS = 90


def _day_bucket(date: Column, days: int) -> Column:
    return F.floor(F.unix_date(F.to_date(date)) / F.lit(days)).cast("long")


def versions(places: DataFrame, on: Sequence[str], valid_from: str) -> DataFrame:
    """One row per key and start of validity, with the next start as `_until`.

    Of several rows with one key and start the one with the fewest nulls counts, of equally complete ones
    the smallest. Rows without a start are no version."""
    others = [c for c in places.columns if c not in (*on, valid_from)]
    nulls = sum((F.col(f"`{c}`").isNull().cast("int") for c in others), F.lit(0))
    first = places.where(F.col(valid_from).isNotNull()).groupBy(*on, valid_from).agg(F.min(F.struct(nulls.alias("_nulls"), *others)).alias("_row"))
    order = Window.partitionBy(*on).orderBy(valid_from)
    return first.withColumn("_until", F.lead(valid_from).over(order)).select(*on, valid_from, "_until", *[F.col(f"_row.{c}").alias(c) for c in others])


def with_geography_as_of(
    patients: DataFrame, places: DataFrame, date: str = "diagnosis_date", valid_from: str = "valid_from",
    on: Sequence[str] = GEO_KEYS, bucket_days: int = BUCKET_DAYS,
) -> DataFrame:
    """Left join of patients with the version of their place that held at `date`: the last one that starts
    at or before it. Patients without a date, a key or such a version stay, with nulls.

    One job reads the extent of the dates; versions are filed only between these."""
    on = list(on)
    places = require_columns(lowercase_columns(places), [*on, valid_from])
    clash = set(places.columns) & set(patients.columns) - set(on)
    patients = patients.drop(*clash)
    low, high = patients.agg(F.min(date), F.max(date)).first()
    held = [c for c in places.columns if c not in on]
    if low is None:
        kinds = {f.name: f.dataType for f in places.schema}
        return patients.withColumns({c: F.lit(None).cast(kinds[c]) for c in held})
    # A version without a successor holds to the last date there is.
    first = _day_bucket(F.greatest(F.col(valid_from), F.lit(low)), bucket_days)
    last = _day_bucket(F.least(F.coalesce("_until", F.lit(high)), F.lit(high)), bucket_days)
    reach = versions(places, on, valid_from).where((F.col(valid_from) <= F.lit(high)) & (F.col("_until").isNull() | (F.col("_until") > F.lit(low))))
    filed = reach.withColumn("_bucket", F.explode(F.sequence(first, last))).groupBy(*on, "_bucket").agg(
        F.sort_array(F.collect_list(F.struct(valid_from, *[c for c in held if c != valid_from]))).alias("_versions"))
    joined = patients.withColumn("_bucket", _day_bucket(F.col(date), bucket_days)).join(filed, [*on, "_bucket"], "left")
    holding = F.filter("_versions", lambda v: v[valid_from] <= F.col(date))
    joined = joined.withColumn("_held", F.get(holding, F.size(holding) - 1))
    return joined.select(*patients.columns, *[F.col(f"_held.{c}").alias(c) for c in held])


def cut_by_table(
    df: DataFrame, value: str, edges: DataFrame, on: Sequence[str], width: float, output: str = "label",
    right: bool = True, low: str = "low", high: str = "high", label: str = "label",
) -> DataFrame:
    """The label of the interval that holds the value, from a table (keys, low, high, label) of intervals per
    key; null outside all of them. As `cut`, intervals are right-closed, or left-closed without `right`. Of
    intervals that overlap the one with the lowest start counts. A null start or end is open.

    `width` is the width of a bucket: about that of the intervals. One job reads the extent of the values.
    """
    on = list(on)
    x = F.col(value).cast("double")
    finite = F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)
    least, most = df.agg(F.min(finite), F.max(finite)).first()
    none = F.lit(None).cast(edges.schema[label].dataType)
    if least is None:
        return df.withColumn(output, none)
    start, end = F.col(low).cast("double"), F.col(high).cast("double")
    bucket = lambda c: F.floor(c / F.lit(float(width))).cast("long")
    reach = edges.where((start.isNull() | (start <= most)) & (end.isNull() | (end >= least)) & (start.isNull() | end.isNull() | (start <= end)))
    filed = reach.withColumn("_bucket", F.explode(F.sequence(
        bucket(F.greatest(F.coalesce(start, F.lit(least)), F.lit(least))), bucket(F.least(F.coalesce(end, F.lit(most)), F.lit(most))))))
    entry = F.struct(start.alias("low"), end.alias("high"), F.col(label).alias("label"))
    names = {c: f"_on_{i}" for i, c in enumerate(on)}
    filed = filed.groupBy(*[F.col(c).alias(names[c]) for c in on], "_bucket").agg(F.sort_array(F.collect_list(entry)).alias("_intervals"))
    same = [F.col(c) == F.col(names[c]) for c in on]
    joined = df.withColumn("_at", bucket(finite)).join(filed, [*same, F.col("_at") == F.col("_bucket")], "left")

    def holds(i: Column) -> Column:
        if right:
            return (i["low"].isNull() | (x > i["low"])) & (i["high"].isNull() | (x <= i["high"]))
        return (i["low"].isNull() | (x >= i["low"])) & (i["high"].isNull() | (x < i["high"]))

    return joined.withColumn(output, F.get(F.filter("_intervals", holds), F.lit(0))["label"]).select(*df.columns, output)
