"""Model evaluation tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import hash_uniform
from .quantiles import exact_percentiles
from .staging import release, stage

HISTOGRAM_BINS = 30
ERROR_RANGES = 5
WHISKER = 1.5


def regression_metrics(df: DataFrame, truth: str = "risk_score", predicted: str = "score") -> DataFrame:
    """One row: rows used, mean squared error, mean absolute error and R2.

    A constant truth gives R2 1 for a perfect prediction and 0 otherwise.
    """
    error = F.col(truth) - F.col(predicted)
    known = error.isNotNull()
    sums = df.agg(
        F.count(error).alias("n"),
        F.avg(error * error).alias("mse"),
        F.avg(F.abs(error)).alias("mae"),
        F.var_pop(F.when(known, F.col(truth))).alias("_spread"),
    )
    r2 = F.when(F.col("_spread") > 0, F.lit(1.0) - F.col("mse") / F.col("_spread")).when(
        F.col("mse").isNotNull(), (F.col("mse") == 0).cast("double")
    )
    return sums.select("n", "mse", "mae", r2.alias("r2"))


def _extents(df: DataFrame, columns: Mapping[str, Column]) -> dict[str, tuple[float, float]]:
    measures = [f(c).alias(f"{tag}{i}") for i, c in enumerate(columns.values()) for tag, f in (("lo", F.min), ("hi", F.max))]
    row = df.agg(*measures).collect()[0]
    return {name: (row[f"lo{i}"], row[f"hi{i}"]) for i, name in enumerate(columns)}


def equal_width_edges(low: float, high: float, n: int, widen_lowest: bool = False) -> list[float]:
    """Edges of `n` equal intervals over [low, high].

    With `widen_lowest` the first edge moves down by 0.1 % of the range, so that the lowest value
    falls inside a right-closed interval; a range of one value is widened on both sides.
    """
    if low == high:
        pad = (0.001 * abs(low) if low else 0.001) if widen_lowest else 0.5
        low, high = low - pad, high + pad
        widen_lowest = False
    step = (high - low) / n
    edges = [low + i * step for i in range(n)] + [high]
    if widen_lowest:
        edges[0] -= (high - low) * 0.001
    return edges


def equal_width_cut(df: DataFrame, column: str, n: int, output: str = "bin") -> tuple[DataFrame, list[float]]:
    """The rows with a 0-based right-closed bin number, and the bin edges.

    The bin number is the count of inner edges below the value.
    """
    value = F.col(column).cast("double")
    low, high = _extents(df, {column: value})[column]
    if low is None:
        return df.withColumn(output, F.lit(None).cast("int")), []
    edges = equal_width_edges(low, high, n, widen_lowest=True)
    number = F.lit(0)
    for edge in edges[1:-1]:
        number = number + (value > F.lit(edge)).cast("int")
    return df.withColumn(output, F.when(value.isNotNull(), number)), edges


def histograms(df: DataFrame, columns: Mapping[str, Column], n: int = HISTOGRAM_BINS) -> DataFrame:
    """Counts in `n` equal bins per column, empty bins included; the last bin is closed.

    Two scans: the extents, then all columns counted together (at most `n` groups per column leave
    an executor). The first runs at once.
    """
    extents = _extents(df, columns)
    cells = []
    for name, col in columns.items():
        if extents[name][0] is None:
            continue
        edges = equal_width_edges(*extents[name], n)
        # The highest value has its own number n + 1. `least` would turn a null into n.
        number = F.when(col.isNotNull(), F.least(
            F.width_bucket(col, F.lit(edges[0]), F.lit(edges[-1]), F.lit(n)), F.lit(n).cast("long")
        ))
        cells.append((name, edges, F.struct(F.lit(name).alias("variable"), number.cast("int").alias("bin"))))
    spark = df.sparkSession
    frame = spark.createDataFrame(
        [(name, i + 1, edges[i], edges[i + 1]) for name, edges, _ in cells for i in range(n)],
        "variable string, bin int, low double, high double",
    )
    if not cells:
        return frame.withColumn("n", F.lit(0).cast("bigint"))
    counts = (
        df.select(F.explode(F.array(*[cell for _, _, cell in cells])).alias("cell")).select("cell.*")
        .where(F.col("bin").isNotNull()).groupBy("variable", "bin").agg(F.count("*").alias("n"))
    )
    return frame.join(counts, ["variable", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))


def residual_histogram(
    df: DataFrame, truth: str = "risk_score", predicted: str = "score", n: int = HISTOGRAM_BINS
) -> DataFrame:
    """Histograms of the residuals, the truth and the prediction in long form; runs jobs.

    The scores are computed once, into a staged table that both scans read; the result, a row per
    bin, is read before that table is released.
    """
    residual = F.col(truth) - F.col(predicted)
    staged = stage(df.where(residual.isNotNull()).select(
        residual.alias("residual"), F.col(truth).cast("double").alias("truth"), F.col(predicted).cast("double").alias("prediction"),
    ), "residuals")
    return _read_and_release(histograms(staged, {c: F.col(c) for c in ("residual", "truth", "prediction")}, n), staged)


def _read_and_release(found: DataFrame, staged: DataFrame) -> DataFrame:
    """A result of a few rows as a table of its own, without the staged table it came from."""
    out = found.sparkSession.createDataFrame(found.toArrow(), found.schema)
    release(staged)
    return out


def error_by_range(
    df: DataFrame, truth: str = "risk_score", predicted: str = "score", bins: int = ERROR_RANGES,
    **quantile_options,
) -> DataFrame:
    """Box-plot numbers of the absolute error per equal-width range of the truth.

    One row per range that has rows: count, extremes, quartiles, and the whiskers, which are the
    outermost errors within 1.5 interquartile ranges of the box; errors beyond them are counted.
    Runs jobs: the errors are computed once, into a staged table that every pass reads.
    """
    error = F.abs(F.col(truth) - F.col(predicted))
    pairs = stage(df.where(error.isNotNull()).select(error.alias("_error"), F.col(truth).alias("_truth")), "errors")
    binned, edges = equal_width_cut(pairs, "_truth", bins, "_range")
    boxes = exact_percentiles(
        binned, {"error": F.col("_error")}, (0.25, 0.5, 0.75), by=F.col("_range"), **quantile_options
    )
    # A handful of numbers per range, looked up by range number.
    held = [boxes.get((g, "error")) or [None] * 3 for g in range(bins)]

    def per_range(values, idx: Column) -> Column:
        return F.get(F.array(*[F.lit(v).cast("double") for v in values]), idx)

    error, idx = F.col("_error"), F.col("_range")
    reach = [None if q1 is None else WHISKER * (q3 - q1) for q1, _, q3 in held]
    low_fence = per_range([None if r is None else q[0] - r for q, r in zip(held, reach)], idx)
    high_fence = per_range([None if r is None else q[2] + r for q, r in zip(held, reach)], idx)
    inside = binned.withColumn("_within", (error >= low_fence) & (error <= high_fence))
    found = inside.groupBy(idx.alias("range_idx")).agg(
        F.count(error).alias("n"),
        F.min(error).alias("min_error"),
        F.max(error).alias("max_error"),
        F.min(F.when(F.col("_within"), error)).alias("whisker_low"),
        F.max(F.when(F.col("_within"), error)).alias("whisker_high"),
        F.count_if(~F.col("_within")).alias("n_outliers"),
    ).where(F.col("n") > 0)
    idx = F.col("range_idx")
    ends = {"low": edges[:-1], "high": edges[1:]} if edges else {"low": [None] * bins, "high": [None] * bins}
    return _read_and_release(found.select(
        "range_idx", *[per_range(v, idx).alias(c) for c, v in ends.items()],
        *[per_range([q[i] for q in held], idx).alias(c) for i, c in enumerate(("q1", "median", "q3"))],
        "n", "min_error", "max_error", "whisker_low", "whisker_high", "n_outliers",
    ), pairs)


def prediction_points(
    df: DataFrame, truth: str = "risk_score", predicted: str = "score",
    fraction: float | None = None, seed: int = 42, row_key: Sequence[str] | None = None,
) -> DataFrame:
    """(truth, prediction, residual) per scored row, for scatter views.

    `fraction` keeps a repeatable share of the rows: whether a row is kept depends on its values.
    """
    # `is_scorable` says the same about a scored table without evaluating the score for it.
    scored = F.col("is_scorable") if "is_scorable" in df.columns else F.col(predicted).isNotNull()
    both = df.where(F.col(truth).isNotNull() & scored)
    if fraction is not None:
        both = both.where(
            hash_uniform(seed, *[F.col(c) for c in (row_key or df.columns)]) < F.lit(fraction)
        )
    return both.select(
        *(row_key or ()), F.col(truth).alias("truth"), F.col(predicted).alias("prediction"),
        (F.col(truth) - F.col(predicted)).alias("residual"),
    )
