"""Train/test splits (E9, E10) that need no shuffle and survive a task being run again."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..fixed_values import TARGET_EDGES
from ..functions import digitize, hash_uniform
from .quantiles import extents, order_statistics


def _row_hash(df: DataFrame, row_key: Sequence[str] | None, seed: int) -> Column:
    return hash_uniform(seed, *[F.col(c) for c in (row_key or df.columns)])


def random_split(
    df: DataFrame, test_fraction: float = 0.2, seed: int = 42,
    row_key: Sequence[str] | None = None, uniform: Column | None = None, flag: str = "is_test",
) -> DataFrame:
    """The rows with a test flag, true for about `test_fraction` of them.

    `uniform` is a number in [0, 1) that belongs to the row; a hash of the row by default.
    """
    uniform = _row_hash(df, row_key, seed) if uniform is None else uniform
    return df.withColumn(flag, uniform < F.lit(test_fraction))


def _test_sizes(counts: dict[int, int], fraction: float) -> dict[int, int]:
    """ceil(fraction * n) test rows spread over the strata by largest remainder."""
    wanted = math.ceil(fraction * sum(counts.values()))
    share = {b: n * wanted / max(sum(counts.values()), 1) for b, n in counts.items()}
    sizes = {b: math.floor(s) for b, s in share.items()}
    by_remainder = sorted(counts, key=lambda b: (sizes[b] - share[b], b))
    for b in by_remainder[: wanted - sum(sizes.values())]:
        sizes[b] += 1
    return sizes


def stratified_split(
    df: DataFrame,
    target: str = "risk_score",
    edges: Sequence[float] = TARGET_EDGES,
    test_fraction: float = 0.2,
    seed: int = 42,
    row_key: Sequence[str] | None = None,
    order: Column | None = None,
    flag: str = "is_test",
) -> DataFrame:
    """The rows with a test flag: an exact share of every target bin; runs jobs.

    Inside a bin the rows with the lowest `order` value (a hash of the row by default) form the
    test set. Instead of ranking the rows of a bin in one task, the hash value at the wanted rank is
    found once per bin; the flag is then a comparison with a constant. Rows without a target get a
    null flag. `order` must be distinct within a bin for the share to be exact.
    """
    stratum = digitize(F.col(target).cast("double"), edges)
    order = _row_hash(df, row_key, seed) if order is None else order.cast("double")
    known = extents(df, order, stratum)
    counts = {b: n for b, (n, _, _) in known.items()}
    wanted = {b: [n - 1] for b, n in _test_sizes(counts, test_fraction).items() if n > 0}
    limits = order_statistics(df, order, stratum, wanted, known=known) if wanted else {}
    is_test = F.when(stratum.isNull(), F.lit(None).cast("boolean"))
    for b, ranks in limits.items():
        is_test = is_test.when(stratum == F.lit(b), order <= F.lit(next(iter(ranks.values()))))
    return df.withColumn(flag, is_test.otherwise(F.lit(False)))
