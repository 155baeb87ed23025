"""Cohort reports of several levels from one scan (A1 x A2 x A7, grouping sets).

The rows are summed once per combination of all keys. The levels are grouping sets over these sums, which
are as many as there are combinations, and every level is finished by the formulas of the single report.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .cohorts import CohortSums


def cohort_lattice(df: DataFrame, levels: Sequence[Sequence[str]], sums: CohortSums, min_rows: int | None = None) -> DataFrame:
    """Prepared rows to one report for all levels: `level`, the keys (null where a level has none), and the
    columns of the single report. As in these, rows with a null key of a level do not count for it."""
    if sums.with_long:
        raise ValueError("lists of many categories need a report of their own")
    if sums.score_first and sums.scope == "cohort":
        raise ValueError("a network scores rows before they are summed, so each level's means would need a scan")
    levels = [list(dict.fromkeys(level)) for level in levels]
    keys = list(dict.fromkeys(k for level in levels for k in level))
    rows = sums.rows(df, keys)
    finest = rows.groupBy(*keys).agg(*[F.expr(f"{text} AS `{name}`") for name, text in sums._sums(rows).items()])
    measures = [c for c in finest.columns if c not in keys]
    # A key that is null in the data is told from one the level leaves out.
    known = finest.withColumns({f"_has_{k}": F.col(k).isNotNull() for k in keys})
    parts = []
    for c in measures:
        total = F.sum(c)
        parts.append((F.coalesce(total, F.lit(0)) if c.startswith("alive_") else total).alias(c))
    sets = [[F.col(k) for k in level] + [F.col(f"_has_{k}") for k in level] for level in levels]
    added = known.groupingSets(sets, *keys, *[f"_has_{k}" for k in keys]).agg(F.grouping_id().alias("_set"), *parts)
    all_present = F.lit(True)
    for k in keys:
        all_present = all_present & F.coalesce(F.col(f"_has_{k}"), F.lit(True))
    bits = 2 * len(keys)
    level = F.lit(None).cast("string")
    for wanted in levels:
        left_out = sum(1 << (bits - 1 - i) for i, k in enumerate(keys) if k not in wanted) + sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in wanted)
        level = F.when(F.col("_set") == left_out, F.lit(",".join(wanted))).otherwise(level)
    return sums.finish(added.where(all_present).withColumn("level", level), ["level", *keys], min_rows)
