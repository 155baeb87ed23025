"""Samples of an exact size per stratum in one pass (E9, bottom-k form).

Of every group the rows with the lowest order values are kept, by default a hash of the row, so that the
sample does not depend on how the rows are partitioned. The k lowest rows of a group are the k lowest of
what its parts keep: each task keeps at most k rows per group before anything moves, and samples kept per
day or per file merge to the sample of all of them. The group's number of rows is counted on the way.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..fixed_values import TARGET_EDGES
from ..functions import digitize, hash_uniform

GROUP, ORDER, TIE, SEEN, WANTED, PART = (f"__sample_{n}" for n in ("group", "order", "tie", "seen", "wanted", "part"))
# Rows a task holds before it drops those that cannot be in the sample, and parts of the first merge.
HELD_ROWS = 1 << 16
PARTS = 1024


def _lowest(rows: pa.Table) -> pa.Table:
    """The wanted number of lowest rows per group; the first of them counts all rows seen."""
    column = lambda name: rows.column(name).combine_chunks()
    code = column(GROUP).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    order = np.lexsort((column(TIE).to_numpy(), column(ORDER).to_numpy(), code))
    code = code[order]
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    rank = np.arange(len(code)) - np.repeat(first, np.diff(np.append(first, len(code))))
    seen = np.zeros(len(code), np.int64)
    seen[first] = np.add.reduceat(column(SEEN).to_numpy()[order], first)
    # A group that wants no row still counts.
    keep = (rank < column(WANTED).to_numpy()[order]) | (rank == 0)
    at = rows.schema.get_field_index(SEEN)
    # The field as it was: Spark's says that it is never null, and tables to be joined later must agree.
    return rows.take(pa.array(order[keep])).set_column(at, rows.schema.field(at), pa.array(seen[keep]))


def _within_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    rows, limit = 0, HELD_ROWS
    for batch in batches:
        if batch.num_rows:
            held.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
        if rows > limit:
            held = [_lowest(pa.concat_tables(held))]
            rows = held[0].num_rows
            if rows > HELD_ROWS:  # many groups: what is kept goes on, later parts merge it
                yield from held[0].to_batches()
                held, rows = [], 0
    if held:
        yield from _lowest(pa.concat_tables(held)).to_batches()


def _merge(marked: DataFrame, names: Sequence[str], total: str) -> DataFrame:
    rows = marked.withColumn(PART, F.spark_partition_id() % F.lit(PARTS))
    for keys in ([GROUP, PART], [GROUP]):
        group = Window.partitionBy(*keys)
        rank, seen = F.row_number().over(group.orderBy(ORDER, TIE)), F.sum(SEEN).over(group)
        rows = rows.withColumns({"__sample_rank": rank, total: seen})
        rows = rows.where((F.col("__sample_rank") <= F.col(WANTED)) | (F.col("__sample_rank") == 1))
        rows = rows.withColumn(SEEN, F.when(F.col("__sample_rank") == 1, F.col(total)).otherwise(F.lit(0).cast("long")))
    return rows.where(F.col("__sample_rank") <= F.col(WANTED)).select(*names, total)


def _marked(df: DataFrame, names: Sequence[str], by: Sequence[str], size: int | Column, order: Column, seen: Column) -> DataFrame:
    size = F.lit(size) if isinstance(size, int) else size
    return df.select(
        *names, F.to_json(F.struct(*by), {"ignoreNullFields": "false"}).alias(GROUP), order.cast("double").alias(ORDER),
        F.xxhash64(*names).alias(TIE), seen.cast("long").alias(SEEN), F.coalesce(size.cast("long"), F.lit(0)).alias(WANTED))


def bottom_k(df: DataFrame, by: Sequence[str], size: int | Column, order: Column | None = None, seed: int = 42,
             row_key: Sequence[str] | None = None, total: str = "n_total") -> DataFrame:
    """The `size` rows of each group with the lowest `order`, all rows of a smaller group, with the group's
    number of rows as `total`.

    `size` may be a column that is the same for all rows of a group; null means none. Rows with a null or
    NaN order are left out. Equal orders are decided by a hash of the row. Null keys form a group.
    """
    names = list(df.columns)
    if total in names:
        raise ValueError(f"the table already has a column {total}")
    order = (hash_uniform(seed, *[F.col(c) for c in (row_key or names)]) if order is None else order).cast("double")
    marked = _marked(df.where(order.isNotNull() & ~F.isnan(order)), names, by, size, order, F.lit(1))
    local = marked.mapInArrow(_within_tasks, marked.schema)
    return _merge(local, names, total)


def merge_samples(samples: Sequence[DataFrame], by: Sequence[str], size: int | Column, order: Column | None = None, seed: int = 42,
                  row_key: Sequence[str] | None = None, total: str = "n_total") -> DataFrame:
    """The sample of all rows from samples of disjoint parts of them, each made by `bottom_k` with the same
    arguments and at least this size. A group that wants no row keeps no count either."""
    names = [c for c in samples[0].columns if c != total]
    order = (hash_uniform(seed, *[F.col(c) for c in (row_key or names)]) if order is None else order).cast("double")
    first = F.row_number().over(Window.partitionBy(*by).orderBy(order, F.xxhash64(*names))) == 1
    marked = [_marked(s.withColumn("__sample_first", first), names, by, size, order, F.when(F.col("__sample_first"), F.col(total)).otherwise(F.lit(0)))
              for s in samples]
    return _merge(reduce(DataFrame.unionByName, marked), names, total)


def stratified_sample(df: DataFrame, sizes: int | Mapping[int, int], target: str = "risk_score", edges: Sequence[float] = TARGET_EDGES,
                      seed: int = 42, row_key: Sequence[str] | None = None, order: Column | None = None, stratum: str = "stratum",
                      total: str = "n_stratum") -> DataFrame:
    """An exact number of rows of every target bin, with the bin and its number of rows.

    `sizes` is one number for all bins or a number per bin; bins without one give no row. Rows without a
    target are left out. A row stands for `n_stratum / rows of its bin in the sample` rows.
    """
    names = list(df.columns)
    order = hash_uniform(seed, *[F.col(c) for c in (row_key or names)]) if order is None else order
    rows = df.withColumns({stratum: digitize(F.col(target).cast("double"), edges), "__sample_by": order}).where(F.col(stratum).isNotNull())
    size: int | Column = sizes if isinstance(sizes, int) else F.lit(0)
    if not isinstance(sizes, int):
        for b, n in sizes.items():
            size = F.when(F.col(stratum) == F.lit(b), F.lit(n)).otherwise(size)
    found = bottom_k(rows, [stratum], size, F.col("__sample_by"), total=total)
    return found.select(*names, stratum, total)
