"""Longest-processing-time sharding of groups that must stay together.

Groups are rows of equal text. Their sizes are summed first (partial aggregates, so a group that
holds a third of all rows is one number before anything moves). Groups are dealt by hash into
buckets of bounded size; within a bucket the largest group first goes to the least-loaded of as many
bins as there are shards, through a heap. Bins are then groups in turn: all bins of all buckets,
largest first, go to the least-loaded shard the same way, in rounds of bounded size until one round
holds them all. A group larger than an even share makes its shard as large as the group: groups are
never split.

Null text counts as empty text and adds no bytes. Repeated rows and rows that share a doc_id each
get a slot. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .shared import Staged, table

SHARDS = 40
BUCKET_GROUPS = 200_000
SLOT_ROWS = 200_000
ROW_BYTES = 16


def least_loaded(sizes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each size, for sizes in decreasing order."""
    heap = [(0, shard) for shard in range(shards)]
    out = np.empty(len(sizes), np.int32)
    for k, size in enumerate(sizes.tolist()):
        load, shard = heap[0]
        out[k] = shard
        heapq.heapreplace(heap, (load + size, shard))
    return out


def schedule(groups: DataFrame, key: str, size: str, shards: int, staged: Staged, bucket_groups: int = BUCKET_GROUPS) -> DataFrame:
    """(key, shard) for a staged table of distinct keys with their sizes."""
    n = groups.count()
    buckets = max(1, -(-n // bucket_groups))
    kind, bin_ = groups.schema[key].dataType.simpleString(), f"bin_of_{key}"

    def spread(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([size, key], ascending=[False, True], kind="stable")
        bins = least_loaded(frame[size].to_numpy(), shards) + frame["bucket"].astype("int64") * shards
        return pd.DataFrame({key: frame[key], size: frame[size], bin_: bins})

    placed = groups.select(key, size, F.pmod(F.xxhash64(F.lit(buckets), key), F.lit(buckets)).alias("bucket")).groupBy("bucket").applyInPandas(
        spread, f"`{key}` {kind}, `{size}` long, `{bin_}` long")
    if buckets == 1:
        return placed.select(key, F.col(bin_).cast("int").alias("shard"))
    placed = staged.write(placed, "bins")
    bins = staged.write(placed.groupBy(bin_).agg(F.sum(size).alias(size)), "loads")
    # Fewer bins than groups as long as a bucket holds more groups than there are shards.
    return placed.select(key, bin_).join(schedule(bins, bin_, size, shards, staged, bucket_groups), bin_).select(key, "shard")


def shard_documents(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text",
                    bucket_groups: int = BUCKET_GROUPS, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """Per document: size, text_crc32, law, shard, slot, grown_shard."""
    staged = Staged(docs.sparkSession, "sharding")
    value = F.coalesce(F.col(text), F.lit(""))
    rows = staged.write(docs.select(
        F.col(doc_id).alias("doc_id"), F.md5(value).alias("content"),
        (F.octet_length(value).cast("long") + ROW_BYTES).alias("size"), F.crc32(value).alias("text_crc32"),
    ), "rows")
    groups = staged.write(rows.groupBy("content").agg(F.sum("size").alias("size")), "groups")
    shard_of = staged.write(schedule(groups, "content", "size", shards, staged, bucket_groups), "shards")
    staged.drop(groups)
    # Slots: rows are dealt into parts of bounded size by a hash that no equal rows share; a slot is
    # the rows of the shard in earlier parts plus the place within the part.
    parts = max(1, -(-rows.count() // slot_rows))
    placed = staged.write(rows.join(shard_of, "content").withColumn(
        "part", F.pmod(F.xxhash64("doc_id", "content", F.monotonically_increasing_id()), F.lit(parts))), "placed")
    staged.drop(rows, shard_of)
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy("shard", "part").count().select(
        "shard", "part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("shard", "part").orderBy("doc_id", "content")
    return placed.withColumn("place", F.row_number().over(inside) - 1).join(before, ["shard", "part"]).select(
        F.col("doc_id").alias(doc_id), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("before") + F.col("place")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
