"""Importance resampling towards a target distribution.

Features of a text are its words and pairs of neighbouring words, hashed into BUCKETS buckets. Counts of
all source texts and of all target texts are arrays of that length; a bucket's gain is the floored
logarithm of the ratio of its smoothed shares, a text's weight the floored mean gain of its features.
Each text's score adds Gumbel noise from its id, so that the texts with the highest scores are a draw
without replacement in proportion to the exponential of the weights.

The draw: a text's key is (score descending, id ascending, row number), the last so that no two keys are
equal. The key at which the draw ends is found by weighted medians of medians. Every run of at most RUN
remaining keys inside a partition gives its median, weighted by the run's size; at least a quarter of the
remaining keys lie on either side of the weighted median of these medians, so each round discards a
guaranteed fraction and writes what is left. The last LEFT keys are sorted where they are. The winners are
sorted by ranges of keys and numbered with the sizes of the ranges before theirs; nothing is gathered.

Words are runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`, with A-Z lower-cased first. Null and empty texts have
no features, a weight of 0, and are drawn only if `least_words` is 0. Repeated rows are drawn on their own;
equal keys but for the row number take ranks in the order of the rows. Rows with a null id all have the
noise of the empty id and come after others of their score. An empty table gives no rows; without target
or source texts the counts are zero. Other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .decontamination import INSIDE
from .quality import total
from .shared import LOWER, Staged, bounded_batches, pieces, table, utf8, words

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
RUN = 1 << 20
LEFT = 1 << 10
POLYNOMIAL = 0xEDB88320
LONG_WORD = 256


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), out >> np.uint32(1))
    return out


CRC = _crc_table()


def crc_states(data: np.ndarray, begin: np.ndarray, end: np.ndarray, state: np.ndarray) -> np.ndarray:
    """The checksum's state after the bytes of each range, from the given states. All ranges advance by
    a byte at a time, the longest first, so that each step works on a prefix of the arrays."""
    size = end - begin
    order = np.argsort(-size, kind="stable")
    at, sizes, out = begin[order], size[order], state[order]
    active = np.searchsorted(-sizes, -np.arange(min(int(sizes[0]) if len(sizes) else 0, LONG_WORD)), side="left")
    for k, n in enumerate(active.tolist()):
        out[:n] = CRC[(out[:n] ^ data[at[:n] + k]) & np.uint32(255)] ^ (out[:n] >> np.uint32(8))
    for i in np.flatnonzero(sizes > LONG_WORD).tolist():
        rest = data[at[i] + LONG_WORD : at[i] + sizes[i]].tobytes()
        out[i] = zlib.crc32(rest, int(out[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    back = np.empty_like(out)
    back[order] = out
    return back


def feature_buckets(data: np.ndarray, at: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket and the row of every feature of the texts, and the words of each row."""
    begin, end, _, row = words(data, at, INSIDE)
    low = LOWER[data]
    start = np.full(len(begin), 0xFFFFFFFF, np.uint32)
    one = crc_states(low, begin, end, start)
    first = np.flatnonzero(row[1:] == row[:-1]) if len(row) else np.zeros(0, np.int64)
    state = one[first]
    state = CRC[(state ^ np.uint32(0x20)) & np.uint32(255)] ^ (state >> np.uint32(8))
    two = crc_states(low, begin[first + 1], end[first + 1], state)
    crc = np.concatenate([one, two]) ^ np.uint32(0xFFFFFFFF)
    return (crc % np.uint32(buckets)).astype(np.int64), np.concatenate([row, row[first]]), np.bincount(row, minlength=len(at) - 1)


def counts(texts: DataFrame, text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all texts, added up level by level."""

    def of_batch(batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros(buckets)
        for piece in pieces(batch, text):
            out += np.bincount(feature_buckets(*utf8(piece.column(text)), buckets)[0], minlength=buckets)
        return out

    return total(texts.select(text), of_batch, buckets)


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of smoothed shares) per bucket, in doubles."""
    n = float(len(source))
    whole_s, whole_t = float(source.sum()), float(target.sum())
    return np.array([
        math.floor(1000 * math.log((t + 1) * (whole_s + n) / ((s + 1) * (whole_t + n)))) for s, t in zip(source.tolist(), target.tolist())
    ], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, doc_id: str, text: str) -> DataFrame:
    """(id, n_words, n_features, weight) of every row."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                bucket, row, n_words = feature_buckets(*utf8(piece.column("text")), len(gain))
                n = np.bincount(row, minlength=len(n_words))
                # The sums of integers of this size are exact in doubles.
                sums = np.bincount(row, gain[bucket], len(n_words)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("id"), *(pa.array(x.astype(np.int64)) for x in (n_words, n, np.where(n > 0, sums // np.maximum(n, 1), 0)))],
                    names=["id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(weigh, f"id {rows.schema['id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def noise(doc_id: str, seed: int):
    """Gumbel noise in thousandths, floored, from a hash of the seed and the id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


# Selection ------------------------------------------------------------------------------------

KEYS = ["down", "last", "id", "row"]


def _sorted(keys: np.ndarray) -> np.ndarray:
    return keys[np.lexsort(keys.T[::-1])]


def _medians(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lower median of each run of keys and the run's size."""

    def median(held: list[np.ndarray]) -> pa.RecordBatch:
        keys = _sorted(np.concatenate(held))
        middle = keys[(len(keys) - 1) // 2]
        return pa.RecordBatch.from_arrays([pa.array([int(v)], pa.int64()) for v in (*middle, len(keys))], names=[*KEYS, "size"])

    held, n = [], 0
    for batch in batches:
        held.append(np.stack([batch.column(k).to_numpy() for k in range(len(KEYS))], axis=1))
        n += batch.num_rows
        if n >= RUN:
            yield median(held)
            held, n = [], 0
    if n:
        yield median(held)


def _before(key: tuple[int, ...], equal: bool):
    """Whether a row's key comes before `key` (or is it)."""
    test = F.lit(equal)
    for name, value in reversed(list(zip(KEYS, key))):
        test = (F.col(name) < value) | ((F.col(name) == value) & test)
    return test


def cutoff(keys: DataFrame, wanted: int, staged: Staged) -> tuple[int, ...] | None:
    """The `wanted`-th smallest of the distinct keys; None for none."""
    n, kept = keys.count(), None
    if not 0 < wanted <= n:
        return None
    while n > LEFT:
        found = sorted(tuple(r) for r in keys.mapInArrow(_medians, ", ".join(f"{k} long" for k in [*KEYS, "size"])).collect())
        half, pivot = 0, None
        for *key, size in found:
            half += size
            if 2 * half >= n:
                pivot = tuple(key)
                break
        low = keys.where(_before(pivot, True))
        n_low = low.count()
        keys, n, wanted = (low, n_low, wanted) if wanted <= n_low else (keys.where(~_before(pivot, True)), n - n_low, wanted - n_low)
        keys, old = staged.write(keys, "keys"), kept
        kept = keys
        if old is not None:
            staged.drop(old)
    out = sorted(tuple(r) for r in keys.collect())[wanted - 1]
    if kept is not None:
        staged.drop(kept)
    return out


def ranked(rows: DataFrame, key, staged: Staged) -> DataFrame:
    """The rows with their place in the order of `key`, a list of columns that tells all rows apart."""
    from pyspark import TaskContext

    names = rows.columns

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(batch.num_rows, part, np.int64)), pa.array(np.arange(n, n + batch.num_rows))],
                names=[*names, "part", "place"])
            n += batch.num_rows

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    order = staged.write(rows.repartitionByRange(*key).sortWithinPartitions(*key).mapInArrow(number, f"{schema}, part long, place long"), "order")
    sizes = sorted((r["part"], r["n"]) for r in order.groupBy("part").agg(F.count("*").alias("n")).collect())
    starts, at = [], 0
    for part, n in sizes:  # a row per partition of the sort
        starts.append((part, at))
        at += n
    starts = rows.sparkSession.createDataFrame(starts, "part long, start long")
    return order.join(F.broadcast(starts), "part").select(*names, (F.col("start") + F.col("place") + 1).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text",
             buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of every row; `rank` is null for rows not drawn.

    Of the rows of at least `least_words` words, `percent` of a hundred are drawn, rounded down."""
    spark = bounded_batches(docs.sparkSession)
    staged = Staged(spark, "resampling")
    gain = gains(counts(docs, text, buckets), counts(target, target_text, buckets))
    scored = weighted(docs, gain, doc_id, text).withColumn("score", F.col("weight") + noise("id", seed))
    rows = staged.write(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    able = rows.where(F.col("n_words") >= least_words)
    id_order = F.col("id") if rows.schema["id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") else F.xxhash64("id")
    keyed = lambda df: df.withColumn("down", -F.col("score")).withColumn("last", F.col("id").isNull().cast("long"))
    keys = keyed(able).select("down", "last", F.coalesce(id_order.cast("long"), F.lit(0)).alias("id"), "row")
    wanted = able.count() * percent // 100
    last = cutoff(keys, wanted, staged)
    none = F.lit(None).cast("long").alias("rank")
    if last is None:
        return rows.select("id", "n_words", "n_features", "weight", "score", none)
    drawn = rows.select("*", F.col("id").alias("own_id"), F.coalesce(id_order.cast("long"), F.lit(0)).alias("key_id"))
    drawn = keyed(drawn).withColumn("id", F.col("key_id"))
    test = (F.col("n_words") >= least_words) & _before(last, True)
    winners = ranked(drawn.where(test).select(*KEYS, "own_id", "n_words", "n_features", "weight", "score"), KEYS, staged)
    shown = [F.col("own_id").alias("id"), "n_words", "n_features", "weight", "score"]
    return winners.select(*shown, "rank").union(drawn.where(~test).select(*shown, none))


def op11_resampling(spark, sf_dir: str) -> DataFrame:
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")
