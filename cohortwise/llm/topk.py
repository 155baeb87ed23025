"""Exact top-k by inner product with multi-resolution segment statistics.

Components are turned into integers floor(scale * x). A squared distance is at least, for each
segment of both vectors, its length times the squared difference of the two means plus that of the
two deviations; as |q - x|**2 = |q|**2 + |x|**2 - 2 q.x, that lower bound on the distance is an upper
bound on the score: the sum over segments of length * (mean*mean + deviation*deviation). The bounds
are computed coarse to fine, from one segment to ever shorter ones; a candidate is dropped as soon as
its bound is below the k-th best exact score known for its query, and survivors get exact scores.

The query set meets all vectors block by block: vectors and queries are packed into blocks of bounded
size inside tasks, and every task compares the blocks of one partition of vectors with those of one
partition of queries, keeping k rows per query. The k best of these are chosen by a second step.

Vectors that are null, or hold a null or non-finite component, take no part. Vectors of another length
than the query's are not candidates. Equal scores go to the smaller vec_id; rows that share a vec_id
with the query are not its candidates, other repeated rows are candidates of their own. Scores have
to fit 64 bits. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .shared import Staged, bounded_batches, table

SCALE = 1024
K = 10
EVERY = 100
VECTOR_BLOCK = 2048
QUERY_BLOCK = 512


def _blocks(size: int):
    """mapInArrow function: rows to blocks (dim, ids, values), ids and values as packed bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, tuple[list, list]] = {}

        def block(dim: int) -> pa.RecordBatch:
            ids, values = waiting.pop(dim)
            return pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()),
                 pa.array([b"".join(values)], pa.binary())], names=["dim", "ids", "vectors"])

        for batch in batches:
            column = batch.column(1)
            for row, vec_id in enumerate(batch.column(0).to_pylist()):
                vector = column[row].values.to_numpy(zero_copy_only=False).astype(np.int64)
                ids, values = waiting.setdefault(len(vector), ([], []))
                ids.append(vec_id)
                values.append(vector.tobytes())
                if len(ids) == size:
                    yield block(len(vector))
        for dim in list(waiting):
            yield block(dim)

    return pack


def segments(dim: int) -> list[int]:
    """Numbers of segments, coarse to fine, down to segments of about four components."""
    counts = [1]
    while counts[-1] * 4 <= max(1, dim // 4):
        counts.append(counts[-1] * 4)
    return counts


class Summaries:
    """Per level: sqrt(length)-weighted means and deviations of every segment, side by side."""

    def __init__(self, vectors: np.ndarray):
        self.levels = []
        for count in segments(vectors.shape[1]):
            edges = np.linspace(0, vectors.shape[1], count + 1).astype(int)
            parts = []
            for a, b in zip(edges[:-1], edges[1:]):
                if b > a:
                    x = vectors[:, a:b].astype(np.float64)
                    parts += [x.mean(axis=1) * np.sqrt(b - a), x.std(axis=1) * np.sqrt(b - a)]
            self.levels.append(np.stack(parts, axis=1) if parts else np.zeros((len(vectors), 1)))


def best_of_block(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int,
                  floor: np.ndarray, left: Summaries, right: Summaries) -> tuple[np.ndarray, ...]:
    """Pairs (query row, vector row, score) that may be among the k best; `floor` is each query's
    k-th best score so far and is raised in place."""
    own = ids[None, :] == query_ids[:, None]
    # A first few candidates by a coarse bound give a floor before anything is pruned.
    seed_level = min(1, len(left.levels) - 1)
    coarse = left.levels[seed_level] @ right.levels[seed_level].T
    take = min(k + 1, len(ids))
    seeds = np.argpartition(-coarse, take - 1, axis=1)[:, :take]
    exact = np.where(np.take_along_axis(own, seeds, axis=1), np.iinfo(np.int64).min, np.einsum("qsd,qd->qs", vectors[seeds], queries))
    if take > k:
        np.maximum(floor, np.partition(exact, take - k, axis=1)[:, take - k], out=floor)
    least = floor.astype(np.float64)[:, None]
    least -= 1e-6 * (1 + np.abs(least))  # rounding of the bounds must not drop an equal score
    alive = ~own
    for a, b in zip(left.levels, right.levels):
        some = np.flatnonzero(alive.any(axis=0))
        bound = a @ b[some].T
        alive[:, some] &= bound + 1e-9 * np.abs(bound) >= least
    q, v = np.nonzero(alive)
    score = np.empty(len(q), np.int64)
    for at in range(0, len(q), 65536):
        part = slice(at, at + 65536)
        score[part] = np.einsum("pd,pd->p", queries[q[part]], vectors[v[part]])
    return q, v, score


def best(query: np.ndarray, vec_id: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k best of each query."""
    order = np.lexsort((vec_id, -score, query))
    query = query[order]
    first = np.searchsorted(query, query, side="left")
    return order[np.arange(len(query)) - first < k]


def _search(k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        summaries: dict[bytes, Summaries] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                dim, raw_q, raw_queries, raw_ids, raw_vectors = (batch.column(n)[row].as_py() for n in ("dim", "query_ids", "queries", "ids", "vectors"))
                query_ids, ids = np.frombuffer(raw_q, np.int64), np.frombuffer(raw_ids, np.int64)
                queries = np.frombuffer(raw_queries, np.int64).reshape(len(query_ids), dim)
                vectors = np.frombuffer(raw_vectors, np.int64).reshape(len(ids), dim)
                name = raw_q + raw_queries[:64]
                if name not in held:
                    none = np.zeros(0, np.int64)
                    held[name] = [query_ids, np.full(len(query_ids), np.iinfo(np.int64).min), none, none, none]
                    summaries[name] = Summaries(queries)
                state = held[name]
                q, v, score = best_of_block(queries, query_ids, vectors, ids, k, state[1], summaries[name], Summaries(vectors))
                q, v, score = np.concatenate([state[2], q]), np.concatenate([state[3], ids[v]]), np.concatenate([state[4], score])
                chosen = best(q, v, score, k)
                state[2:] = q[chosen], v[chosen], score[chosen]
                count = np.bincount(state[2], minlength=len(query_ids))
                full = np.flatnonzero(count >= k)
                state[1][full] = np.maximum(state[1][full], state[4][np.cumsum(count)[full] - 1])
        for query_ids, _, q, v, score in held.values():
            yield pa.RecordBatch.from_arrays([pa.array(query_ids[q]), pa.array(v), pa.array(score)], names=["query_id", "vec_id", "score"])

    return search


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k highest inner products of each query with every other vector."""
    spark = bounded_batches(vectors.sparkSession)

    def usable(df: DataFrame) -> DataFrame:
        component = lambda x: F.floor(x.cast("double") * scale).cast("long")
        finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
        return df.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & F.forall(vector, finite)).select(
            F.col(vec_id).cast("long").alias("id"), F.transform(vector, component).alias("vector"))

    block = "dim int, ids binary, vectors binary"
    staged = Staged(spark, "topk")
    stored = staged.write(usable(vectors).mapInArrow(_blocks(VECTOR_BLOCK), block), "vectors")
    asked = staged.write(usable(queries).mapInArrow(_blocks(QUERY_BLOCK), block).select(
        F.col("dim").alias("query_dim"), F.col("ids").alias("query_ids"), F.col("vectors").alias("queries")), "queries")
    # Every block of queries against every block of vectors: the stated query set against all rows.
    found = stored.crossJoin(asked).where("dim = query_dim").mapInArrow(_search(k), "query_id long, vec_id long, score long")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked).cast("int")).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def op4_topk(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % EVERY == 0))
