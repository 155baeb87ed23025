"""Candidate pairs from shared keys, components of links.

Rows that share a key are candidates. The keys of a task are grouped where they are made: of all rows
with one key the smallest id stands for the others, so that a key which a third of all rows share
leaves each task once. Keys travel packed, a range of hash values per bucket and 32 bits within it (keys
that agree in those only add candidates), and every bucket joins the representatives of all tasks the same
way. Where the sizes of the sets are known, the rows of a key are first parted wherever two sizes next to each other
are too far apart for similar sets: no similar pair is parted, and each part is a key of its own. The candidates of a key are thus a star of stars: one
pair per row instead of all pairs. If every pair of a key ends in one component, so do all its rows, and
no other pair of that key matters; `link_all` goes on with the keys where this fails, so no link is
lost.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .shared import SKETCHES, Staged, may_be_similar, release

FLUSH = 1 << 21
BUCKET_KEYS = 1 << 20
PACKED = "bucket int, head_key binary, head_id binary, low binary, span binary, head binary, member binary"
FOREST_EDGES = 1 << 18
LEVELS = 64  # levels of set sizes in the ratio that a similarity allows
LEVEL_GAP = LEVELS + 2  # one for cutting to whole levels, one for rounding
EARLIER = 8  # elements before it that each element of a prefix is kept with


def _runs(key: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by key and `low`, and the number of each row's run in that order: rows of one key whose
    ranges of levels are at most LEVEL_GAP apart, directly or through others between them."""
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    several = ~new
    several[:-1] |= ~new[1:]
    several = np.flatnonzero(several)  # rows of keys with more rows than one: few, so the rest is not sorted again
    of = order[several]
    by_level = np.lexsort((low[of], key[several]))
    of = order[several] = of[by_level]
    first = new[several]
    span = np.cumsum(first) * (1 << 20)  # beyond all levels, so the highest level so far starts afresh with each key
    top = np.maximum.accumulate(high[of] + span)
    first[1:] |= low[of[1:]] + span[1:] > top[:-1] + LEVEL_GAP
    new[several] = first
    return order, np.cumsum(new) - 1


def _stars(key: np.ndarray, id_: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each run its key, smallest id, lowest and highest level; the other distinct rows as (run, id); each row's run."""
    order, run = _runs(key, low, high)
    starts = np.flatnonzero(np.diff(run, prepend=-1))
    sorted_id = id_[order]
    head = np.minimum.reduceat(sorted_id, starts) if len(starts) else sorted_id
    others = np.flatnonzero(sorted_id != head[run])
    others = others[np.lexsort((sorted_id[others], run[others]))]
    of, member = run[others], sorted_id[others]
    again = np.zeros(len(of), bool)
    again[1:] = (of[1:] == of[:-1]) & (member[1:] == member[:-1])
    bounds = (f.reduceat(c[order], starts) if len(starts) else c for f, c in ((np.minimum, low), (np.maximum, high)))
    run_of = np.empty(len(key), np.int64)
    run_of[order] = run
    return key[order[starts]], head, *bounds, of[~again], member[~again], run_of


def size_levels(sizes: np.ndarray, percent: int) -> np.ndarray:
    """Levels of set sizes such that sets of a Jaccard similarity of `percent` are at most LEVEL_GAP apart."""
    return np.floor(np.log(np.maximum(sizes, 1)) * (LEVELS / max(math.log(100 / percent), 0.05))).astype(np.int64)


def pairs_by_key(rows: DataFrame, keys_of: Callable[[pa.RecordBatch], tuple[np.ndarray, ...]], n_keys: int) -> DataFrame:
    """(key, ref, member) for all keys that several ids share; `n_keys`, how many keys there are
    about, fixes the number of buckets. `keys_of` gives hashed uint64 keys and int64 ids of a batch, and may
    give the `size_levels` of the ids' sets: a hashed key then falls apart into keys whose rows are close in size."""
    bits = min(31, max(0, n_keys - 1).bit_length() - BUCKET_KEYS.bit_length() + 1) if n_keys > BUCKET_KEYS else 0
    buckets = 1 << bits

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate(c) for c in zip(*held)]
            held.clear()
            keys, ids, level = columns if len(columns) == 3 else (*columns, np.zeros(len(columns[0]), np.int64))
            head_key, head_id, low, high, of, member, _ = _stars(keys >> np.uint64(32 - bits), ids, level, level)
            # Keys are sorted, and a bucket is a range of keys.
            edges = np.arange(1, buckets, dtype=np.uint64) << np.uint64(32)
            of_head = [0, *np.searchsorted(head_key, edges).tolist(), len(head_key)]
            of_rest = np.searchsorted(of, of_head).tolist()
            for b in range(buckets):
                h, r = slice(of_head[b], of_head[b + 1]), slice(of_rest[b], of_rest[b + 1])
                if h.stop > h.start:
                    parts = (head_key[h].astype(np.uint32), head_id[h], low[h].astype(np.uint16), (high[h] - low[h]).astype(np.uint16),
                             (of[r] - h.start).astype(np.uint32), member[r])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([b], pa.int32()), *(pa.array([p.tobytes()], pa.binary()) for p in parts)],
                        names=["bucket", "head_key", "head_id", "low", "span", "head", "member"])

        for batch in batches:
            held.append(keys_of(batch))
            if sum(len(c[0]) for c in held) >= FLUSH:
                yield from flush()
        if held:
            yield from flush()

    def receive(parts: pa.Table) -> pa.Table:
        read = lambda name, kind: np.frombuffer(b"".join(parts[name].to_pylist()), kind)
        head_id, member, low = read("head_id", np.int64), read("member", np.int64), read("low", np.uint16).astype(np.int64)
        _, first, _, _, of, others, run = _stars(read("head_key", np.uint32), head_id, low, low + read("span", np.uint16))
        # Other rows of a task name their head by its place in the row of `parts` they came with.
        heads, rest = (np.array([len(p) for p in parts[n].to_pylist()], np.int64) // width for n, width in (("head_key", 4), ("head", 4)))
        head = read("head", np.uint32) + np.repeat(np.cumsum(heads) - heads, rest)
        columns = [np.concatenate(c) for c in ((of, run[head]), (first[of], head_id[head]), (others, member))]
        columns[0] = columns[0] + (parts["bucket"][0].as_py() << 32 if len(parts) else 0)
        return pa.table([pa.array(c) for c in columns], names=["key", "ref", "member"])

    return rows.mapInArrow(send, PACKED).groupBy("bucket").applyInArrow(receive, "key long, ref long, member long")


def distinct_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs a < b, each once."""
    return pairs.select(F.least("ref", "member").alias("a"), F.greatest("ref", "member").alias("b")).where("a < b").distinct()


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, id, component) of all rows of the keys whose rows lie in several components.

    `members` is a staged table (key, id), `labels` has (node, component) for nodes with a link.
    """
    named = members.join(labels, members["id"] == labels["node"], "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    open_ = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    return named.join(open_.select("key"), "key", "left_semi")


def _possible(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose set sizes and sketches allow the similarity."""
    side = lambda n: sketches.select(F.col("id").alias(n), *[F.col(c).alias(f"{n}_{c}") for c in ("size", *SKETCHES)])
    return pairs.join(side("a"), "a").join(side("b"), "b").where(may_be_similar(percent, "a_", "b_")).select("a", "b")


def _centres(members: DataFrame) -> DataFrame:
    """(key, id, component): of each key's rows but the first, the one in most open keys, of equal ones that which
    meets most rows there."""
    met = members.groupBy("key").agg(F.count("*").alias("met"), F.min("id").alias("first"))
    members = members.join(met, "key")
    degree = members.groupBy("id").agg(F.struct(F.count("*").alias("keys"), F.sum("met").alias("met")).alias("degree"))
    best = members.where("id != first").join(degree, "id").groupBy("key").agg(F.max(F.struct("degree", "id", "component")).alias("best"))
    return best.select("key", F.col("best.id").alias("centre"), F.col("best.component").alias("centre_component"))


def _prefixes(elements: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """(id, element, earlier): of each set's elements the rarest ones, of which similar sets have one in common at
    least, each with those just before it.

    A set of s elements shares at least t * s of them with any set of similarity t, so the first of these in
    one order of all elements is among its first s - t * s + 1. Elements of one set alone come first
    in an order by rarity; they meet nothing and are counted only."""
    met = elements.groupBy("element").agg(F.count("*").alias("met")).where("met > 1")
    order = Window.partitionBy("id").orderBy("met", "element")
    shared = elements.join(met, "element").withColumn("rank", F.row_number().over(order))
    shared = shared.withColumn("earlier", F.collect_list("element").over(order.rowsBetween(-EARLIER, -1))).join(sketches.select("id", "size"), "id")
    counted = F.count("*").over(Window.partitionBy("id"))
    near = shared.withColumn("shared", counted).where(F.expr(f"rank <= shared - (size * {percent} + 99) div 100 + 1"))
    return near.select("id", "element", "earlier")


def _met(able: DataFrame, by: str, percent: int) -> DataFrame:
    """(a, b) of different components that have a value of `by` in common and may be similar.

    A pair of prefixes (with `earlier`) meets at the first element both have. It meets at a later one again only
    if the EARLIER elements before it are different ones in both, so near copies meet about once instead of at
    every element they share."""
    columns = ["id", "component", "size", *SKETCHES, *(["earlier"] if "earlier" in able.columns else [])]
    left, right = (able.select(by, *[F.col(c).alias(f"{n}_{c}") for c in columns]) for n in "ab")
    apart = (F.col("a_id") < F.col("b_id")) & (F.col("a_component") != F.col("b_component"))
    if "earlier" in able.columns:
        apart = apart & ~F.arrays_overlap("a_earlier", "b_earlier")
    return left.join(right, by).where(apart & may_be_similar(percent, "a_", "b_")).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))


def link_all(pairs: DataFrame, confirm: Callable[[DataFrame], DataFrame], second_centre: bool, percent: int,
             staged: Staged, sketches: DataFrame, elements: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """All links that decide components, and the components: (a, b) and (node, component).

    `pairs` has (key, ref, member). `sketches` has (id, size, sketch columns) of all sets; only pairs for
    which these allow the similarity go to `confirm`, which returns those that are similar.

    First the stars of all keys are confirmed. Where a key's rows stay in several components, with
    `second_centre` the row that is in most open keys becomes a second centre: of copies that were each
    changed a little it is the one closest to the others. For keys that are open even
    then, all pairs between components are looked at, and confirmed but for those that cannot be similar:
    two sets differ in as many elements as their sketches do in bits, which bounds their similarity. So a
    group of copies costs a few pairs per row, and no link is lost.

    With `elements`, which gives (id, element) of the sets of a table of ids, these pairs meet by the rare
    elements that similar sets share, see `_prefixes`, however many rows have a key in common. Without it they
    meet by the key, and the sketches of rows that share one without being similar are compared pair by
    pair, inside the join, a number that grows with the square of their group.
    """
    spark = pairs.sparkSession
    links = staged.write(confirm(_possible(distinct_pairs(pairs), sketches, percent)), "links")
    release(spark)
    labels = staged.write(components(links, staged), "labels")
    rows = pairs.select("key", F.col("ref").alias("id")).union(pairs.select("key", F.col("member").alias("id")))
    rows = staged.write(rows.distinct(), "rows")
    members = staged.write(_open(rows, labels), "open")
    release(spark)
    if members.isEmpty():
        return links, labels

    def grown(more: DataFrame) -> DataFrame:
        """The components with more links: those known are stars already."""
        stars = labels.where("node != component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        return staged.write(components(stars.union(more), staged), "labels")

    if second_centre:
        spokes = members.join(_centres(members), "key").where("component != centre_component")
        spokes = distinct_pairs(spokes.select(F.col("centre").alias("ref"), F.col("id").alias("member")))
        more = staged.write(confirm(_possible(spokes, sketches, percent)), "links")
        release(spark)
        if not more.isEmpty():
            links, labels = links.union(more), grown(more)
            members = staged.write(_open(members.select("key", "id"), labels), "members")
    if elements is None:
        able, by = members.join(sketches, "id"), "key"
    else:
        named = staged.write(members.select("id", "component").distinct(), "able")
        rare = _prefixes(staged.write(elements(named.select("id")), "elements"), sketches, percent)
        able, by = staged.write(rare.join(named, "id").join(sketches, "id"), "prefixes"), "element"
        release(spark)
    # Rows that are close share many keys; what is left is little, and each pair is confirmed once.
    rest = staged.write(_met(able, by, percent).distinct(), "rest")
    release(spark)
    if not rest.isEmpty():
        more = staged.write(confirm(rest), "links")
        if not more.isEmpty():
            links, labels = links.union(more), grown(more)
    return links, labels


# Union-find -----------------------------------------------------------------------------------


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the links of a task, a bounded number at a time: a link per node to its root."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def flush() -> pa.RecordBatch:
        links = [(x, r) for x in list(parent) if (r := find(x)) != x]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([r for _, r in links], pa.int64())], names=["u", "v"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) >= FOREST_EDGES:
            yield flush()
    yield flush()


def components(links: DataFrame, staged: Staged) -> DataFrame:
    """(node, component) of every node with a link, the component being its smallest node.

    Distributed union-find: every task first reduces its links to a forest; the forests are then
    merged by alternating two steps until all trees are stars. The large step hangs the larger
    neighbours of every node under its smallest neighbour, the small step does so with the smaller
    ones. Each round is written to the shared folder. Links have columns a and b.
    """
    forest = links.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(_forest, "u long, v long").distinct()
    edges = staged.write(forest, "forest")
    while not _stars_only(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = staged.write(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        small = staged.write(moved.union(least.select("u", F.col("m").alias("v"))).distinct(), "small")
        staged.drop(edges, large)
        edges = small
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _stars_only(edges: DataFrame) -> bool:
    """Whether every node hangs under one node, which hangs under none: per node, how often it is
    the lower end and whether it is an upper end. Edges lead from larger to smaller nodes."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("lower"), F.lit(0).alias("upper")).union(
        edges.select("v", F.lit(0), F.lit(1)))
    bad = ends.groupBy("node").agg(F.sum("lower").alias("lower"), F.max("upper").alias("upper")).where("lower > 1 or lower + upper > 1")
    return bad.isEmpty()
