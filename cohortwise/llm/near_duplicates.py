"""Near-duplicate documents: MinHash signatures and a multi-index Hamming join.

A document's set holds its distinct 5-word shingles. Its signature has SYMBOLS symbols of BITS bits,
the low bits of that many MinHash values. Two signatures differ in a symbol with a probability of one
minus the similarity of their sets, so for documents of at least the wanted similarity the number of
differing symbols, the signature distance, is binomial and stays below a threshold.

Index: signatures are split into CHUNKS chunks of CHUNK symbols. By the pigeonhole principle two
signatures at a distance below CHUNKS * (ERRORS + 1) agree in some chunk but for at most ERRORS
symbols. Those errors are enumerated: a chunk is filed once for each way of leaving ERRORS of its
symbols out. All pairs at a distance of at most MAX_DISTANCE = 19 of 50 are thus candidates, and so are
most pairs beyond it. Every candidate whose set sizes and parity sketches (see `shared.set_sketches`) allow
the similarity is confirmed on full sets, whatever its distance, so all that is missed are pairs that share no key at all: by the binomial model
a chance of 1.5e-8 at a similarity of 0.85 and of 1.6e-6 at 0.8, less above.

Documents with equal sets are one class before anything is compared, so that copies cost one row each.
Candidates of a key form stars, see `candidates`; where a key's rows stay in different components, all
pairs that can be similar are compared, so no link between different sets is lost. Shingles and classes are told apart by
64-bit hashes.

Words are runs of bytes other than ASCII white space, with A-Z lower-cased. Texts of fewer than five
words have one shingle, all their words; null, empty and blank texts have none and are linked with
nothing. Repeated rows are documents of their own in one class; a row with a null id takes part, and its
component is the smallest id that is not null, if there is one. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .candidates import link_all, pairs_by_key
from .shared import SKETCHES, WHITE, Staged, bounded_batches, forget, free_name, mix, pieces, ranges, set_sketches, table, utf8, words

SHINGLE = 5
PERCENT = 85
CHUNKS, CHUNK, ERRORS, BITS = 10, 5, 1, 16
SYMBOLS = CHUNKS * CHUNK
MAX_DISTANCE = CHUNKS * (ERRORS + 1) - 1
BROADCAST_ROWS = 1 << 18  # of 16 bytes

_seeds = np.random.Generator(np.random.PCG64(8191))
PLACES = _seeds.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SALTS = _seeds.integers(1, 1 << 63, SHINGLE + 1, dtype=np.uint64)
MULTIPLIERS = _seeds.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _seeds.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64)
KEY_SALTS = _seeds.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64)


def shingle_sets(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows, sorted within each row, and where each row's begin."""
    rows = len(at) - 1
    _, _, hashes, row = words(data, at, ~WHITE)
    n = np.bincount(row, minlength=rows)
    first = np.cumsum(n) - n
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, (n > 0).astype(np.int64))
    begin, owner = ranges(first, count), np.repeat(np.arange(rows), count)
    size = np.minimum(n, SHINGLE)[owner]
    out = SALTS[size]
    for k in range(SHINGLE):
        if (size > k).all():
            out = out + hashes[begin + k] * PLACES[k]
        else:
            has = size > k
            out[has] += hashes[begin[has] + k] * PLACES[k]
    out = mix(out)
    order = np.lexsort((out, owner))
    out, owner = out[order], owner[order]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    out = out[keep]
    return out, np.searchsorted(owner[keep], np.arange(rows + 1))


def class_ids(sets: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A hash of each whole set, below 2**63; -1 for empty sets."""
    total = np.zeros(len(sets) + 1, np.uint64)
    np.cumsum(sets, out=total[1:])
    other = np.zeros(len(sets) + 1, np.uint64)
    np.cumsum(mix(sets + np.uint64(1)), out=other[1:])
    size = np.diff(begin)
    value = mix((total[begin[1:]] - total[begin[:-1]]) ^ mix(other[begin[1:]] - other[begin[:-1]] + size.astype(np.uint64)))
    return np.where(size > 0, (value >> np.uint64(1)).astype(np.int64), -1)


def signatures(sets: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """MinHash symbols of each row's set, rows x SYMBOLS; rows without shingles have zeros."""
    full = np.flatnonzero(np.diff(begin) > 0)
    out = np.zeros((len(begin) - 1, SYMBOLS), np.uint16)
    if len(full):
        starts = begin[full]
        for k in range(SYMBOLS):
            least = np.minimum.reduceat((sets ^ OFFSETS[k]) * MULTIPLIERS[k], starts)
            out[full, k] = (mix(least) >> np.uint64(64 - BITS)).astype(np.uint16)
    return out


def index_keys(signature: np.ndarray) -> np.ndarray:
    """Rows x SYMBOLS keys: every chunk with each one of its symbols left out."""
    values = mix(signature.astype(np.uint64) + KEY_SALTS * np.uint64(1 << 16)).reshape(len(signature), CHUNKS, CHUNK)
    chunk = values.sum(axis=2, dtype=np.uint64, keepdims=True)
    return mix((chunk - values).reshape(len(signature), SYMBOLS) + KEY_SALTS)


def with_class(docs: DataFrame, text: str, name: str, more: bool = False) -> DataFrame:
    """The documents with their class and, with `more`, n_shingles, signature and sketch instead of the text."""
    kept = [c for c in docs.columns if not (more and c == text)]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for piece in pieces(batch, text):
                sets, begin = shingle_sets(*utf8(piece.column(text)))
                columns = [piece.column(c) for c in kept] + [pa.array(class_ids(sets, begin))]
                if more:
                    packed = [s.tobytes() for s in signatures(sets, begin)]
                    columns += [pa.array(np.diff(begin), pa.int64()), pa.array(packed, pa.binary()), *map(pa.array, set_sketches(sets, begin))]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, name, *(["n_shingles", "signature", *SKETCHES] if more else [])])

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept]
    return docs.mapInArrow(sign, ", ".join([*schema, f"`{name}` long", *(["n_shingles long", "signature binary", *(f"{s} long" for s in SKETCHES)] if more else [])]))


def _keys_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    signature = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(len(ids), SYMBOLS)
    return index_keys(signature).ravel(), np.repeat(ids, SYMBOLS)


def _similar(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("set_a"), batch.column("set_b")):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return confirm


def _sets(docs: DataFrame, doc_id: str, text: str, wanted: DataFrame) -> DataFrame:
    """Full sets of the wanted classes, a staged table (class, doc). Up to BROADCAST_ROWS of them are sent to
    every executor, so that the texts stay where they are; beyond that the join shuffles."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                sets, begin = shingle_sets(*utf8(piece.column("text")))
                right = np.flatnonzero(class_ids(sets, begin) == piece.column("class").to_numpy())
                yield pa.RecordBatch.from_arrays(
                    [piece.column("class").take(pa.array(right)), pa.array([sets[begin[r] : begin[r + 1]].tobytes() for r in right], pa.binary())],
                    names=["class", "shingles"])

    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    found = rows.join(wanted, rows["id"].eqNullSafe(wanted["doc"])).select("class", "text").mapInArrow(take, "class long, shingles binary")
    # Rows that repeat an id and a text would give a set twice.
    return found.dropDuplicates(["class"])


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k, shingles in enumerate(batch.column("shingles")):
            found = np.frombuffer(shingles.as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), batch.column("class")[k].as_py())), pa.array(found)], names=["id", "element"])


def _elements_of(sets: DataFrame, ids: DataFrame) -> DataFrame:
    return sets.join(ids, sets["class"] == ids["id"], "left_semi").select("class", "shingles").mapInArrow(_elements, "id long, element long")


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    side = lambda n: sets.select(F.col("class").alias(n), F.col("shingles").alias(f"set_{n}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_similar(percent), "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Per document (id, class, n_shingles, component, component_id, kept), and the links between
    classes. `component` is the smallest class of the component, null without shingles."""
    spark = bounded_batches(docs.sparkSession)
    staged = Staged(spark, "near-duplicates")
    rows = staged.write(with_class(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")), "text", "class", more=True), "signed")
    classes = staged.write(rows.where("class >= 0").groupBy("class").agg(
        F.min("id").alias("doc"), *(F.max(c).alias(c) for c in ("n_shingles", "signature", *SKETCHES))), "classes")
    sketches = classes.select(F.col("class").alias("id"), F.col("n_shingles").alias("size"), *SKETCHES)
    pairs = staged.write(pairs_by_key(classes.select("class", "signature"), _keys_of, classes.count() * SYMBOLS), "pairs")
    # The sets of all that share a key; every later step needs some of these.
    sharing = pairs.select(F.col("ref").alias("class")).union(pairs.select("member")).distinct()
    sets = staged.write(_sets(docs, doc_id, text, staged.write(classes.join(sharing, "class", "left_semi").select("class", "doc"), "wanted")), "sets")
    links, labels = link_all(pairs, lambda candidates: _links(candidates, sets, percent), True, percent, staged, sketches,
                             lambda ids: _elements_of(sets, ids))
    named = classes.join(labels, classes["class"] == labels["node"], "left").select(
        "class", "doc", F.coalesce("component", "class").alias("component"))
    first = named.groupBy("component").agg(F.min("doc").alias("component_id"))
    named = staged.write(named.join(first, "component").select("class", "component", "component_id"), "named")
    staged.drop(pairs, sets)
    lone = rows.where("class < 0").select("id", "class", "n_shingles", F.lit(None).cast("long").alias("component"), F.col("id").alias("component_id"))
    linked = rows.where("class >= 0").join(named, "class").select("id", "class", "n_shingles", "component", "component_id")
    out = lone.union(linked).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
    return out, links


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """The documents without all but one of each component; same columns. Documents without shingles
    stay; of rows that repeat the kept document, one stays."""
    found, _ = near_duplicates(docs, doc_id, text, percent)
    keepers = found.where("class >= 0 and kept").groupBy("component").agg(F.min("component_id").alias("keeper"), F.min("class").alias("keeper_class"))
    name = free_name(docs, "set_class")
    rows = with_class(docs, text, name)
    named = rows.where(F.col(name) >= 0)
    same = (named[name] == keepers["keeper_class"]) & named[doc_id].eqNullSafe(keepers["keeper"])
    kept = named.join(keepers, same, "left_semi").dropDuplicates([name, doc_id])
    return kept.union(rows.where(F.col(name) < 0)).select(*docs.columns)


def op6_near_duplicates(spark, sf_dir: str) -> DataFrame:
    found, _ = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")
