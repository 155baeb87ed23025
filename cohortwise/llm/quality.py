"""Quality classification by co-training of a content view and a metadata view.

Content view: how often each of CONTENT hashed byte trigrams occurs in a whole text. Metadata view: the
page's other columns (language, source, length): whole values hashed to METADATA indicators, an equal share
of them for each column; it never sees the text.
Each view is a ridge regression on the labels. In every round each view scores all documents without a
label; what it is confident about (calibrated probability of at least CONFIDENT for either class) becomes a
pseudo-label that the other view, not itself, learns from next, at weight PSEUDO. After the last round
both calibrated views are combined by a logistic model and score all documents.

Nothing is sampled: every pass covers all rows. Features are computed once and written to the shared
folder. A pass sends per task the sums a regression needs (matrices whose size depends on the view alone);
they are added up level by level, at most FAN of them in a task, and the driver solves systems of that
size. Of the labelled documents every fifth, by a hash of its id, is kept out of all fits and used to
calibrate; calibration reads histograms of scores, not rows.

A document's label is the majority of its rows in the label table, a draw counting as 1; null labels are
no labels. Null and empty texts have a content view without trigrams. Null metadata are a value of their
own. Rows that share a doc_id share its label and are scored each; rows without an id have no label. If
the labels hold one class only or none, all scores are the share of class 1 (0.5 without labels). An empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import Staged, bounded_batches, pieces, table, utf8

CONTENT, METADATA = 256, 1536
ROUNDS = 2
CONFIDENT = 0.95
PSEUDO = 0.3
RIDGE = 1e-3
FOLDS = 5
BINS = 64
FAN = 64
KEEP = 0.5


# Views ----------------------------------------------------------------------------------------


def content_features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Square roots of the shares of hashed trigrams, scaled to bytes; rows x CONTENT."""
    rows = len(at) - 1
    out = np.zeros((rows, CONTENT), np.uint8)
    if len(data) < 3:
        return out
    wide = data.astype(np.uint32)
    code = wide[:-2] | wide[1:-1] << np.uint32(8) | wide[2:] << np.uint32(16)
    bucket = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - (CONTENT - 1).bit_length())
    for row in range(rows):
        begin, end = at[row], at[row + 1] - 2
        if end > begin:
            count = np.bincount(bucket[begin:end], minlength=CONTENT)
            out[row] = np.minimum(255, np.sqrt(count / (end - begin)) * 512).astype(np.uint8)
    return out


def metadata_features(values: list[list[str]]) -> np.ndarray:
    """Hashed indicators of (column, value), rows x columns; each below METADATA, each column's in a
    block of its own."""
    block = METADATA // len(values)
    out = np.empty((len(values[0]), len(values)), np.uint16)
    for k, column in enumerate(values):
        place = {v: k * block + int.from_bytes(hashlib.blake2b(v.encode(), digest_size=8).digest(), "little") % block for v in set(column)}
        out[:, k] = [place[v] for v in column]
    return out


def content_matrix(packed: pa.Array) -> np.ndarray:
    raw = np.frombuffer(b"".join(packed.to_pylist()), np.uint8).reshape(-1, CONTENT)
    return np.concatenate([raw / 256.0, np.ones((len(raw), 1))], axis=1)


def metadata_places(packed: pa.Array) -> np.ndarray:
    """The indicators that are one in each row, the constant last."""
    n = len(packed)
    raw = np.frombuffer(b"".join(packed.to_pylist()), np.uint16).reshape(n, -1)
    return np.concatenate([raw.astype(np.int64), np.full((n, 1), METADATA)], axis=1)


def content_sums(packed: pa.Array, weight: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
    x = content_matrix(packed)
    weighted = x * weight[:, None]
    return [(weighted.T @ x).ravel(), weighted.T @ target]


def metadata_sums(packed: pa.Array, weight: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
    at, width = metadata_places(packed), METADATA + 1
    n = at.shape[1]
    both = (at[:, :, None] * width + at[:, None, :]).ravel()
    return [np.bincount(both, np.repeat(weight, n * n), width * width), np.bincount(at.ravel(), np.repeat(weight * target, n), width)]


SUMS = {"content": content_sums, "metadata": metadata_sums}
SCORE = {"content": lambda packed, w: content_matrix(packed) @ w, "metadata": lambda packed, w: w[metadata_places(packed)].sum(axis=1)}
WIDTH = {"content": CONTENT + 1, "metadata": METADATA + 1}


def features(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, metadata: tuple[str, ...], label_id: str, label: str, staged: Staged) -> DataFrame:
    """Per document (id, content, metadata, label, fold), written once."""
    length = F.coalesce(F.floor(F.log2(F.col(metadata[-1]).cast("double") + 1)).cast("string"), F.lit("none"))
    columns = [F.coalesce(F.col(c).cast("string"), F.lit("none")).alias(f"m{k}") for k, c in enumerate(metadata[:-1])]
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), *columns, length.alias(f"m{len(columns)}"))
    n_meta = len(metadata)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                content = content_features(*utf8(piece.column("text")))
                meta = metadata_features([piece.column(f"m{k}").to_pylist() for k in range(n_meta)])
                yield pa.RecordBatch.from_arrays(
                    [piece.column("id"), pa.array([r.tobytes() for r in content], pa.binary()), pa.array([r.tobytes() for r in meta], pa.binary())],
                    names=["id", "content", "metadata"])

    kind = rows.schema["id"].dataType.simpleString()
    built = rows.mapInArrow(build, f"id {kind}, content binary, metadata binary")
    known = labels.where(F.col(label).isNotNull()).groupBy(F.col(label_id).alias("label_id")).agg(
        (F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("label"))
    fold = F.pmod(F.xxhash64(F.lit("fold"), "id"), F.lit(FOLDS)).cast("int")
    return staged.write(built.join(known, F.col("id") == F.col("label_id"), "left").select(
        "id", "content", "metadata", "label", fold.alias("fold")), "features")


# Sums over all rows ---------------------------------------------------------------------------


def total(rows: DataFrame, of_batch: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The sum of `of_batch` over all batches. A task sends one vector; vectors are added in groups of
    at most FAN, level by level, so that no task holds more and the driver receives one. They travel
    packed, being mostly zeros where values are rare."""
    tasks = rows.rdd.getNumPartitions()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out = np.zeros(size)
        for batch in batches:
            out += of_batch(batch)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([zlib.compress(out.tobytes(), 1)], pa.binary())], names=["part", "sums"])

    def join(parts: pa.Table) -> pa.Table:
        out = np.zeros(size)
        for value in parts["sums"].to_pylist():
            out += np.frombuffer(zlib.decompress(value))
        return pa.table([pa.array([parts["part"][0].as_py()], pa.int64()), pa.array([zlib.compress(out.tobytes(), 1)], pa.binary())], names=["part", "sums"])

    sums = rows.mapInArrow(add, "part long, sums binary")
    while tasks > 1:
        sums = sums.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("part").applyInArrow(join, "part long, sums binary")
        tasks = -(-tasks // FAN)
    found = sums.collect()
    return sum((np.frombuffer(zlib.decompress(r["sums"])) for r in found), np.zeros(size))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 50) -> np.ndarray:
    """Weighted logistic regression by Newton steps, lightly shrunk."""
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(beta))
        step = np.linalg.solve(hessian, x.T @ (weight * (y - p)) - 1e-3 * beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return beta


def probability(score: np.ndarray, calibration: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(calibration[0] + calibration[1] * score, -30, 30)))


def _bin(score: np.ndarray) -> np.ndarray:
    return np.clip(((score + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)


CENTRES = (np.arange(BINS) + 0.5) / BINS * 2 - 0.5


def _read_labels(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    label = batch.column("label").fill_null(-1).to_numpy(zero_copy_only=False)
    held = batch.column("fold").to_numpy(zero_copy_only=False) == 0
    return label, (label >= 0) & ~held, (label >= 0) & held


class Views:
    """Weights and calibration of both views, and of their combination."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.weights = weights
        self.calibration = {v: np.array([0.0, 1.0]) for v in weights}
        self.combined = np.zeros(3)

    def scores(self, batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        return {v: SCORE[v](batch.column(v), w) for v, w in self.weights.items()}

    def probabilities(self, scores: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        return {v: probability(s, self.calibration[v]) for v, s in scores.items()}

    def together(self, p: dict[str, np.ndarray]) -> np.ndarray:
        x = logits(p)
        return 1 / (1 + np.exp(-np.clip(x @ self.combined, -30, 30)))


def logits(p: dict[str, np.ndarray]) -> np.ndarray:
    columns = [np.log(np.clip(p[v], 1e-6, 1 - 1e-6) / np.clip(1 - p[v], 1e-6, 1)) for v in sorted(p)]
    return np.stack([np.ones(len(columns[0])), *columns], axis=1)


def _fit(rows: DataFrame, views: Views | None) -> Views:
    """One pass: both regressions, each on the true labels and on what the other view is sure of."""
    widths = [WIDTH[v] for v in sorted(WIDTH)]

    def sums(batch: pa.RecordBatch) -> np.ndarray:
        label, train, _ = _read_labels(batch)
        target = {v: np.where(train, label, 0).astype(float) for v in WIDTH}
        weight = {v: train.astype(float) for v in WIDTH}
        if views is not None:
            p = views.probabilities(views.scores(batch))
            for view, other in (("content", "metadata"), ("metadata", "content")):
                for value, sure in ((1.0, p[other] >= CONFIDENT), (0.0, p[other] <= 1 - CONFIDENT)):
                    sure &= label < 0
                    target[view][sure], weight[view][sure] = value, PSEUDO
        out = []
        for view in sorted(WIDTH):
            out += SUMS[view](batch.column(view), weight[view], target[view])
        return np.concatenate(out)

    found = total(rows, sums, sum(w * w + w for w in widths))
    weights, at = {}, 0
    for view, width in zip(sorted(WIDTH), widths):
        gram, right = found[at : at + width * width].reshape(width, width), found[at + width * width : at + width * width + width]
        at += width * width + width
        shrink = RIDGE * max(1.0, np.trace(gram) / width) * np.eye(width)
        weights[view] = np.linalg.solve(gram + shrink, right)
    return Views(weights)


def _calibrate(rows: DataFrame, views: Views) -> None:
    """One pass over the labelled documents kept out of the fits: histograms of both scores."""
    order = sorted(WIDTH)

    def sums(batch: pa.RecordBatch) -> np.ndarray:
        label, _, held = _read_labels(batch)
        s = views.scores(batch)
        a, b = (_bin(s[v][held]) for v in order)
        return np.bincount((label[held] * BINS + a) * BINS + b, minlength=2 * BINS * BINS).astype(float)

    count = total(rows.where("label is not null and fold = 0"), sums, 2 * BINS * BINS).reshape(2, BINS, BINS)
    for axis, view in enumerate(order):
        by_score = count.sum(axis=2 - axis)
        x = np.tile(np.stack([np.ones(BINS), CENTRES], axis=1), (2, 1))
        views.calibration[view] = logistic(x, np.repeat([0.0, 1.0], BINS), by_score.ravel())
    a, b = np.meshgrid(CENTRES, CENTRES, indexing="ij")
    x = logits(views.probabilities({order[0]: a.ravel(), order[1]: b.ravel()}))
    views.combined = logistic(np.tile(x, (2, 1)), np.repeat([0.0, 1.0], BINS * BINS), count.ravel())


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", metadata: tuple[str, ...] = ("lang", "source", "n_chars"),
             label_id: str = "doc_id", label: str = "quality", rounds: int = ROUNDS) -> DataFrame:
    """Per document: doc_id, label (null if unknown), content_score, metadata_score, score, kept.

    The last of `metadata` is a number, taken by its order of magnitude.
    """
    staged = Staged(bounded_batches(docs.sparkSession), "quality")
    rows = features(docs, labels, doc_id, text, metadata, label_id, label, staged)
    seen = {r["label"]: r["n"] for r in rows.where("label is not null").groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(seen) < 2:
        share = F.lit(float(next(iter(seen), 0.5)))
        return rows.select(F.col("id").alias(doc_id), "label", *(share.alias(n) for n in ("content_score", "metadata_score", "score")), (share >= KEEP).alias("kept"))
    views = _fit(rows, None)
    _calibrate(rows, views)
    for _ in range(rounds):
        views = _fit(rows, views)
        _calibrate(rows, views)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = views.probabilities(views.scores(batch))
            both = views.together(p)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array(p["content"]), pa.array(p["metadata"]), pa.array(both), pa.array(both >= KEEP)],
                names=[doc_id, "label", "content_score", "metadata_score", "score", "kept"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(score, f"`{doc_id}` {kind}, label int, content_score double, metadata_score double, score double, kept boolean")


def op1_quality(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
