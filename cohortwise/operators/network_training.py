"""Training of dense networks by synchronous data-parallel mini-batch optimisation (M1, M2).

The training rows are shuffled once into blocks of `batch` rows, packed, and the blocks dealt to the steps
of an epoch. A step is one job over its blocks: each task runs its blocks forwards and backwards and sends
one vector, the vectors are added level by level, and the driver, which holds the parameters, takes one
step of Adam. A step's rows are `rows / steps` whatever the size of the table, so an epoch costs the same
number of jobs at any scale, and a step's gradient is the mean over all of its rows.

Batch normalisation takes its statistics from each block, so no layer waits for another task. Dropout masks
come from the seed of epoch, step and block, so a task that runs again draws the same. The state after each
epoch is written to `folder`, if one is named; a run that finds states there goes on from the last one.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .features import category_sql, filled_sql
from ..functions import sql_text
from .model import Layer, RiskModel
from .scoring import scaled_sql
from .staging import release, stage

FAN = 32  # vectors one task adds up
VALIDATION_STEP = -1


@dataclass(frozen=True)
class Dense:
    """A hidden layer: units, activation, dropout after it, batch normalisation before the dropout."""

    units: int
    activation: str = "leaky_relu"
    dropout: float = 0.0
    normalise: bool = False
    slope: float = 0.3


@dataclass(frozen=True)
class Training:
    """How a network is trained. Defaults are those of the individual network."""

    hidden: tuple[Dense, ...] = (Dense(1024, dropout=0.5), Dense(256, dropout=0.4), Dense(128, dropout=0.3))
    penalty: float = 1e-3  # of the squared weights of hidden layers
    rate: float = 1e-3
    epochs: int = 400
    steps: int = 16  # per epoch
    batch: int = 32  # rows of a block
    patience: int = 20  # epochs without a lower validation loss before the end
    rate_patience: int = 10  # and before the rate is halved
    least_rate: float = 1e-6
    validation: float = 0.1  # share of the training rows held back
    momentum: float = 0.99  # of the moving statistics
    seed: int = 42
    folder: str | None = None


# The population network.
POPULATION_TRAINING = Training(
    hidden=(Dense(128, "relu", 0.4, True), Dense(64, "relu", 0.3), Dense(32, "relu")),
    penalty=0.0, epochs=500, batch=64, patience=30, rate_patience=15, least_rate=1e-7,
)
EPSILON = 1e-3  # of the normalisation's variance


@dataclass
class Rows:
    """A block: scaled numbers, first-layer row of every category (-1 for none), targets."""

    numbers: np.ndarray
    places: np.ndarray
    target: np.ndarray


class Network:
    """Parameters of a network as one vector, and its passes over a block."""

    def __init__(self, n_inputs: int, training: Training):
        self.training = training
        self.layers = [*training.hidden, Dense(1, "linear")]
        self.shapes: list[tuple[int, ...]] = []
        width = n_inputs
        for layer in self.layers:
            self.shapes += [(width, layer.units), (layer.units,)]
            if layer.normalise:
                self.shapes += [(layer.units,), (layer.units,)]
            width = layer.units
        self.size = sum(int(np.prod(s)) for s in self.shapes)
        self.n_moving = 2 * sum(layer.units for layer in self.layers if layer.normalise)

    def start(self) -> tuple[np.ndarray, np.ndarray]:
        """Uniform weights by the layers' widths, no bias, normalisations that change nothing."""
        rng = np.random.Generator(np.random.PCG64(self.training.seed))
        parts, moving = [], []
        at = iter(self.shapes)
        for layer in self.layers:
            rows, columns = next(at)
            reach = np.sqrt(6 / (rows + columns))
            parts += [rng.uniform(-reach, reach, rows * columns), np.zeros(*next(at))]
            if layer.normalise:
                parts += [np.ones(*next(at)), np.zeros(*next(at))]
                moving += [np.zeros(layer.units), np.ones(layer.units)]
        return np.concatenate(parts), np.concatenate([*moving, np.zeros(0)])

    def split(self, vector: np.ndarray) -> list[list[np.ndarray]]:
        """Views of the vector per layer: weights, bias, and scale and shift where there are some."""
        out, at, shapes = [], 0, iter(self.shapes)
        for layer in self.layers:
            parts = []
            for _ in range(4 if layer.normalise else 2):
                shape = next(shapes)
                n = int(np.prod(shape))
                parts.append(vector[at : at + n].reshape(shape))
                at += n
            out.append(parts)
        return out

    def penalty(self, vector: np.ndarray) -> tuple[float, np.ndarray]:
        """The penalty of the hidden layers' weights and its gradient."""
        gradient, total = np.zeros_like(vector), 0.0
        for own, into in list(zip(self.split(vector), self.split(gradient)))[:-1]:
            total += self.training.penalty * float((own[0] ** 2).sum())
            into[0][:] = 2 * self.training.penalty * own[0]
        return total, gradient

    def first(self, rows: Rows, weights: np.ndarray) -> np.ndarray:
        """Inputs times first-layer weights; a category is a row of the weights."""
        n = rows.numbers.shape[1]
        out = rows.numbers @ weights[:n]
        for place in rows.places.T:
            known = place >= 0
            out[known] += weights[place[known]]
        return out

    def activate(self, layer: Dense, signal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The activation and its slope."""
        if layer.activation == "linear":
            return signal, np.ones_like(signal)
        below = 0.0 if layer.activation == "relu" else layer.slope
        slope = np.where(signal >= 0, 1.0, below)
        return signal * slope, slope

    def predict(self, rows: Rows, vector: np.ndarray, moving: np.ndarray) -> np.ndarray:
        """Predictions with the moving statistics and without dropout."""
        signal, at = None, 0
        for k, (layer, parts) in enumerate(zip(self.layers, self.split(vector))):
            signal = (self.first(rows, parts[0]) if k == 0 else signal @ parts[0]) + parts[1]
            signal, _ = self.activate(layer, signal)
            if layer.normalise:
                mean, variance = moving[at : at + layer.units], moving[at + layer.units : at + 2 * layer.units]
                signal = (signal - mean) / np.sqrt(variance + EPSILON) * parts[2] + parts[3]
                at += 2 * layer.units
        return signal[:, 0]

    def gradient(self, rows: Rows, vector: np.ndarray, rng: np.random.Generator | None) -> tuple[float, np.ndarray, np.ndarray]:
        """Sum of squared errors of a block, its gradient, and the block's statistics; no dropout without
        a generator."""
        parts, kept, statistics = self.split(vector), [], []
        signal = None
        for k, (layer, own) in enumerate(zip(self.layers, parts)):
            before = signal
            raw = (self.first(rows, own[0]) if k == 0 else signal @ own[0]) + own[1]
            signal, slope = self.activate(layer, raw)
            normal = spread = mask = None
            if layer.normalise:
                mean, variance = signal.mean(axis=0), signal.var(axis=0)
                statistics += [mean, variance]
                spread = np.sqrt(variance + EPSILON)
                normal = (signal - mean) / spread
                signal = normal * own[2] + own[3]
            if layer.dropout and rng is not None:
                mask = (rng.random(signal.shape) >= layer.dropout) / (1 - layer.dropout)
                signal = signal * mask
            kept.append((before, slope, normal, spread, mask))
        error = signal[:, 0] - rows.target
        out = np.zeros(self.size)
        into = self.split(out)
        delta = 2 * error[:, None]
        for k in range(len(parts) - 1, -1, -1):
            before, slope, normal, spread, mask = kept[k]
            if mask is not None:
                delta = delta * mask
            if normal is not None:
                into[k][2][:] = (delta * normal).sum(axis=0)
                into[k][3][:] = delta.sum(axis=0)
                delta = delta * parts[k][2]
                delta = (delta - delta.mean(axis=0) - normal * (delta * normal).mean(axis=0)) / spread
            delta = delta * slope
            into[k][1][:] = delta.sum(axis=0)
            if k:
                into[k][0][:] = before.T @ delta
                delta = delta @ parts[k][0].T
            else:
                n = rows.numbers.shape[1]
                into[0][0][:n] = rows.numbers.T @ delta
                for place in rows.places.T:
                    known = place >= 0
                    np.add.at(into[0][0], place[known], delta[known])
        return float((error**2).sum()), out, np.concatenate([*statistics, np.zeros(0)])

    def result(self, vector: np.ndarray, moving: np.ndarray) -> tuple[Layer, ...]:
        """The layers of a model, each normalisation folded into two vectors."""
        out, at = [], 0
        for layer, parts in zip(self.layers, self.split(vector)):
            scale = shift = None
            if layer.normalise:
                mean, variance = moving[at : at + layer.units], moving[at + layer.units : at + 2 * layer.units]
                scale = parts[2] / np.sqrt(variance + EPSILON)
                shift = parts[3] - mean * scale
                at += 2 * layer.units
            out.append(Layer(parts[0].copy(), parts[1].copy(), layer.activation, scale, shift, layer.slope))
        return tuple(out)


# Blocks and sums ----------------------------------------------------------------------------------


def packed_blocks(rows: DataFrame, prepared: RiskModel, target: str, training: Training) -> DataFrame:
    """The rows as (step, block, n, numbers, places, target), staged; step -1 is for validation.

    Rows come into an order of hashes of their numbers in the table, which spreads equal rows, and are cut
    into blocks as they come; a partition's last block may be smaller, or larger by a single row, as one row
    has no spread to normalise by.
    """
    spec, offsets = prepared.spec, prepared.category_offsets()
    numbers = [F.expr(scaled_sql(prepared, c, filled_sql(c, sql_text.number(prepared.means[c])))).cast("double").alias(f"n{i}") for i, c in enumerate(spec.numeric)]
    texts = [F.expr(category_sql(rows, spec, c)).alias(f"c{i}") for i, c in enumerate(spec.categorical)]
    key = F.xxhash64(F.lit(training.seed), F.monotonically_increasing_id())
    wanted = rows.select(*numbers, *texts, F.col(target).cast("double").alias("y"), key.alias("key"))
    held = F.pmod(F.xxhash64(F.lit("validation"), "key"), F.lit(1 << 20)) < int(training.validation * (1 << 20))
    wanted = wanted.withColumn("held", held).repartition("key").sortWithinPartitions("held", "key").drop("key")
    n_numeric, columns = len(spec.numeric), list(spec.categorical)
    values = [pd.Index(list(prepared.categories[c])) for c in columns]
    starts = [offsets[c] for c in columns]
    steps, batch = training.steps, training.batch

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held: dict[bool, list[pa.RecordBatch]] = {False: [], True: []}
        count = {False: 0, True: 0}

        def take(kind: bool, last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal made
            frame = pa.Table.from_batches(held[kind])
            n = len(frame) if last else max(0, len(frame) - 1) // batch * batch
            edges = list(range(0, n, batch)) + [n]
            if len(edges) > 2 and edges[-1] - edges[-2] == 1:
                del edges[-2]
            x = np.stack([frame[f"n{i}"].to_numpy() for i in range(n_numeric)], axis=1) if n_numeric else np.zeros((len(frame), 0))
            codes = [index.get_indexer(frame[f"c{i}"].to_pandas()) if len(index) else np.full(len(frame), -1) for i, index in enumerate(values)]
            places = np.stack([np.where(c >= 0, c + s, -1) for c, s in zip(codes, starts)], axis=1) if codes else np.zeros((len(frame), 0), np.int64)
            y = frame["y"].to_numpy()
            for i, j in zip(edges, edges[1:]):
                if j > i:
                    # Consecutive blocks of all partitions go to consecutive steps.
                    step = VALIDATION_STEP if kind else (made + part) % steps
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([step], pa.int32()), pa.array([(part << 32) + made], pa.int64()), pa.array([j - i], pa.int32()),
                         *(pa.array([v[i:j].astype(t).tobytes()], pa.binary()) for v, t in ((x, "<f8"), (places, "<i4"), (y, "<f8")))],
                        names=["step", "block", "n", "numbers", "places", "target"])
                    made += 1
            rest = frame.slice(n)
            held[kind], count[kind] = rest.to_batches() if len(rest) else [], len(rest)

        for rows_ in batches:
            flags = rows_.column("held")
            for kind in (False, True):
                own = rows_.filter(flags if kind else pa.compute.invert(flags))
                if own.num_rows:
                    held[kind].append(own)
                    count[kind] += own.num_rows
                if count[kind] > 64 * batch:
                    yield from take(kind, False)
        for kind in (False, True):
            if count[kind]:
                yield from take(kind, True)

    blocks = wanted.mapInArrow(cut, "step int, block long, n int, numbers binary, places binary, target binary")
    return stage(blocks, "network-blocks", by="step")


def read_rows(batch: pa.RecordBatch, n_numeric: int) -> Iterator[tuple[int, Rows]]:
    for row in batch.to_pylist():
        n = row["n"]
        yield row["block"], Rows(np.frombuffer(row["numbers"], "<f8").reshape(n, n_numeric), np.frombuffer(row["places"], "<i4").reshape(n, -1),
                                 np.frombuffer(row["target"], "<f8"))


def summed(blocks: DataFrame, of_block: Callable[[int, Rows], np.ndarray], size: int, n_numeric: int) -> np.ndarray:
    """The sum of a vector per block; every task sends one, and at most FAN of them are added in a task."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size)
        for batch in batches:
            for number, rows in read_rows(batch, n_numeric):
                out += of_block(number, rows)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([out.tobytes()], pa.binary())], names=["part", "sums"])

    def join(parts: pa.Table) -> pa.Table:
        out = np.zeros(size)
        for value in parts["sums"].to_pylist():
            out += np.frombuffer(value)
        return pa.table([parts["part"].slice(0, 1), pa.array([out.tobytes()], pa.binary())], names=["part", "sums"])

    sums = blocks.mapInArrow(add, "part long, sums binary")
    tasks = blocks.rdd.getNumPartitions()
    while tasks > FAN:
        sums = sums.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("part").applyInArrow(join, "part long, sums binary")
        tasks = -(-tasks // FAN)
    # Added in the order of the partitions, so that a run can be repeated to the last digit.
    found = sorted((r["part"], r["sums"]) for r in sums.collect())
    return sum((np.frombuffer(v) for _, v in found), np.zeros(size))


# Training -----------------------------------------------------------------------------------------


@dataclass
class State:
    """All that a run needs to go on."""

    vector: np.ndarray
    moving: np.ndarray
    first: np.ndarray
    second: np.ndarray
    rate: float
    step: int = 0
    epoch: int = 0
    best: float = float("inf")
    best_vector: np.ndarray | None = None
    best_moving: np.ndarray | None = None
    since_best: int = 0
    since_rate: int = 0
    curves: list[tuple[int, float, float, float]] = field(default_factory=list)

    _ARRAYS = ("vector", "moving", "first", "second", "best_vector", "best_moving")

    def save(self, spark: SparkSession, folder: str) -> None:
        numbers = json.dumps({k: getattr(self, k) for k in ("rate", "step", "epoch", "best", "since_best", "since_rate", "curves")})
        rows = [("numbers", numbers.encode())] + [(k, getattr(self, k).tobytes()) for k in self._ARRAYS if getattr(self, k) is not None]
        spark.createDataFrame(rows, "name string, value binary").coalesce(1).write.mode("overwrite").parquet(f"{folder}/epoch-{self.epoch:06d}")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> State | None:
        pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/epoch-*/_SUCCESS")
        found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
        paths = sorted(f.getPath().getParent().toString() for f in found or [])
        if not paths:
            return None
        values = {r["name"]: bytes(r["value"]) for r in spark.read.schema("name string, value binary").parquet(paths[-1]).collect()}
        numbers = json.loads(values.pop("numbers"))
        numbers["curves"] = [tuple(c) for c in numbers["curves"]]
        arrays = {k: np.frombuffer(v).copy() for k, v in values.items()}
        return cls(**arrays, **numbers)


@dataclass
class Trained:
    layers: tuple[Layer, ...]
    curves: list[tuple[int, float, float, float]]  # epoch, rate, training loss, validation loss

    def curve_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.curves, "epoch int, rate double, loss double, validation_loss double")


def adam(state: State, gradient: np.ndarray) -> None:
    state.step += 1
    state.first = 0.9 * state.first + 0.1 * gradient
    state.second = 0.999 * state.second + 0.001 * gradient**2
    rate = state.rate * np.sqrt(1 - 0.999**state.step) / (1 - 0.9**state.step)
    state.vector = state.vector - rate * state.first / (np.sqrt(state.second) + 1e-7)


def after_epoch(state: State, training: Training, loss: float, validation: float) -> None:
    """Keeps the best parameters, counts epochs without a better one, halves the rate."""
    state.epoch += 1
    state.curves.append((state.epoch, state.rate, loss, validation))
    if validation < state.best:
        state.best, state.best_vector, state.best_moving = validation, state.vector.copy(), state.moving.copy()
        state.since_best = state.since_rate = 0
        return
    state.since_best += 1
    state.since_rate += 1
    if state.since_rate >= training.rate_patience:
        state.rate, state.since_rate = max(state.rate / 2, training.least_rate), 0


def train_network(rows: DataFrame, prepared: RiskModel, target: str, training: Training = Training()) -> Trained:
    """A network fitted to the prepared rows; its best layers by validation loss, and the curves.

    Without a row held back for validation the training loss decides. No rows are an error.
    """
    spark = rows.sparkSession
    network = Network(len(prepared.feature_names), training)
    n_numeric = len(prepared.spec.numeric)
    blocks = packed_blocks(rows, prepared, target, training)
    try:
        sizes = {r["step"]: r["n"] for r in blocks.groupBy("step").agg(F.sum("n").alias("n")).collect()}
        steps = sorted(s for s in sizes if s != VALIDATION_STEP)
        if not steps:
            raise ValueError("no training rows")
        state = State.load(spark, training.folder) if training.folder else None
        if state is None:
            vector, moving = network.start()
            state = State(vector, moving, np.zeros(network.size), np.zeros(network.size), training.rate)
        while state.epoch < training.epochs and state.since_best < training.patience:
            squares = 0.0
            for step in steps:
                shared = spark.sparkContext.broadcast(state.vector)
                seed = (training.seed, state.epoch, step)

                def of_block(number: int, block: Rows) -> np.ndarray:
                    rng = np.random.Generator(np.random.PCG64([*seed, number >> 32, number & 0xFFFFFFFF]))  # noqa: B023
                    error, gradient, statistics = network.gradient(block, shared.value, rng)  # noqa: B023
                    n = len(block.target)
                    return np.concatenate([gradient, statistics * n, [error, n]])

                sums = summed(blocks.where(F.col("step") == step), of_block, network.size + network.n_moving + 2, n_numeric)
                shared.unpersist()
                n, error = sums[-1], sums[-2]
                squares += error
                adam(state, sums[: network.size] / n + network.penalty(state.vector)[1])
                statistics = sums[network.size : -2] / n
                state.moving = training.momentum * state.moving + (1 - training.momentum) * statistics
            penalty = network.penalty(state.vector)[0]
            loss = squares / sum(sizes[s] for s in steps) + penalty
            validation = loss
            if VALIDATION_STEP in sizes:
                shared = spark.sparkContext.broadcast((state.vector, state.moving))

                def of_held(number: int, block: Rows) -> np.ndarray:
                    return np.array([((network.predict(block, *shared.value) - block.target) ** 2).sum()])  # noqa: B023

                validation = summed(blocks.where(F.col("step") == VALIDATION_STEP), of_held, 1, n_numeric)[0] / sizes[VALIDATION_STEP] + penalty
                shared.unpersist()
            after_epoch(state, training, float(loss), float(validation))
            if training.folder:
                state.save(spark, training.folder)
    finally:
        release(blocks)
    return Trained(network.result(state.best_vector, state.best_moving), state.curves)


def network_trainer(training: Training = Training(), curves: list | None = None):
    """The `trainer` of `fit_risk_model` and `fit_population_model`; appends the curves to `curves`."""

    def trainer(rows: DataFrame, prepared: RiskModel, target: str) -> tuple[Layer, ...]:
        trained = train_network(rows, prepared, target, training)
        if curves is not None:
            curves.extend(trained.curves)
        return trained.layers

    return trainer
