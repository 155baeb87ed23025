"""Gradients against differences, a run against one process, early stopping, going on after a loss."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortwise.operators import network_training as N
from cohortwise.operators.features import FeatureSpec
from cohortwise.operators.model import Layer, RiskModel
from cohortwise.operators.scoring import network_forward, score
from cohortwise.operators.training import fit_preparation, fit_risk_model

SPEC = FeatureSpec(("age", "bmi"), ("sex", "occupation"), "robust")
HIDDEN = (N.Dense(5, "leaky_relu", 0.2, True), N.Dense(3, "relu", 0.0), N.Dense(2, "linear", 0.1, True))


def block(n=17, seed=1, inputs=6):
    rng = np.random.Generator(np.random.PCG64(seed))
    return N.Rows(rng.normal(size=(n, 2)), np.stack([rng.integers(2, 4, n), np.where(rng.random(n) < 0.3, -1, rng.integers(4, inputs, n))], axis=1), rng.normal(size=n))


@pytest.mark.parametrize("hidden", [(), HIDDEN[:1], HIDDEN])
def test_gradients_against_differences(hidden):
    network = N.Network(6, N.Training(hidden=hidden, penalty=0.01))
    vector, _ = network.start()
    vector = vector + np.random.Generator(np.random.PCG64(2)).normal(size=len(vector)) * 0.1
    rows = block()
    rng = lambda: np.random.Generator(np.random.PCG64(5))

    def loss(v):
        return network.gradient(rows, v, rng())[0] + network.penalty(v)[0]

    found = network.gradient(rows, vector, rng())[1] + network.penalty(vector)[1]
    for k in range(len(vector)):
        move = np.zeros(len(vector))
        move[k] = 1e-6
        assert abs((loss(vector + move) - loss(vector - move)) / 2e-6 - found[k]) < 1e-4 * max(1, abs(found[k]))


def test_folded_normalisation_predicts_the_same():
    network = N.Network(6, N.Training(hidden=HIDDEN))
    vector, moving = network.start()
    moving = moving + np.random.Generator(np.random.PCG64(3)).random(len(moving))
    rows = block()
    model = RiskModel(SPEC, {c: 0.0 for c in SPEC.numeric}, {c: (0.0, 1.0) for c in SPEC.numeric}, {"sex": ["F", "M"], "occupation": ["a", "b"]}, network.result(vector, moving))
    codes = [np.where(p >= 0, p - at, -1) for p, at in zip(rows.places.T, (2, 4))]
    assert np.allclose(network_forward(model, rows.numbers, codes), network.predict(rows, vector, moving))


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.Generator(np.random.PCG64(9))
    rows = []
    for k in range(900):
        age, bmi = float(rng.integers(20, 80)), float(rng.normal(26, 4))
        sex, job = "FM"[k % 2], rng.choice(["x", "y", "z"])
        y = 0.01 * age + 0.05 * (bmi > 27) * (sex == "M") + 0.1 * (job == "z") + float(rng.normal(0, 0.01))
        rows.append((k, None if k % 50 == 0 else age, bmi, sex, None if k % 40 == 0 else str(job), y))
    return spark.createDataFrame(rows, "id long, age double, bmi double, sex string, occupation string, risk_score double")


def alone(blocks, network, training, epochs):
    """The same run in one process, from the same blocks."""
    state = N.State(*network.start(), np.zeros(network.size), np.zeros(network.size), training.rate)
    held = [b for s, _, b in blocks if s == N.VALIDATION_STEP]
    for epoch in range(epochs):
        squares = 0.0
        for step in sorted({s for s, _, _ in blocks} - {N.VALIDATION_STEP}):
            own = [(number, b) for s, number, b in blocks if s == step]
            total, n = np.zeros(network.size), sum(len(b.target) for _, b in own)
            statistics = np.zeros(network.n_moving)
            for number, b in own:
                rng = np.random.Generator(np.random.PCG64([training.seed, epoch, step, number >> 32, number & 0xFFFFFFFF]))
                error, gradient, found = network.gradient(b, state.vector, rng)
                squares, total, statistics = squares + error, total + gradient, statistics + found * len(b.target)
            N.adam(state, total / n + network.penalty(state.vector)[1])
            state.moving = training.momentum * state.moving + (1 - training.momentum) * statistics / n
        penalty = network.penalty(state.vector)[0]
        loss = squares / sum(len(b.target) for s, _, b in blocks if s != N.VALIDATION_STEP) + penalty
        wrong = sum(((network.predict(b, state.vector, state.moving) - b.target) ** 2).sum() for b in held)
        N.after_epoch(state, training, loss, wrong / sum(len(b.target) for b in held) + penalty)
    return state


SMALL = N.Training(hidden=(N.Dense(8, dropout=0.1, normalise=True), N.Dense(4)), epochs=3, steps=3, batch=16, rate=0.01, validation=0.2)


def test_run_against_one_process(spark, people, monkeypatch):
    monkeypatch.setattr(N, "FAN", 2)
    prepared = fit_preparation(people, SPEC)
    blocks = N.packed_blocks(people, prepared, "risk_score", SMALL)
    plain = [(r["step"], r["block"], b) for r in blocks.collect() for _, b in N.read_rows(
        __import__("pyarrow").RecordBatch.from_pylist([r.asDict()]), 2)]
    N.release(blocks)
    # Every row once, in blocks of the wanted size but for the last of a partition.
    assert sorted(y for _, _, b in plain for y in b.target) == sorted(r.risk_score for r in people.collect())
    assert max(len(b.target) for _, _, b in plain) <= SMALL.batch + 1 and {s for s, _, _ in plain} == {-1, 0, 1, 2}
    found = N.train_network(people, prepared, "risk_score", SMALL)
    wanted = alone(plain, N.Network(len(prepared.feature_names), SMALL), SMALL, 3)
    assert np.allclose(found.curves, wanted.curves, rtol=1e-9)
    assert found.curve_table(spark).count() == 3


def test_going_on_from_a_folder(spark, people, tmp_path):
    from dataclasses import replace

    prepared = fit_preparation(people, SPEC)
    whole = N.train_network(people, prepared, "risk_score", SMALL)
    part = replace(SMALL, folder=str(tmp_path), epochs=1)
    N.train_network(people, prepared, "risk_score", part)
    rest = N.train_network(people, prepared, "risk_score", replace(part, epochs=3))
    assert np.allclose(rest.curves, whole.curves, rtol=1e-9)
    assert all(np.allclose(a.weights, b.weights) for a, b in zip(rest.layers, whole.layers))


def test_early_stopping_and_rate():
    training = N.Training(patience=3, rate_patience=2, least_rate=0.3)
    state = N.State(np.zeros(1), np.zeros(0), np.zeros(1), np.zeros(1), 1.0)
    for k, value in enumerate([5, 4, 4, 6, 7]):
        state.vector = np.array([float(k)])
        N.after_epoch(state, training, 0.0, value)
    assert (state.best, state.best_vector[0], state.since_best, state.rate) == (4, 1.0, 3, 0.5)
    for _ in range(4):
        N.after_epoch(state, training, 0.0, 9)
    assert state.rate == 0.3 and state.epoch == 9


def test_fit_with_a_network(spark, people):
    curves = []
    training = N.Training(hidden=(N.Dense(16), N.Dense(8)), penalty=0.0, epochs=12, steps=4, batch=32, rate=0.02, patience=12)
    fitted = fit_risk_model(people, spec=SPEC, row_key=["id"], trainer=N.network_trainer(training, curves))
    spread = people.agg(F.var_pop("risk_score")).first()[0]
    assert len(curves) == 12 and fitted.test["mse"] < 0.3 * spread
    assert score(fitted.rows, fitted.model).where("score is null").count() == 0
    fitted.release()


def test_no_rows(people):
    prepared = fit_preparation(people, SPEC)
    with pytest.raises(ValueError, match="no training rows"):
        N.train_network(people.where("false"), prepared, "risk_score", SMALL)
