import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.linalg import Vectors

from claimsift.operators import stochastic
from claimsift.operators.blocks import SLICE, TERMS, Rows
from claimsift.operators.stochastic import Descent, descend


def made(n, terms, classes, seed):
    """Unit rows whose label follows a hidden direction per class."""
    rng = np.random.default_rng(seed)
    hidden = rng.normal(size=(terms, classes))
    rows = []
    for _ in range(n):
        at = np.sort(rng.choice(terms, rng.integers(1, 9), replace=False))
        weights = rng.random(len(at)) + 0.1
        weights /= np.linalg.norm(weights)
        rows.append((at, weights, int((weights @ hidden[at]).argmax())))
    return rows


def dense_loop(rows, terms, classes, how, rounds):
    """The same descent in the plainest form: one task, one batch, dense vectors."""
    x = np.zeros((len(rows), terms))
    for k, (at, weights, _) in enumerate(rows):
        x[k, at] = weights
    y = np.array([r[2] for r in rows])[:, None] == np.arange(classes)
    w, b, seen = np.zeros((terms, classes)), np.zeros(classes), 0
    for turn in range(rounds):
        for turns in range(how.passes):
            order = np.random.default_rng((how.seed, turn, 0, 0, turns)).permutation(len(rows))
            for at in range(0, len(order), how.batch):
                pick = order[at:at + how.batch]
                slope = (1 / (1 + np.exp(-(x[pick] @ w + b))) - y[pick]) / len(pick)
                step = min(stochastic.MOST_STEP, len(pick) * how.step / (1 + how.alpha * how.step * seen))
                w = (1 - step * how.alpha) * w - step * x[pick].T @ slope
                b = b - step * slope.sum(axis=0)
                seen += len(pick)
    return w, b


def vectors(spark, rows, terms, parts):
    data = [(Vectors.sparse(terms, at.tolist(), weights.tolist()), float(label)) for at, weights, label in rows]
    return spark.createDataFrame(data, ["features", "label"]).coalesce(1).repartition(parts) if parts > 1 else spark.createDataFrame(data, ["features", "label"]).coalesce(1)


def test_one_task_equals_a_dense_loop(spark):
    rows = made(300, 40, 3, 1)
    how = Descent(1e-3, batch=7, passes=2, rounds=3, tolerance=-1.0)
    state, losses = descend(vectors(spark, rows, 40, 1), 40, 3, how)
    w, b = dense_loop(rows, 40, 3, how, 3)
    assert len(losses) == 3 and losses[0] > losses[-1]
    assert np.allclose(state.weights, w, atol=1e-9) and np.allclose(state.bias, b, atol=1e-9)


def test_averaged_tasks_come_near_the_optimum(spark):
    rows = made(3000, 40, 3, 2)
    alpha = 1e-3
    state, losses = descend(vectors(spark, rows, 40, 5), 40, 3, Descent(alpha, task_rows=600))
    x = np.zeros((len(rows), 40))
    for k, (at, weights, _) in enumerate(rows):
        x[k, at] = weights
    y = np.array([r[2] for r in rows])[:, None] == np.arange(3)
    loss = lambda w, b: np.logaddexp(0, np.where(y, -1, 1) * (x @ w + b)).mean(axis=0) + alpha / 2 * (w * w).sum(axis=0)
    w, b = np.zeros((40, 3)), np.zeros(3)
    for _ in range(20_000):  # full gradients
        slope = (1 / (1 + np.exp(-(x @ w + b))) - y) / len(rows)
        w, b = w - 3 * (x.T @ slope + alpha * w), b - 3 * slope.sum(axis=0)
    assert (loss(state.weights, state.bias) <= 1.03 * loss(w, b)).all()


def test_slices_and_tables_without_rows(spark, monkeypatch):
    assert descend(vectors(spark, made(1, 9, 2, 3), 9, 1).limit(0), 9, 2, Descent(1e-4, rounds=2))[0].weights.sum() == 0
    rows = made(50, SLICE, 2, 4)
    state, _ = descend(vectors(spark, rows, SLICE, 3), SLICE, 2, Descent(1e-4, rounds=2))
    assert state.weights.shape == (SLICE, 2) and np.isfinite(state.weights).all() and state.weights.any()


@pytest.mark.parametrize("sizes", [[0, 3, 0, 0, 2, 0], [0], [], [TERMS + 5, 0, 1, TERMS // 2, TERMS, 0]])
def test_blocks_of_rows(sizes):
    rng = np.random.default_rng(5)
    ends = np.cumsum([0, *sizes])
    at, weights, matrix = rng.integers(0, 50, ends[-1]), rng.random(ends[-1]), rng.random((50, 4))
    batch = pa.RecordBatch.from_arrays(
        [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at, pa.int32())), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(weights))],
        names=["_indices", "_weights"])
    want = np.array([(weights[a:b, None] * matrix[at[a:b]]).sum(axis=0) for a, b in zip(ends, ends[1:], strict=False)]).reshape(len(sizes), 4)
    assert np.allclose(Rows(batch).times(matrix), want)
    back = np.zeros((50, 3))
    values = rng.random((len(sizes), 3))
    for row, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
        np.add.at(back, at[a:b], weights[a:b, None] ** 2 * values[row])
    assert np.allclose(Rows(batch).back(values, 50, squared=True), back)
    assert len(sizes) < 2 or np.allclose(Rows(batch.slice(1)).times(matrix), want[1:])
