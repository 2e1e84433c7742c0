"""One-vs-rest logistic models by stochastic gradient descent, averaged over tasks.

In a round every task starts from the same model and goes through its rows a few times, in small
batches with a decaying step; the models the tasks end with are averaged, weighted by their rows.
Coefficients leave a task in slices that are added up by a shuffle, so the driver gets one model a
round, whatever the number of tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimsift.operators.blocks import Rows, added_slices, slices

MOST_STEP = 4.0  # for the mean gradient of a batch: rows have unit length, so half of what is stable


@dataclass(frozen=True)
class Descent:
    """How to descend.  The step for one row is ``step / (1 + alpha * step * rows seen)``."""

    alpha: float
    step: float = 10.0
    batch: int = 16
    passes: int = 4  # per round
    rounds: int = 30  # at most
    tolerance: float = 0.05  # a round counts as gain if the loss falls by this share
    patience: int = 1  # rounds without gain that end the descent
    task_rows: int = 1000  # a task with fewer has little to add to the average: small tables go to fewer tasks
    seed: int = 42


@dataclass
class State:
    weights: np.ndarray  # terms x classes
    bias: np.ndarray
    seen: int = 0


def one_pass(rows: Rows, labels: np.ndarray, state: State, how: Descent, rng: np.random.Generator) -> float:
    """Go through ``rows`` once in random order, changing ``state``; returns the sum of losses met on the way."""
    order = rng.permutation(len(labels))
    scale, total, classes = 1.0, 0.0, np.arange(len(state.bias))
    flat = state.weights.reshape(-1)
    for at in range(0, len(order), how.batch):
        pick = order[at:at + how.batch]
        sizes = rows.sizes[pick]
        owner = np.repeat(np.arange(len(pick)), sizes)
        begin = np.cumsum(sizes) - sizes
        places = np.arange(len(owner)) + np.repeat(rows.ends[pick] - begin, sizes)
        terms, weights = rows.indices[places], rows.weights[places, None]
        scores = np.zeros((len(pick), len(classes)))
        if len(terms):
            scores[sizes > 0] = np.add.reduceat(weights * state.weights[terms], begin[sizes > 0], axis=0)
        scores = scale * scores + state.bias
        truth = labels[pick, None] == classes
        total += float(np.logaddexp(0.0, np.where(truth, -scores, scores)).sum())
        slope = (1.0 / (1.0 + np.exp(-scores)) - truth) / len(pick)
        step = min(MOST_STEP, len(pick) * how.step / (1.0 + how.alpha * how.step * state.seen))
        scale *= 1.0 - step * how.alpha
        np.add.at(flat, (terms[:, None] * len(classes) + classes).ravel(), ((-step / scale) * weights * slope[owner]).ravel())
        state.bias -= step * slope.sum(axis=0)
        state.seen += len(pick)
    state.weights *= scale
    return total


def _round(data: DataFrame, state: State, how: Descent, turn: int) -> tuple[State, float]:
    """The average of the models that the tasks reach from ``state``, and the mean loss on the way."""
    shared = data.sparkSession.sparkContext.broadcast((state.weights, state.bias, state.seen))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias, seen = shared.value
        own = State(weights.copy(), bias.copy(), seen)
        part = TaskContext.get().partitionId()
        count, loss = 0, 0.0
        for number, batch in enumerate(batches):
            rows, labels = Rows(batch), batch.column("label").to_numpy().astype(np.int64)
            for turns in range(how.passes):
                loss += one_pass(rows, labels, own, how, np.random.default_rng((how.seed, turn, part, number, turns)))
            count += len(labels)
        if count:
            flat = np.concatenate([own.weights.ravel(), own.bias, [loss / count]]) * count
            yield from slices(count, flat)

    count, total = added_slices(data.mapInArrow(run, "slice bigint, count bigint, values array<double>"))
    shared.unpersist()
    if not count:
        return state, 0.0
    flat = total / count
    size, k = state.weights.size, len(state.bias)
    # Each task's step decays by the rows it has seen itself; the mean of these counts goes on.
    seen = state.seen + how.passes * count // max(data.rdd.getNumPartitions(), 1)
    return State(flat[:size].reshape(state.weights.shape), flat[size:size + k], seen), float(flat[-1]) / how.passes


def descend(vectors: DataFrame, terms: int, classes: int, how: Descent) -> tuple[State, list[float]]:
    """The model (terms x classes) for ``vectors(features, label)``, kept while it lasts, and the mean loss of each round."""
    parts = F.unwrap_udt(F.col("features"))
    data = vectors.select(parts["indices"].alias("_indices"), parts["values"].alias("_weights"), F.col("label").cast("int"))
    data = data.coalesce(max(1, data.count() // how.task_rows))  # never more partitions than there are
    own = not vectors.is_cached  # rows that the caller keeps are not kept twice
    if own:
        data.persist()
    state, losses = State(np.zeros((terms, classes)), np.zeros(classes)), []
    best, idle = np.inf, 0
    try:
        for turn in range(how.rounds):
            state, loss = _round(data, state, how, turn)
            losses.append(loss)
            idle = idle + 1 if loss > best * (1 - how.tolerance) else 0
            best = min(best, loss)
            if idle >= how.patience:
                break
    finally:
        if own:
            data.unpersist()
    return state, losses
