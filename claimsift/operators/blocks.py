"""Blocks of sparse rows times a dense matrix, one product per part of an Arrow batch, and sums of vectors over tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame

TERMS = 1 << 17  # terms of rows that are multiplied at a time; a longer row is a part of its own
BLOCK = 1 << 19  # terms of the rows that are packed together; a longer row is a block of its own
LONG = 16  # terms a row, on average, from which rows are multiplied one by one: what is taken from the matrix stays in the nearest memory
SLICE = 1 << 13  # numbers that are added up in one group


class Rows:
    """The arrays ``_indices`` and ``_weights`` of a batch, end to end."""

    def __init__(self, batch: pa.RecordBatch):
        indices, weights = batch.column("_indices"), batch.column("_weights")
        sizes = pc.fill_null(pc.list_value_length(indices), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        self._set(sizes, indices.flatten().to_numpy(zero_copy_only=False), weights.flatten().to_numpy(zero_copy_only=False))

    def _set(self, sizes: np.ndarray, indices: np.ndarray, weights: np.ndarray) -> None:
        self.sizes, self.indices, self.weights = sizes, indices, weights
        self.ends = np.concatenate([[0], np.cumsum(sizes)])

    def parts(self, most: int = TERMS) -> Iterator[tuple[int, int]]:
        """Ranges of rows of ``most`` terms or a single row each."""
        begin, count = 0, len(self.sizes)
        while begin < count:
            end = max(begin + 1, int(np.searchsorted(self.ends, self.ends[begin] + most, side="right")) - 1)
            yield begin, min(end, count)
            begin = min(end, count)

    def times(self, matrix: np.ndarray) -> np.ndarray:
        """One row of products per row; a row without terms gives zeros."""
        out, matrix, columns = np.zeros((len(self.sizes), matrix.shape[1])), np.ascontiguousarray(matrix), np.ascontiguousarray(matrix.T)
        for begin, end in self.parts():
            a, b = self.ends[begin], self.ends[end]
            filled = np.flatnonzero(self.sizes[begin:end])
            if b - a >= LONG * len(filled):
                ends = self.ends.tolist()
                for k in (begin + filled).tolist():
                    own = slice(ends[k], ends[k + 1])
                    np.dot(self.weights[own], matrix.take(self.indices[own], axis=0), out=out[k])
            else:
                at, weights, firsts = self.indices[a:b], self.weights[a:b], self.ends[begin:end][filled] - a
                for k, column in enumerate(columns):
                    out[begin + filled, k] = np.add.reduceat(column.take(at) * weights, firsts)
        return out

    def back(self, values: np.ndarray, terms: int, squared: bool = False) -> np.ndarray:
        """One row per term: weights (or their squares) times the ``values`` of their rows, added up."""
        out, columns = np.zeros((values.shape[1], terms)), np.ascontiguousarray(values.T)
        for begin, end in self.parts():
            a, b = self.ends[begin], self.ends[end]
            at, weights, sizes = self.indices[a:b].astype(np.int64), self.weights[a:b], self.sizes[begin:end]
            weights = weights * weights if squared else weights
            for k, column in enumerate(columns):
                out[k] += np.bincount(at, weights * np.repeat(column[begin:end], sizes), minlength=terms)
        return np.ascontiguousarray(out.T)


def packed(data: DataFrame) -> RDD:
    """``data(_indices, _weights, label)`` in blocks of rows, kept by the session: (sizes, indices, weights, labels), bytes each.

    Bytes go from the kept blocks to Python as they are; a row of a DataFrame is taken apart and put together on every pass.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, labels = Rows(batch), batch.column("label").to_numpy().astype(np.int64)
            for begin, end in rows.parts(BLOCK):
                own = slice(rows.ends[begin], rows.ends[end])
                parts = rows.sizes[begin:end], rows.indices[own].astype(np.int32), rows.weights[own].astype(np.float64), labels[begin:end]
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], names=["sizes", "indices", "weights", "labels"])

    blocks = data.mapInArrow(run, "sizes binary, indices binary, weights binary, labels binary")
    return blocks.rdd.map(lambda block: tuple(bytes(x) for x in block)).persist(StorageLevel.MEMORY_AND_DISK)


def unpacked(block: tuple[bytes, ...]) -> tuple[Rows, np.ndarray]:
    """Rows and labels of a block of ``packed``."""
    rows, (sizes, indices, weights, labels) = Rows.__new__(Rows), block
    rows._set(np.frombuffer(sizes, np.int64), np.frombuffer(indices, np.int32), np.frombuffer(weights, np.float64))
    return rows, np.frombuffer(labels, np.int64)


def list_column(table: np.ndarray) -> pa.ListArray:
    """A matrix as a column of arrays."""
    n, k = table.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), pa.array(table.ravel()))


def one_slice(number: int, count: int, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([number], pa.int64()), pa.array([count], pa.int64()), list_column(values[None])], names=["slice", "count", "values"])


def slices(count: int, flat: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's vector, which stands for ``count`` rows, in (slice, count, values)."""
    for k in range(0, len(flat), SLICE):
        yield one_slice(k // SLICE, count, flat[k:k + SLICE])


def added_vectors(vectors: RDD) -> tuple[int, np.ndarray]:
    """Counts and vectors of (count, vector), added up slice by slice; the driver gets one vector."""

    def cut(one: tuple[int, np.ndarray]) -> Iterator[tuple[int, tuple[int, np.ndarray]]]:
        count, flat = one
        return ((k // SLICE, (count, flat[k:k + SLICE])) for k in range(0, len(flat), SLICE))

    found = sorted(vectors.flatMap(cut).reduceByKey(lambda a, b: (a[0] + b[0], a[1] + b[1])).collect(), key=lambda slice: slice[0])
    return (found[0][1][0], np.concatenate([values for _, (_, values) in found])) if found else (0, np.zeros(0))


def added_slices(df: DataFrame) -> tuple[int, np.ndarray]:
    """Rows and the sum of the tasks' vectors, added up slice by slice; the driver gets one vector."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, count, total = None, 0, None
        for batch in batches:
            for k, n, values in zip(batch.column("slice").to_pylist(), batch.column("count").to_pylist(), batch.column("values"), strict=True):
                if k != number:
                    if number is not None:
                        yield one_slice(number, count, total)
                    number, count, total = k, 0, 0.0
                count, total = count + n, total + values.values.to_numpy()
        if number is not None:
            yield one_slice(number, count, total)

    found = df.repartition("slice").sortWithinPartitions("slice").mapInArrow(add, df.schema).toArrow().sort_by("slice").combine_chunks()
    if not len(found):
        return 0, np.zeros(0)
    return found.column("count")[0].as_py(), found.column("values").combine_chunks().flatten().to_numpy()
