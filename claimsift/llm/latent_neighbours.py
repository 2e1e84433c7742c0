"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

A text is a bag of word shapes (letter case, what ends the word, length, whether it repeats one of
the words just before) and of neighbouring shapes.  Damped, inverse-document-frequency-weighted
counts of a bounded sample of labelled texts are reduced by a singular value decomposition; the
labelled vectors, whose number and width are parameters, are broadcast, and every text is compared with
all of them by exact cosine products in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimsift.llm.common import remainder, text_bytes, text_of_rows

LABELLED = 4096  # labelled rows that are fitted and compared with, at most
WIDTH = 48  # latent dimensions
NEIGHBOURS = 25
SHARPNESS = 8  # power of the cosine that weighs a vote
ACCEPT = 0.7
BLOCK = 512  # texts compared at a time
MEMORY = 200_000  # words whose shape a task remembers

CASES, ENDS, SIZES = 6, 6, 3
COARSE = CASES * ENDS
SHAPES = COARSE * SIZES
FEATURES = SHAPES * 2 + COARSE * COARSE


def shape(word: bytes) -> int:
    """Number of the word's shape: letter case, end and length."""
    body = word.rstrip(b"!#$%&'*+-,./:;<=>?@\\^_|~\"()[]{}`")
    end = word[len(body):]
    if not body:
        case = 0
    elif body.isdigit():
        case = 1
    elif any(48 <= b <= 57 for b in body):
        case = 2
    elif (text := body.decode("utf-8", "replace")).islower():
        case = 3
    elif len(text) > 1 and text.isupper():
        case = 4
    else:
        case = 5
    if not end:
        stop = 0
    elif end in (b",", b".", b";", b":"):
        stop = 1
    elif len(end) == 1:
        stop = 2
    elif end.count(b"!") == len(end):
        stop = 3
    elif b"." in end or b"," in end:
        stop = 4
    else:
        stop = 5
    return (case * ENDS + stop) * SIZES + (0 if len(word) < 4 else 1 if len(word) < 10 else 2)


class Shapes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        self[word] = found = shape(word)
        return found


def counts(data: bytes, shapes: Shapes) -> np.ndarray:
    """How often each shape and pair of shapes occurs in a text."""
    words = data.split()
    ids = np.fromiter(map(shapes.__getitem__, words), np.int64, len(words))
    again = np.zeros(len(words), np.int64)
    for lag in (1, 2):
        same = np.fromiter((a == b for a, b in zip(words[lag:], words, strict=False)), bool, max(0, len(words) - lag))
        again[lag:] |= same
    coarse = ids // SIZES
    return np.bincount(np.concatenate([ids + again * SHAPES, 2 * SHAPES + coarse[:-1] * COARSE + coarse[1:]]), minlength=FEATURES)


def damped(table: np.ndarray) -> np.ndarray:
    """Shares of a text's counts, damped by a root so that rare shapes still count."""
    total = np.maximum(1, table.sum(axis=1, keepdims=True))
    return np.sqrt(table / total).astype(np.float32)


def unit(table: np.ndarray) -> np.ndarray:
    return table / np.maximum(1e-9, np.linalg.norm(table, axis=1, keepdims=True))


class Neighbours:
    """Labelled latent vectors and the projection of further texts into their space."""

    def __init__(self, table: np.ndarray, labels: np.ndarray, width: int = WIDTH):
        bags = damped(table)
        present = (table > 0).sum(axis=0)
        self.idf = (np.log((1 + len(table)) / (1 + present)) + 1).astype(np.float32)
        if len(table):
            _, vectors = np.linalg.eigh((unit(bags * self.idf).T @ unit(bags * self.idf)).astype(np.float64))
            self.axes = vectors[:, ::-1][:, :width].astype(np.float32)
        else:
            self.axes = np.zeros((FEATURES, 1), np.float32)
        self.labels = labels.astype(np.float32)
        self.latent = self.project(table)
        self.base = float(self.labels.mean()) if len(table) else 0.5

    def project(self, table: np.ndarray) -> np.ndarray:
        return unit(unit(damped(table) * self.idf) @ self.axes)

    def vote(self, table: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        """Share of label 1 among the nearest labelled vectors, weighted by similarity; one base vote joins in."""
        if not len(self.labels):
            return np.full(len(table), self.base)
        cosine = self.project(table) @ self.latent.T
        k = min(neighbours, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(0, np.take_along_axis(cosine, near, axis=1)).astype(np.float64) ** SHARPNESS
        total = weight.sum(axis=1)
        return ((weight * self.labels[near]).sum(axis=1) + 1e-3 * self.base) / (total + 1e-3)


def learned(doc_id: Column) -> Column:
    return remainder(doc_id, 4) != 2


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, label, data) of labelled documents, none of which is held out; ``most`` ids at most.

    Ids are taken by a hash, at a rate that makes about nine tenths of ``most`` of a larger table.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & learned(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    total = known.count()
    if total > most:
        part = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_000_000))
        known = known.where(part < most * 900_000_000 // total).limit(most)
    return docs.select("doc_id", text_bytes().alias("data")).join(F.broadcast(known), "doc_id").select("doc_id", "label", "data")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = LABELLED, width: int = WIDTH) -> Neighbours:
    """Neighbours fitted on ``most`` labelled rows at most.  Unlabelled, null-labelled and held-out rows are not seen."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shapes = Shapes()
        for batch in batches:
            bags = [counts(data, shapes).astype(np.int32).tobytes() for data in batch["data"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype(str), "label": batch["label"], "bag": bags})

    rows = labelled_sample(docs, labels, label, most).mapInPandas(run, "doc_id string, label int, bag binary").collect()
    rows = sorted(rows, key=lambda r: (r[0], r[2]))[:most]  # repeated documents must not pass the bound
    table = np.array([np.frombuffer(r[2], np.int32) for r in rows]).reshape(-1, FEATURES)
    return Neighbours(table, np.array([r[1] for r in rows]), width)


def scored(docs: DataFrame, model: Neighbours) -> DataFrame:
    """``docs`` as struct ``row`` with ``score``, the weighted share of votes for label 1."""
    from pyspark.sql import types as T
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(model)  # LABELLED * WIDTH and FEATURES * WIDTH numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Shapes()
        for batch in batches:
            scores, data = [], text_of_rows(batch.column("row")).cast(pa.binary())
            for at in range(0, batch.num_rows, BLOCK):
                block = data.slice(at, BLOCK)
                scores.append(shared.value.vote(np.stack([counts(data.as_py(), shapes) for data in block])))
            found = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found, pa.float64())], names=["row", "score"])

    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return row.mapInArrow(run, T.StructType([row.schema["row"], T.StructField("score", T.DoubleType())]))


def quality(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Null and empty texts are scored like any text without words; a table without usable labels gives
    0.5 everywhere; of contradicting labels of one id the larger counts; repeated rows are rows of
    their own; an empty table gives no rows; further columns are ignored.
    """
    found = scored(docs, fit(docs, labels))
    return found.select(
        "row.doc_id", (~learned(F.col("row.doc_id"))).alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """``docs`` without the rows whose score is below ``accept``; the columns stay as they are."""
    return scored(docs, fit(docs, labels)).where(F.col("score") >= accept).select("row.*")
