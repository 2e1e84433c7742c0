"""Toxicity: maximum-scoring segments of token log-odds, judged by extreme-value statistics.

A token's evidence is the posterior log-odds of label 1 under a chain of Dirichlet priors: the whole
word is shrunk to its longest known beginning, that one to the next shorter, and the shortest to the
base rate.  A linear scan finds every maximal segment of the scores of a text.  The score of the best
segment of a clean text follows an extreme-value law, whose parameters are solved from clean labelled
texts; it turns segment scores into expected counts by chance, and these into the score of the text.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimsift.llm.common import LOWER, text_bytes
from claimsift.llm.latent_neighbours import labelled_sample, learned
from claimsift.session import materialise

LABELLED = 16384  # labelled rows that are learned from, at most
BEGINNINGS = (3, 5, 6, 7, 8)  # code points of the beginnings of a word that evidence is kept for
PRIOR = 4.0  # texts that a prior counts as
LEAST_TEXTS = 4  # texts that a unit must occur in to be kept
DRIFT = 1.0  # taken off every token, so that chance segments stay short
CHANCE = 0.01  # segments expected by chance below which a segment is significant
ACCEPT = 0.3
MEMORY = 200_000  # words whose score a task remembers
EDGE = b"!#$%&'*+-,./:;<=>?@\\^_|~\"()[]{}`\xc2\xbf"


def units(word: bytes) -> list[str]:
    """The beginnings of a word, shortest first, and the word itself, marked."""
    text = word.strip(EDGE).decode("utf-8", "replace")
    return [text[:k] for k in BEGINNINGS if k < len(text)] + [f"{text}$"]


class Evidence(dict):
    """Score of a word, remembered; ``odds`` has the units that differ from their prior."""

    def __init__(self, odds: dict[str, float], drift: float):
        super().__init__()
        self.odds, self.drift = odds, drift

    def __missing__(self, word: bytes) -> float:
        if len(self) >= MEMORY:
            self.clear()
        found = 0.0
        for unit in units(word):
            found = self.odds.get(unit, found)
        self[word] = found = found - self.drift
        return found


def posterior(seen: dict[str, tuple[int, int]], base: float) -> dict[str, float]:
    """Log-odds of each unit against ``base``, given the texts with label 1 and 0 that it occurs in."""
    chance: dict[str, float] = {}

    def of(unit: str) -> float:
        if unit in chance:
            return chance[unit]
        text = unit.removesuffix("$")
        shorter = [k for k in BEGINNINGS if k < len(text)]
        prior = next((of(text[:k]) for k in reversed(shorter) if text[:k] in seen and text[:k] != unit), base)
        ones, zeros = seen[unit]
        chance[unit] = (ones + PRIOR * prior) / (ones + zeros + PRIOR)
        return chance[unit]

    logit = lambda p: math.log(p / (1 - p))
    odds: dict[str, float] = {}
    for unit in sorted(seen, key=lambda u: (len(u.removesuffix("$")), u.endswith("$"))):
        text = unit.removesuffix("$")
        nearest = next((odds[text[:k]] for k in reversed(BEGINNINGS) if k < len(text) and text[:k] in odds), 0.0)
        found = round(logit(of(unit)) - logit(base), 4)
        if abs(found - nearest) >= 0.05:  # else the nearest beginning says the same
            odds[unit] = found
    return odds


def token_scores(words: list[bytes], evidence: Evidence) -> np.ndarray:
    """Scores of the words; a word that only repeats the one before it brings no evidence."""
    scores = np.fromiter(map(evidence.__getitem__, words), np.float64, len(words))
    again = np.fromiter((a == b for a, b in zip(words[1:], words, strict=False)), bool, max(0, len(words) - 1))
    scores[1:][again] = -evidence.drift
    return scores


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, stop, score) of a sequence, in one pass over its positive runs."""
    positive = scores > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], positive, [0]]).astype(np.int8)))
    if not len(edges):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    stack: list[tuple[int, int, float, float, int]] = []  # start, stop, sum before, sum up to stop, last smaller before
    for start, stop in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        left, right = float(total[start]), float(total[stop])
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= right:
                stack.append((start, stop, left, right, j))
                break
            start, left = stack[j][0], stack[j][2]
            del stack[j:]
    return [(start, stop, right - left) for start, stop, left, right, _ in stack]


def tail_rate(values: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of sum(weights * exp(rate * values)) = 1 for scores of negative mean."""
    weights = weights / weights.sum()
    if values.max(initial=-1) <= 0:
        return 1.0
    mass = lambda rate: float((weights * np.exp(np.minimum(700, rate * values))).sum())
    low, high = 0.0, 1.0
    while mass(high) < 1:
        high *= 2
    for _ in range(60):
        low, high = (mid, high) if mass(mid := (low + high) / 2) < 1 else (low, mid)
    return (low + high) / 2


class Calibration:
    """Evidence, the extreme-value law of clean texts, and the map of a text's segments to its score."""

    def __init__(self, odds: dict[str, float], rate: float = 1.0, constant: float = 1.0, weights=(0.0, 0.0, 0.0)):
        self.odds, self.rate, self.constant, self.weights = odds, rate, constant, np.array(weights)

    def passages(self, words: list[bytes], evidence: Evidence) -> list[tuple[int, int, float, float]]:
        """(start, stop, score, segments as good expected by chance) of every maximal segment."""
        found = segments(token_scores(words, evidence))
        return [(a, b, s, self.expected(len(words), s)) for a, b, s in found]

    def expected(self, size: int, score: float) -> float:
        return self.constant * max(1, size) * math.exp(-self.rate * score)

    def features(self, expected: list[float]) -> list[float]:
        """Constant, strength of the best segment, and strength of all significant ones; strength is -ln(expected by chance)."""
        strength = [-math.log(max(e, 1e-300)) for e in expected]
        best = max(strength, default=-10.0)
        return [1.0, math.tanh(best / 10) * 10, math.log1p(sum(x for x in strength if x > -math.log(CHANCE)))]

    def score(self, expected: list[float]) -> float:
        return float(1 / (1 + math.exp(-float(np.clip(self.weights @ self.features(expected), -30, 30)))))


def logistic(table: np.ndarray, labels: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps of a logistic regression with a small ridge."""
    weights = np.zeros(table.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(table @ weights, -30, 30)))
        hessian = (table * (p * (1 - p))[:, None]).T @ table + ridge * np.eye(table.shape[1])
        step = np.linalg.solve(hessian, table.T @ (labels - p) - ridge * weights)
        weights = weights + step
        if np.abs(step).max() < 1e-9:
            break
    return weights


def calibrate(odds: dict[str, float], clean: dict[float, int], texts: list[tuple[int, int, list[float]]]) -> Calibration:
    """``clean``: tokens of clean texts by score; ``texts``: (label, words, segment scores) of labelled texts."""
    values, weights = np.array(list(clean) or [-1.0]), np.array(list(clean.values()) or [1.0])
    model = Calibration(odds, tail_rate(values, weights))
    # The best of n chance segments: rate * best - ln(n) is ln(constant) plus a standard Gumbel variable, median 0.3665.
    middle = [model.rate * max(scores, default=0.0) - math.log(max(1, n)) for label, n, scores in texts if not label]
    model.constant = math.exp(float(np.median(middle)) - 0.3665) if middle else 1.0
    table = np.array([model.features([model.expected(n, s) for s in scores]) for _, n, scores in texts]).reshape(-1, 3)
    labels = np.array([label for label, _, _ in texts], float)
    if len(set(labels)) > 1:
        model.weights = logistic(table, labels)
    else:
        model.weights = np.array([math.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1)), 0.0, 0.0])
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = LABELLED) -> Calibration:
    """Evidence and calibration from ``most`` labelled rows at most; held-out rows are not seen."""
    sample = materialise(labelled_sample(docs, labels, label, most).select("label", "data"), "labelled")
    n, ones = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    base = (ones + 1) / (n + 2)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = (Counter(), Counter())
            for one, data in zip(batch.column("label").to_pylist(), batch.column("data"), strict=True):
                seen[one].update({u for w in set(data.as_py().translate(LOWER).split()) for u in units(w)})
            for one, found in enumerate(seen):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(found), pa.string()), pa.array([one] * len(found), pa.int32()), pa.array(list(found.values()), pa.int64())],
                    names=["unit", "label", "n"])

    of_label = lambda k: F.sum(F.when(F.col("label") == k, F.col("n")).otherwise(0))
    seen = sample.mapInArrow(count, "unit string, label int, n long").groupBy("unit").agg(
        of_label(1).alias("ones"), of_label(0).alias("zeros")).where(F.col("ones") + F.col("zeros") >= LEAST_TEXTS)
    odds = posterior({u: (a, b) for u, a, b in seen.collect()}, base)  # units of a bounded number of texts
    shared = docs.sparkSession.sparkContext.broadcast(odds)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = Evidence(shared.value, DRIFT)
        columns = pa.schema([("label", pa.int32()), ("n", pa.int64()), ("scores", pa.list_(pa.float64())), ("bins", pa.list_(pa.float64())), ("weights", pa.list_(pa.int64()))])
        for batch in batches:
            out = []
            for one, data in zip(batch.column("label").to_pylist(), batch.column("data"), strict=True):
                scores = token_scores(data.as_py().translate(LOWER).split(), evidence)
                values, weights = np.unique(np.round(scores, 1), return_counts=True)
                out.append({"label": one, "n": len(scores), "scores": [s for _, _, s in segments(scores)], "bins": values.tolist(), "weights": weights.tolist()})
            yield pa.RecordBatch.from_pylist(out, schema=columns)

    texts = sample.mapInArrow(scan, "label int, n long, scores array<double>, bins array<double>, weights array<long>").collect()
    clean: Counter = Counter()
    for row in texts:
        if not row["label"]:
            clean.update(dict(zip(row["bins"], row["weights"], strict=True)))
    return calibrate(odds, dict(clean), [(r["label"], r["n"], sorted(r["scores"])) for r in sorted(texts, key=lambda r: (r["label"], r["n"], sorted(r["scores"])))])


def scored(docs: DataFrame, model: Calibration) -> DataFrame:
    """``docs`` as struct ``row`` with ``score`` and ``passages``, the significant ones.

    A passage has start and stop in words, its score, and ``expected``, the number of segments as good that chance
    puts into a clean text of this length.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # units of a bounded number of labelled texts
    passage = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        calibration = shared.value
        evidence = Evidence(calibration.odds, DRIFT)
        for batch in batches:
            scores, passages = [], []
            for data in batch.column("data"):
                found = calibration.passages(data.as_py().translate(LOWER).split(), evidence)
                scores.append(calibration.score([e for *_, e in found]))
                passages.append([dict(zip(("start", "stop", "score", "expected"), p, strict=True)) for p in found if p[3] < CHANCE])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(scores, pa.float64()), pa.array(passages, pa.list_(passage))], names=["row", "score", "passages"])

    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_bytes().alias("data"))
    found = T.StructType.fromDDL("score double, passages array<struct<start:bigint,stop:bigint,score:double,expected:double>>")
    return row.mapInArrow(run, T.StructType([row.schema["row"], *found.fields]))


def toxicity(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_passages) for every row of ``docs``.

    Null and empty texts have no passages and the score of such texts; without usable labels every
    text gets 0.5; of contradicting labels of one id the larger counts; repeated rows are rows of their
    own; an empty table gives no rows; further columns are ignored.
    """
    found = scored(docs, fit(docs, labels))
    return found.select(
        "row.doc_id", (~learned(F.col("row.doc_id"))).alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"),
        F.size("passages").cast("bigint").alias("n_passages"))
