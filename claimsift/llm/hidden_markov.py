"""Language-model scoring by a hidden Markov model over the words of the corpus.

States emit classes.  The most frequent words are classes of their own; every other word belongs to
one of a fixed number of word shapes, and a shape emits its words by their smoothed share of it, so
that the model gives every text an exact probability while its tables stay bounded.  Word counts are
taken over all training text.  Baum-Welch starts on a bounded sample and then runs over all training
text: every task returns expected counts, which are added up per class before they reach the driver.
Texts are scored by the scaled forward recursion, many at a time; the shares of rare words come from a
join of (text, word) with the counts, whose keys are rare by construction.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimsift.llm.common import LOWER, remainder, text_bytes
from claimsift.operators.features import top_terms
from claimsift.session import materialise

STATES = 8
FREQUENT = 32768  # words that are classes of their own
ROUNDS = 3  # Baum-Welch rounds over all training text
SAMPLE_TEXTS, SAMPLE_TOKENS, SAMPLE_ROUNDS = 1024, 1 << 20, 20  # the start, on a bounded sample
PIECE = 256  # training text is cut into pieces of so many tokens; scoring never cuts
PIECES = 2048  # pieces handled at a time
MEMORY = 100_000  # rare words whose shape a task remembers
FOLDS = 10
ADD = 0.1  # added to counts of words
PRIOR = 200.0  # tokens that the overall distribution of classes adds to each state
SEED = 11

LEADS, ENDS, SIZES = 9, 4, 3
SHAPES = LEADS * ENDS * SIZES
_ENDS = bytes(1 if b == 44 else 2 if b == 46 else 0 if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 3 for b in range(256))
_WIDE = re.compile(rb"[\x80-\xff]+")


def shape(word: bytes) -> int:
    """Number of a rare word's shape: its first letter beyond ASCII, its end, its length."""
    lead = 0 if word.isascii() else 1 + _WIDE.search(word)[0][-1] % (LEADS - 1)
    return (lead * ENDS + _ENDS[word[-1]]) * SIZES + (0 if len(word) <= 6 else 1 if len(word) <= 12 else 2)


class Shapes(dict):
    """Shapes of words, remembered up to MEMORY of them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        self[word] = found = shape(word)
        return found


def count_words(docs: DataFrame) -> DataFrame:
    """(word binary, n) over ``docs(data)``; every task adds up before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for data in batch.column("data").to_pylist():
                seen.update(data.translate(LOWER).split())
                if len(seen) > 400_000:
                    yield rows()
                    seen.clear()
        yield rows()

    return docs.select("data").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Classes:
    """Classes of words with their counts in training text: frequent words, shapes, then the end of a text."""

    def __init__(self, frequent: list[tuple[bytes, int]], shapes: dict[int, tuple[int, int]], texts: int):
        self.number = {word: k for k, (word, _) in enumerate(frequent)}
        self.first_shape = len(frequent)
        self.end = self.first_shape + SHAPES
        self.size = self.end + 1
        of_shapes = [shapes.get(k, (0, 0)) for k in range(SHAPES)]
        self.counts = np.array([n for _, n in frequent] + [n for n, _ in of_shapes] + [texts], np.float64)
        self.tokens = int(self.counts.sum())
        self.distinct = len(frequent) + sum(v for _, v in of_shapes) + (texts > 0)
        self.divisor = self.tokens + ADD * (self.distinct + 1)
        self.shape_divisors = [n + ADD * (v + 1) for n, v in of_shapes]
        self.base = np.log10((self.counts + ADD) / self.divisor)  # of frequent words and the end

    def encode(self, data: bytes, shapes: Shapes) -> tuple[np.ndarray, Counter]:
        """Classes of the tokens of a text, the end last, and its rare words."""
        words = data.translate(LOWER).split()
        get = self.number.get
        ids = np.fromiter(map(get, words, repeat(-1)), np.int32, len(words))
        places = np.flatnonzero(ids < 0)
        rare = [words[k] for k in places.tolist()]
        ids[places] = np.fromiter(map(shapes.__getitem__, rare), np.int32, len(rare)) + self.first_shape
        return np.append(ids, np.int32(self.end)), Counter(rare)


def learn_classes(counts: DataFrame, texts: int, frequent: int = FREQUENT) -> Classes:
    top = top_terms(counts.select(F.col("word").alias("term"), "n"), frequent)  # a cut by count, no top-k in one task
    head = sorted(((bytes(w), n) for w, n in top.select("term", "n").collect()), key=lambda r: (-r[1], r[0]))
    known = counts.sparkSession.sparkContext.broadcast({w for w, _ in head})  # at most FREQUENT words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((SHAPES, 2), np.int64)
        for batch in batches:
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                if word not in known.value:
                    total[shape(word)] += (n, 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SHAPES)), pa.array(total[:, 0]), pa.array(total[:, 1])], names=["shape", "n", "v"])

    rows = counts.mapInArrow(run, "shape long, n long, v long").groupBy("shape").agg(F.sum("n"), F.sum("v")).collect()
    return Classes(head, {k: (n, v) for k, n, v in rows}, texts)


class Model:
    """Start, transition and emission probabilities; emissions by class, then state."""

    def __init__(self, start: np.ndarray, steps: np.ndarray, emit: np.ndarray):
        self.start, self.steps, self.emit = start, steps, emit
        late = np.full(len(start), 1 / len(start))
        for _ in range(200):
            late = late @ steps
        self.late = late / late.sum()  # where pieces after the first start

    @classmethod
    def from_counts(cls, start: np.ndarray, steps: np.ndarray, emit: np.ndarray, overall: np.ndarray) -> Model:
        start, steps = start + 1.0, steps + 1.0
        emit = emit + PRIOR * overall[:, None]
        return cls(start / start.sum(), steps / steps.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))

    def log10(self, tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """log10 probability of each sequence, by the scaled forward recursion; sequence k is tokens[offsets[k]:offsets[k + 1]]."""
        sizes = np.diff(offsets)
        order = np.argsort(-sizes, kind="stable")
        begins, sizes = offsets[:-1][order], sizes[order]
        active = np.searchsorted(-sizes, -np.arange(1, (sizes[0] if len(sizes) else 0) + 1), side="right")
        total = np.zeros(len(sizes))
        alpha = None
        for t, m in enumerate(active):
            ahead = self.emit.take(tokens[begins[:m] + t], axis=0)
            ahead *= self.start if t == 0 else alpha[:m] @ self.steps
            alpha = ahead
            scale = alpha.sum(axis=1)
            alpha /= scale[:, None]
            total[:m] += np.log10(scale)
        out = np.empty(len(sizes))
        out[order] = total
        return out

    def expect(self, pieces: list[tuple[np.ndarray, bool]], emit: np.ndarray, steps: np.ndarray, start: np.ndarray) -> None:
        """Add the expected counts of the pieces, given as (classes, whether the text starts there)."""
        k = len(self.start)
        pieces = sorted(pieces, key=lambda p: -len(p[0]))
        sizes = np.array([len(p) for p, _ in pieces])
        table = np.zeros((sizes[0], len(pieces)), np.int32)
        for i, (p, _) in enumerate(pieces):
            table[:len(p), i] = p
        first = np.array([f for _, f in pieces])
        active = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")
        alpha, out, scales = [], [], []
        for t, m in enumerate(active):
            prior = np.where(first[:, None], self.start, self.late) if t == 0 else alpha[-1][:m] @ self.steps
            out.append(self.emit.take(table[t, :m], axis=0))
            prior *= out[-1]
            scales.append(prior.sum(axis=1, keepdims=True))
            prior /= scales[-1]
            alpha.append(prior)
        beta = np.ones((active[-1], k))
        seen = np.zeros((k, k))
        for t in range(len(active) - 1, -1, -1):
            m = active[t]
            if t + 1 < len(active):
                ahead = out.pop()  # of t + 1, which is not looked at again
                ahead *= beta
                ahead /= scales[t + 1]
                seen += alpha[t][:len(ahead)].T @ ahead
                beta = np.ones((m, k))
                beta[:len(ahead)] = ahead @ self.steps.T
            alpha[t] *= beta  # from here on the chance of each state, given the whole piece
        steps += seen * self.steps
        start += alpha[0][first].sum(axis=0)
        flat = np.concatenate([table[t, :m] for t, m in enumerate(active)])
        weight = np.concatenate(alpha)
        for s in range(k):
            emit[:, s] += np.bincount(flat, weights=weight[:, s], minlength=len(emit))


def cut(tokens: np.ndarray, offsets: np.ndarray) -> Iterator[list[tuple[np.ndarray, bool]]]:
    """Pieces of the sequences, PIECES at a time."""
    pieces = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        for at in range(a, b, PIECE):
            pieces.append((tokens[at:min(b, at + PIECE)], at == a))
            if len(pieces) == PIECES:
                yield pieces
                pieces = []
    if pieces:
        yield pieces


def first_model(tokens: np.ndarray, offsets: np.ndarray, overall: np.ndarray, states: int = STATES, rounds: int = SAMPLE_ROUNDS) -> Model:
    """Baum-Welch on a sample: pieces start in chosen states that rarely change."""
    rng = np.random.default_rng(SEED)
    batches = list(cut(tokens, offsets))
    emit = np.zeros((len(overall), states))
    for pieces in batches:
        for piece, _ in pieces:
            np.add.at(emit, (piece, rng.integers(states)), 1)
    stay = np.full((states, states), 1.0) + np.eye(states) * 50 * states
    model = Model.from_counts(np.ones(states), stay, emit, overall)
    for _ in range(rounds):
        emit, steps, start = np.zeros_like(model.emit), np.zeros((states, states)), np.zeros(states)
        for pieces in batches:
            model.expect(pieces, emit, steps, start)
        model = Model.from_counts(start, steps, emit, overall)
    return model


def sequences(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column("classes")
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), offsets - offsets[0]


def round_of_all(encoded: DataFrame, model: Model, overall: np.ndarray) -> Model:
    """One Baum-Welch round over ``encoded(classes)``: expected counts per task, added up per class."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)  # FREQUENT and SHAPES times STATES numbers
    k = len(model.start)
    names = [f"s{s}" for s in range(k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = shared.value
        emit, steps, start = np.zeros_like(now.emit), np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            for pieces in cut(*sequences(batch)):
                now.expect(pieces, emit, steps, start)
        seen = np.flatnonzero(emit.any(axis=1))
        key = np.concatenate([seen, -1 - np.arange(k), [-1 - k]])
        rows = np.concatenate([emit[seen], steps, start[None]]).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), *(pa.array(rows[:, s]) for s in range(k))], names=["key", *names])

    added = encoded.select("classes").mapInArrow(run, "key long, " + ", ".join(f"{n} float" for n in names))
    rows = added.groupBy("key").agg(*[F.sum(n) for n in names]).collect()
    emit, rest = np.zeros_like(model.emit), np.zeros((k + 1, k))
    for key, *values in rows:
        if key >= 0:
            emit[key] = values
        else:
            rest[-1 - key] = values
    return Model.from_counts(rest[k], rest[:k], emit, overall)


def encode(docs: DataFrame, classes: Classes) -> DataFrame:
    """``docs(doc, held_out, data)`` with classes of tokens, rare words, and the base score of all but these."""
    shared = docs.sparkSession.sparkContext.broadcast(classes)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, shapes = shared.value, Shapes()
        listed = lambda sizes, values: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids, base, known, words, times, rare = [], [], [], [], [], []
                for data in part.column("data"):
                    tokens, seen = book.encode(data.as_py(), shapes)
                    common = tokens[(tokens < book.first_shape) | (tokens == book.end)]
                    ids.append(tokens)
                    base.append(float(book.base[common].sum()))
                    known.append(len(common) - (book.counts[book.end] == 0))
                    words += seen
                    times += seen.values()
                    rare.append(len(seen))
                kinds = np.fromiter(map(shapes.__getitem__, words), np.int32, len(words))
                table = pa.StructArray.from_arrays([pa.array(words, pa.binary()), pa.array(kinds), pa.array(times, pa.int32())], names=["word", "shape", "n"])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc"), part.column("held_out"), listed([len(i) for i in ids], pa.array(np.concatenate(ids), pa.int32())), listed(rare, table),
                     pa.array(base, pa.float64()), pa.array(known, pa.int64())],
                    names=["doc", "held_out", "classes", "rare", "base", "known"])

    found = T.StructType.fromDDL("held_out boolean, classes array<int>, rare array<struct<word:binary,shape:int,n:int>>, base double, known bigint")
    return docs.mapInArrow(run, T.StructType([docs.schema["doc"], *found.fields]))


def start_sample(training: DataFrame, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of about SAMPLE_TEXTS training texts, in hash order of their ids, as long as they fit SAMPLE_TOKENS together.

    An id counts once, with the least of its texts, so that neither partitions nor copies change the outcome.
    """
    place = F.pmod(F.xxhash64(F.col("doc.doc_id").cast("string"), F.lit(SEED)), F.lit(1_000_000)).alias("place")
    near = training.where(place < min(1_000_000, SAMPLE_TEXTS * 1_000_000 // max(1, texts)))
    least = near.groupBy(F.col("doc.doc_id").cast("string").alias("id"), place).agg(F.min(F.struct(F.size("classes").alias("n"), F.xxhash64("classes"), "key")).alias("least"))
    chosen, held = [], 0
    for row in sorted(least.collect(), key=lambda r: (r["place"], r["id"] or "")):  # about SAMPLE_TEXTS rows
        if held + row["least"]["n"] <= SAMPLE_TOKENS:
            chosen.append(row["least"]["key"])
            held += row["least"]["n"]
    found = dict(training.where(F.col("key").isin(chosen)).select("key", "classes").collect()) if chosen else {}
    pieces = [np.array(found[key], np.int32) for key in chosen]
    return np.concatenate([*pieces, np.zeros(0, np.int32)]), np.cumsum([0, *map(len, pieces)])


def score(docs: DataFrame, states: int = STATES, frequent: int = FREQUENT, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    Learns from rows whose crc32 of the id, modulo FOLDS, is not 0.  A null or blank text is the end
    alone; a null id counts as the empty text in the remainder; repeated rows are rows of their own;
    without training rows every token has the same chance; an empty table gives no rows; further columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.struct("doc_id").alias("doc"), (remainder(F.col("doc_id"), FOLDS) == 0).alias("held_out"), text_bytes().alias("data"))
    counts = materialise(count_words(rows.where("not held_out")), "word-counts")
    texts = rows.where("not held_out").count()
    classes = learn_classes(counts, texts, frequent)
    encoded = materialise(encode(rows, classes).withColumn("key", F.monotonically_increasing_id()), "encoded")

    overall = (classes.counts + ADD) / (classes.counts + ADD).sum()
    training = encoded.where("not held_out")
    tokens, offsets = start_sample(training, texts)
    model = first_model(tokens, offsets, overall, states)
    for _ in range(rounds if texts else 0):
        model = round_of_all(training, model, overall)
    shared = spark.sparkContext.broadcast(model)

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, offsets = sequences(batch)
            found = shared.value.log10(tokens, offsets)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("key", "doc", "held_out", "base", "known")), pa.array(np.diff(offsets), pa.int64()), pa.array(found)],
                names=["key", "doc", "held_out", "base", "known", "n_tokens", "forward"])

    schema = T.StructType([T.StructField("key", T.LongType()), rows.schema["doc"], *T.StructType.fromDDL(
        "held_out boolean, base double, known bigint, n_tokens bigint, forward double").fields])
    scored = encoded.select("key", "doc", "held_out", "base", "known", "classes").mapInArrow(forward, schema)

    rare = encoded.select("key", F.explode("rare").alias("r")).select("key", "r.*")
    rare = rare.join(counts.withColumnRenamed("n", "c"), "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    divisors = F.array(*[F.lit(float(d)) for d in classes.shape_divisors])
    share = lambda divisor: F.sum(F.col("n") * F.log10((F.col("c") + F.lit(ADD)) / divisor))
    rare = rare.groupBy("key").agg(
        share(F.lit(float(classes.divisor))).alias("rare_base"), share(divisors[F.col("shape")]).alias("rare_share"),
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"))
    none = F.lit(0.0)
    return scored.join(rare, "key", "left").select(
        "doc.doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).cast("bigint").alias("n_known"),
        F.lit(classes.tokens).cast("bigint").alias("train_tokens"), (F.col("base") + F.coalesce("rare_base", none)).alias("base_score"),
        (F.col("forward") + F.coalesce("rare_share", none)).alias("score"))
