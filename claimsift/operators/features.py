"""Term statistics and TF-IDF.

A claim's terms never leave its row until they are aggregated: counting against the vocabulary is a
look-up of its tokens on the executor, pairs of neighbours as pairs of word numbers, and weights and
norms are array expressions on the row, so the features of a table cost no shuffle at all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkContext
from pyspark.ml.feature import CountVectorizerModel, StringIndexer, StringIndexerModel
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimsift.functions.text import explode_terms, with_ngrams, with_tokens
from claimsift.operators.numbering import number_rows
from claimsift.session import materialise, new_path

TOKENS = 1 << 19  # tokens that are looked up at a time; a longer row is a part of its own
CODES = 1 << 22  # pairs that a task holds before it adds them up
CODED = "rows bigint, words array<string>, totals array<bigint>, sizes binary, train binary, codes binary"


def with_terms(
    df: DataFrame, text: str = "claim", stop_words: Sequence[str] = (), low: int = 1, high: int = 2
) -> DataFrame:
    """Add ``terms``: n-grams of the tokens left after stop words and masks."""
    return with_ngrams(with_tokens(df, text, "tokens", stop_words), "tokens", "terms", low, high).drop("tokens")


def term_totals(df: DataFrame, terms: str = "terms") -> DataFrame:
    """Occurrences of every term over all rows; counted on the map side first."""
    return explode_terms(df, terms, "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def document_frequency(df: DataFrame, terms: str = "terms") -> DataFrame:
    """Rows containing each term."""
    distinct = explode_terms(df, F.array_distinct(terms), "term")
    return distinct.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def count_at(totals: DataFrame, size: int) -> Row | None:
    """(n, terms, upto): the count of the term at place ``size``, terms with that count, terms with it or more; None if there are fewer."""
    per_count = totals.groupBy("n").agg(F.count(F.lit(1)).alias("terms"))
    upto = F.sum("terms").over(W.orderBy(F.desc("n")))  # one row per distinct count
    return per_count.withColumn("upto", upto).where(F.col("upto") >= size).orderBy(F.desc("n")).first()


def top_terms(totals: DataFrame, size: int) -> DataFrame:
    """The ``size`` most frequent terms, ties in term order; the rows come in no order.

    A top-k would send ``size`` rows of every partition to one task; here the count at the cut is read
    off the (small) table of counts, terms above it are taken by a filter, and only terms exactly at it
    are put in order, in parallel.
    """
    totals = materialise(totals, "term-totals")
    cut = count_at(totals, size)
    if cut is None:
        return totals
    above = totals.where(F.col("n") > cut["n"])
    need = size - (cut["upto"] - cut["terms"])
    at_cut = totals.where(F.col("n") == cut["n"])
    if need == cut["terms"]:
        return above.unionByName(at_cut)
    placed = number_rows(at_cut, ["term"], "place")
    return above.unionByName(placed.where(F.col("place") <= need).select("term", "n"))


def fit_vocabulary(train: DataFrame, size: int, terms: str = "terms") -> list[str]:
    """The vocabulary in alphabetical order; ``size`` bounds what reaches the driver."""
    kept = top_terms(term_totals(train, terms), size).select("term").toPandas()
    return sorted(kept["term"])


class Numbered:
    """Tokens of a batch as numbers of the given words, -1 for all others, a part of the rows at a time."""

    def __init__(self, words: Sequence[str]):
        self.words = pa.array(words, pa.string())

    def of(self, words: pa.Array) -> np.ndarray:
        """The number of each word."""
        return pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def parts(self, tokens: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(tokens per row, row of each token, number of each token) of rows with TOKENS tokens or a single row each."""
        sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        numbers = self.of(tokens.flatten().cast(pa.string()))
        begin = 0
        while begin < len(sizes):
            end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + TOKENS, side="right")) - 1)
            yield sizes[begin:end], np.repeat(np.arange(len(sizes[begin:end])), sizes[begin:end]), numbers[ends[begin]:ends[end]]
            begin = end

    def pairs(self, owner: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and code of every two neighbours that both have a number: first times the number of words plus second."""
        both = np.flatnonzero((owner[1:] == owner[:-1]) & (numbers[1:] >= 0) & (numbers[:-1] >= 0))
        return owner[both], numbers[both] * len(self.words) + numbers[both + 1]


def pair_totals(df: DataFrame, words: Sequence[str], tokens: str = "tokens") -> DataFrame:
    """(code, n): how often two of the ``words`` (their places in it are the numbers) are neighbours; tasks add up first."""
    shared = df.sparkSession.sparkContext.broadcast(Numbered(words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = shared.value
        yield from added_codes(book.pairs(owner, numbers)[1] for batch in batches for _, owner, numbers in book.parts(batch.column(0)))

    return df.select(tokens).mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))


def added_codes(codes: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(code, n), added up whenever CODES codes are held."""

    def added(held: list[np.ndarray]) -> pa.RecordBatch:
        code, n = np.unique(np.concatenate([np.zeros(0, np.int64), *held]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(code), pa.array(n.astype(np.int64))], names=["code", "n"])

    count, held = 0, []
    for some in codes:
        held.append(some)
        count += len(some)
        if count >= CODES:
            yield added(held)
            count, held = 0, []
    yield added(held)


def fit_vocabulary_of_tokens(train: DataFrame, size: int, tokens: str = "tokens") -> list[str]:
    """What ``fit_vocabulary`` gives for the tokens and their pairs; ``train`` is stored.

    A pair occurs at most as often as either of its words.  With L the count of the word at place
    ``size`` (0 if there are fewer words), pairs are counted of words above L only, as numbers: that gives
    every term above L.  If these are fewer than ``size``, terms at L count as well and all pairs are counted.
    """
    totals = materialise(term_totals(train, tokens), "word-totals")
    return _cut_vocabulary(
        totals, size, lambda words: pair_totals(train, words, tokens), lambda: with_ngrams(train.select(tokens), tokens, "terms"))


def _cut_vocabulary(totals: DataFrame, size: int, pairs_of: Callable[[list[str]], DataFrame], all_terms: Callable[[], DataFrame]) -> list[str]:
    """The vocabulary from stored word totals, the totals of pairs of given words and, if these are too few, the terms of all rows."""
    at = count_at(totals, size)
    least = at["n"] if at else 0
    above = totals.where(F.col("n") > least)
    words = sorted(r[0] for r in above.select("term").collect())  # fewer than size
    pairs = materialise(pairs_of(words).where(F.col("n") > least), "pair-totals")
    cut = count_at(above.select("n").unionByName(pairs.select("n")), size)
    if cut is None and least:
        return fit_vocabulary(all_terms(), size)
    if cut is not None:
        above, pairs = above.where(F.col("n") >= cut["n"]), pairs.where(F.col("n") >= cut["n"])
    spark, count = totals.sparkSession, F.lit(len(words))
    named = materialise(spark.createDataFrame(pa.table({"number": pa.array(range(len(words)), pa.int64()), "word": pa.array(words, pa.string())})), "words")
    first = F.broadcast(named.select(F.col("number").alias("_a"), F.col("word").alias("a")))  # fewer than size, twice
    second = F.broadcast(named.select(F.col("number").alias("_b"), F.col("word").alias("b")))
    split = pairs.select(F.expr(f"code div {max(len(words), 1)}").alias("_a"), (F.col("code") % count).alias("_b"), "n")
    spelt = split.join(first, "_a").join(second, "_b").select(F.concat_ws(" ", "a", "b").alias("term"), "n")
    return sorted(top_terms(above.unionByName(spelt), size).select("term").toPandas()["term"])


class TermBook:
    """Places of the terms of a vocabulary: of words by number, of pairs by code."""

    def __init__(self, vocabulary: Sequence[str]):
        split = [term.split(" ") for term in vocabulary]
        words = sorted({word for term in split for word in term})
        number = {word: k for k, word in enumerate(words)}
        self.numbered, self.size = Numbered(words), len(vocabulary)
        self.place = np.full(len(words) + 1, -1, np.int64)  # the last for tokens that are no word
        codes, places = [], []
        for place, term in enumerate(split):
            if len(term) == 1:
                self.place[number[term[0]]] = place
            else:
                codes.append(number[term[0]] * len(words) + number[term[1]])
                places.append(place)
        order = np.argsort(np.array(codes, np.int64), kind="stable")
        self.codes, self.pairs = np.array(codes, np.int64)[order], np.array(places, np.int64)[order]

    def counts(self, tokens: pa.ListArray) -> tuple[pa.ListArray, pa.ListArray]:
        """Indices in order and counts of the terms of every row."""
        return self.added(self.numbered.parts(tokens))

    def added(self, parts: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[pa.ListArray, pa.ListArray]:
        """The same for parts as ``Numbered`` gives them."""
        sizes, indices, counts = [np.zeros(1, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for rows, owner, numbers in parts:
            single = self.place[numbers]
            keys = [(owner * self.size + single)[single >= 0]]
            if len(self.codes):
                of, code = self.numbered.pairs(owner, numbers)
                near = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
                hit = self.codes[near] == code
                keys.append(of[hit] * self.size + self.pairs[near[hit]])
            key, n = np.unique(np.concatenate(keys), return_counts=True)
            sizes.append(np.bincount(key // max(self.size, 1), minlength=len(rows)))
            indices.append(key % max(self.size, 1))
            counts.append(n)
        ends = pa.array(np.cumsum(np.concatenate(sizes)), pa.int32())
        listed = lambda values, kind: pa.ListArray.from_arrays(ends, pa.array(np.concatenate(values).astype(kind)))
        return listed(indices, np.int32), listed(counts, np.float64)


def count_tokens(df: DataFrame, book: TermBook, tokens: str = "tokens") -> DataFrame:
    """Replace the tokens by ``indices`` and ``counts`` of the vocabulary terms of the row: words and pairs of neighbours."""
    shared = df.sparkSession.sparkContext.broadcast(book)  # as long as the vocabulary
    rows = df.select(*[c for c in df.columns if c != tokens], tokens)
    kept = len(rows.columns) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:kept], *shared.value.counts(batch.column(kept))], names=[*batch.schema.names[:kept], "indices", "counts"])

    added = T.StructType.fromDDL("indices array<int>, counts array<double>")
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:kept], *added.fields]))


def code_tokens(df: DataFrame, train: Column, tokens: str, stop_words: Sequence[str] = ()) -> DataFrame:
    """(kept, CODED): the rows in blocks of TOKENS tokens or a single row each, tokens as places in the words of their block.

    ``kept`` are the other columns.  Later passes look at the words of a block, not at every token as a text; ``totals``
    says how often each occurs on the ``train`` side.  Stop words are dropped before neighbours are told.
    """
    others = [c for c in df.columns if c != tokens]
    rows = df.select(F.struct(*others).alias("kept"), F.coalesce(train, F.lit(False)).alias("_train"), F.col(tokens).alias("_tokens"))
    stops, added = pa.array(list(stop_words), pa.string()), T.StructType.fromDDL(CODED)
    names = added.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, train, tokens = (batch.column(k) for k in range(3))
            sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends, flat, side = np.concatenate([[0], np.cumsum(sizes)]), tokens.flatten().cast(pa.string()), train.to_numpy(zero_copy_only=False)
            begin = 0
            while begin < len(sizes):
                end = min(len(sizes), max(begin + 1, int(np.searchsorted(ends, ends[begin] + TOKENS, side="right")) - 1))
                coded = flat.slice(ends[begin], ends[end] - ends[begin]).dictionary_encode()
                words, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
                stays = ~pc.is_in(words, value_set=stops).to_numpy(zero_copy_only=False)[codes]
                owner = np.repeat(np.arange(end - begin), sizes[begin:end])[stays]
                codes = codes[stays]
                totals = np.bincount(codes[side[begin:end][owner]], minlength=len(words))
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(pa.array([0, end - begin], pa.int32()), kept.slice(begin, end - begin)), pa.array([end - begin], pa.int64()),
                     pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words),
                     pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pa.array(totals.astype(np.int64))),
                     *[pa.array([x.tobytes()], pa.binary()) for x in (
                         np.bincount(owner, minlength=end - begin).astype(np.int32), side[begin:end].astype(np.bool_), codes.astype(np.int32))]],
                    names=["kept", *names])
                begin = end

    return rows.mapInArrow(run, T.StructType([T.StructField("kept", T.ArrayType(rows.schema["kept"].dataType)), *added.fields]))


def _block(batch: pa.RecordBatch, k: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, tokens per row, side of each row, row of each token and place of its word."""
    read = lambda name, kind: np.frombuffer(batch.column(name)[k].as_buffer(), kind)
    sizes = read("sizes", np.int32).astype(np.int64)
    return batch.column("words")[k].values.cast(pa.string()), sizes, read("train", np.bool_), np.repeat(np.arange(len(sizes)), sizes), read("codes", np.int32)


def fit_vocabulary_of_coded(coded: DataFrame, size: int) -> list[str]:
    """``fit_vocabulary_of_tokens`` for the train side of stored ``code_tokens``."""
    each = coded.select(F.explode(F.arrays_zip("words", "totals")).alias("e")).select(F.col("e.words").alias("term"), F.col("e.totals").alias("n"))
    totals = materialise(each.where("n > 0").groupBy("term").agg(F.sum("n").alias("n")), "word-totals")

    def pairs_of(known: list[str]) -> DataFrame:
        shared = coded.sparkSession.sparkContext.broadcast(Numbered(known))

        def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
            for batch in batches:
                for k in range(batch.num_rows):
                    words, _, train, owner, places = _block(batch, k)
                    yield shared.value.pairs(owner, np.where(train[owner], shared.value.of(words)[places], -1))[1]

        blocks = coded.select("words", "sizes", "train", "codes")
        return blocks.mapInArrow(lambda batches: added_codes(codes(batches)), "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))

    def all_terms() -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    words, sizes, train, owner, places = _block(batch, k)
                    ends = np.concatenate([[0], np.cumsum(sizes[train])])
                    yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words.take(pa.array(places[train[owner]])))], names=["_tokens"])

        tokens = coded.select("words", "sizes", "train", "codes").mapInArrow(run, "_tokens array<string>")
        return with_ngrams(tokens, "_tokens", "terms")

    return _cut_vocabulary(totals, size, pairs_of, all_terms)


def count_coded(coded: DataFrame, book: TermBook) -> DataFrame:
    """The rows of ``code_tokens`` with ``indices`` and ``counts``, as ``count_tokens`` gives them."""
    shared = coded.sparkSession.sparkContext.broadcast(book)  # as long as the vocabulary
    kept = coded.schema["kept"].dataType.elementType
    names = [*kept.names, "indices", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                words, sizes, _, owner, places = _block(batch, k)
                found = shared.value.added([(sizes, owner, shared.value.numbered.of(words)[places])])
                yield pa.RecordBatch.from_arrays([*batch.column("kept")[k].values.flatten(), *found], names=names)

    added = T.StructType.fromDDL("indices array<int>, counts array<double>")
    return coded.select("kept", "words", "sizes", "train", "codes").mapInArrow(run, T.StructType([*kept.fields, *added.fields]))


def term_counter(vocabulary: Sequence[str], terms: str = "terms") -> CountVectorizerModel:
    """The dictionary of the vocabulary, sent to the JVM in one piece: terms hold no line ends."""
    jvm = SparkContext._active_spark_context._jvm
    words = jvm.java.util.regex.Pattern.compile("\n").split("\n".join(vocabulary))
    model = CountVectorizerModel._create_from_java_class("org.apache.spark.ml.feature.CountVectorizerModel", words)
    return model.setInputCol(terms).setOutputCol("_vector")


def count_arrays(df: DataFrame, model: CountVectorizerModel) -> DataFrame:
    """Replace the terms by ``indices`` and ``counts`` of the vocabulary terms of the row."""
    terms = model.getInputCol()
    others = [c for c in df.columns if c != terms]
    vector = F.unwrap_udt(F.col("_vector"))
    return model.transform(df).select(*others, vector.alias("_v")).select(
        *others, F.col("_v.indices").alias("indices"), F.col("_v.values").alias("counts")
    )


def idf_smooth(counted_train: DataFrame) -> DataFrame:
    """(idx, df, idf) with idf = ln((1 + N) / (1 + df)) + 1, from the train side only."""
    n = counted_train.agg(F.count(F.lit(1)).cast("double")).scalar()
    per_term = explode_terms(counted_train, "indices", "idx").groupBy("idx").agg(F.count(F.lit(1)).alias("df"))
    return per_term.select("idx", "df", (F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + 1.0).alias("idf"))


def idf_array(idf: DataFrame) -> Column:
    """All idf values in index order as one value: as long as the vocabulary."""
    ordered = F.array_sort(F.collect_list(F.struct("idx", "idf")))
    return idf.agg(F.transform(ordered, lambda s: s["idf"])).scalar()


def weight_arrays(counted: DataFrame, idf: DataFrame) -> DataFrame:
    """Replace ``counts`` by ``weights``: (1 + ln count) x idf, divided by the row's Euclidean norm."""
    others = [c for c in counted.columns if c != "counts"]
    raw = F.zip_with("indices", "counts", lambda i, c: (F.log(c) + 1.0) * F.get(F.col("_idf"), i))
    norm = F.sqrt(F.aggregate("_raw", F.lit(0.0), lambda acc, w: acc + w * w))
    norms = F.array_repeat(norm, F.size("_raw"))  # an array, so that the norm is computed once per row
    return (
        counted.withColumn("_idf", idf_array(idf))
        .select(*others, raw.alias("_raw"))
        .select(*others, F.zip_with("_raw", norms, lambda w, n: w / n).alias("weights"))
    )


def long_form(weighted: DataFrame, *keep: str) -> DataFrame:
    """One row per (claim, term index)."""
    exploded = explode_terms(weighted, F.arrays_zip("indices", "weights"), "e", *keep)
    return exploded.select(*keep, F.col("e.indices").alias("idx"), F.col("e.weights").alias("weight"))


def write_features(weighted: DataFrame, vocabulary_size: int) -> tuple[DataFrame, DataFrame]:
    """Write the features once and return two readings of the same files.

    A sparse vector column is stored in Parquet as a struct of its parts.  Writing that struct and
    reading it with the vector type turns arrays into ML vectors without any user function.
    """
    spark = weighted.sparkSession
    others = [c for c in weighted.columns if c not in ("indices", "weights")]
    vector = F.struct(
        F.lit(0).cast("tinyint").alias("type"), F.lit(vocabulary_size).alias("size"),
        F.col("indices"), F.col("weights").alias("values"),
    )
    stored = weighted.select(*others, vector.alias("features"))
    path = new_path(spark, "features")
    stored.write.parquet(path)
    fields = [f for f in stored.schema.fields if f.name != "features"]
    vectors = spark.read.schema(T.StructType([*fields, T.StructField("features", VectorUDT())])).parquet(path)
    arrays = spark.read.schema(stored.schema).parquet(path).select(
        *others, F.col("features.indices").alias("indices"), F.col("features.values").alias("weights")
    )
    return vectors, arrays


def fit_label_encoder(train: DataFrame, label: str = "tag_clean") -> StringIndexerModel:
    """Classes in alphabetical order; a label not seen in training is an error when encoding."""
    indexer = StringIndexer(
        inputCol=label, outputCol="label", stringOrderType="alphabetAsc", handleInvalid="error"
    )
    return indexer.fit(train)


def encode_labels(df: DataFrame, encoder: StringIndexerModel) -> DataFrame:
    return encoder.transform(df)


def decode_labels(df: DataFrame, labels: Sequence[str], index: str = "prediction", out: str = "predicted") -> DataFrame:
    """Index back to class name."""
    names = F.array(*[F.lit(name) for name in labels])
    return df.withColumn(out, F.get(names, F.col(index).cast("int")))
