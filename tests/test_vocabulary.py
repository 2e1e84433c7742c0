import numpy as np
import pytest
from pyspark.sql import functions as F

from claimsift.functions.text import with_tokens
from claimsift.operators import features, models
from claimsift.operators.newton import Loss
from tests.test_stochastic import made, vectors


@pytest.fixture(scope="module")
def tokens(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{k}" for k in np.minimum(rng.zipf(1.4, n), 300)) for n in rng.integers(0, 60, 200)]
    rows = list(enumerate([*texts, None, "", "aa aa aa aa bb", "aa aa", "w1 ä w2 über w1"]))
    df = spark.createDataFrame(rows, "claim_id long, claim string").repartition(7)
    return models.materialise(with_tokens(df, "claim", "tokens", ["w3"]).drop("claim"), "tokens")


@pytest.mark.parametrize("size", [1, 5, 40, 150, 250, 1000, 100_000])
def test_vocabulary_of_tokens_is_that_of_all_terms(spark, tokens, size):
    terms = features.with_ngrams(tokens, "tokens", "terms").drop("tokens")
    vocabulary = features.fit_vocabulary(terms, size)
    assert features.fit_vocabulary_of_tokens(tokens, size) == vocabulary
    counted = features.count_arrays(terms, features.term_counter(vocabulary))
    found = features.count_tokens(tokens, features.TermBook(vocabulary)).select(counted.columns)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, counted.collect()))


def test_pairs_are_counted_of_the_given_words_only(spark, tokens):
    found = {r["code"]: r["n"] for r in features.pair_totals(tokens, ["aa", "w1"]).collect()}
    assert found[0] == 4 and set(found) <= {0, 1, 2, 3}


def test_tokens_without_rows(spark, tokens):
    none = tokens.limit(0)
    assert features.fit_vocabulary_of_tokens(none, 5) == []
    counted = features.count_tokens(tokens, features.TermBook([]))
    assert counted.where(F.size("indices") > 0).isEmpty() and counted.count() == tokens.count()


def test_a_long_row_is_a_part_of_its_own(monkeypatch, tokens):
    whole = features.TermBook(["aa", "aa aa", "w1", "w1 w2"])
    batch = tokens.select("tokens").toArrow().combine_chunks().column("tokens").chunk(0)
    before = [x.to_pylist() for x in whole.counts(batch)]
    monkeypatch.setattr(features, "TOKENS", 3)
    assert [x.to_pylist() for x in whole.counts(batch)] == before


def test_rows_that_are_kept_are_not_kept_twice(spark):
    kept = vectors(spark, made(50, 10, 2, 1), 10, 2).persist()
    loss = Loss(kept, 10, 2, lambda n: 1.0)
    try:
        assert not loss.own and not loss.data.is_cached and loss.at(np.zeros((11, 2))).loss > 0
    finally:
        loss.close()
    assert kept.is_cached
    kept.unpersist()


@pytest.mark.parametrize("size", [1, 40, 250, 100_000])
def test_coded_tokens_give_what_tokens_give(spark, monkeypatch, size):
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{k}" for k in np.minimum(rng.zipf(1.4, n), 300)) for n in rng.integers(0, 60, 120)]
    rows = [(k, None if k % 5 == 0 else k % 3 > 0, x) for k, x in enumerate([*texts, None, "", "w3 w3", "w1 w3 w2 ÄÖ äö", "w1 w2", "w1 w2"])]
    df = spark.createDataFrame([*rows, *rows[-3:]], "claim_id long, learn boolean, claim string").repartition(5)
    plain = models.materialise(with_tokens(df, "claim", "tokens", ["w3"]).drop("claim"), "tokens")
    coded = models.materialise(features.code_tokens(with_tokens(df, "claim", "tokens").drop("claim"), F.col("learn"), "tokens", ["w3"]), "coded")
    assert coded.count() <= 5 and "w3" not in [r[0] for r in coded.select(F.explode(F.arrays_zip("words", "totals")).alias("e")).where("e.totals > 0").select("e.words").collect()]
    vocabulary = features.fit_vocabulary_of_tokens(plain.where("learn"), size, "tokens")
    assert features.fit_vocabulary_of_coded(coded, size) == vocabulary
    wanted = features.count_tokens(plain, features.TermBook(vocabulary))
    found = features.count_coded(coded, features.TermBook(vocabulary))
    assert found.columns == wanted.columns and sorted(map(str, found.collect())) == sorted(map(str, wanted.collect()))


def test_training_stores_no_token_as_a_text(spark):
    df = spark.createDataFrame([(1, "aa bb aa"), (2, None)], "claim_id long, claim string")
    kept, make = {}, models.materialise
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(models, "materialise", lambda x, name: kept.setdefault(name, make(x, name)))
        vectoriser, counted = models.fit_vectoriser(df, 10, ["zz"], masks=())
    assert vectoriser.vocabulary == ["aa", "aa bb", "bb", "bb aa"] and counted.count() == 2
    assert kept["tokens"].agg(F.sum(F.size("words"))).first()[0] == 2 and "_tokens" not in kept["tokens"].columns
