import itertools
import math
from collections import Counter

import numpy as np
import pytest

from claimsift.llm import hidden_markov as hm
from claimsift.llm.common import py_remainder
from tests.llm.conftest import DOCS, document, sentence

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [w.decode() for w in (text or "").translate(LOWER).encode().split()] + [None]


def brute(rows):
    seen = Counter(t for r in rows if py_remainder(r[0], 10) for t in tokens(r[1]))
    n, v = sum(seen.values()), len(seen)
    return [(sum(math.log10((seen[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens(r[1])), len(tokens(r[1])), sum(seen[t] > 0 for t in tokens(r[1])), n) for r in rows]


@pytest.mark.parametrize("frequent", [3, 1000])
def test_base_score_and_counts(spark, odd, odd_rows, frequent):
    got = hm.score(odd, states=2, frequent=frequent, rounds=1).collect()
    want = sorted((str(r[0]), b[1], b[2], b[3], round(b[0], 6)) for r, b in zip(odd_rows, brute(odd_rows), strict=True))
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.held_out == (py_remainder(r.doc_id, 10) == 0) and r.score <= 0 for r in got)


def test_forward_is_the_sum_over_all_paths():
    rng = np.random.default_rng(1)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    model = hm.Model(norm(rng.random(3), 0), norm(rng.random((3, 3)), 1), norm(rng.random((5, 3)), 0))
    sequences = [[4], [0, 1, 4], [2, 2, 3, 1, 4], [3, 4]]
    want = [math.log10(sum(
        model.start[path[0]] * math.prod(model.steps[a, b] for a, b in itertools.pairwise(path)) * math.prod(model.emit[c, s] for c, s in zip(seq, path, strict=True))
        for path in itertools.product(range(3), repeat=len(seq)))) for seq in sequences]
    got = model.log10(np.concatenate(sequences), np.cumsum([0, *map(len, sequences)]))
    assert np.allclose(got, want)


def test_rounds_raise_the_likelihood_and_counts_are_whole():
    rng = np.random.default_rng(2)
    flat = rng.integers(0, 3, 900) + 3 * (np.arange(900) // 150 % 2)  # two regimes
    offsets = np.array([0, 300, 500, 900])
    overall = np.full(6, 1 / 6)
    model = hm.first_model(flat, offsets, overall, 2, 0)
    before = model.log10(flat, offsets).sum()
    emit, steps, start = np.zeros((6, 2)), np.zeros((2, 2)), np.zeros(2)
    for pieces in hm.cut(flat, offsets):
        model.expect(pieces, emit, steps, start)
    assert emit.sum() == pytest.approx(900) and start.sum() == pytest.approx(3)
    assert np.allclose(emit.sum(axis=1), np.bincount(flat, minlength=6))
    assert steps.sum() == pytest.approx(900 - len([0 for p in hm.cut(flat, offsets) for _ in p]))
    assert hm.first_model(flat, offsets, overall, 2, 5).log10(flat, offsets).sum() > before


def test_two_languages_beat_the_base_on_held_out_texts(spark):
    other = str.maketrans("aeiou", "äëïöü")
    rows = [document(k, sentence(k, 40 + k % 50) if k % 2 else sentence(k, 40 + k % 50).translate(other)) for k in range(300)]
    held = [r for r in hm.score(spark.createDataFrame(rows, DOCS), states=4, frequent=1000, rounds=1).collect() if r.held_out]
    assert len(held) > 10 and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_the_start_is_the_same_however_rows_lie(spark, monkeypatch):
    monkeypatch.setattr(hm, "SAMPLE_TOKENS", 300)
    monkeypatch.setattr(hm, "SAMPLE_TEXTS", 20)
    rows = [(k % 50, list(range(k % 50, 30 + k % 50))) for k in range(200)] + [(None, [7, 8])] * 3 + [(3, [1])]
    table = spark.createDataFrame([(((k,), c)) for k, c in rows], "doc struct<doc_id:long>, classes array<int>")
    found = []
    for parts in (1, 5):
        keyed = table.repartition(parts).withColumn("key", hm.F.monotonically_increasing_id())
        tokens, offsets = hm.start_sample(hm.materialise(keyed, "rows"), 50)
        found.append((tokens.tolist(), offsets.tolist()))
    assert found[0] == found[1] and 0 < len(found[0][0]) <= 300 and len(found[0][1]) > 5
    assert len({tuple(found[0][0][a:b]) for a, b in itertools.pairwise(found[0][1])}) == len(found[0][1]) - 1  # an id once


def test_empty_table(empty):
    assert hm.score(empty, states=2, rounds=1).collect() == []
