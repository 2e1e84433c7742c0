import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as s

from claimsift.llm import benchmark_suffixes as bs
from tests.llm.conftest import rows_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def cut(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window=13):
    words, hit, found = cut(text), set(), set()
    for name, item in items:
        other = cut(item)
        size = min(window, len(other))
        for at in range(len(other) - size + 1 if size else 0):
            for k in range(len(words) - size + 1):
                if words[k:k + size] == other[at:at + size]:
                    hit |= set(range(k, k + size))
                    found.add(name or "")
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes,shard_words", [(8 << 20, 1 << 20), (40, 5)])
def test_against_brute_force(spark, odd, odd_rows, block_bytes, shard_words):
    items = [("b1", odd_rows[0][1][20:260]), ("b1", odd_rows[0][1][20:260]), ("b2", "THE the"), (None, "word"), ("b3", None), ("b4", " ,; "), ("b5", odd_rows[8][1])]
    benchmark = spark.createDataFrame([(a, b, 1) for a, b in items], "item_id string, text string, row int")
    got = bs.scan(odd, benchmark, block_bytes=block_bytes, shard_words=shard_words)
    want = [(r[0], *brute(r[1], items)) for r in odd_rows]
    assert rows_of(got, "row.doc_id", "n_words", "n_hit", "items") == sorted(want, key=lambda r: tuple((v is None, str(v)) for v in r))
    clean = sorted(str(w[0]) for w in want if not (w[2] > 0 and 20 * w[2] >= w[1]))
    kept = bs.decontaminate(odd, benchmark)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == clean


def test_longest_matches_and_places(spark):
    item = "a1 b2 c3 d4 e5 f6"
    docs = spark.createDataFrame([(1, "x a1 b2 c3 y b2 c3 d4 e5 z")], "doc_id long, text string")
    got = bs.scan(docs, spark.createDataFrame([("i", item)], "item_id string, text string"), window=3).first()
    assert [tuple(m) for m in got.matches] == [("i", 1, 5, 4)]
    assert [tuple(m) for m in got.spans] == [(1, 4), (5, 9)] and got.n_hit == 7


def test_empty_tables(spark, odd, empty):
    none = spark.createDataFrame([], "item_id string, text string")
    assert bs.scan(empty, none).collect() == []
    assert {(r.n_hit, r.contaminated) for r in bs.scan(odd, none).collect()} == {(0, False)}


@settings(max_examples=60, deadline=None)
@given(s.lists(s.integers(0, 3), min_size=1, max_size=40), s.integers(1, 6))
def test_suffix_array_orders_suffixes(values, depth):
    stream = np.array(values, np.int64)
    suffix = lambda k: (values[k:k + depth] + [0] * depth)[:depth]
    order = bs.suffix_array(stream, depth).tolist()
    assert [suffix(k) for k in order] == sorted(suffix(k) for k in range(len(values)))
    low, high = bs.equal_ranges(stream, np.array(order), np.array([suffix(0)]))
    assert sorted(order[low[0]:high[0]]) == [k for k in range(len(values)) if suffix(k) == suffix(0)]
