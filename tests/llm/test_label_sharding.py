import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from claimsift.llm import label_sharding as ls
from claimsift.llm import queries
from tests.llm.conftest import DOCS, document, rows_of, sentence


def size(text):
    return len((text or "").encode()) + 1


def held(rows, shards=8):
    """What the law and the numbering ask for, by counting; returns bytes per shard and shards per text."""
    loads, slots, places = Counter(), defaultdict(list), defaultdict(Counter)
    for r in rows:
        loads[r.shard] += r.size
        slots[r.shard].append(r.slot)
        places[(r.size, r.text_crc32)][r.shard] += 1
    assert set(loads) <= set(range(shards))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    return [loads[s] for s in range(shards)], places


def test_query_on_copies_and_singles(spark, monkeypatch):
    """A text with a third of all rows, groups of two to forty copies, texts of very different length."""
    rows = [document(k, f"n{k} {sentence(k, 2 + (k * k) % 300)}") for k in range(1500)]
    rows += [document(5000 + 50 * g + c, f"g{g} {sentence(g, 40 + g)}") for g in range(60) for c in range(2 + g % 39)]
    rows += [document(20_000 + k, sentence(99_999, 150)) for k in range(900)]
    monkeypatch.setattr(queries, "documents", lambda *_: spark.createDataFrame(rows, DOCS).repartition(5))
    found = queries.op13_label_sharding(spark, "")
    assert found.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    got = found.collect()
    texts = {r[0]: r[1] for r in rows}
    assert sorted(r.doc_id for r in got) == sorted(texts)
    assert all(r.size == size(texts[r.doc_id]) and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in got)
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}
    loads, places = held(got)
    mean = sum(loads) / 8
    assert max(loads) - min(loads) <= 0.005 * mean
    hot = places.pop((size(rows[-1][1]), zlib.crc32(rows[-1][1].encode())))
    least = -(-900 * size(rows[-1][1]) // (mean * 1.01))  # shards that the large group needs in any case
    assert len(hot) <= least + 1
    assert sum(len(p) > 1 for p in places.values()) <= 2


def test_reruns_and_partitions_agree(odd):
    columns = ["doc_id", "size", "text_crc32", "shard"]
    assert rows_of(ls.balanced_shards(odd), *columns) == rows_of(ls.balanced_shards(odd.repartition(7)), *columns)


def test_odd_rows(odd, odd_rows, empty):
    got = ls.balanced_shards(odd, 3).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], size(r[1])) for r in odd_rows)
    held(got, 3)
    assert len({r.shard for r in got if r.doc_id in (1, 2)}) == 1
    assert ls.balanced_shards(empty).collect() == []


@pytest.mark.parametrize("copies", [2, 3])
def test_every_row_has_copies(spark, copies):
    rows = [document(10 * k + c, f"n{k} {sentence(k, 3 + k % 90)}") for k in range(600) for c in range(copies)]
    loads, places = held(ls.balanced_shards(spark.createDataFrame(rows, DOCS), 4).collect(), 4)
    assert max(loads) - min(loads) <= 0.03 * sum(loads) / 4
    assert sum(len(p) > 1 for p in places.values()) <= 100


def test_one_text_only(spark):
    rows = [document(k, "same") for k in range(1000)]
    loads, _ = held(ls.balanced_shards(spark.createDataFrame(rows, DOCS)).collect())
    assert max(loads) - min(loads) <= 2 * 5


def test_fill_evens_loads_out(spark):
    rng = np.random.default_rng(1)
    sizes = (rng.pareto(1.1, 3000) * 50 + 1).astype(int)
    table = spark.createDataFrame([(bytes(str(k), "ascii"), int(s)) for k, s in enumerate(sizes)], "digest binary, size long")
    loads = np.array([0.0, 9000, 100, 30_000])
    found = ls.fill(table, loads).collect()
    assert sorted((r.digest, r.size) for r in found) == sorted((bytes(str(k), "ascii"), int(s)) for k, s in enumerate(sizes))
    for r in found:
        loads[r.shard] += r.size
    assert loads.max() - loads.min() <= max(20, sizes.max() - sizes.sum() / 4)


def test_flows_keep_quotas():
    rng = np.random.default_rng(2)
    for _ in range(50):
        wanted, room = rng.integers(0, 100, (8, 8)) * (1 - np.eye(8)), rng.integers(-20, 60, 8)
        got = ls.flows(wanted, room)
        assert (got <= wanted + 1e-9).all() and (got.sum(axis=0) <= np.maximum(room + got.sum(axis=1), 0) * 1.001 + 1e-6).all()
