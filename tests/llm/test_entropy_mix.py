import pytest

from claimsift.llm import entropy_mix as em
from tests.llm.conftest import DOCS, document, rows_of, sentence


def brute_targets(sizes):
    order = sorted((x for x in sizes if x is not None)) + [None] * (None in sizes)
    weight = {x: (5, 2, 1)[k % 3] for k, x in enumerate(order)}
    total, stopped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[x] for x in stopped)
        share = {x: rest * weight[x] / sum(weight[y] for y in order if y not in stopped) for x in order if x not in stopped}
        above = {x for x in share if share[x] > 3 * sizes[x]}
        if not above:
            return {**{x: 3.0 * sizes[x] for x in stopped}, **share}
        stopped |= above


def test_targets_and_taken_words(spark):
    rows = [document(k, sentence(k, 5 + k * 37 % 90), f"s{k % 5}" if k % 5 else "s0") for k in range(400)]
    rows += [document(1000 + k, sentence(k, 10), None) for k in range(3)]
    got = em.mix(spark.createDataFrame(rows, DOCS)).collect()
    sizes, sources = {}, {r[0]: r[3] for r in rows}
    for r in got:
        sizes[sources[r.doc_id]] = sizes.get(sources[r.doc_id], 0) + r.size
    want = brute_targets(sizes)
    for source, size in sizes.items():
        mine = [r for r in got if sources[r.doc_id] == source]
        assert {r.source_size for r in mine} == {size}
        assert mine[0].target == pytest.approx(want[source])
        assert abs(sum(r.taken for r in mine) - want[source]) <= max(r.size for r in mine) / 2 + 1e-6
        assert max(abs(r.rate - want[source] / size) for r in mine) < 1e-9
    assert all(r.taken == r.copies * r.size and 0 <= r.copies <= 3 for r in got)


def test_reruns_and_partitions_agree(odd):
    assert rows_of(em.mix(odd), "doc_id", "size", "taken") == rows_of(em.mix(odd.repartition(7)), "doc_id", "size", "taken")


def test_odd_rows(odd, odd_rows):
    got = em.mix(odd)
    assert rows_of(got, "doc_id", "size") == sorted(
        ((r[0], len((r[1] or "").encode().split())) for r in odd_rows), key=lambda r: tuple((v is None, str(v)) for v in r))
    mixed = em.mixed(odd)
    assert [c for c in mixed.columns if c not in ("size", "target", "copies")] == [c for c in odd.columns if c not in ("size", "copies")]
    assert all(r.copies > 0 for r in mixed.collect())


def test_tables_without_words(spark, empty):
    assert em.mix(empty).collect() == [] and em.mixed(empty).collect() == []
    blank = spark.createDataFrame([document(1, None), document(2, "", "s1")], DOCS)
    assert rows_of(em.mix(blank), "doc_id", "target", "taken") == [(1, 0.0, 0), (2, 0.0, 0)]
