import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from claimsift.llm import simhash_trie as st
from claimsift.llm.common import connected_components
from tests.llm.conftest import document, rows_of, DOCS, sentence


def brute_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius):
    group = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i in range(len(prints)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= radius and group[i] != group[j]:
                    group[i] = group[j] = min(group[i], group[j])
                    changed = True
    return group


def test_odd_rows(odd, odd_rows):
    found = st.near_duplicates(odd).select("doc_id", st.hexadecimal(F.col("fingerprint")), "component_id", "n_links")
    prints = [brute_print(r[1]) for r in odd_rows]
    groups = brute_components(prints, 2)
    want = []
    for k, row in enumerate(odd_rows):
        members = [odd_rows[j][0] for j in range(len(odd_rows)) if groups[j] == groups[k]]
        links = sum((p ^ prints[k]).bit_count() <= 2 for p in prints) - 1
        want.append((row[0], f"{prints[k]:016x}", min((m for m in members if m is not None), default=None), links))
    assert rows_of(found, *found.columns) == sorted(want, key=lambda r: tuple((v is None, str(v)) for v in r))


def test_empty_table(empty):
    assert st.near_duplicates(empty).collect() == []
    assert st.keep_one(empty).collect() == []


@pytest.mark.parametrize("leaf", [2, 16, 4096])
def test_links_span_all_close_pairs(spark, leaf):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    values = {int(c) ^ (1 << int(a)) ^ (1 << int(b)) for c in centres for a, b in rng.integers(0, 64, (30, 2))}
    values |= {int(v) for v in rng.integers(0, 1 << 63, 200, dtype=np.uint64)} | {0, (1 << 64) - 1, 1 << 63}
    values = sorted(values)
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    copies = [1 + k % 4 for k in range(len(signed))]
    table = spark.createDataFrame(list(zip(signed, copies, strict=True)), "value long, n long")
    forest, partners = st.links(table, 2, leaf)
    near = {signed[i]: sum(copies[j] for j, w in enumerate(values) if j != i and (v ^ w).bit_count() <= 2) for i, v in enumerate(values)}
    assert dict(partners.collect()) == {v: n for v, n in near.items() if n}
    got = dict(connected_components(forest).collect())
    groups = brute_components(values, 2)
    assert [signed[g] if sum(h == g for h in groups) > 1 else None for g in groups] == [
        None if v not in got else min((w for w in signed if got.get(w) == got[v]), key=lambda w: signed.index(w)) for v in signed]


def test_components_of_chains_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 150)] + [(7, 7), (100, 101), (None, 3)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 150), 100)}


def test_one_of_each_group_stays(spark, odd, odd_rows):
    kept = st.keep_one(odd)
    assert kept.columns == odd.columns
    # 1 and 2 are copies; 3, 4, 5 and a nameless row are blank; 6 is there twice; the other nameless row is alone.
    assert [r[0] for r in rows_of(kept, "doc_id")] == [1, 10, 3, 6, 7, 8, 9, None]
    nameless = spark.createDataFrame([document(None, sentence(1, 20)), document(None, sentence(1, 20)), document(None, sentence(9, 20))], DOCS)
    assert st.keep_one(nameless).count() == 2


def test_stage_keeps_one_of_each_component(spark):
    from corpus_pipeline import near_dedup

    rng = np.random.default_rng(3)
    texts = []
    for k in range(12):
        words = [f"w{x}" for x in rng.integers(0, 5000, 900)]
        texts.append(" ".join(words))
        for changed in (1, 1, 2, 40):
            edited = list(words)
            for at in rng.choice(len(words), changed, replace=False):
                edited[at] = f"x{rng.integers(0, 5000)}"
            texts.append(" ".join(edited))
    texts += [None, "", "  ", "one word", "One  word", "other words", "a a a a a a a a a", "a a a a a"]
    group = brute_components([brute_print(t) for t in texts], 2)
    assert len(set(group)) < len(texts) - 20
    rows = [document(k, t) for k, t in enumerate(texts)]
    kept = near_dedup(spark, spark.createDataFrame(rows, DOCS).repartition(5), "")
    assert [r[0] for r in kept.orderBy("doc_id").select("doc_id").collect()] == sorted(set(group))
    nameless = [document(None, t) for t in texts]
    assert near_dedup(spark, spark.createDataFrame(nameless, DOCS).repartition(5), "").count() == len(set(group))
    assert near_dedup(spark, spark.createDataFrame([], DOCS), "").collect() == []
