import hashlib
import zlib
from functools import partial

import duckdb
import pyarrow as pa
import pytest

from claimsift.llm import merkle_manifest as mm
from claimsift.llm import queries
from tests.llm.conftest import DOCS, document, sentence


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, more=0):
    doc_id, text, lang, source, n_chars = row[:5]
    values = [doc_id, source, lang, None if n_chars is None else n_chars + more, text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes):
    """All levels of the tree over ``nodes``, built in pairs."""
    found = [nodes]
    while len(found[-1]) > 1:
        below = found[-1]
        found.append([sha("".join(below[k:k + 2])) for k in range(0, len(below), 2)])
    return found


def walk(tree, at):
    path = []
    for level in tree[:-1]:
        path.append((at & 1, level[at ^ 1] if at ^ 1 < len(level) else None))
        at >>= 1
    return path


def brute(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in langs}
    trees = {x: levels([leaf(r) for r in groups[x]]) for x in langs}
    top = levels([trees[x][-1][0] for x in langs])
    found = []
    for k, x in enumerate(langs):
        for at, row in enumerate(groups[x]):
            path = walk(trees[x], at) + walk(top, k)
            crc = zlib.crc32(b"" if row[0] is None else str(row[0]).encode())
            node = leaf(row, int(crc % 7 == 0))
            for right, sibling in path:
                node = sha(node if sibling is None else sibling + node if right else node + sibling)
            found.append((row[0], leaf(row), trees[x][-1][0], top[-1][0], sha("".join(s or "" for _, s in path)), node, node == top[-1][0]))
    return found


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.fixture
def rows(odd_rows):
    made = list(odd_rows)
    for k in range(20, 120):
        row = list(document(k, sentence(k, 5)))
        row[2] = [None, "de", "en", "é", "zz"][k % 5 if k < 110 else 2]
        made.append(tuple(row))
    return made + [(300, None, "alone", None, None, *made[0][5:]), (301, "x", "", "s", 1, *made[0][5:])]


@pytest.mark.parametrize("height", [1, 2, 12])
def test_query_equals_brute_force(spark, rows, monkeypatch, height):
    """Small blocks make several rounds of appends and many blocks."""
    monkeypatch.setattr(queries, "documents", lambda *_: spark.createDataFrame(rows, DOCS).repartition(4))
    monkeypatch.setattr(mm, "manifest", partial(mm.manifest, height=height))
    found = queries.op12_merkle_manifest(spark, "")
    assert in_order(map(tuple, found.collect())) == in_order(brute(rows))
    assert {r.verified for r in found.collect()} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13, 100])
def test_appends(n):
    hashes = [sha(str(k)) for k in range(n)]
    block = mm.Appends(n)
    for k, h in enumerate(hashes):
        block.append(k, h)
    tree = levels(hashes)
    assert block.root() == tree[-1][0]
    for k, h in enumerate(hashes):
        assert bytes(block.witnesses[k]) == b"".join(bytes.fromhex(s) for _, s in walk(tree, k) if s)
        assert mm.fold(h, bytes(block.witnesses[k]), [(k, n), (0, 1)]) == tree[-1][0]


def test_more_rows_than_a_block_and_a_batch(spark):
    n = 12_345
    rows = [(k, str(k), "en" if k % 3 else None, "s", k) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = mm.verify(mm.manifest(docs)).collect()
    want = {r[0]: r for r in brute(rows)}
    assert len(got) == n
    assert all(r.folded_root == r.root == want[r.doc_id][3] and r.subroot == want[r.doc_id][2] for r in got)
    assert all(sha(r.witness.hex()) == want[r.doc_id][4] for r in got)


def test_empty_table_and_one_row(spark, empty):
    assert mm.verify(mm.manifest(empty)).collect() == []
    (one,) = mm.verify(mm.manifest(spark.createDataFrame([document(1, "x")], DOCS))).collect()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.witness == b""


def test_sql_equals_brute_force(rows):
    known = [r for r in rows if r[0] is not None]
    types = dict(doc_id=pa.int64(), text=pa.string(), lang=pa.string(), source=pa.string(), n_chars=pa.int64())
    con = duckdb.connect()
    con.register("documents", pa.table({c: pa.array([r[k] for r in known], t) for k, (c, t) in enumerate(types.items())}))
    assert in_order(con.sql(queries.ORACLES["op12_merkle_manifest"]).fetchall()) == in_order(brute(known))
