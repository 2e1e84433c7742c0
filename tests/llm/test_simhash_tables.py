import hashlib

from pyspark.sql import functions as F

from claimsift.llm import simhash_tables as st
from tests.llm.conftest import DOCS, document, sentence


def check(rows, got):
    """Against the definition; ids are distinct or belong to equal rows."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5((r[1] or "").encode()).hexdigest()))
    prints = {r.doc_id: int(r.fingerprint, 16) for r in got}
    want = []
    for k, r in enumerate(order):
        text, after = r[1] or "", order[(k + 1) % len(order)]
        half = len(text) // 2
        edited = text[:len(text) - half] + (after[1] or "")[:half]
        near_next = 1 - (prints[r[0]] ^ prints[after[0]]).bit_count() / 128
        n_near = sum((prints[r[0]] ^ prints[o[0]]).bit_count() <= 3 for o in order) - 1 if r[0] is not None and r[0] % 50 == 0 else None
        want.append((r[0], len(text), hashlib.sha256(edited.encode()).hexdigest(), near_next, n_near))
    assert sorted([(r.doc_id, r.n_chars, r.edited_sha256, r.near_next, r.n_near) for r in got], key=str) == sorted(want, key=str)


def test_against_definition(spark, monkeypatch):
    monkeypatch.setattr(st, "BLOCK_ROWS", 7)
    rows = [document(k * 5, sentence(k % 40, 3 + k % 60)) for k in range(90)] + [document(1000, sentence(3, 6)), document(1050, sentence(3, 6))]
    check(rows, st.fingerprint_documents(spark.createDataFrame(rows, DOCS)).collect())
    taken = st.with_next(spark.createDataFrame(rows, DOCS).select("doc_id", "text"), 7)
    assert taken.count() == len(rows)


def test_odd_rows(spark, odd_rows):
    rows = [r for r in odd_rows if r[0] is not None] + [document(None, sentence(3, 50))]
    check(rows, st.fingerprint_documents(spark.createDataFrame(rows, DOCS)).collect())


def test_lone_document_and_empty_table(spark, empty):
    check([document(50, "abc def")], st.fingerprint_documents(spark.createDataFrame([document(50, "abc def")], DOCS)).collect())
    assert st.fingerprint_documents(empty).collect() == []


def test_tables_find_all_pairs_within_the_radius(spark):
    base = [(k * 0x9E3779B97F4A7C15, k * 0xC2B2AE3D27D4EB4F) for k in range(40)]
    flips = [(0, 0), (1 << 5, 0), (1 << 63, 1), (7, 0), (1 << 40, 3), (15, 0), (1, 7)]
    values = [((h ^ a) % (1 << 64), (l ^ b) % (1 << 64)) for h, l in base for a, b in flips]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    table = spark.createDataFrame([(signed(h), signed(l), 1) for h, l in values], "hi long, lo long, n long")
    got = sorted((r.hi, r.lo, r.other_hi, r.other_lo) for r in st.near(table.select("hi", "lo"), table).collect())
    near = lambda a, b: (a[0] ^ b[0]).bit_count() + (a[1] ^ b[1]).bit_count() <= 3
    assert got == sorted((signed(a[0]), signed(a[1]), signed(b[0]), signed(b[1])) for a in values for b in values if near(a, b))


def test_votes(spark):
    def brute(hashes):
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    text = sentence(5, 40)
    row = spark.createDataFrame([(1, text)], "key long, text string")
    words = row.select(F.explode(F.split("text", " ")).alias("w")).select(F.xxhash64("w")).collect()
    hashes = [w[0] for w in words]
    runs = spark.createDataFrame([(k, a, b, c) for k, (a, b, c) in enumerate(zip(hashes, [*hashes[1:], None], [*hashes[2:], None, None], strict=True))], "k int, a long, b long, c long")
    terms = [r[0] % (1 << 64) for r in runs.select(F.xxhash64("a", "b", "c")).collect()]
    assert st.fingerprints(row).first().hi % (1 << 64) == brute(terms)


def test_no_python_in_the_plan(odd):
    plan = st.fingerprint_documents(odd)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))
