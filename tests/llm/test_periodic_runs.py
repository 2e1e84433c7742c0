import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from claimsift.llm import periodic_runs as pr
from claimsift.llm import queries
from tests.llm.conftest import DOCS, document, sentence


def brute_runs(words, least=24, times=3):
    """Every stretch of equal words ``q`` apart, for every q, without those that a shorter period has too."""
    n, found = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least, times * q):
                run = words[i:i + length]
                if all(any(a != b for a, b in zip(run, run[p:], strict=False)) for p in range(1, q)):
                    found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def planted(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def want(doc_id, text):
    words = planted(doc_id, text)
    runs = brute_runs(words)
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    digest = lambda data: hashlib.sha256(data).hexdigest()
    return (
        doc_id, len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
        digest("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()),
        digest(b" ".join(w for i, w in enumerate(words) if i not in gone)))


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 4).flatmap(lambda a: st.lists(st.integers(1, a), max_size=70)), st.sampled_from([(2, 2), (6, 3), (24, 3)]))
def test_runs_of_random_words(words, least):
    assert sorted(map(tuple, pr.runs_of(words, *least).tolist()), key=lambda r: (r[0], r[2])) == brute_runs(words, *least)


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_zones_lose_no_run(data):
    words = data.draw(st.lists(st.integers(0, 5), max_size=60))
    for _ in range(data.draw(st.integers(0, 3))):  # a stretch is repeated, with a word changed here and there
        period = data.draw(st.integers(1, 20))
        stretch = (words or [9])[-period:]
        words = words + (stretch * data.draw(st.integers(1, 6)))[:data.draw(st.integers(0, 90))] + data.draw(st.lists(st.integers(0, 30), max_size=9))
    texts = [words, words[::-1], [], words[3:]]
    got = [runs for _, runs in pr.text_runs([" ".join(map(str, t)).encode() for t in texts], 6, 3)]
    assert [list(map(tuple, runs.tolist())) for runs in got] == [brute_runs(t, 6, 3) for t in texts]


def test_long_texts(spark):
    stretch = [f"w{k * k % 977}" for k in range(5000)]
    text = [*(f"a{k}" for k in range(7000)), *stretch, *stretch, *stretch, stretch[0], "end", *["na"] * 30_000]
    (row,) = pr.periodic_runs(spark.createDataFrame([document(1, " ".join(text))], DOCS)).collect()
    inner = {r for r in map(tuple, row.runs) if r[2] == 977}
    assert row.n_words == len(text) and (7000, 15_001, 5000) in map(tuple, row.runs) and (22_002, 30_000, 1) in map(tuple, row.runs)
    assert len(inner) in (1, 3)


def test_query_equals_brute_force(spark, monkeypatch, odd_rows):
    rows = [document(r[0], r[1] if len(r[1] or "") < 9000 else r[1][:9000], r[3]) for r in odd_rows]
    rows += [document(k, sentence(k, 15 + k % 250)) for k in range(100, 420)]
    rows += [document(500, "la " * 24), document(501, "la " * 23), document(502, "a b c d e f g h " * 3 + "a b x"), document(503, "x y " * 40 + "z " + "x y " * 11)]
    monkeypatch.setattr(queries, "documents", lambda *_: spark.createDataFrame(rows, DOCS).repartition(5))
    key = lambda r: tuple((v is None, str(v)) for v in r)
    found = queries.op11_periodic_runs(spark, "")
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, found.collect()), key=key) == sorted((want(r[0], r[1]) for r in rows), key=key)


def test_odd_rows_and_empty_table(odd, empty, odd_rows):
    assert pr.periodic_runs(empty).collect() == []
    got = pr.periodic_runs(odd)
    assert got.select("row.*").columns == [c for c in odd.columns if c != "text"]
    assert sorted(r.n_words for r in got.collect()) == sorted(len((r[1] or "").encode().split()) for r in odd_rows)


@pytest.mark.parametrize("texts", [["x"] * 3, ["", None, " "], ["é 漢 " * 20]])
def test_collapse_keeps_one_period(spark, texts):
    got = pr.periodic_runs(spark.createDataFrame([document(k, t) for k, t in enumerate(texts)], DOCS)).orderBy("row.doc_id").collect()
    assert [r.collapsed for r in got] == [{"x": "x", "é 漢 " * 20: "é 漢"}.get(t, "") for t in texts]
