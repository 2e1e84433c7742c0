import hashlib
import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from claimsift.llm import private_spans as ps
from tests.llm.conftest import DOCS, document, rows_of


@pytest.fixture(scope="module")
def field():
    return ps.train()


def test_base_spans():
    text = "x.y@z.com, a@b, 1.2.3.4.5 and 300.1.1.1; 4111 1111-1111 1111 or 4111111111111112; +1 (234) 555-1234 98765 or +12345 ü+49 30 1234567"
    assert [(text[a:b], ps.KINDS[k]) for a, b, k in ps.base_spans(text)] == [
        ("x.y@z.com", "email"), ("1.2.3.4", "ip"), ("4111 1111-1111 1111", "card"), ("+49 30 1234567", "phone")]
    # A match that fails is dropped whole: the first phone number runs on to more than 15 digits.


# The patterns of the contract, searched as they stand.
PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def naive_spans(text):
    """Every pattern searched from left to right, and the checks of each kind in the plainest form."""
    found = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m.group() if c in "0123456789"]
            doubled = [d if k % 2 == 0 else sum(map(int, str(2 * d))) for k, d in enumerate(reversed(digits))]
            fits = [
                True, kind == 1 and all(int(p) <= 255 for p in m.group().split(".")),
                14 <= len(digits) <= 19 and sum(doubled) % 10 == 0, 10 <= len(digits) <= 15][kind]
            if fits:
                found.append((m.start(), m.end(), kind))
    return sorted(found, key=lambda s: (s[0], s[2]))


@settings(max_examples=2000, deadline=None)
@given(st.one_of(
    st.text("0123.@-+ a_()é", max_size=40), st.text("01. ", max_size=40), st.text("a.@-", max_size=30), st.text("4 -0", max_size=60),
    st.lists(st.sampled_from(["1.2.3.4", "10.0.0.255", "256.1.1.1", "00000255.1.2.3", ".", "a@b.c", "@", "x-y.z", "4111 1111-1111 1111", "+49 30 1234567", "+", "5", " ", "٣", "é"]), max_size=9).map("".join)))
def test_base_spans_equal_a_naive_search(text):
    assert sorted(ps.base_spans(text), key=lambda s: (s[0], s[2])) == naive_spans(text)


@pytest.mark.parametrize("text", [
    "7" * 1_000_000, "a" * 1_000_000 + "@", "a" * 500_000 + "@" + "b" * 500_000, "0" * 5000 + ".1.2.3", "1." * 500_000, "@" * 1_000_000,
    "1.2.3." + "9" * 1_000_000 + ".x", "+1" + " ." * 400_000, "a.b@" * 250_000, "1 " * 500_000, "9.9.9.9 " * 100_000], ids=lambda t: t[:9])
def test_long_runs_take_linear_time(text):
    start = time.perf_counter()
    found = ps.base_spans(text)
    assert ps.redact(text, found).count("<") == len(found)
    assert time.perf_counter() - start < 2
    assert (len(found) == 1) == (text[:5] == "00000")


def test_random_field_on_rows_it_has_not_seen(field):
    rows = ps.labelled_table(300, seed=99)
    decoded = field.decode([words for words, _ in rows])
    assert sum(d == tags for d, (_, tags) in zip(decoded, rows, strict=True)) >= 0.95 * len(rows)
    assert all(not (b[0] == "I" and a[1:] != b[1:]) for d in decoded for a, b in zip(["O", *d], d, strict=False))


def test_viterbi_is_the_best_of_all_paths(field):
    import itertools
    words = ["ring", "+4", "(123)", "now"]
    table, _ = ps.padded([field.encode(words)])
    emit = field.emissions(table)[0]
    value = lambda path: field.start[path[0]] + emit[range(4), path].sum() + sum(field.steps[a, b] for a, b in itertools.pairwise(path))
    best = max(itertools.product(range(len(ps.LABELS)), repeat=4), key=lambda p: value(list(p)))
    assert field.decode([words]) == [[ps.LABELS[k] for k in best]]


def test_added_spans_leave_base_spans_alone(field):
    text = "mail jo.doe (at) host1 (dot) com or ring (234) 555-1234 please, page 12 of 300, key \"0f0f\", me@x.org too"
    (base, every), = ps.find_spans([text], field)
    assert set(base) <= set(every) and [(text[a:b], ps.KINDS[k]) for a, b, k in every] == [
        ("jo.doe (at) host1 (dot) com", "email"), ("(234) 555-1234", "phone"), ("me@x.org", "email")]


def test_windows_hold_every_sign_once():
    rng = random.Random(3)
    for _ in range(200):
        text = " ".join(rng.choice(["a", "b", "1", "x@y", "(at)"]) if rng.random() < 0.2 else "w" for _ in range(60))
        places = [p for w in ps.windows(text) for p in w]
        assert places == sorted(set(places))
        assert {m.span() for m in ps.WORD.finditer(text) if ps.SIGN.search(m.group())} <= set(places)


def test_query_and_redaction(odd, odd_rows):
    got = ps.private_data(odd)
    want = []
    for r in odd_rows:
        base = naive_spans(r[1] or "")
        want.append((r[0], *(sum(k == kind for *_, k in base) for kind in range(4)), hashlib.sha256(ps.joined(base).encode()).hexdigest()))
    assert rows_of(got, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == sorted(want, key=lambda r: tuple((v is None, str(v)) for v in r))
    clean = ps.redacted(odd)
    assert clean.columns == odd.columns
    by = {r.doc_id: r for r in clean.collect()}
    assert by[9].text == odd_rows[11][1].replace("a.b@c.de", "<EMAIL>").replace("+1 (234) 555-1234", "<PHONE>") and by[9].n_chars == len(by[9].text) and by[3].text is None and by[5].text == " \t\n "


def test_empty_table(empty):
    assert ps.private_data(empty).collect() == [] and ps.redacted(empty).collect() == []


def test_long_run_of_signs(spark, field):
    text = "7 " * 20_000 + "a@b.cd"
    assert ps.private_data(spark.createDataFrame([document(1, text)], DOCS)).first().n_email == 1


def test_spans_across_pieces_of_a_long_run(field):
    values = ["(234) 555-1234", "(234) 555 1234", "jo (at) host (dot) org"]
    for value, kind in zip(values, ("phone", "phone", "email"), strict=True):
        for at in range(250, 261):
            text = "row 7 " * (at // 2) + "row " * (at % 2) + value + " row 7" * 200
            start = text.index(value)
            (_, every), = ps.find_spans([text], field)
            assert any(a <= start and start + len(value) <= b and ps.KINDS[k] == kind for a, b, k in every), (value, at)
    words = [w for row, _ in ps.labelled_table(120, seed=7) for w in row]
    assert len(words) > 512 and field.decode_run(words, 256) == field.decode_run(words, 7) == field.decode([words])[0]
