import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as s

from claimsift.llm import warc_segments as ws
from claimsift.session import new_path

PAGES = "page_id long, url string, html string, digest string, payload string, segment int"


@settings(max_examples=100, deadline=None)
@given(s.binary(max_size=300), s.integers(1, 60))
def test_chunk_framing_round_trip(payload, size):
    assert ws.unchunked(ws.chunked(payload, size)) == payload


@settings(max_examples=60, deadline=None)
@given(s.lists(s.binary(max_size=200), max_size=6), s.integers(20, 90), s.integers(1, 50))
def test_archive_round_trip(payloads, segment, chunk):
    found = [r for k, p in enumerate(payloads) for r in ws.records(k, "http://x y", p, "d", None, str(k), segment, chunk)]
    parts: dict = {}
    for head, block in ws.split_archive(b"".join(r + ws.END for r in found)):
        assert len(block) <= segment
        parts.setdefault(head.get("WARC-Segment-Origin-ID", head["WARC-Record-ID"]), []).append(block)
    assert [ws.unchunked(b"".join(b).partition(ws.END)[2]) for b in parts.values()] == payloads


def brute(rows):
    out = []
    for k, _, html, *_ in rows:
        data = (html or "").encode()
        peers = [r[0] for r in rows if (r[2] or "") == (html or "") and r[0] is not None]
        keeper = max(peers, default=None) if len(data) >= 1000 else None
        revisit = keeper is not None and k != keeper
        out.append((k, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", keeper if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("segment", [ws.SEGMENT_BYTES, 700])
def test_pages_come_back(spark, segment):
    big = "é\r\n\r\nWARC/1.1\r\n" * 300
    rows = [(1, "u", big), (2, None, big), (3, "u v\r\n", big), (None, "u", big), (4, "u", None), (5, "u", ""), (6, "u", "x" * 999), (7, "u", "x" * 999),
            (8, "u", "y" * 1000), (8, "u", "y" * 1000), (9, "u", "long " * 60_000), (None, "n", "z" * 2000), (None, "n", "z" * 2000)]
    pages = spark.createDataFrame([(*r, "d", "p", 1) for r in rows], PAGES).repartition(3)
    path = new_path(spark, "test-archives")
    ws.write_archives(pages, path, segment=segment, chunk=256, per_archive=4)
    assert sorted((tuple(r) for r in ws.read_archives(spark, path).collect()), key=str) == brute(rows)


def test_lost_segment_fails(spark):
    rows = ws.records(1, "u", b"a" * 500, "d", None, "0", 100, 50)
    heads = [h for h, _ in ws.split_archive(b"".join(r + ws.END for r in rows))]
    found = [(1 if k == 0 else None, None, h["WARC-Type"], "d", "o", k + 1, 10 if k + 1 == len(heads) else None, b"x") for k, h in enumerate(heads)]
    with pytest.raises(Exception, match="broken segments"):
        ws.reassemble(spark.createDataFrame(found, ws._RECORD)).collect()


def test_empty_table(spark):
    assert ws.round_trip(spark.createDataFrame([], PAGES)).collect() == []
