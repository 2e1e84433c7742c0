"""Benchmark decontamination by suffix arrays of the training text.

Every task cuts its documents into shards of bounded size and builds a suffix array over the words
of each shard.  Each suffix of a benchmark item that is at least a window long is binary-searched in
it; equal ranges give all places of the window, and neighbouring places on one diagonal join into
the longest verbatim matches.  The benchmark is sent in blocks of bounded bytes; documents pass the
blocks one after another and are never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimsift.llm.common import text_bytes

WINDOW = 13  # words of an item that must follow one another
SHARE = 20  # a document is contaminated when SHARE times its hit words reach its words
BLOCK_BYTES = 8 << 20  # benchmark text broadcast at a time
SHARD_WORDS = 1 << 20  # words of one suffix array
QUERIES_AT_ONCE = 1 << 15

#: Words are digits, a-z after lower-casing A-Z, and everything beyond ASCII; all else parts them.
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

_MATCHES = "array<struct<item_id:string,item_offset:bigint,position:bigint,words:bigint>>"
_SPANS = "array<struct<start:bigint,stop:bigint>>"
_FOUND = f"n_words bigint, spans {_SPANS}, items array<string>, matches {_MATCHES}"
_TYPES = {
    "n_words": pa.int64(),
    "spans": pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])),
    "items": pa.list_(pa.string()),
    "matches": pa.list_(pa.struct([("item_id", pa.string()), ("item_offset", pa.int64()), ("position", pa.int64()), ("words", pa.int64())])),
}


def words(data: bytes) -> list[bytes]:
    return data.translate(_WORD).split()


class Windows:
    """The distinct windows of a block of items, by length, and the (item, offset) places of each."""

    def __init__(self, rows: list[tuple[str, bytes]], window: int):
        self.names = sorted({name for name, _ in rows})
        number = {name: k for k, name in enumerate(self.names)}
        self.vocabulary: dict[bytes, int] = {}
        places: dict[int, dict[tuple, list[tuple[int, int]]]] = {}
        for name, data in rows:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(data)]
            size = min(window, len(ids))
            for at in range(len(ids) - size + 1 if size else 0):
                places.setdefault(size, {}).setdefault(tuple(ids[at:at + size]), []).append((number[name], at))
        self.by_size = {}
        for size, found in places.items():
            counts = np.array([len(p) for p in found.values()])
            flat = np.array([p for ps in found.values() for p in ps], np.int64)
            self.by_size[size] = (np.array(list(found), np.int64), np.cumsum(counts) - counts, counts, flat)
        self.shortest = min(self.by_size, default=0)
        self.longest = max(self.by_size, default=0)


def suffix_ranks(stream: np.ndarray, depth: int) -> np.ndarray:
    """Rank of every suffix of ``stream`` by its next ``depth`` values, by prefix doubling; equal ones rank equal.

    Values are not negative; beyond the end they count as 0.
    """
    rank, known = np.concatenate([stream, np.zeros(depth, stream.dtype)]), 1
    while known < depth:
        step = min(known, depth - known)
        ahead = np.zeros_like(rank)
        ahead[:len(rank) - step] = rank[step:]
        _, rank = np.unique(rank * (int(rank.max()) + 1) + ahead, return_inverse=True)
        known += step
    return rank[:len(stream)]


def suffix_array(stream: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``stream`` in the order of their next ``depth`` values."""
    return np.argsort(suffix_ranks(stream, depth), kind="stable")


def equal_ranges(stream: np.ndarray, order: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each query the range of ``order`` whose suffixes begin with it, by binary search."""
    size = queries.shape[1]
    padded = np.concatenate([stream, np.zeros(size, stream.dtype)])
    reach = np.arange(size)

    def search(beyond_equal: bool) -> np.ndarray:
        low, high = np.zeros(len(queries), np.int64), np.full(len(queries), len(order))
        while (open_ := low < high).any():
            mid = (low + high) // 2
            suffix = padded[order[np.minimum(mid, len(order) - 1)][:, None] + reach]
            apart = suffix != queries
            first = apart.argmax(axis=1)
            line = np.arange(len(queries))
            less = suffix[line, first] < queries[line, first]
            goes_up = np.where(apart.any(axis=1), less, beyond_equal) & open_
            low = np.where(goes_up, mid + 1, low)
            high = np.where(open_ & ~goes_up, mid, high)
        return low

    return search(False), search(True)


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[k], starts[k] + 1, ... counts[k] of them, for each k in turn."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts - starts, counts)


def scan_shard(documents: list[np.ndarray], index: Windows) -> list[tuple[list, list, list]]:
    """For each document of a shard, given as word ids with 0 for words of no item: spans, items, longest matches."""
    out: list[tuple[list, list, list]] = [([], [], []) for _ in documents]
    sizes = np.array([len(d) for d in documents])
    flat = np.concatenate([np.concatenate([d, [0]]) for d in documents]).astype(np.int64)
    owner = np.repeat(np.arange(len(documents)), sizes + 1)
    place = spread(np.zeros(len(sizes), np.int64), sizes + 1)
    # Only runs of words that items hold can match; shorter runs than the shortest window cannot.
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flat > 0, [0]]).astype(np.int8)))
    begins, stops = edges[::2], edges[1::2]
    long_enough = stops - begins >= max(1, index.shortest)
    begins, stops = begins[long_enough], stops[long_enough]
    if not len(begins) or not index.by_size:
        return out
    keep = spread(begins, stops - begins + 1)  # each run with the 0 behind it
    stream, owner, place = flat[keep], owner[keep], place[keep]
    order = suffix_array(stream, index.longest)
    cover = np.zeros(len(stream) + 1, np.int64)
    found = []
    for size, (queries, firsts, counts, places) in index.by_size.items():
        for at in range(0, len(queries), QUERIES_AT_ONCE):
            low, high = equal_ranges(stream, order, queries[at:at + QUERIES_AT_ONCE])
            hit = np.flatnonzero(high > low)
            where = order[spread(low[hit], (high - low)[hit])]
            which = np.repeat(hit + at, (high - low)[hit])
            np.add.at(cover, where, 1)
            np.add.at(cover, where + size, -1)
            items = places[spread(firsts[which], counts[which])]
            found.append(np.stack([np.repeat(where, counts[which]), items[:, 0], items[:, 1], np.full(len(items), size)]))
    hit = np.concatenate([[0], np.cumsum(cover[:-1]) > 0, [0]]).astype(np.int8)
    edges = np.flatnonzero(np.diff(hit))
    for start, stop in zip(edges[::2], edges[1::2], strict=True):
        out[owner[start]][0].append((int(place[start]), int(place[stop - 1]) + 1))
    where, item, offset, size = np.concatenate(found, axis=1)
    if not len(where):
        return out
    line = np.lexsort([where, where - offset, item])  # by item, diagonal, place
    where, item, offset, size = where[line], item[line], offset[line], size[line]
    new = np.ones(len(where), bool)
    new[1:] = (np.diff(where) != 1) | (np.diff(offset) != 1) | (np.diff(item) != 0)
    head = np.flatnonzero(new)
    length = np.diff(np.concatenate([head, [len(where)]])) - 1 + size[head]
    where, item, offset = where[head], item[head], offset[head]
    best = np.lexsort([offset, place[where], -length, item, owner[where]])
    seen = None
    for k in best:
        key = (owner[where[k]], item[k])
        if key != seen:
            seen = key
            name = index.names[item[k]]
            out[key[0]][1].append(name)
            out[key[0]][2].append((name, int(offset[k]), int(place[where[k]]), int(length[k])))
    return out


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    joined: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if joined and start <= joined[-1][1]:
            joined[-1] = (joined[-1][0], max(stop, joined[-1][1]))
        else:
            joined.append((start, stop))
    return joined


def _scan(index, shard_words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = index.value
        known = windows.vocabulary
        for batch in batches:
            results: list[tuple[list, list, list]] = []
            lengths, shard, held = [], [], 0
            for data in batch.column("data"):
                tokens = words(data.as_py())
                lengths.append(len(tokens))
                shard.append(np.fromiter((known.get(w, 0) for w in tokens), np.int32, len(tokens)))
                held += len(tokens)
                if held >= shard_words:
                    results += scan_shard(shard, windows)
                    shard, held = [], 0
            if shard:
                results += scan_shard(shard, windows)
            columns = {"n_words": lengths, "spans": [], "items": [], "matches": []}
            before = [batch.column(c).to_pylist() for c in ("spans", "items", "matches")]
            for k, (spans, items, matches) in enumerate(results):
                spans = spans + [(s["start"], s["stop"]) for s in before[0][k]]
                columns["spans"].append([{"start": a, "stop": b} for a, b in union(spans)])
                best = {m["item_id"]: tuple(m.values()) for m in before[2][k]}
                for m in matches:
                    if m[0] not in best or m[3] > best[m[0]][3]:
                        best[m[0]] = m
                columns["items"].append(sorted({*items, *before[1][k]}))
                columns["matches"].append([dict(zip(("item_id", "item_offset", "position", "words"), best[n], strict=True)) for n in sorted(best)])
            arrays = [batch.column("row"), batch.column("data"), *(pa.array(columns[c], t) for c, t in _TYPES.items())]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "data", *_TYPES])

    return run


def benchmark_blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items as (id, text bytes), in blocks of about ``block_bytes`` (one item at least), one at a time."""
    rows = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), text_bytes().alias("data")).distinct()
    rows = rows.withColumn("size", F.octet_length("data"))
    total, largest = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).first()
    n = -(-total // block_bytes) or 1
    limit = 2 * max(block_bytes, largest)
    while True:
        block = F.pmod(F.xxhash64("name", "data"), F.lit(n))
        if n == 1 or rows.groupBy(block).agg(F.sum("size").alias("s")).where(F.col("s") > limit).isEmpty():
            break
        n *= 2
    for k in range(n):
        yield [(r[0], bytes(r[1])) for r in rows.where(block == k).select("name", "data").collect()]


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Every row of ``docs`` as struct ``row`` with n_words, spans, items, matches, n_hit, n_items, contaminated.

    Words are maximal runs of digits, letters a-z (A-Z lower-cased) and characters beyond ASCII.  A
    window is ``window`` words of an item in sequence; an item of fewer words, but not none, is one
    window.  spans: the parts of the document, in words, that occurrences of windows cover.  items:
    ids of items with such windows, sorted.  matches: of each of them the longest verbatim match (the
    first in the document, then in the item, of equal ones).  contaminated: n_hit > 0 and
    20 * n_hit >= n_words.  Null texts have no words; a null item id is listed as the empty string;
    repeated items count once; repeated documents are rows of their own; an empty benchmark hits
    nothing; further columns stay inside ``row`` and cannot clash.
    """
    spark = docs.sparkSession
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_bytes().alias("data"))
    schema = T.StructType([row.schema["row"], T.StructField("data", T.BinaryType()), *T.StructType.fromDDL(_FOUND).fields])
    out = row.select(
        "row", "data", F.lit(0).cast("bigint").alias("n_words"), F.array().cast(_SPANS).alias("spans"),
        F.array().cast("array<string>").alias("items"), F.array().cast(_MATCHES).alias("matches"))
    for rows in benchmark_blocks(benchmark, block_bytes):
        out = out.mapInArrow(_scan(spark.sparkContext.broadcast(Windows(rows, window)), shard_words), schema)
    covered = F.aggregate("spans", F.lit(0).cast("bigint"), lambda total, s: total + s["stop"] - s["start"])
    return out.drop("data").withColumn("n_hit", covered).withColumn("n_items", F.size("items").cast("bigint")).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.lit(SHARE) * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without contaminated documents; the columns stay as they are."""
    return scan(docs, benchmark, window).where("not contaminated").select("row.*")
