"""Periodic runs of words: suffix trees of a text and of its reversal, Lyndon roots, longest common extensions.

A run is a maximal stretch of words with a smallest period.  Every run holds a Lyndon root: the longest
Lyndon word that starts at some place, for the order of words or for its reverse.  Those words end
where the next smaller (or greater) suffix starts, which the order of the leaves of a suffix tree
tells; each is then extended to both sides by longest common extensions, which are depths of lowest
common ancestors: minima over an Euler tour, in constant time per question.

Trees are built for the zones of a text where a run can be at all.  A word of a run, but for the
first period, has an equal word at most a period before it, so long stretches of words with near
predecessors are looked for at every power of two; a text without any has no run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimsift.llm.common import text_bytes

LEAST = 24  # words of a run
TIMES = 3  # periods of a run
PART = 1 << 21  # bytes of texts cut into words at a time; a longer text is a part of its own
BLOCK = 16  # entries of an Euler tour that share a cell of the table of minima

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


class Extensions:
    """Longest common extensions between the suffixes of a sequence of positive integers."""

    def __init__(self, words: list[int]):
        text = [*words, 0]  # the end is a letter of its own, less than all others
        edges, left, right, base = _suffix_tree(text)
        tour, self.first = _euler_tour(edges, left, right, base, len(text))
        self._prepare(tour)

    def _prepare(self, tour: np.ndarray) -> None:
        """Minima from and up to every entry inside its block, and of 2^k blocks from every block on."""
        size = -(-len(tour) // BLOCK) * BLOCK
        self.cells = np.full(size, np.iinfo(np.int32).max, np.int32)
        self.cells[:len(tour)] = tour
        blocks = self.cells.reshape(-1, BLOCK)
        self.upto = np.minimum.accumulate(blocks, axis=1).ravel()
        self.onward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table = [blocks.min(axis=1)]
        while (step := 1 << len(self.table) - 1) * 2 <= len(blocks):
            below = self.table[-1]
            self.table.append(np.minimum(below[:-step], below[step:]))

    def between(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words the suffixes at ``i`` and ``j`` (two different ones each) have in common."""
        a, b = self.first[i], self.first[j]
        a, b = np.minimum(a, b), np.maximum(a, b)
        one, two = a // BLOCK, b // BLOCK
        found = np.minimum(self.onward[a], self.upto[b])
        gap = two - one - 1
        for k, row in enumerate(self.table):
            at = np.flatnonzero((gap >= 1 << k) & (gap < 2 << k))
            if len(at):
                found[at] = np.minimum(found[at], np.minimum(row[one[at] + 1], row[two[at] - (1 << k)]))
        at = np.flatnonzero(one == two)
        if len(at):
            places = (one[at] * BLOCK)[:, None] + np.arange(BLOCK)
            inside = (places >= a[at, None]) & (places <= b[at, None])
            found[at] = np.where(inside, self.cells[places], np.iinfo(np.int32).max).min(axis=1)
        return found.astype(np.int64)


def _suffix_tree(text: list[int]) -> tuple[dict[int, int], list[int], list[int], int]:
    """Ukkonen's tree: edges by ``parent * base + first letter``, and the label ``text[left:right]`` above each node."""
    base, size = max(text) + 1, len(text)
    edges: dict[int, int] = {}
    left, right, link = [0], [0], [0]
    node = length = at = waiting = 0
    for end, letter in enumerate(text):
        waiting += 1
        fresh = 0
        while waiting:
            if not length:
                at = end
            key = node * base + text[at]
            below = edges.get(key)
            if below is None:
                edges[key] = len(left)
                left.append(end)
                right.append(size)
                link.append(0)
                if fresh:
                    link[fresh] = node
                    fresh = 0
            else:
                span = right[below] - left[below]
                if length >= span:
                    node = below
                    at += span
                    length -= span
                    continue
                middle = left[below] + length
                if text[middle] == letter:
                    if fresh:
                        link[fresh] = node
                    length += 1
                    break
                split = len(left)
                left += (left[below], end)
                right += (middle, size)
                link += (0, 0)
                left[below] = middle
                edges[key] = split
                edges[split * base + letter] = split + 1
                edges[split * base + text[middle]] = below
                if fresh:
                    link[fresh] = split
                fresh = split
            waiting -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                at = end - waiting + 1
    return edges, left, right, base


def _euler_tour(edges: dict[int, int], left: list[int], right: list[int], base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Depths of the nodes in the order of a tour that takes children by their letters, and where each suffix stands."""
    keys = np.fromiter(edges.keys(), np.int64, len(edges))
    order = np.argsort(keys)
    children = np.fromiter(edges.values(), np.int64, len(edges))[order].tolist()
    begin = np.searchsorted(keys[order] // base, np.arange(len(left) + 1)).tolist()
    span = (np.array(right) - np.array(left)).tolist()
    tour, first = [0], np.zeros(size, np.int64)
    path, depths = [0], [0]
    following = begin[:-1]
    while path:
        node, depth = path[-1], depths[-1]
        child = following[node]
        if child < begin[node + 1]:
            following[node] = child + 1
            child = children[child]
            deeper = depth + span[child]
            if begin[child] == begin[child + 1]:
                first[size - deeper] = len(tour)
                tour += (deeper, depth)
            else:
                tour.append(deeper)
                path.append(child)
                depths.append(deeper)
        else:
            path.pop()
            depths.pop()
            if path:
                tour.append(depths[-1])
    return np.array(tour, np.int32), first


def _next_less(order: list[int]) -> list[int]:
    """For every place the next one with a lesser entry, or the end."""
    found, open_places = [len(order)] * len(order), []
    for place in range(len(order) - 1, -1, -1):
        own = order[place]
        while open_places and order[open_places[-1]] > own:
            open_places.pop()
        if open_places:
            found[place] = open_places[-1]
        open_places.append(place)
    return found


def runs_of(words: list[int], least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """(start, length, period) of all runs of ``least`` words and ``times`` (two or more) periods, by start, then period."""
    n = len(words)
    if n < max(least, times):
        return np.zeros((0, 3), np.int64)
    forward = Extensions(words)
    ranks = forward.first[:n]
    ends = np.array(_next_less(ranks.tolist()) + _next_less((-ranks).tolist()), np.int64)
    starts = np.tile(np.arange(n), 2)
    period = ends - starts
    onward = np.zeros(2 * n, np.int64)
    inner = ends < n
    onward[inner] = forward.between(starts[inner], ends[inner])
    del forward
    # In the reversed order the end is no longer the least letter; runs up to the end are those of the first order.
    sound = (ends + onward < n) | (np.arange(2 * n) < n)
    starts, ends, period, onward = starts[sound], ends[sound], period[sound], onward[sound]
    back = Extensions(words[::-1]).between(n - starts, n - ends)
    length = back + period + onward
    kept = (length >= least) & (length >= times * period)
    return np.unique(np.stack([starts - back, length, period], axis=1)[kept], axis=0)


def zones(before: np.ndarray, ends: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int]]:
    """Stretches of places, each inside one text, that hold every run of the texts that end at ``ends``.

    ``before`` says how far back the same word stands (0: nowhere).  A run of period q has at least
    max(least, times * q) - q words in a row whose distance is at most q.
    """
    starts = np.concatenate([[0], ends[:-1]])
    longest = int((ends - starts).max(initial=0))
    found: list[tuple[int, int]] = []
    furthest = int(before.max(initial=0))
    begin = end = np.zeros(0, np.int64)
    scale = 1
    while times * (half := scale // 2 + 1) <= longest:  # periods from half to scale
        if scale < 2 * furthest:  # beyond, every distance is near
            near = np.concatenate([[False], (before > 0) & (before <= scale), [False]])
            edge = np.flatnonzero(near[1:] != near[:-1])
            begin, end = edge[::2], edge[1::2]
        turn = min(max(half, least // times), scale)
        enough = end - begin >= min(max(least, times * q) - q for q in (half, turn, scale))
        begun = starts[np.searchsorted(ends, begin[enough], side="right")]  # of the texts
        found += zip(np.maximum(begin[enough] - scale, begun).tolist(), end[enough].tolist(), strict=True)
        scale *= 2
    merged: list[tuple[int, int]] = []
    for begin, end in sorted(found):
        if merged and begin < merged[-1][1]:
            merged[-1] = merged[-1][0], max(end, merged[-1][1])
        else:
            merged.append((begin, end))
    return merged


def _distances(ids: np.ndarray, text_of: np.ndarray) -> np.ndarray:
    """How far before each word the same word stands in the same text; 0 if nowhere."""
    key = text_of * (int(ids.max(initial=0)) + 1) + ids
    order = np.argsort(key, kind="stable")
    before = np.zeros(len(ids), np.int64)
    same = key[order[1:]] == key[order[:-1]]
    before[order[1:][same]] = order[1:][same] - order[:-1][same]
    return before


def text_runs(texts: list[bytes], least: int = LEAST, times: int = TIMES) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Words and runs of each text."""
    words = [text.split() for text in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(sizes)
    ids = pa.array([x for w in words for x in w], pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    text_of = np.repeat(np.arange(len(words)), sizes)
    found: list[list[np.ndarray]] = [[] for _ in words]
    for begin, end in zones(_distances(ids, text_of), ends, least, times):
        text = int(text_of[begin])
        local = np.unique(ids[begin:end], return_inverse=True)[1] + 1
        runs = runs_of(local.tolist(), least, times)
        if len(runs):
            found[text].append(runs + [begin - int(ends[text] - sizes[text]), 0, 0])
    for own, runs in zip(words, found, strict=True):
        runs = np.concatenate(runs) if runs else np.zeros((0, 3), np.int64)
        yield own, runs[np.lexsort([runs[:, 2], runs[:, 0]])]


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words joined by one space, without those that stand in a run after its first period."""
    if len(runs):
        cover = np.zeros(len(words) + 1, np.int64)
        np.add.at(cover, runs[:, 0] + runs[:, 2], 1)
        np.add.at(cover, runs[:, 0] + runs[:, 1], -1)
        words = [words[k] for k in np.flatnonzero(np.cumsum(cover)[:-1] == 0).tolist()]
    return b" ".join(words)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        texts, begin, size = batch.column("data"), 0, 0
        for k in range(batch.num_rows):
            size += len(texts[k].as_buffer() or b"")
            if size >= PART or k + 1 == batch.num_rows:
                part = batch.slice(begin, k + 1 - begin)
                yield part, part.column("data").to_pylist()
                begin, size = k + 1, 0


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(row, n_words, runs, collapsed) for every row of ``docs``; ``row`` holds all its columns but the text.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0.  ``runs`` are (start, length, period) of all maximal
    stretches of at least ``least`` words and ``times`` periods, by start, then period; ``collapsed`` is
    the text with one period of each run, words joined by one space.  A null, empty or blank text has no
    words, no runs and an empty ``collapsed``.  Repeated rows and null ids are rows like any other, an
    empty table gives none, and names in ``docs`` cannot clash with the new columns.  Whole texts are taken,
    however long; there is no shuffle.
    """
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), text_bytes().alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run_type = pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])
        for part, texts in _parts(batches):
            sizes, found, kept = [], [], []
            for words, runs in text_runs(texts, least, times):
                sizes.append(len(words))
                found.append(runs)
                kept.append(collapse(words, runs))
            every = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
            structs = pa.StructArray.from_arrays([pa.array(every[:, k]) for k in range(3)], fields=list(run_type))
            ends = pa.array(np.cumsum([0, *(len(r) for r in found)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(ends, structs), pa.array(kept, pa.binary())],
                names=["row", "n_words", "runs", "collapsed"])

    schema = f"row {rows.schema['row'].dataType.simpleString()}, n_words bigint, runs {RUNS}, collapsed binary"
    return rows.mapInArrow(run, schema).withColumn("collapsed", F.col("collapsed").cast("string"))
