"""SimHash near-duplicates: binary trie self-join under a Hamming budget.

The distinct fingerprints form a binary trie over their 64 bits.  Pairs of trie nodes are walked
down together from (root, root): each step adds the bits in which the two nodes differ and drops the
pair as soon as the budget is exceeded.  The upper levels of the walk are joins between tables of
nodes; a pair whose subtrees are small enough is finished inside one task, in numpy, and only a
spanning forest of the links found there leaves the task.  Nodes that hold too many fingerprints are
split further down, so a crowded prefix is dealt to many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimsift.llm.common import LOWER, connected_components, text_bytes
from claimsift.session import materialise

BITS = 64
WORDS = 3  # words of a shingle
RADIUS = 2  # bits in which linked fingerprints may differ
LEAF = 4096  # fingerprints of a subtree that one task finishes
STEP = 2  # trie levels that a crowded node is split by at a time
BLOCK = 1 << 18  # node pairs expanded at a time inside a task

digest = partial(xxhash.xxh64_intdigest, seed=42)


def shingle_hashes(data: bytes, words: int = WORDS) -> np.ndarray:
    """Hashes of the word shingles of a text in their order; a shorter text is one shingle, none without words."""
    tokens = data.translate(LOWER).split()
    if len(tokens) < words:
        return np.array([digest(b" ".join(tokens))] if tokens else [], np.uint64)
    shingles = map(b" ".join, zip(*(tokens[k:] for k in range(words)), strict=False))
    return np.fromiter(map(digest, shingles), np.uint64, len(tokens) - words + 1)


def fingerprint(data: bytes, words: int = WORDS) -> int:
    """Signed 64-bit SimHash of the word shingles of a text, repeats included; 0 without words."""
    return majority(shingle_hashes(data, words))


def majority(hashes: np.ndarray) -> int:
    """Signed 64 bits: those that more than half of the hashes have."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        raw = hashes[at:at + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fingerprint long), a row for every row of ``docs``; null and blank texts give 0."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["fingerprint"] = np.fromiter((fingerprint(data, words) for data in batch.pop("data")), np.int64, len(batch))
            yield batch

    rows = docs.select(F.struct("doc_id").alias("key"), text_bytes().alias("data"))
    schema = f"key struct<doc_id:{key}>, fingerprint long"
    return rows.mapInPandas(run, schema).select("key.doc_id", "fingerprint")


def prefix(value: Column, depth: int) -> Column:
    return F.shiftrightunsigned(value, BITS - depth) if depth else F.lit(0).cast("long")


def flips(depth: int, radius: int) -> list[int]:
    """All values of ``depth`` bits with at most ``radius`` ones."""
    masks = level = {0}
    for _ in range(radius):
        level = {m | 1 << k for m in level for k in range(depth)}
        masks = masks | level
    return sorted(masks)


class Forest:
    """Groups of positions joined by links given in blocks."""

    def __init__(self, size: int):
        self.parent = np.arange(size)

    def link(self, u: np.ndarray, v: np.ndarray) -> None:
        while True:
            a, b = self.parent[u], self.parent[v]
            apart = a != b
            if not apart.any():
                return
            u, v, a, b = u[apart], v[apart], a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := self.parent[self.parent], self.parent):
                self.parent = up


def walk(left: np.ndarray, right: np.ndarray, same: bool, depth: int, differing: int, radius: int) -> Iterator[tuple]:
    """Positions of the pairs within ``radius`` bits, in blocks.  Both sides sorted, distinct, uint64.

    A node is a range of a sorted side.  ``same``: one side with itself, each pair once.
    """
    ones: dict[int, tuple] = {}

    def counts(bit: int) -> tuple:
        if bit not in ones:
            of = lambda side: np.concatenate([[0], np.cumsum((side >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)])
            ones[bit] = (of(left), of(left) if same else of(right))
        return ones[bit]

    start = np.array([[0], [len(left)], [0], [len(right)], [differing], [int(same)]], np.int64)
    stack = [(BITS - 1 - depth, start)]
    while stack:
        bit, pairs = stack.pop()
        if pairs.shape[1] > BLOCK:
            stack += [(bit, pairs[:, :BLOCK]), (bit, pairs[:, BLOCK:])]
            continue
        a0, a1, b0, b1, diff, own = pairs
        single = (a1 - a0) * (b1 - b0) == 1
        if single.any():
            pick = single & (own == 0)
            i, j = a0[pick], b0[pick]
            near = np.bitwise_count(left[i] ^ right[j]) <= radius
            yield i[near], j[near]
            a0, a1, b0, b1, diff, own = pairs[:, ~single]
        if not len(a0) or bit < 0:
            continue
        of_left, of_right = counts(bit)
        am = a1 - (of_left[a1] - of_left[a0])
        bm = b1 - (of_right[b1] - of_right[b0])
        children = [
            np.stack([a0, am, b0, bm, diff, own]),
            np.stack([am, a1, bm, b1, diff, own]),
            np.stack([a0, am, bm, b1, diff + 1, np.zeros_like(own)]),
            np.stack([am, a1, b0, bm, diff + 1, np.zeros_like(own)])[:, own == 0],
        ]
        grown = np.concatenate(children, axis=1)
        grown = grown[:, (grown[0] < grown[1]) & (grown[2] < grown[3]) & (grown[4] <= radius)]
        if grown.shape[1]:
            stack.append((bit - 1, grown))


def finish(group: pd.DataFrame, radius: int) -> pd.DataFrame:
    """A spanning forest (a, b) of the links between the two subtrees of a pair of nodes, and (a, null, n): the copies ``a`` links to."""
    depth, a, b, differing = (int(group[c].iloc[0]) for c in ("depth", "a", "b", "differing"))
    value = group["value"].to_numpy(np.int64).view(np.uint64)
    order = np.lexsort([value, group["side"].to_numpy()])
    value, copies = value[order], group["n"].to_numpy(np.int64)[order]
    middle = int((group["side"] == 0).sum())
    left = value[:middle]
    right = left if a == b else value[middle:]
    shift = 0 if a == b else len(left)
    forest = Forest(shift + len(right))
    partners = np.zeros(len(value), np.int64)
    if len(left) and len(right):
        for i, j in walk(left, right, a == b, depth, differing, radius):
            forest.link(i, j + shift)
            np.add.at(partners, i, copies[j + shift])
            np.add.at(partners, j + shift, copies[i])
    every = value.view(np.int64)
    linked, counted = np.flatnonzero(forest.parent != np.arange(len(every))), np.flatnonzero(partners)
    return pd.DataFrame({
        "a": np.concatenate([every[linked], every[counted]]),
        "b": pd.array([*every[forest.parent[linked]], *[None] * len(counted)], "Int64"),
        "n": pd.array([*[None] * len(linked), *partners[counted]], "Int64")})


def links(values: DataFrame, radius: int = RADIUS, leaf: int = LEAF) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) that connect the distinct longs of ``values(value, n)`` wherever two differ in ``radius`` bits or fewer.

    The links returned span the same components as all such pairs; pairs inside a component that
    others already connect need not appear.  The second table has (value, n): how many rows, ``n`` for
    each value, the value links to besides its own.  Values are distinct and not null.
    """
    spark = values.sparkSession
    total = values.count()
    depth = 0
    while total > leaf << depth and depth < BITS - STEP:
        depth += 1
    nodes = values.groupBy(prefix(F.col("value"), depth).alias("node")).agg(F.count(F.lit(1)).alias("n"))
    nodes = materialise(nodes, "trie-nodes")
    masks = F.explode(F.array(*[F.lit(m).cast("long") for m in flips(depth, radius)]))
    pairs = (
        nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), masks.alias("mask"))
        .withColumn("b", F.col("a").bitwiseXOR(F.col("mask"))).where("a <= b")
        .join(nodes.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b")
        .select("a", "b", "na", "nb", F.bit_count("mask").alias("differing"))
    )
    dealt = None
    while True:
        pairs = materialise(pairs, "trie-pairs")
        crowded = (F.col("na") + F.col("nb") > 2 * leaf) if depth < BITS else F.lit(False)
        ready = pairs.where(~crowded).select("a", "b", F.lit(depth).alias("depth"), "differing")
        at = values.select("value", "n", prefix(F.col("value"), depth).alias("at"))
        one = at.join(ready.withColumn("at", F.col("a")), "at").withColumn("side", F.lit(0))
        two = at.join(ready.where("a <> b").withColumn("at", F.col("b")), "at").withColumn("side", F.lit(1))
        part = one.unionByName(two).drop("at")
        dealt = part if dealt is None else dealt.unionByName(part)
        split = pairs.where(crowded)
        if split.isEmpty():
            break
        step = min(STEP, BITS - depth)
        depth += step
        nodes = values.groupBy(prefix(F.col("value"), depth).alias("node")).agg(F.count(F.lit(1)).alias("n"))
        child = nodes.select("node", "n", F.shiftrightunsigned("node", step).alias("up"))
        pairs = (
            split.select("a", "b", "differing")
            .join(child.select(F.col("up").alias("a"), F.col("node").alias("ca"), F.col("n").alias("na")), "a")
            .join(child.select(F.col("up").alias("b"), F.col("node").alias("cb"), F.col("n").alias("nb")), "b")
            .withColumn("bits", F.bit_count(F.col("ca").bitwiseXOR(F.col("cb")).bitwiseAND(F.lit((1 << step) - 1))))
            .where(F.col("differing") + F.col("bits") <= radius)
            .where("a < b or ca <= cb")
            .select(F.col("ca").alias("a"), F.col("cb").alias("b"), "na", "nb", (F.col("differing") + F.col("bits")).cast("int").alias("differing"))
        )
    if not total:
        return spark.createDataFrame([], "a long, b long"), spark.createDataFrame([], "value long, n long")
    found = dealt.groupBy("depth", "a", "b").applyInPandas(lambda group: finish(group, radius), "a long, b long, n long")
    found = materialise(found, "links")
    partners = found.where("b is null").groupBy(F.col("a").alias("value")).agg(F.sum("n").alias("n"))
    return found.where("b is not null").select("a", "b").distinct(), partners


def near_duplicates(docs: DataFrame, radius: int = RADIUS, leaf: int = LEAF, words: int = WORDS) -> DataFrame:
    """(doc_id, fingerprint long, component_id, n_links) for every row of ``docs``.

    component_id is the least doc_id reachable over links of ``radius`` bits or fewer, the row's own
    included; n_links counts the other rows within ``radius`` bits of the row itself.  Null and blank
    texts have fingerprint 0 and link like any other; repeated rows are rows of their own; a null
    doc_id is passed over in the minimum (null if the component has no other).  An empty table gives
    no rows; further columns of ``docs`` are ignored.
    """
    prints = materialise(fingerprints(docs, words), "fingerprints")
    values = materialise(
        prints.groupBy(F.col("fingerprint").alias("value")).agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")),
        "distinct-fingerprints",
    )
    forest, partners = links(values.select("value", "n"), radius, leaf)
    groups = connected_components(forest)
    placed = values.join(groups.withColumnRenamed("node", "value"), "value", "left").withColumn(
        "component", F.coalesce("component", "value"))
    heads = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = placed.join(heads, "component").join(partners.withColumnRenamed("n", "others"), "value", "left").select(
        F.col("value").alias("fingerprint"), "component_id", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return prints.join(classes, "fingerprint").select("doc_id", "fingerprint", "component_id", "n_links")


def hexadecimal(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def keep_one(docs: DataFrame, radius: int = RADIUS, words: int = WORDS) -> DataFrame:
    """``docs`` without near-duplicates: of each component the row with the least doc_id stays.

    Documents are linked by fingerprints of ``words``-word shingles within ``radius`` bits.  Rows that
    repeat the least doc_id are one document and leave one row.  A row without doc_id stays only if
    no row of its component has one, one row per component.  Null and blank texts are one component; an empty
    table stays empty; columns of any name pass through.
    """
    columns = docs.columns
    found = materialise(near_duplicates(docs, radius, words=words).withColumnRenamed("fingerprint", "value"), "near-duplicates")
    losers = found.where("doc_id is not null and doc_id <> component_id").select("doc_id").distinct()
    repeated = found.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id")
    kept = docs.where("doc_id is not null").join(losers, "doc_id", "left_anti").select(*columns)
    repeated = materialise(repeated, "repeated-ids")
    if not repeated.isEmpty():  # else the texts need not pass a second time
        copies = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
        kept = kept.join(repeated, "doc_id", "left_anti").select(*columns).unionByName(copies.select(*columns))
    nameless = docs.where("doc_id is null")
    if nameless.isEmpty():
        return kept
    headless = found.where("doc_id is null and component_id is null").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    groups = connected_components(links(headless, radius)[0]).withColumnRenamed("node", "value")
    headless = headless.join(groups, "value", "left").withColumn("component", F.coalesce("component", "value"))
    marked = nameless.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), _value_column(words).alias("value"))
    last = marked.join(headless, "value").dropDuplicates(["component"])
    return kept.unionByName(last.select("row.*"))


def _value_column(words: int) -> Column:
    @F.pandas_udf("long")
    def of(data: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter((fingerprint(x, words) for x in data), np.int64, len(data)))

    return of(text_bytes())
