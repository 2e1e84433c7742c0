"""Merkle manifest of a table: leaves per language, a tree of languages, a witness for every row.

Trees grow by appending.  A task takes an aligned block of a tree's nodes in order and keeps the open
subtrees; an append may complete subtrees, and then each side's root goes to the witnesses of the
leaves of the other side.  What a block leaves is one root, which is appended to the blocks of the
next round in the same way, until a tree is one node; the roots of all trees are the leaves of the
last one.  A witness is extended by that of its block root, a join of one row per block.

H is the SHA-256 of the inputs' hexadecimal digests.  A last node without sibling is hashed alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimsift.llm.common import number_within
from claimsift.session import materialise

HEIGHT = 12  # levels of a block: 4,096 nodes
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def leaf_hash(**changed: Column) -> Column:
    """The digest of a row: each field ``-`` if null, else its bytes, a colon and its value."""
    parts = []
    for name in FIELDS:
        value = changed.get(name, F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def node_hash(*children: str) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


class Appends:
    """The open subtrees of one block, and the witnesses of its leaves so far."""

    def __init__(self, nodes: int, height: int = HEIGHT):
        self.last = nodes - 1  # of the tree, at the level of the leaves
        self.height = min(height, self.last.bit_length())
        self.witnesses: list[bytearray] = []
        self.open: list[tuple[int, int, str, int]] = []  # level, index, root, first leaf; leftmost first

    def append(self, index: int, root: str) -> None:
        level, first = 0, len(self.witnesses)
        self.witnesses.append(bytearray())
        while level < self.height:
            if index & 1:
                _, _, left, before = self.open.pop()
                self._witness(before, first, root)
                self._witness(first, len(self.witnesses), left)
                root, first = node_hash(left, root), before
            elif index == self.last >> level:  # nothing will come beside it
                root = node_hash(root)
            else:
                break
            level, index = level + 1, index >> 1
        self.open.append((level, index, root, first))

    def _witness(self, first: int, end: int, sibling: str) -> None:
        digest = bytes.fromhex(sibling)
        for witness in self.witnesses[first:end]:
            witness += digest

    def root(self) -> str:
        ((_, _, root, _),) = self.open
        return root


def _append_blocks(batches: Iterator[pa.RecordBatch], height: int) -> Iterator[pa.RecordBatch]:
    """Add ``witness`` and ``top`` (the root of the block) to rows that are sorted by tree and place."""
    waiting: list[pa.RecordBatch] = []  # rows not yet given out; the last ones are those of the open block
    witnesses: list[bytes] = []
    tops: list[str] = []
    block, current = None, None

    def close() -> None:
        if block is not None:
            witnesses.extend(map(bytes, block.witnesses))
            tops.extend([block.root()] * len(block.witnesses))

    def ready() -> pa.RecordBatch:
        nonlocal waiting
        table = pa.Table.from_batches(waiting)
        done = table.slice(0, len(tops)).combine_chunks()
        waiting = table.slice(len(tops)).to_batches()
        columns = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in done.columns]
        made = pa.RecordBatch.from_arrays(
            [*columns, pa.array(witnesses, pa.binary()), pa.array(tops, pa.string())], names=[*table.column_names, "witness", "top"])
        witnesses.clear()
        tops.clear()
        return made

    for batch in batches:
        waiting.append(batch)
        for tree, index, nodes, root in zip(*(batch.column(c).to_pylist() for c in ("tree", "pos", "n", "hash")), strict=True):
            key = (tree, index >> height)
            if key != current:
                close()
                block, current = Appends(nodes, height), key
            block.append(index, root)
        if tops:
            yield ready()
    if block is not None:
        close()
        yield ready()


def grow(nodes: DataFrame, height: int = HEIGHT) -> tuple[DataFrame, DataFrame]:
    """(every node with ``witness`` and ``top``; (tree, root)) of trees whose leaves are ``nodes(tree, pos, n, hash, ...)``.

    ``witness`` holds the siblings from the leaf to the root, 32 bytes each.  Rounds go on until all trees are one node.
    """
    rounds = []
    while True:
        rows = nodes.repartition("tree", F.shiftright("pos", height)).sortWithinPartitions("tree", "pos")
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema.fields)
        done = materialise(rows.mapInArrow(lambda batches: _append_blocks(batches, height), f"{schema}, witness binary, top string"), "blocks")
        rounds.append(done)
        if (done.agg(F.max("n")).first()[0] or 0) <= 1 << height:
            break
        nodes = done.where(F.col("pos").bitwiseAND(F.lit((1 << height) - 1)) == 0).select(
            "tree", F.shiftright("pos", height).alias("pos"), F.shiftright(F.col("n") + ((1 << height) - 1), height).alias("n"),
            F.col("top").alias("hash"))
    roots = rounds[-1].where("pos = 0").select("tree", F.col("top").alias("root"))
    upper = None
    for done in reversed(rounds):
        if upper is not None:
            above = upper.select("tree", F.col("pos").alias("_block"), F.col("witness").alias("_above"))
            done = done.withColumn("_block", F.shiftright("pos", height)).join(above, ["tree", "_block"]).withColumn(
                "witness", F.concat("witness", "_above")).drop("_block", "_above")
        upper = done
    return upper.drop("top"), roots


def fold(leaf: str, witness: bytes, path: list[tuple[int, int]]) -> str:
    """The root above ``leaf``; ``path`` has its place and the number of leaves of each tree from below."""
    at = 0
    for index, nodes in path:
        last = nodes - 1
        while last:
            if index & 1 or index < last:
                sibling = witness[at:at + 32].hex()
                at += 32
                leaf = node_hash(sibling, leaf) if index & 1 else node_hash(leaf, sibling)
            else:
                leaf = node_hash(leaf)
            index, last = index >> 1, last >> 1
    return leaf


def manifest(docs: DataFrame, presented: Column | None = None, height: int = HEIGHT) -> DataFrame:
    """A row for every row of ``docs``: (doc_id, leaf, lang, pos, n, tree_pos, trees, subroot, root, witness, presented).

    ``witness`` holds the siblings of the row's path, leaf to root, 32 bytes each; with (pos, n) and
    (tree_pos, trees), its place among the leaves of its language and among the languages, it is all that
    ``verify`` needs.  Blocks have 2^``height`` nodes.  ``presented`` is a digest shown later in the leaf's stead (null: the leaf itself).
    Leaves of a language ascend by doc_id, nulls first, then by digest; rows that repeat are leaves of
    their own.  A null language is a tree like any other, the first one.  Further columns are ignored, an
    empty table gives no rows.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))
    shown = (F.lit(None) if presented is None else presented).cast("string")
    leaves = docs.select("doc_id", "lang", leaf_hash().alias("hash"), shown.alias("presented"), tree.alias("tree"))
    leaves = materialise(leaves, "leaves")  # dealing by ranges looks at them twice, the texts are hashed once
    rows, subroots = grow(number_within(leaves, "tree", ["doc_id", "hash"]), height)
    tops = number_within(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("under"), F.col("root").alias("hash")), "tree", ["under"])
    tops, root = grow(tops, height)
    above = materialise(tops.select(
        F.col("under").alias("tree"), F.col("hash").alias("subroot"), F.col("pos").alias("tree_pos"), F.col("n").alias("trees"),
        F.col("witness").alias("_above")), "languages")
    return rows.join(above, "tree").select(
        "doc_id", F.col("hash").alias("leaf"), "lang", "pos", "n", "tree_pos", "trees", "subroot", root.select("root").scalar().alias("root"),
        F.concat("witness", "_above").alias("witness"), "presented")


def verify(rows: DataFrame) -> DataFrame:
    """Add ``folded_root``, from what was presented (else the leaf) and the witness, to rows of ``manifest``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf, shown, witness, *path = (batch.column(c).to_pylist() for c in ("leaf", "presented", "witness", "pos", "n", "tree_pos", "trees"))
            roots = [
                fold(s or h, w, [(i, n), (j, m)]) for h, s, w, i, n, j, m in zip(leaf, shown, witness, *path, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, pa.string())], names=[*batch.schema.names, "folded_root"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{schema}, folded_root string")
