"""Shards of even size that keep equal documents together: balanced label propagation.

Documents of equal text are linked, all with each other.  They start where a hash puts them, and in
each round a text's copies move towards the shard in which most of them (their neighbours) stand.
Copies of one text are alike, so the state is a count per text and shard: a joined, aggregated table.
Rounds keep quotas: from the volume that wants to go from each shard to each other one, flows are
worked out that no shard's capacity forbids, and the copies that move are the first ones by hash up to
the flow; a text that a shard cannot take as a whole is cut there, and only there.  Documents without
copies have no links and fill the shards up to an even number of bytes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimsift.llm.common import number_within
from claimsift.session import materialise

SHARDS = 8
ROUNDS = 64  # at most; a round that moves nothing ends them
BUCKET_BITS = 16  # leading bits of a hash by which volumes are added up
CHUNK_BITS = 14  # copies of a text that are joined with its places under one key
HEAVY = 64  # documents of this share of a mean shard are placed one by one
EVEN = 1e-3  # share of the capacity that copies may lie above it
BLOCKED = 0.1  # a shard that takes less than this share of what wants to come is closed


def bucket(key: Column) -> Column:
    return F.shiftrightunsigned(key, 64 - BUCKET_BITS)


def flows(wanted: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The largest scaling of ``wanted[from, to]`` found under which no shard gains more than its ``room``."""
    found = wanted.astype(float)
    for _ in range(200):
        arriving, allowed = found.sum(axis=0), np.maximum(room + found.sum(axis=1), 0)
        over = arriving > allowed * (1 + 1e-9)
        if not over.any():
            break
        found[:, over] *= allowed[over] / arriving[over]
    return found


def _by_shard(cells: DataFrame, shards: int) -> np.ndarray:
    loads = np.zeros(shards)
    for shard, load in cells.groupBy("shard").agg(F.sum(F.col("n") * F.col("size"))).collect():  # a row per shard
        loads[shard] = load
    return loads


def _move(cells: DataFrame, wishes: DataFrame, room: np.ndarray, most: np.ndarray | None = None) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Cells after a round, with what moved and what wanted to; ``wishes`` are cells with ``target`` and ``key``.

    Which copies move from one shard to another: the first by ``key`` up to the flow.  Volumes are
    added up per bucket of keys, and only the bucket in which the flow ends is put in order.
    """
    spark, shards = cells.sparkSession, len(room)
    wishes = materialise(wishes.withColumn("bucket", bucket(F.col("key"))), "wishes")
    volumes = materialise(wishes.groupBy("shard", "target", "bucket").agg(F.sum(F.col("n") * F.col("size")).alias("volume")), "volumes")
    wanted = np.zeros((shards, shards))
    for source, target, volume in volumes.groupBy("shard", "target").agg(F.sum("volume")).collect():  # shards x shards
        wanted[source, target] = volume
    if most is not None:  # what each shard gives away
        wanted *= np.minimum(1, most / np.maximum(wanted.sum(axis=1), 1))[:, None]
    allowed = flows(wanted, room)
    if not allowed.any():
        return cells, allowed, wanted
    quotas = spark.createDataFrame(
        [(s, t, float(allowed[s, t])) for s in range(shards) for t in range(shards) if wanted[s, t]], "shard int, target int, quota double")
    upto = F.sum("volume").over(W.partitionBy("shard", "target").orderBy("bucket"))  # at most 2^BUCKET_BITS rows
    edges = volumes.withColumn("upto", upto).join(F.broadcast(quotas), ["shard", "target"]).groupBy("shard", "target").agg(
        F.first("quota").alias("quota"), F.min(F.when(F.col("upto") > F.col("quota"), F.col("bucket"))).alias("edge"),
        F.coalesce(F.max(F.when(F.col("upto") <= F.col("quota"), F.col("upto"))), F.lit(0)).alias("before"))
    edges = spark.createDataFrame(edges.collect(), edges.schema)  # shards x shards rows
    placed = wishes.join(F.broadcast(edges), ["shard", "target"])
    whole = placed.where("edge is null or bucket < edge").withColumn("moved", F.col("n"))
    volume = F.col("n") * F.col("size")
    ahead = F.sum(volume).over(W.partitionBy("shard", "target").orderBy("key", "digest")) - volume
    part = placed.where("bucket = edge").withColumn("moved", F.floor((F.col("quota") - F.col("before") - ahead) / F.col("size") + 1e-6))
    part = part.withColumn("moved", F.greatest(F.lit(0), F.least("n", "moved")).cast("bigint"))
    columns = ["digest", "size", "shard", "target", "moved"]
    moved = materialise(whole.select(columns).unionByName(part.select(columns)).where("moved > 0"), "moved")
    changed = cells.select("digest", "size", "shard", "n").unionByName(
        moved.select("digest", "size", "shard", (-F.col("moved")).alias("n"))).unionByName(
        moved.select("digest", "size", F.col("target").alias("shard"), F.col("moved").alias("n")))
    cells = materialise(changed.groupBy("digest", "size", "shard").agg(F.sum("n").alias("n")).where("n > 0"), "cells")
    done = np.zeros((shards, shards))
    for source, target, volume in moved.groupBy("shard", "target").agg(F.sum(F.col("moved") * F.col("size"))).collect():
        done[source, target] = volume
    return cells, done, wanted


def relieve(cells: DataFrame, loads: np.ndarray, capacity: float) -> tuple[DataFrame, np.ndarray]:
    """Cells and loads after shards clearly above ``capacity`` have given copies away, the fullest to the emptiest."""
    for turn in range(4 * len(loads)):
        source, target = int(np.argmax(loads)), int(np.argmin(loads))
        if loads[source] - capacity <= EVEN * capacity:
            break
        most = np.zeros(len(loads))
        most[source] = min(loads[source] - capacity, capacity - loads[target])
        wishes = cells.where(F.col("shard") == source).withColumn("target", F.lit(target)).withColumn("key", F.xxhash64("digest", F.lit(-1 - turn)))
        cells, done, _ = _move(cells, wishes, np.maximum(capacity - loads, 0), most)
        loads = loads + done.sum(axis=0) - done.sum(axis=1)
        if not done.any():
            break
    return cells, loads


def propagate(cells: DataFrame, capacity: float, shards: int = SHARDS) -> DataFrame:
    """``cells(digest, size, shard, n)`` after the copies of each text have gathered as far as capacity lets them.

    Copies go to the open shard in which most copies of their text stand (equal numbers: by a hash,
    so that as many wish to come as to go).  A shard that hardly takes any of those that want to come is closed, and its texts gather in
    another one.  Shards above their capacity first give copies away.
    """
    loads = _by_shard(cells, shards)
    closed: set[int] = set()
    for turn in range(ROUNDS):
        own = F.struct("n", F.xxhash64("digest", "shard").alias("order"), "shard")
        is_open = ~F.col("shard").isin(sorted(closed)) if closed else F.lit(True)
        best = cells.where(is_open).groupBy("digest").agg(F.max(own).alias("best"))
        wishes = cells.join(best, "digest").where(F.col("best") > own).withColumn("target", F.col("best.shard"))
        wishes = wishes.select("digest", "size", "shard", "n", "target", F.xxhash64("digest", F.lit(turn)).alias("key"))
        cells, done, wanted = _move(cells, wishes, capacity - loads)
        loads += done.sum(axis=0) - done.sum(axis=1)
        asked = wanted.sum(axis=0)
        blocked = {t for t in range(shards) if asked[t] and done[:, t].sum() < BLOCKED * asked[t]} - closed
        closed |= blocked
        if not done.any() and not blocked:
            break
    return relieve(cells, loads, capacity)[0]


def _largest_first(rows: list) -> list:
    return sorted(rows, key=lambda r: (-r[1], bytes(r[0])))


def fill(singles: DataFrame, loads: np.ndarray) -> DataFrame:
    """``singles(digest, size, ...)`` with ``shard``, such that loads and sizes together are as even as can be.

    Documents that are large beside a shard, at most shards * HEAVY, go one by one, the largest first, to
    the shard that has least.  Each class of sizes (powers of two) of the others is dealt in the order of a hash,
    cut where the shards' shares end, and the few documents that lie across a cut, at most one per class
    and cut, again go one by one.
    """
    spark, shards = singles.sparkSession, len(loads)
    least = max(1, -(-int(singles.agg(F.sum("size")).first()[0] or 0) // (shards * HEAVY)))
    loads, large = loads.copy(), []
    for digest, size in _largest_first(singles.where(F.col("size") >= least).select("digest", "size").collect()):
        large.append((digest, int(np.argmin(loads))))
        loads[large[-1][1]] += size
    large = spark.createDataFrame(large, "digest binary, shard int")
    columns = [*singles.columns, "shard"]
    heavy = singles.where(F.col("size") >= least).join(F.broadcast(large), "digest").select(columns)
    singles = singles.where(F.col("size") < least)
    key = F.xxhash64("digest")
    rows = singles.withColumn("class", F.floor(F.log2("size")).cast("int")).withColumn("key", key).withColumn("bucket", bucket(key))
    volumes = materialise(rows.groupBy("class", "bucket").agg(F.sum("size").alias("volume")), "fill-volumes")
    classes = {c: int(v) for c, v in volumes.groupBy("class").agg(F.sum("volume")).collect()}  # at most 63
    total = sum(classes.values())
    level = min(((loads[loads <= x].sum() + total) / (loads <= x).sum() for x in loads), default=0.0)
    missing = np.maximum(level - loads, 0)
    share = np.cumsum(missing / max(missing.sum(), 1))[:-1]
    cuts = {c: (share * v).tolist() for c, v in classes.items()}
    bounds = spark.createDataFrame(list(cuts.items()), "class int, cuts array<double>")
    running = volumes.withColumn("upto", F.sum("volume").over(W.partitionBy("class").orderBy("bucket"))).join(F.broadcast(bounds), "class")
    before = F.col("upto") - F.col("volume")
    passed = lambda end: F.size(F.filter("cuts", lambda c: c <= end))
    reached = lambda end: F.size(F.filter("cuts", lambda c: c < end))
    crossed = running.withColumn("before", before).where(passed(F.col("before")) < reached(F.col("upto")))
    crossed = crossed.select("class", "bucket", "before")  # at most shards - 1 buckets per class
    inner = running.join(F.broadcast(crossed.select("class", "bucket")), ["class", "bucket"], "left_anti")
    steps = inner.groupBy("class", passed(before).alias("shard")).agg(F.min("bucket").alias("first"))
    steps = steps.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("first", "shard"))).alias("steps"))
    edge = rows.join(F.broadcast(crossed), ["class", "bucket"]).join(F.broadcast(bounds), "class")
    start = F.col("before") + F.sum("size").over(W.partitionBy("class", "bucket").orderBy("key", "digest")) - F.col("size")
    edge = materialise(edge.withColumn("start", start).withColumn("shard", passed(F.col("start"))).withColumn(
        "across", passed(F.col("start")) < reached(F.col("start") + F.col("size"))), "fill-edges")
    whole = rows.join(F.broadcast(crossed.select("class", "bucket")), ["class", "bucket"], "left_anti").join(F.broadcast(steps), "class")
    last = F.element_at(F.filter("steps", lambda s: s["first"] <= F.col("bucket")), -1)["shard"]
    settled = materialise(whole.withColumn("shard", last).select(columns).unionByName(edge.where("not across").select(columns)), "filled")
    for shard, size in settled.groupBy("shard").agg(F.sum("size")).collect():
        loads[shard] += size
    placed = []
    across = edge.where("across").select("digest", "size").collect()  # at most shards - 1 per class
    for digest, size in _largest_first(across):
        placed.append((digest, int(np.argmin(loads))))
        loads[placed[-1][1]] += size
    placed = spark.createDataFrame(placed, "digest binary, shard int")
    return heavy.unionByName(settled).unionByName(edge.where("across").drop("shard").join(F.broadcast(placed), "digest").select(columns))


def balanced_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row of ``docs``: even in bytes, equal texts together.

    size is the UTF-8 bytes of the text and one; a null text counts as an empty one.  slot numbers the
    rows of a shard from 0, by doc_id.  Rows of equal text are linked, repeated rows and null ids
    like any other; a text that no shard can hold beside its neighbours is cut.  Further columns are ignored; an
    empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = materialise(docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.md5(text.cast("binary"))).alias("digest")), "sizes")
    rows = materialise(number_within(rows, "digest", ["doc_id"]), "copies")
    capacity = (rows.agg(F.sum("size")).first()[0] or 0) / shards
    start = F.pmod(F.xxhash64("digest", "pos"), F.lit(shards)).cast("int").alias("shard")
    linked = rows.where("n > 1")
    cells = materialise(linked.groupBy("digest", "size", start).agg(F.count(F.lit(1)).alias("n")), "cells")
    cells = propagate(cells, capacity, shards)
    spans = cells.groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("shard", "n"))).alias("spans"), F.sum("n").alias("total"))
    chunks = spans.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.shiftright(F.col("total") - 1, CHUNK_BITS)))).drop("total")
    ends = F.transform("spans", lambda s, k: F.struct(F.aggregate(F.slice("spans", F.lit(1), k + 1), F.lit(0).cast("bigint"), lambda a, x: a + x["n"]).alias("end"), s["shard"].alias("shard")))
    gathered = linked.withColumn("chunk", F.shiftright("pos", CHUNK_BITS)).join(chunks.withColumn("spans", ends), ["digest", "chunk"])
    gathered = gathered.withColumn("shard", F.element_at(F.filter("spans", lambda s: s["end"] > F.col("pos")), 1)["shard"])
    columns = ["doc_id", "size", "text_crc32", "digest", "shard"]
    alone = fill(rows.where("n = 1").drop("pos", "n"), _by_shard(cells, shards))
    placed = materialise(gathered.select(columns).unionByName(alone.select(columns)), "sharded")
    numbered = number_within(placed, "shard", ["doc_id", "digest"])
    return numbered.select("doc_id", "size", "text_crc32", "shard", F.col("pos").alias("slot"))
