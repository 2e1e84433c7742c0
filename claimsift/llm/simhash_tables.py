"""Document fingerprints: SimHash by votes of weighted terms, found again through permuted block tables.

A term is a run of up to three words; it votes once for every place where it stands, so its weight is
its count.  Votes are added up by an aggregation over exploded term hashes: one sum holds the votes of
two bits.  To find fingerprints within RADIUS bits, a fingerprint is cut into BLOCKS blocks; of two that
near, at least BLOCKS - RADIUS blocks agree, so one table per choice of that many blocks, keyed by
them, has the pair in one bucket.  Everything is made of DataFrame functions.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimsift.operators.numbering import number_rows
from claimsift.session import materialise

HALVES = 2  # 64-bit halves of a fingerprint
BITS = 64 * HALVES
LANES = 32  # sums per half; each holds two bits' votes in 32 bits
RADIUS = 3
BLOCKS = 5
BLOCK_ROWS = 2048  # documents whose neighbours by doc_id are found in one task
MOST_BLOCKS = 1 << 16  # blocks at most; beyond BLOCK_ROWS * MOST_BLOCKS documents the blocks grow
EVERY = 50  # documents whose id divides by it are queries


def words(text: Column) -> Column:
    """Lower-cased (A-Z) words between white space of ASCII."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def fingerprints(texts: DataFrame) -> DataFrame:
    """(key, hi, lo) of ``texts(key, text)``; keys are distinct.  Texts without words have fingerprint 0."""
    listed = texts.select("key", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))
    runs = F.transform("h", lambda h, k: F.xxhash64(h, F.get("h", k + 1), F.get("h", k + 2)))
    terms = listed.select("key", F.explode_outer(runs).alias("hi")).withColumn("lo", F.xxhash64("hi"))
    mask = F.lit((1 << LANES) | 1)
    votes = [
        F.sum(F.shiftrightunsigned(half, lane).bitwiseAND(mask)).alias(f"{half}{lane}")
        for half in ("hi", "lo") for lane in range(LANES)]
    added = terms.groupBy("key").agg(F.count("hi").alias("n"), *votes)

    def bits(half: str) -> Column:
        low = lambda lane: F.col(f"{half}{lane}").bitwiseAND(F.lit((1 << LANES) - 1))
        high = lambda lane: F.shiftrightunsigned(f"{half}{lane}", LANES)
        at = lambda lane: [(low(lane), lane), (high(lane), lane + LANES)]
        ones = [F.when(F.lit(2) * count > F.col("n"), F.shiftleft(F.lit(1).cast("bigint"), bit)).otherwise(F.lit(0).cast("bigint"))
                for lane in range(LANES) for count, bit in at(lane)]
        return reduce(Column.bitwiseOR, ones)

    return added.select("key", bits("hi").alias("hi"), bits("lo").alias("lo"))


def with_next(docs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``docs(doc_id, text)`` with ``next``, the text that follows by descending doc_id; after the last, the first.

    Only ids are sorted as a whole.  They give the first id of each block; every block also takes the
    document that begins the next one, so texts are shuffled once and each block is ordered by itself.
    """
    order = [F.desc_nulls_last("doc_id")]
    ids = docs.select("doc_id").where("doc_id is not null")
    total = ids.count()
    rows = max(block_rows, -(-total // MOST_BLOCKS))
    numbered = number_rows(ids.select(F.col("doc_id").cast("bigint").alias("doc_id")), [F.desc("doc_id")], "place", 0)
    firsts = sorted({r[0] for r in numbered.where(F.col("place") % rows == 0).select("doc_id").collect()}, reverse=True)  # MOST_BLOCKS ids
    listed = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")  # noqa: E731  folded to one value
    step = max(1, int(len(firsts) ** 0.5))
    starts, coarse = listed(firsts or [0]), listed(firsts[::step] or [0])
    doc_id = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63)))
    reached = lambda array: F.size(F.filter(array, lambda x: x >= doc_id))
    # Two look-ups of a root of the blocks each: the stretch of starts, then the start within it.
    stretch = F.greatest(reached(coarse) - 1, F.lit(0)) * step
    block = F.greatest(stretch + reached(F.slice(starts, stretch + 1, F.lit(step))) - 1, F.lit(0))
    begins = F.array_contains(F.slice(starts, block + 1, F.lit(1)), doc_id)
    last = max(0, len(firsts) - 1)
    taken = docs.select("doc_id", "text", block.alias("block"), begins.alias("begins"))
    before = F.when(F.col("block") == 0, F.lit(last)).otherwise(F.col("block") - 1)
    own = F.struct(F.col("block").alias("block"), F.lit(0).alias("guest"))
    guest = F.struct(before.cast("int").alias("block"), F.lit(1).alias("guest"))
    dealt = taken.select("doc_id", "text", F.explode(F.when(F.col("begins"), F.array(own, guest)).otherwise(F.array(own))).alias("at"))
    line = W.partitionBy("at.block").orderBy("at.guest", *order, F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    followed = dealt.withColumn("next", F.lead("text").over(line))
    return followed.where("at.guest = 0").select("doc_id", "text", "next")


def likeness(a: list[Column], b: list[Column]) -> Column:
    apart = reduce(Column.__add__, [F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b, strict=True)])
    return F.lit(1.0) - apart / F.lit(float(BITS))


def block_keys(hi: Column, lo: Column) -> list[Column]:
    """One key per table: the blocks that its choice keeps."""
    edges = [BITS * k // BLOCKS for k in range(BLOCKS + 1)]

    def part(half: Column, first: int, stop: int) -> Column:
        return F.shiftrightunsigned(half, 64 - stop).bitwiseAND(F.lit((1 << (stop - first)) - 1))

    blocks = []
    for a, b in zip(edges, edges[1:], strict=False):
        halves = [part(half, max(a, at) - at, min(b, at + 64) - at) for half, at in ((hi, 0), (lo, 64)) if max(a, at) < min(b, at + 64)]
        blocks.append(halves[0] if len(halves) == 1 else F.shiftleft(halves[0], b - 64).bitwiseOR(halves[1]))
    width = max(b - a for a, b in zip(edges, edges[1:], strict=False))
    return [reduce(lambda key, x: F.shiftleft(key, width).bitwiseOR(x), (blocks[k] for k in kept)) for kept in combinations(range(BLOCKS), BLOCKS - RADIUS)]


def near(queries: DataFrame, prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(hi, lo, other_hi, other_lo, n, apart): every pair of distinct fingerprints within ``radius`` bits.

    ``queries(hi, lo)`` and ``prints(hi, lo, n)`` have distinct fingerprints.  A pair is taken from
    the first table in which it shares a bucket.  The radius may be RADIUS or less.
    """
    def tables(df: DataFrame, names: list[str]) -> DataFrame:
        keys = F.array(*block_keys(F.col("hi"), F.col("lo")))
        return df.select(*[F.col(a).alias(b) for a, b in zip(df.columns, names, strict=True)], F.posexplode(keys).alias("table", "key"))

    left = tables(queries.select("hi", "lo"), ["hi", "lo"])
    right = tables(prints.select("hi", "lo", "n"), ["other_hi", "other_lo", "n"])
    apart = F.bit_count(F.col("hi").bitwiseXOR(F.col("other_hi"))) + F.bit_count(F.col("lo").bitwiseXOR(F.col("other_lo")))
    ours, theirs = block_keys(F.col("hi"), F.col("lo")), block_keys(F.col("other_hi"), F.col("other_lo"))
    agreeing = F.array(*[a == b for a, b in zip(ours, theirs, strict=True)])
    pairs = left.join(right, ["table", "key"]).where(apart <= radius).where(F.array_position(agreeing, True) == F.col("table") + 1)
    return pairs.select("hi", "lo", "other_hi", "other_lo", "n", apart.alias("apart"))


def fingerprint_documents(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_near) per row of ``docs``.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all)
    of the next text by descending doc_id; the last is followed by the first, and a lone document by itself.
    Rows that repeat a doc_id follow one another in the order of their text's md5; null ids come last.
    n_near, for ids that divide by EVERY, counts the other rows whose fingerprint is within ``radius`` bits;
    it is null elsewhere.  Null texts are empty; an empty table gives no rows; further columns are ignored.
    """
    rows = with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring(F.coalesce("next", "text"), F.lit(1), half))
    named = rows.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.length("text").cast("bigint").alias("n_chars"), "text", edited.alias("edited"),
        F.md5(F.col("text").cast("binary")).alias("digest"), F.md5(F.coalesce("next", "text").cast("binary")).alias("next_digest"))
    head = F.struct("row", "doc_id", "n_chars", "digest", "next_digest", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    both = named.select(F.explode(F.array(
        F.struct(F.struct(head.alias("head"), F.lit(0).alias("which")).alias("key"), F.col("text").alias("text")),
        F.struct(F.struct(head.alias("head"), F.lit(1).alias("which")).alias("key"), F.col("edited").alias("text")))).alias("x"))
    prints = fingerprints(both.select("x.key", "x.text"))
    pick = lambda which, half: F.max(F.when(F.col("key.which") == which, F.col(half)))
    prints = materialise(prints.groupBy(F.col("key.head").alias("head")).agg(
        pick(0, "hi").alias("hi"), pick(0, "lo").alias("lo"), pick(1, "hi").alias("edited_hi"), pick(1, "lo").alias("edited_lo")
    ).select("head.*", "hi", "lo", "edited_hi", "edited_lo"), "fingerprints")

    of_text = prints.select(F.col("digest").alias("next_digest"), F.col("hi").alias("next_hi"), F.col("lo").alias("next_lo")).groupBy("next_digest").agg(
        F.max("next_hi").alias("next_hi"), F.max("next_lo").alias("next_lo"))
    queries = prints.where(F.col("doc_id") % EVERY == 0).select("hi", "lo").distinct()
    counted = prints.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n"))
    found = near(queries, counted, radius).groupBy("hi", "lo").agg((F.sum("n") - 1).alias("n_near"))
    own, edit = [F.col("hi"), F.col("lo")], [F.col("edited_hi"), F.col("edited_lo")]
    text = lambda half: F.concat(*[F.lpad(F.lower(F.hex(h)), 16, "0") for h in half])
    out = prints.join(of_text, "next_digest").join(found, ["hi", "lo"], "left")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", text(own).alias("fingerprint"), text(edit).alias("edited_fingerprint"),
        likeness(own, edit).alias("near_edited"), likeness(own, [F.col("next_hi"), F.col("next_lo")]).alias("near_next"),
        F.when(F.col("doc_id") % EVERY == 0, F.col("n_near")).alias("n_near"))
