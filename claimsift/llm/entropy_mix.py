"""Mixing sources to target weights by entropy balancing of tokens.

Rates r of the documents minimise the sum of size * (r ln r - r) while every source's size * r adds
up to its target.  The dual has one unknown per source and is solved by Newton steps, each an
aggregation over the table of sizes; rates are exp(unknown).  Rates become whole copies by one
cut-off per source: a document gets the whole part, and one copy more if the md5 of its id is not
above the cut-off, which is chosen where the words taken come nearest to the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimsift.operators.numbering import number_rows
from claimsift.session import materialise

WEIGHTS = (5, 2, 1)  # of the sources in order, repeating
MOST = 3  # times a source's size that its target may reach
CLOSE = 1e-12  # share of a target by which the solved total may differ
STEPS = 200  # Newton steps; a source short of its target loses at most 1 per step in the logarithm
BUCKET_DIGITS = 4  # hexadecimal digits of a bucket of ids


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def order_key(doc_id: Column) -> Column:
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target): weights go round the sources by code point, null last.

    All sizes are shared out by weight; a share above ``most`` times its source's size stops there
    and the excess is shared again by weight, until none is above.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    numbered = number_rows(totals, [F.col("source").asc_nulls_last()], "place", 0)
    weight = F.array(*[F.lit(w) for w in weights])[(F.col("place") % len(weights)).cast("int")]
    sources = materialise(numbered.select("source", "source_size", weight.alias("weight")), "sources")
    total, rest = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    if total is None:
        return sources.select("source", "source_size", F.lit(0.0).alias("target"))
    level, stopped = total / rest, 0
    full = F.col("source_size") * most
    while True:
        above = full < F.col("weight") * F.lit(level)
        n, held, rest = sources.agg(F.count_if(above), F.coalesce(F.sum(F.when(above, full)), F.lit(0)),
                                    F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0))).first()
        if n == stopped or not rest:
            break
        level, stopped = (total - held) / rest, n
    target = F.when(full < F.col("weight") * F.lit(level), full.cast("double")).otherwise(F.col("weight") * F.lit(level))
    return sources.select("source", "source_size", target.alias("target"))


def solve_rates(sizes: DataFrame, targets: DataFrame, close: float = CLOSE) -> DataFrame:
    """``targets`` with ``rate``: exp of the dual unknown of the source, 0 for a target of 0."""
    counts = materialise(sizes.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "size-counts")
    state = materialise(targets.withColumn("unknown", F.lit(0.0)), "dual")
    for _ in range(STEPS):
        held = F.broadcast(state) if state.count() <= 10_000 else state  # rows of two numbers and a name
        tilted = counts.join(held.select(F.col("source").alias("s"), "unknown"), same(F.col("source"), F.col("s")))
        mass = tilted.groupBy("source").agg(F.sum(F.col("n") * F.col("size") * F.exp("unknown")).alias("mass"))
        mass = mass.withColumnRenamed("source", "s")
        step = F.when((F.col("target") > 0) & (F.col("mass") > 0), (F.col("target") - F.col("mass")) / F.col("mass"))
        moved = state.join(mass, same(F.col("source"), F.col("s")), "left").select(
            *targets.columns, F.coalesce(F.col("unknown") + step, "unknown").alias("unknown"), F.abs(step).alias("off"))
        moved = materialise(moved, "dual")
        worst = moved.agg(F.max("off")).first()[0]
        state = moved.drop("off")
        if worst is None or worst <= close:
            break
    else:
        raise RuntimeError("the dual did not converge")
    return state.select(*targets.columns, F.when(F.col("target") > 0, F.exp("unknown")).otherwise(0.0).alias("rate"))


def cut_offs(sizes: DataFrame, rates: DataFrame) -> DataFrame:
    """``rates`` with copies every document gets (``whole``) and ``cut``: ids with md5 up to it get one more.

    Sizes are summed per bucket of the md5; only the bucket in which the remainder is reached is ordered.
    """
    whole = F.floor(F.col("rate") + 1e-9)
    rates = materialise(rates.withColumn("whole", whole).withColumn(
        "extra", F.col("target") - whole * F.col("source_size")), "rates")
    keyed = sizes.select("source", "size", order_key(F.col("doc_id")).alias("key"))
    keyed = keyed.withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    sums = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("size"))
    upto = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)  # 65,536 rows a source
    running = sums.withColumn("upto", F.sum("size").over(upto))
    short = rates.select(F.col("source").alias("s"), "extra")
    crossing = running.join(short, same(F.col("source"), F.col("s"))).where("upto > extra").groupBy("s").agg(
        F.min(F.struct("bucket", (F.col("upto") - F.col("size")).alias("before"), "extra")).alias("at"))
    crossing = materialise(crossing.select("s", "at.*"), "crossing-buckets")
    inside = keyed.join(crossing.withColumnRenamed("bucket", "b"), same(F.col("source"), F.col("s")) & (F.col("bucket") == F.col("b")))
    inside = inside.groupBy("s", "key", "before", "extra").agg(F.sum("size").alias("size"))
    sofar = W.partitionBy("s").orderBy("key").rowsBetween(W.unboundedPreceding, -1)  # one bucket of a source
    chosen = inside.withColumn("upto", F.col("before") + F.coalesce(F.sum("size").over(sofar), F.lit(0)))
    last = chosen.where("upto + size / 2 <= extra").groupBy("s").agg(F.max("key").alias("key"))
    cuts = crossing.select("s", "bucket").join(last.withColumnRenamed("s", "t"), same(F.col("s"), F.col("t")), "left").select(
        "s", F.coalesce("key", "bucket").alias("cut"))
    return rates.join(cuts, same(F.col("source"), F.col("s")), "left").select(
        "source", "source_size", "target", "rate", "whole", F.coalesce("cut", F.lit("g")).alias("cut"))  # "g": above any md5


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """The table of (doc_id, source, size) and the decisions per source for ``docs``."""
    sizes = materialise(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    targets = materialise(source_targets(sizes, weights, most), "targets")
    return sizes, materialise(cut_offs(sizes, solve_rates(sizes, targets)), "cut-offs")


def with_copies(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """``rows(doc_id, source, ...)`` with ``decision``, the struct of the source's figures and the copies."""
    figures = decisions.select(F.col("source").alias("_source"), F.struct(
        "source_size", "target", "rate", "whole", "cut").alias("_figures"))
    extra = (order_key(F.col("doc_id")) <= F.col("_figures.cut")).cast("bigint")
    joined = rows.join(figures, same(F.col("source"), F.col("_source")))
    return joined.withColumn("decision", F.struct("_figures.*", (F.col("_figures.whole") + extra).alias("copies"))).drop("_source", "_figures")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies, rate) for every row of ``docs``.

    size: words of the text, 0 for null.  taken: copies * size.  Rows that repeat a doc_id are rows
    of their own and get the same copies; null ids are one id; null sources are one source, the last;
    sources without words have target 0; an empty table gives no rows; further columns are ignored.
    """
    sizes, decisions = plan(docs, weights, most)
    out = with_copies(sizes, decisions)
    return out.select(
        "doc_id", "size", "decision.source_size", "decision.target", (F.col("decision.copies") * F.col("size")).alias("taken"),
        "decision.copies", "decision.rate")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The documents that the mix takes, with columns ``size``, ``target`` and ``copies`` behind their own.

    Columns of ``docs`` with these names are replaced.  Texts stay where they are while the
    decisions, one row per source, are small enough to be broadcast by their size.
    """
    _, decisions = plan(docs, weights, most)
    own = [c for c in docs.columns if c not in ("size", "target", "copies")]
    row = docs.select("doc_id", "source", n_words(F.col("text")).alias("n"), F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"))
    out = with_copies(row, decisions).where("decision.copies > 0")
    return out.select("row.*", F.col("n").alias("size"), "decision.target", "decision.copies")
