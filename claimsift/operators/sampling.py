"""Exact, reproducible samples and splits.

Order inside a stratum is that of ``md5(seed ':' id)``.  Nothing ranks a stratum as a whole: rows are
counted per hash bucket, the bucket in which the quota is reached is found from the running sums, and
only that bucket is ranked.  The outcome is one cut-off per stratum, so the table itself is split by a
comparison on the map side; no text is ever shuffled for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimsift.fixed_values import SAMPLE_SIZE, SEED, SEED_PER_CLASS, SEED_TOTAL, TEST_SHARE
from claimsift.operators.numbering import number_rows
from claimsift.session import materialise

BUCKET_DIGITS = 4  # 65,536 hash buckets per stratum
MOST_STRATA = 10_000  # strata whose cut-offs are broadcast; more are refused


def row_hash(row_id: Column | str, seed: int | str = SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(row_id).cast("string") if isinstance(row_id, str) else row_id))


def by_stratum(left: DataFrame, right: DataFrame, stratum: str, how: str = "inner") -> DataFrame:
    """Join with a table of one row per stratum; null is a stratum like any other."""
    if right.count() > MOST_STRATA:
        raise ValueError(f"more than {MOST_STRATA} strata")
    named = right.withColumnRenamed(stratum, "_stratum_key")
    on = F.col(stratum).eqNullSafe(F.col("_stratum_key"))
    return left.join(F.broadcast(named), on, how).drop("_stratum_key")


def proportional_quotas(sizes: DataFrame, stratum: str, total: Column) -> DataFrame:
    """Share of ``total`` per stratum by largest remainder, ties in label order; exact integer arithmetic.

    ``sizes`` has one row per stratum: (stratum, size).  ``total`` may refer to ``n``, the sum of sizes.
    """
    everything = W.partitionBy(F.lit(0))  # one row per stratum
    shares = (
        sizes.withColumn("n", F.sum("size").over(everything))
        .withColumn("total", total.cast("bigint"))
        .withColumn("product", F.col("size").cast("decimal(19,0)") * F.col("total").cast("decimal(19,0)"))
        .withColumn("base", F.expr("product div n"))
        .withColumn("rest", F.expr("product % n"))
    )
    by_rest = W.partitionBy(F.lit(0)).orderBy(F.desc("rest"), F.asc(stratum))
    missing = F.col("total") - F.sum("base").over(everything)
    extra = F.when(F.row_number().over(by_rest) <= missing, 1).otherwise(0)
    return shares.select(stratum, "size", (F.col("base") + extra).cast("bigint").alias("quota"))


def bucket_counts(keys: DataFrame, stratum: str, row_id: str, seed: int | str = SEED) -> DataFrame:
    """Rows per (stratum, hash bucket), written once: at most strata x 65,536 rows."""
    bucket = F.substring(row_hash(row_id, seed), 1, BUCKET_DIGITS).alias("bucket")
    return materialise(keys.groupBy(F.col(stratum), bucket).agg(F.count(F.lit(1)).alias("rows")), "bucket-counts")


def cut_offs(
    keys: DataFrame, counts: DataFrame, quotas: DataFrame, stratum: str, row_id: str, seed: int | str = SEED
) -> DataFrame:
    """(stratum, cut_hash, cut_id) of the last row inside each quota; a quota of zero has no row."""
    running = counts.withColumn("upto", F.sum("rows").over(W.partitionBy(stratum).orderBy("bucket")))
    edge = (
        by_stratum(running, quotas.select(stratum, "quota"), stratum)
        .where((F.col("upto") >= F.col("quota")) & (F.col("upto") - F.col("rows") < F.col("quota")))
        .select(stratum, "bucket", (F.col("quota") - F.col("upto") + F.col("rows")).alias("need"))
    )
    edge = materialise(edge, "edges")
    hashed = keys.select(stratum, row_id, row_hash(row_id, seed).alias("h"))
    hashed = hashed.withColumn("bucket", F.substring("h", 1, BUCKET_DIGITS))
    rank = F.row_number().over(W.partitionBy(stratum).orderBy("h", row_id))
    last = (
        by_stratum(hashed, edge.withColumnRenamed("bucket", "edge"), stratum).where(F.col("bucket") == F.col("edge"))
        .withColumn("rank", rank)
        .where(F.col("rank") == F.col("need"))
        .select(stratum, F.col("h").alias("cut_hash"), F.col(row_id).alias("cut_id"))
    )
    return materialise(last, "cut-offs")


def inside(row_id: str, seed: int | str = SEED) -> Column:
    """Whether a row joined with its cut-off lies inside the quota."""
    h = row_hash(row_id, seed)
    hit = (h < F.col("cut_hash")) | ((h == F.col("cut_hash")) & (F.col(row_id) <= F.col("cut_id")))
    return F.coalesce(hit, F.lit(False))


def _near(df: DataFrame, n: int, pool: DataFrame, row_id: str, seed: int | str) -> DataFrame:
    """A stored part of ``df`` that holds its first ``n`` rows in hash order: all rows up to a bucket, which is read off the pool."""
    counts = bucket_counts(pool.select(row_id, F.lit("all").alias("_stratum")), "_stratum", row_id, seed)
    upto = counts.withColumn("upto", F.sum("rows").over(W.partitionBy("_stratum").orderBy("bucket")))  # at most 65,536 rows
    wanted = 2 * n
    while True:
        last = upto.where(F.col("upto") >= wanted).agg(F.min("bucket")).first()[0]
        part = df if last is None else df.where(F.substring(row_hash(row_id, seed), 1, BUCKET_DIGITS) <= last)
        part = materialise(part, "near")
        if last is None or part.count() >= n:
            return part
        wanted *= 4


def sample_n(df: DataFrame, n: int, row_id: str = "claim_id", seed: int | str = SEED, pool: DataFrame | None = None) -> DataFrame:
    """Exactly ``n`` rows (all, if there are fewer), the first in hash order.

    The ids are written first, so ``df`` is computed twice.  With ``pool``, a table whose ids hold all those of
    ``df`` (the table before a filter on its texts), it is computed once: what lies near the cut is
    estimated from the ids of the pool, stored, and cut exactly; only if less than half of the pool
    passes the filter, a second time with a wider bound.
    """
    if pool is not None:
        df = _near(df, n, pool, row_id, seed)
    keys = df.select(row_id, F.lit("all").alias("_stratum"))
    keys = keys if pool is not None else materialise(keys, "sample-keys")
    counts = bucket_counts(keys, "_stratum", row_id, seed)
    quotas = counts.groupBy("_stratum").agg(F.least(F.sum("rows"), F.lit(n)).alias("quota"))
    cuts = cut_offs(keys, counts, quotas, "_stratum", row_id, seed).drop("_stratum")
    last = cuts.select(F.struct("cut_hash", "cut_id")).scalar()
    own = F.struct(row_hash(row_id, seed).alias("cut_hash"), F.col(row_id).alias("cut_id"))
    return df.where(own <= last)


def stratified_split(
    df: DataFrame, stratum: str = "tag_clean", row_id: str = "claim_id",
    test_share: float = TEST_SHARE, seed: int | str = SEED,
) -> DataFrame:
    """Add ``split``: the test side has ceil(share x n) rows, spread over strata by largest remainder."""
    keys = df.select(row_id, stratum)
    counts = bucket_counts(keys, stratum, row_id, seed)
    sizes = counts.groupBy(stratum).agg(F.sum("rows").alias("size"))
    quotas = proportional_quotas(sizes, stratum, F.ceil(F.col("n") * F.lit(float(test_share))))
    cuts = cut_offs(keys, counts, quotas, stratum, row_id, seed)
    split = F.when(inside(row_id, seed), "test").otherwise("train")
    return by_stratum(df, cuts, stratum, "left").withColumn("split", split).drop("cut_hash", "cut_id")


def nested_sample(
    split: DataFrame, size: int = SAMPLE_SIZE, stratum: str = "tag_clean", row_id: str = "claim_id",
    seed: int | str = "sample",
) -> DataFrame:
    """Add ``in_sample``: exactly ``size`` rows of the test side, by the same rule."""
    test = split.where("split = 'test'").select(row_id, stratum)
    counts = bucket_counts(test, stratum, row_id, seed)
    sizes = counts.groupBy(stratum).agg(F.sum("rows").alias("size"))
    available = sizes.agg(F.sum("size")).first()[0] or 0
    if size > available:
        raise ValueError(f"a sample of {size} rows was asked for, the test side has {available}")
    quotas = proportional_quotas(sizes, stratum, F.lit(size))
    cuts = cut_offs(test, counts, quotas, stratum, row_id, seed)
    chosen = (F.col("split") == "test") & inside(row_id, seed)
    return by_stratum(split, cuts, stratum, "left").withColumn("in_sample", chosen).drop("cut_hash", "cut_id")


def split_report(split: DataFrame) -> DataFrame:
    """Sizes of both sides and the number of texts present on both (``digest`` identifies a text)."""
    per_text = split.groupBy("digest").agg(
        F.count(F.when(F.col("split") == "train", 1)).alias("train"),
        F.count(F.when(F.col("split") == "test", 1)).alias("test"),
    )
    return per_text.agg(
        F.sum("train").alias("n_train"), F.sum("test").alias("n_test"),
        F.count(F.when((F.col("train") > 0) & (F.col("test") > 0), 1)).alias("n_leaked_texts"),
    )


def balanced_per_class(
    df: DataFrame, per_class: int = SEED_PER_CLASS, stratum: str = "tag_clean", row_id: str = "claim_id",
    seed: int | str = SEED,
) -> DataFrame:
    """min(per_class, class size) rows of every class, the first in hash order; only keys are looked at."""
    keys = df.select(row_id, stratum)
    counts = bucket_counts(keys, stratum, row_id, seed)
    sizes = counts.groupBy(stratum).agg(F.sum("rows").alias("size"))
    quotas = sizes.select(stratum, F.least("size", F.lit(per_class)).alias("quota"))
    cuts = cut_offs(keys, counts, quotas, stratum, row_id, seed)
    return by_stratum(keys, cuts, stratum).where(inside(row_id, seed)).select(row_id, stratum)


def top_up(
    df: DataFrame, chosen: DataFrame, total: int = SEED_TOTAL, row_id: str = "claim_id", seed: int | str = SEED
) -> tuple[DataFrame, int]:
    """Fill ``chosen`` up to ``total`` keys with rows not yet chosen; also return the shortfall."""
    chosen = materialise(chosen, "chosen")
    missing = total - chosen.count()
    if missing <= 0:
        return chosen, 0
    rest = df.select(chosen.columns).join(chosen.select(row_id), row_id, "left_anti").select(chosen.columns)
    added = materialise(sample_n(rest, missing, row_id, seed), "top-up")
    return chosen.unionByName(added), missing - added.count()


def shuffle_rows(df: DataFrame, row_id: str = "claim_id", seed: int | str = "shuffle") -> DataFrame:
    """Random order that can be repeated: add ``position`` 1..n by a second hash."""
    hashed = df.withColumn("_h", row_hash(row_id, seed))
    return number_rows(hashed, ["_h", row_id], "position").drop("_h")


def balanced_seed(
    df: DataFrame, total: int = SEED_TOTAL, per_class: int = SEED_PER_CLASS, stratum: str = "tag_clean",
    row_id: str = "claim_id", seed: int | str = SEED,
) -> DataFrame:
    """Keys of the seed sample with their position: balanced, topped up, shuffled."""
    keys, _ = top_up(df, balanced_per_class(df, per_class, stratum, row_id, seed), total, row_id, seed)
    return shuffle_rows(keys, row_id)


def head_n(df: DataFrame, n: int, order: str = "position") -> DataFrame:
    return df.orderBy(order).limit(n)
