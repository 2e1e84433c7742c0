"""From raw claims to unique, usable, harmonised claims."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimsift.fixed_values import LENGTH_CAP, MIN_SUPPORT, TAXONOMY
from claimsift.functions.text import strip_text, word_count
from claimsift.session import materialise

TAXONOMY_BROADCAST_ROWS = 10_000


def select_useful(raw: DataFrame) -> DataFrame:
    keep = ["claim_id", "date_received", "tag", "claim", "company", "label"]
    return raw.select([c for c in keep if c in raw.columns])


def drop_missing_text(raw: DataFrame) -> DataFrame:
    return raw.where(F.col("claim").isNotNull())


def drop_blank_text(stripped: DataFrame) -> DataFrame:
    return stripped.where(F.col("claim") != "")


def usable_text(raw: DataFrame) -> DataFrame:
    """Claims with text, stripped, blank ones dropped.  Map-side only."""
    return drop_blank_text(drop_missing_text(raw).withColumn("claim", strip_text("claim")))


def coverage(raw: DataFrame) -> DataFrame:
    """Rows, rows with usable text, and their share in percent: one pass."""
    usable = F.col("claim").isNotNull() & (strip_text("claim") != "")
    return raw.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(F.when(usable, 1)).alias("n_usable"),
    ).withColumn("pct_usable", F.round(F.col("n_usable") * F.lit(100.0) / F.col("n_rows"), 6))


def text_presence_share(raw: DataFrame) -> DataFrame:
    """Present and missing text on the raw table (blank text counts as present)."""
    return (
        raw.agg(F.count("claim").alias("present"), F.count(F.lit(1)).alias("total"))
        .selectExpr("total", "stack(2, true, present, false, total - present) AS (has_text, n)")
        .where("n > 0")
        .select("has_text", "n", F.round(F.col("n") * F.lit(100.0) / F.col("total"), 6).alias("pct"))
    )


def unique_keys(usable: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Key of the first row of every (text, tag), without the text.

    Grouping is by digest and the aggregates are numbers, so copies collapse before the shuffle however
    many there are, and no text is shuffled.  ``carry`` columns must be determined by the text.
    """
    return usable.groupBy(F.sha2("claim", 256).alias("digest"), "tag").agg(
        F.min("claim_id").alias("claim_id"), *[F.min(c).alias(c) for c in carry]
    )


def dedup_exact(usable: DataFrame) -> DataFrame:
    """One row per (text, tag), the one that came first; a missing tag is a group of its own.

    Texts stay where they are: only the ids that are not first, the smaller part, are joined with them.
    """
    digest = F.sha2("claim", 256).alias("digest")
    keys = materialise(usable.select("claim_id", digest, "tag"), "text-keys")
    copied = keys.groupBy("digest", "tag").agg(F.min("claim_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copied = copied.select("digest", F.col("tag").alias("_tag"), "first")
    later = keys.join(copied, "digest").where(F.col("tag").eqNullSafe(F.col("_tag")) & (F.col("claim_id") > F.col("first")))
    return usable.join(materialise(later.select("claim_id"), "later-copies"), "claim_id", "left_anti")


def harmonise_tag(df: DataFrame, taxonomy: Mapping[str, str] = TAXONOMY) -> DataFrame:
    """Add ``tag_clean``: mapped tag, else the tag itself; missing stays missing."""
    spark = df.sparkSession
    table = spark.createDataFrame(list(taxonomy.items()), "tag string, mapped string")
    if len(taxonomy) <= TAXONOMY_BROADCAST_ROWS:
        table = F.broadcast(table)
    return df.join(table, "tag", "left").withColumn("tag_clean", F.coalesce("mapped", "tag")).drop("mapped")


def clean_claims(raw: DataFrame, taxonomy: Mapping[str, str] = TAXONOMY) -> DataFrame:
    """The whole chain, with word counts."""
    unique = dedup_exact(usable_text(select_useful(raw)))
    return harmonise_tag(unique, taxonomy).withColumn("word_count", word_count("claim"))


def claim_profile(raw: DataFrame, taxonomy: Mapping[str, str] = TAXONOMY) -> DataFrame:
    """Unique usable claims with tags and word count but without their text: one pass over the texts.

    All counts and length profiles need no more than this.
    """
    counted = usable_text(select_useful(raw)).withColumn("word_count", word_count("claim"))
    return harmonise_tag(unique_keys(counted, ("word_count",)).drop("digest"), taxonomy)


def length_cap(df: DataFrame, cap: int = LENGTH_CAP) -> DataFrame:
    return df.where(F.col("word_count") <= cap)


def tag_counts(df: DataFrame, tag: str, keep_null: bool = False) -> DataFrame:
    """Rows per tag, largest first."""
    rows = df if keep_null else df.where(F.col(tag).isNotNull())
    return rows.groupBy(tag).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc_nulls_last(tag))


def distinct_tags(df: DataFrame) -> DataFrame:
    """Distinct non-null raw and harmonised tags, from one row per distinct pair."""
    pairs = df.groupBy("tag", "tag_clean").agg(F.lit(1).alias("one"))
    return pairs.agg(
        F.count_distinct("tag").alias("n_raw_tags"), F.count_distinct("tag_clean").alias("n_clean_tags")
    )


def min_support_filter(df: DataFrame, minimum: int = MIN_SUPPORT, tag: str = "tag_clean", stored: bool = False) -> DataFrame:
    """Rows whose tag has at least ``minimum`` rows.

    The rows are needed twice, so they are written first unless they are those of a ``stored`` table.
    The surviving tags are written as well: the planner then broadcasts them if they are small enough.
    """
    df = df if stored else materialise(df, "tagged-rows")
    counts = df.where(F.col(tag).isNotNull()).groupBy(tag).agg(F.count(F.lit(1)).alias("support"))
    valid = materialise(counts.where(F.col("support") >= minimum).select(tag), "valid-tags")
    return df.join(valid, tag, "left_semi")
