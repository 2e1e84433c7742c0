"""Profiles of the claims: columns, lengths, frequent expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimsift.fixed_values import DENSITY_POINTS, LENGTH_BINS, PROFILE_SAMPLE, PROFILE_TOP, SEED
from claimsift.functions.text import with_ngrams, with_tokens
from claimsift.operators.features import term_totals, top_terms
from claimsift.operators.sampling import sample_n
from claimsift.session import materialise

PREVIEW_ROWS = 5


def profile_table(df: DataFrame) -> DataFrame:
    """Per column: position, name, non-null rows, all rows.  One pass, then unpivoted."""
    names = df.columns
    totals = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(f"_c{i}") for i, c in enumerate(names)])
    cells = ", ".join(f"{i}, '{c}', _c{i}" for i, c in enumerate(names))
    return totals.selectExpr(f"stack({len(names)}, {cells}) AS (position, column_name, n_non_null)", "_rows AS n_rows")


def preview(df: DataFrame, row_id: str = "claim_id", rows: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows of the table, by id; every task hands on that many at most."""
    return df.orderBy(row_id).limit(rows)


def length_frequencies(capped: DataFrame) -> DataFrame:
    """Rows per word count: as many rows as the cap at most, whatever the size of the table."""
    return capped.groupBy("word_count").agg(F.count(F.lit(1)).alias("freq"))


def length_histogram(capped: DataFrame, bins: int = LENGTH_BINS) -> DataFrame:
    """Equal bins over [min, max], last bin closed, empty bins present; bin numbers are exact."""
    freq = materialise(length_frequencies(capped), "lengths")
    extremes = freq.agg(F.min("word_count").alias("lo"), F.max("word_count").alias("hi")).where("lo IS NOT NULL")
    x, lo, hi = F.col("word_count"), F.col("s.lo"), F.col("s.hi")
    number = F.when(hi == lo, F.lit(bins // 2)).otherwise(
        F.least(F.floor((x - lo) * F.lit(bins) / F.nullif(hi - lo, F.lit(0))), F.lit(bins - 1))
    )
    placed = freq.withColumn("s", extremes.select(F.struct("lo", "hi")).scalar())
    filled = placed.groupBy(number.cast("int").alias("bin")).agg(F.sum("freq").alias("filled"))
    start = F.when(F.col("hi") == F.col("lo"), F.col("lo") - 0.5).otherwise(F.col("lo").cast("double"))
    width = F.when(F.col("hi") == F.col("lo"), F.lit(1.0)).otherwise((F.col("hi") - F.col("lo")).cast("double")) / bins
    return (
        extremes.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
        .join(F.broadcast(filled), "bin", "left")  # at most `bins` rows
        .select(
            "bin",
            F.round(start + F.col("bin") * width, 6).alias("bin_start"),
            F.round(start + (F.col("bin") + 1) * width, 6).alias("bin_end"),
            F.coalesce("filled", F.lit(0)).alias("n"),
        )
    )


def length_density(capped: DataFrame, points: int = DENSITY_POINTS, bins: int = LENGTH_BINS) -> DataFrame:
    """Gaussian kernel curve over the histogram, Scott bandwidth, scaled to counts.

    The kernel sum runs over distinct word counts, weighted by their frequency, never over rows.
    """
    freq = materialise(length_frequencies(capped), "lengths")
    x = F.col("word_count").cast("double")
    stats = freq.agg(
        F.min("word_count").alias("lo"), F.max("word_count").alias("hi"), F.sum("freq").alias("n"),
        F.sum(F.col("freq") * F.col("word_count")).alias("s1"),
        F.sum(F.col("freq") * F.col("word_count") * F.col("word_count")).alias("s2"),
    ).select(
        "lo", "hi", "n",
        (F.sqrt((F.col("s2") - F.col("s1") * F.col("s1") / F.col("n")) / (F.col("n") - 1))
         * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("bandwidth"),
    ).where("hi > lo")
    one = stats.select(F.struct("lo", "hi", "bandwidth").alias("s")).scalar()
    grid = freq.withColumn("s", one).where("s IS NOT NULL").select(
        "freq", x.alias("x"), "s.*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point")
    )
    at = F.col("lo") + F.col("point") * (F.col("hi") - F.col("lo")) / F.lit(float(points - 1))
    z = (F.col("at") - F.col("x")) / F.col("bandwidth")
    kernel = F.exp(F.lit(-0.5) * z * z) / (F.col("bandwidth") * F.sqrt(F.lit(2.0) * F.pi()))
    bin_width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    return (
        grid.withColumn("at", at)
        .groupBy("point", "at")
        .agg(F.round(F.sum(F.col("freq") * kernel * bin_width), 6).alias("density"))
        .select("point", F.round("at", 6).alias("x"), "density")
    )


def length_box_stats(capped: DataFrame, tag: str = "tag_clean") -> DataFrame:
    """Quartiles, whiskers within 1.5 IQR and rows beyond them, from (tag, word count) frequencies."""
    freq = (
        capped.where(F.col(tag).isNotNull()).groupBy(tag, "word_count").agg(F.count(F.lit(1)).alias("freq"))
    )
    per_tag = freq.groupBy(tag).agg(
        F.percentile("word_count", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("freq")).alias("q"),
        F.collect_list(F.struct("word_count", "freq")).alias("cells"),  # bounded by the length cap
        F.sum("freq").alias("n"),
    ).select(
        tag, "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"),
        F.explode("cells").alias("cell"),
    )
    spread = F.col("q3") - F.col("q1")
    low, high = F.col("q1") - 1.5 * spread, F.col("q3") + 1.5 * spread
    length = F.col("cell.word_count")
    return (
        per_tag.groupBy(tag, "n", "q1", "median", "q3")
        .agg(
            F.min(F.when(length >= low, length)).alias("lowest"),
            F.max(F.when(length <= high, length)).alias("highest"),
            F.sum(F.when((length < low) | (length > high), F.col("cell.freq")).otherwise(0)).alias("n_outliers"),
        )
        .select(
            tag, "n", "q1", "median", "q3",
            F.least(F.col("lowest").cast("double"), F.col("q1")).alias("whisker_low"),
            F.greatest(F.col("highest").cast("double"), F.col("q3")).alias("whisker_high"),
            "n_outliers",
        )
    )


def top_bigrams(
    claims: DataFrame, stop_words: Iterable[str], masks: Iterable[str] = (), sample: int = PROFILE_SAMPLE,
    top: int = PROFILE_TOP, seed: int | str = SEED, text: str = "claim", row_id: str = "claim_id", pool: DataFrame | None = None,
) -> DataFrame:
    """The most frequent bigrams of a sample of the claims; stop words go before pairs are formed.

    ``pool`` (the table that the claims are filtered from, of which only the ids are read) spares a pass over the texts.
    """
    drawn = sample_n(claims.where(F.col(text).isNotNull()).select(row_id, text), sample, row_id, seed, pool)
    tokens = with_tokens(drawn, text, "tokens", [*stop_words, *masks])
    found = top_terms(term_totals(with_ngrams(tokens, "tokens", "terms", 2, 2)), top)
    return found.orderBy(F.desc("n"), F.asc("term"))  # ``top`` rows
