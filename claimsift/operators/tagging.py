"""The table of claims and the three ways of tagging it, as bulk jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimsift.fixed_values import ALLOWED_TAGS
from claimsift.functions.answers import (
    build_prompt, clean_manual_tag, confidence, normalise_tag, parse_claim_id, request_status,
)
from claimsift.functions.text import web_trim
from claimsift.operators.models import LinearTextModel, predict


def inbox_filter(claims: DataFrame, tag: str | None = None) -> DataFrame:
    """``all`` or nothing: every claim, newest first; ``null`` or ``untagged``: no tag; else that tag."""
    if not tag or tag == "all":
        return order_newest(claims)
    if tag in ("null", "untagged"):
        return claims.where(F.col("tag").isNull())
    return claims.where(F.col("tag") == tag)


def order_newest(claims: DataFrame) -> DataFrame:
    return claims.orderBy(F.desc("id"))


def claim_by_id(claims: DataFrame, claim_id: int) -> DataFrame:
    return claims.where(F.col("id") == claim_id)


def latest_changes(events: DataFrame, *values: str) -> DataFrame:
    """Last event per claim by (ts, event_id); null is a value.  Event ids are distinct and not negative.

    An event without ts is older than any other, among events of one ts one without event_id; of events
    that lack the same the greatest values stay, so every claim with an event has one row.
    The order of an event is one number of fixed width, so that the maximum is a hash aggregate; the
    winning events are then looked up.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp")).cast("decimal(18,0)")
    micros = F.coalesce(micros, F.lit(str(1 - 10**18)).cast("decimal(18,0)"))
    number = F.coalesce(F.col("event_id").cast("decimal(19,0)"), F.lit("-1").cast("decimal(19,0)"))
    place = micros * F.lit(str(10**19)).cast("decimal(20,0)") + number
    placed = events.where("claim_id IS NOT NULL").select("claim_id", *values, place.cast("decimal(38,0)").alias("place"))
    last = placed.groupBy("claim_id").agg(F.max("place").alias("place"))
    winners = placed.join(last, ["claim_id", "place"])
    return winners.groupBy("claim_id").agg(F.max(F.struct(*values)).alias("last")).select("claim_id", "last.*")


def manual_changes(events: DataFrame) -> DataFrame:
    """Tags typed by a person, cleaned: empty or missing clears the tag."""
    return events.withColumn("tag", clean_manual_tag("tag"))


def apply_tags(claims: DataFrame, events: DataFrame) -> DataFrame:
    """Set tags by id, last write wins, unknown ids change nothing.  A null tag clears."""
    changes = latest_changes(events, "tag").select(
        F.col("claim_id").alias("id"), F.col("tag").alias("new_tag"), F.lit(True).alias("changed")
    )
    tag = F.when(F.col("changed"), F.col("new_tag")).otherwise(F.col("tag"))
    return claims.join(changes, "id", "left").withColumn("tag", tag).drop("new_tag", "changed")


def tag_state(events: DataFrame) -> DataFrame:
    """Current tag of a claim, who set it, and how sure that engine was."""
    return latest_changes(events, "tag", "engine", "confidence")


def _with_claim(requests: DataFrame, right: DataFrame) -> DataFrame:
    """Requests joined with one row per claim.  Requests without a readable id stay out of the join:
    their missing keys would all meet in one task.  A claim requested very often is split by the
    adaptive skew join."""
    parsed = requests.withColumn("claim_id", parse_claim_id("id"))
    joined = parsed.where(F.col("claim_id").isNotNull()).join(right, "claim_id", "left")
    return joined.unionByName(parsed.where(F.col("claim_id").isNull()), allowMissingColumns=True)


def resolve_requests(requests: DataFrame, claims: DataFrame) -> DataFrame:
    """Add ``claim_id``, the claim's content and ``status``: invalid_id, not_found or found."""
    known = _requested(requests, claims).select("claim_id", "content", F.lit(True).alias("known"))
    status = (
        F.when(F.col("claim_id").isNull(), "invalid_id").when(F.col("known"), "found").otherwise("not_found")
    )
    return _with_claim(requests, known).withColumn("status", status).drop("known")


def validate_requests(requests: DataFrame, claim: str = "user_claim") -> DataFrame:
    return requests.withColumn("status", request_status(claim))


def _resolve_ids(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Requests with the result of their claim; only ids and results are shuffled, never texts."""
    return _with_claim(requests, results).withColumn(
        "status",
        F.when(F.col("claim_id").isNull(), "invalid_id").otherwise(F.coalesce("status", F.lit("not_found"))),
    )


def _requested(requests: DataFrame, claims: DataFrame) -> DataFrame:
    """Claims asked for, each one once however often it was requested."""
    wanted = requests.select(parse_claim_id("id").alias("id")).where("id IS NOT NULL").distinct()
    return claims.join(wanted, "id", "left_semi").withColumnRenamed("id", "claim_id")


def auto_tag_ml(requests: DataFrame, claims: DataFrame, model: LinearTextModel) -> DataFrame:
    """Requests to (status, tag, confidence, engine); a claim is scored once, in one transform."""
    asked = _requested(requests, claims).withColumn("status", request_status("content"))
    valid = F.col("status") == "valid"
    asked = asked.withColumn("content", F.when(valid, F.col("content")).otherwise(""))
    scored = predict(asked, model, "claim_id", "status", text="content").select(
        "claim_id", F.when(valid, "tagged").otherwise(F.col("status")).alias("status"), F.when(valid, F.col("predicted")).alias("tag"),
        F.when(valid, confidence("probabilities", "class_index")).alias("confidence"),
    )
    return _resolve_ids(requests, scored).select(
        "request_id", "claim_id", "status", "tag", "confidence",
        F.when(F.col("status") == "tagged", F.lit("ml")).alias("engine"),
    )


def auto_tag_external(
    requests: DataFrame, claims: DataFrame, answers: DataFrame, allowed: Sequence[str] = ALLOWED_TAGS
) -> DataFrame:
    """Requests to (status, raw answer, tag) from a table of external answers (claim_id, prediction_raw).

    Of several answers for a claim the one that comes first in the order of texts counts: answers have no time.
    """
    asked = _requested(requests, claims).select("claim_id")
    known = answers.select("claim_id", F.coalesce(web_trim("prediction_raw"), F.lit("")).alias("prediction_raw"))
    known = known.join(asked, "claim_id", "left_semi").groupBy("claim_id").agg(F.min("prediction_raw").alias("prediction_raw"))
    answered = asked.join(known, "claim_id", "left").select(
        "claim_id", "prediction_raw",
        F.when(F.col("prediction_raw").isNull(), "no_answer").otherwise("tagged").alias("status"),
        F.when(F.col("prediction_raw").isNotNull(), normalise_tag("prediction_raw", allowed)).alias("tag"),
    )
    return _resolve_ids(requests, answered).select("request_id", "claim_id", "status", "prediction_raw", "tag")


def prompts(requests: DataFrame, claims: DataFrame) -> DataFrame:
    """What is sent out for the requested claims."""
    return _requested(requests, claims).select("claim_id", build_prompt("content").alias("prompt"))


def apply_results(claims: DataFrame, results: DataFrame) -> DataFrame:
    """Write the tags of an automatic run into the table of claims; all results of a claim are alike."""
    tags = results.where("status = 'tagged'").groupBy("claim_id").agg(F.min("tag").alias("new_tag"))
    joined = claims.join(tags.withColumnRenamed("claim_id", "id"), "id", "left")
    return joined.withColumn("tag", F.coalesce("new_tag", "tag")).drop("new_tag")
