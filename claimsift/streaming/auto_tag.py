"""Claims that arrive as files are tagged per micro-batch.

The versions of a claim are in one total order: by time of arrival, one without it before any other, and
at equal times the one with the least digest of its content last.  The stream keeps the place of the
newest version of every claim in its state store and passes on only versions beyond it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from claimsift.functions.answers import confidence, request_status
from claimsift.operators.models import LinearTextModel, predict

TAGGED = T.StructType([
    T.StructField("claim_id", T.LongType()),
    T.StructField("arrived", T.LongType()),
    T.StructField("status", T.StringType()),
    T.StructField("tag", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("digest", T.LongType()),
])
VERSIONS = "claim_id bigint, named boolean, arrived bigint, known boolean, digest bigint, content string"
PLACE = "known boolean, arrived bigint, digest bigint"


def read_arrivals(spark: SparkSession, path: str, schema: T.StructType, max_files: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def _digest(content: str = "content") -> Column:
    return F.xxhash64(content)


def _pass_on(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The newest of a claim's rows, if it is beyond the place that is kept; rows without an id pass as they are."""
    if not key[1]:
        yield from (frame.drop(columns="lane") for frame in frames)
        return
    place, newest = tuple(state.get) if state.exists else None, None
    for frame in frames:
        for known, arrived, digest, content in zip(frame["known"], frame["arrived"], frame["digest"], frame["content"], strict=True):
            here = (bool(known), int(arrived), ~int(digest))
            if place is None or here > place:
                place, newest = here, content
                beyond = pd.DataFrame({
                    "claim_id": [key[0]], "named": [True], "arrived": [here[1]], "known": [here[0]], "digest": [~here[2]], "content": [newest]})
    if place is not None and (not state.exists or place != tuple(state.get)):
        state.update(place)
        yield beyond


def newest_versions(arrivals: DataFrame) -> DataFrame:
    """(claim_id, arrived, digest, content) of the versions of a stream that are newer than all before them: at most one per claim and batch.

    The state is one place per claim, in the state store, spread by claim_id.  Rows without claim_id leave no state
    and are dealt by their content.  A version that is repeated, or older than one seen, gives no row.
    """
    named = F.col("claim_id").isNotNull()
    rows = arrivals.select(
        F.coalesce("claim_id", F.lit(0)).cast("bigint").alias("claim_id"), named.alias("named"), F.coalesce("arrived", F.lit(0)).cast("bigint").alias("arrived"),
        F.col("arrived").isNotNull().alias("known"), _digest().alias("digest"), "content")
    rows = rows.withColumn("lane", F.when(F.col("named"), 0).otherwise(F.xxhash64("digest", "arrived")))
    passed = rows.groupBy("claim_id", "named", "lane").applyInPandasWithState(_pass_on, VERSIONS, PLACE, "update", GroupStateTimeout.NoTimeout)
    return passed.select(F.when(F.col("named"), F.col("claim_id")).alias("claim_id"), F.when(F.col("known"), F.col("arrived")).alias("arrived"), "digest", "content")


def tag_batch(batch: DataFrame, model: LinearTextModel) -> DataFrame:
    """A table of (claim_id, content, arrived) in bulk: the newest version of every claim, tagged."""
    named = batch.where("claim_id IS NOT NULL").select("claim_id", "arrived", "content")
    named = named.withColumn("digest", _digest())
    last = named.groupBy("claim_id").agg(F.max("arrived").alias("last"))
    newest = named.join(last, "claim_id").where(F.col("arrived").eqNullSafe(F.col("last"))).drop("last")
    first = newest.groupBy("claim_id").agg(F.min("digest").alias("digest"))
    newest = newest.join(first, ["claim_id", "digest"]).dropDuplicates(["claim_id"])  # equal ones by now
    return tag_versions(newest.unionByName(batch.where("claim_id IS NULL").select("claim_id", "arrived", "content", _digest().alias("digest"))), model)


def tag_versions(versions: DataFrame, model: LinearTextModel) -> DataFrame:
    """Validate and score (claim_id, arrived, digest, content), one row per claim, in one pass.

    Refused texts are scored as empty ones.  A row without claim_id is refused as ``invalid_id``, every
    such row for itself.
    """
    status = F.when(F.col("claim_id").isNull(), "invalid_id").otherwise(request_status("content"))
    checked = versions.withColumn("status", status)
    valid = F.col("status") == "valid"
    asked = checked.withColumn("content", F.when(valid, F.col("content")).otherwise(""))
    return predict(asked, model, "claim_id", "arrived", "status", "digest", text="content").select(
        "claim_id", "arrived", F.when(valid, "tagged").otherwise(F.col("status")).alias("status"),
        F.when(valid, F.col("predicted")).alias("tag"), F.when(valid, confidence("probabilities", "class_index")).alias("confidence"), "digest")


def auto_tag_stream(arrivals: DataFrame, model: LinearTextModel, target: str, checkpoint: str) -> StreamingQuery:
    """Tag everything available, then stop.  Only versions that are newer than what the state holds are scored and written.

    Each batch overwrites its own folder, so a batch that is replayed after a failure leaves one copy.
    Folders of a query whose checkpoint was lost are overwritten or stay as older arrivals; either is harmless.
    """
    run = uuid.uuid4().hex  # numbers of batches start again with a new checkpoint

    def upsert(batch: DataFrame, batch_id: int) -> None:
        tag_versions(batch, model).write.mode("overwrite").parquet(f"{target}/{run}-{batch_id}")

    return (
        newest_versions(arrivals).writeStream.outputMode("update").foreachBatch(upsert).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def read_tagged(spark: SparkSession, target: str) -> DataFrame:
    """Current state: the newest version of a claim decides, whatever batch or checkpoint tagged it.

    Rows without claim_id are all there; nothing tells
    a row that was replayed with a new checkpoint from another one.
    """
    rows = spark.read.schema(TAGGED).option("recursiveFileLookup", "true").parquet(target)
    values = ["arrived", "status", "tag", "confidence", "digest"]
    named = rows.where("claim_id IS NOT NULL").groupBy("claim_id").agg(
        F.max_by(F.struct(*values), F.struct("arrived", F.bitwise_not("digest"))).alias("last")
    ).select("claim_id", "last.*")
    return named.unionByName(rows.where("claim_id IS NULL").select("claim_id", *values))


def compact_tagged(spark: SparkSession, target: str) -> None:
    """Replace the folders of past batches by one with the current state; not to be run beside the stream.

    If it is cut off before the old folders are gone, their rows only repeat what the new one says.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = [status.getPath() for status in files.listStatus(path)]
    read_tagged(spark, target).write.parquet(f"{target}/state-{uuid.uuid4().hex}")
    for folder in old:
        files.delete(folder, True)
