"""The application's table of claims: id, content, tag; rows lie in buckets by id, a log tells which files are current.

Every line of the log is a whole state: the folders that hold the rows of each bucket, and the ids that
insertions have reserved.  A change writes new folders for the buckets it touches and then one line;
a job that fails leaves the state before, and a reader sees one state or the other.  There is one
writer at a time.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimsift.operators.numbering import number_rows
from claimsift.schemas import CLAIMS

BUCKETS = 32
ROW_GROUP_BYTES = 16 << 20
DISTINCT_TAGS = 1000  # that the Bloom filter of a row group is made for; with more it lets more pass
LOG = "n long, buckets int, files array<struct<bucket:int,folder:string>>, reserved array<struct<batch:string,first:long,rows:long>>"


@dataclass(frozen=True)
class State:
    """What one line of the log says."""

    n: int = 0
    buckets: int = BUCKETS
    files: list = field(default_factory=list)  # (bucket, folder)
    reserved: list = field(default_factory=list)  # (batch, first id, rows)


def _state(spark: SparkSession, path: str) -> State:
    try:
        last = spark.read.schema(LOG).json(f"{path}/log").orderBy(F.desc("n")).first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return State()
    return State(last["n"], last["buckets"], [tuple(f) for f in last["files"]], [tuple(r) for r in last["reserved"]])


def _commit(spark: SparkSession, path: str, state: State) -> None:
    row = (state.n + 1, state.buckets, state.files, state.reserved)
    spark.createDataFrame([row], LOG).coalesce(1).write.mode("append").json(f"{path}/log")


def _bucket(state: State, claim_id: str = "id") -> Column:
    return F.pmod(F.xxhash64(F.col(claim_id).cast("bigint")), F.lit(state.buckets)).cast("int")


def _write(claims: DataFrame, path: str, state: State) -> list[tuple[int, str]]:
    """Store rows in a new folder, by bucket; returns the buckets that have any.

    Rows of a bucket lie in the order of ids, and row groups carry a Bloom filter of their tags, so that a reader skips the row groups
    that cannot hold an id or a tag.
    """
    spark, folder = claims.sparkSession, f"version-{uuid.uuid4().hex}"
    rows = claims.select(*CLAIMS.names).withColumn("bucket", _bucket(state))
    rows = rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "id")
    layout = {"parquet.block.size": ROW_GROUP_BYTES, "parquet.bloom.filter.enabled#tag": "true", "parquet.bloom.filter.expected.ndv#tag": DISTINCT_TAGS}
    rows.write.options(**layout).partitionBy("bucket").parquet(f"{path}/{folder}")
    written = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{folder}")
    names = [s.getPath().getName() for s in written.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(written)]
    return [(int(name.removeprefix("bucket=")), folder) for name in names if name.startswith("bucket=")]


def _read(spark: SparkSession, path: str, files: list[tuple[int, str]]) -> DataFrame:
    if not files:
        return spark.createDataFrame([], CLAIMS)
    return spark.read.schema(CLAIMS).parquet(*[f"{path}/{folder}/bucket={bucket}" for bucket, folder in sorted(files)])


def read_claims_table(spark: SparkSession, path: str) -> DataFrame:
    """The newest state of the table."""
    return _read(spark, path, _state(spark, path).files)


def read_claims_of(ids: DataFrame, path: str) -> DataFrame:
    """The rows of the buckets that hold the ``id`` column of ``ids``; other buckets are not read."""
    spark = ids.sparkSession
    state = _state(spark, path)
    touched = {r[0] for r in ids.select(_bucket(state)).distinct().collect()}  # at most as many as buckets
    return _read(spark, path, [f for f in state.files if f[0] in touched])


def read_claim(spark: SparkSession, path: str, claim_id: int) -> DataFrame:
    """The row of one id, from its bucket and there from the row group whose range of ids holds it."""
    return read_claims_of(spark.range(1).select(F.lit(claim_id).alias("id")), path).where(F.col("id") == claim_id)


def replace_claims(claims: DataFrame, path: str) -> DataFrame:
    """Store a new state of the whole table, which may be computed from the one before."""
    spark = claims.sparkSession
    state = _state(spark, path)
    _commit(spark, path, replace(state, files=_write(claims, path, state)))
    return read_claims_table(spark, path)


def change_tags(changes: DataFrame, path: str) -> DataFrame:
    """Set the tags of ``changes(id, tag)``, one row per id; unknown ids change nothing, a null tag clears.

    Only the buckets of these ids are read and written again.
    """
    spark = changes.sparkSession
    state = _state(spark, path)
    new = changes.select("id", F.col("tag").alias("new_tag"), F.lit(True).alias("changed"))
    rows = read_claims_of(changes, path).join(new, "id", "left")
    rows = rows.withColumn("tag", F.when(F.col("changed"), F.col("new_tag")).otherwise(F.col("tag")))
    written = _write(rows, path, state)
    done = {bucket for bucket, _ in written}
    _commit(spark, path, replace(state, files=[f for f in state.files if f[0] not in done] + written))
    return read_claims_table(spark, path)


def read_claims_jdbc(
    spark: SparkSession, url: str, lower: int, upper: int, partitions: int, table: str = "claims", **options: str
) -> DataFrame:
    """The same table from a database, read in ranges of the primary key."""
    return spark.read.jdbc(
        url, table, column="id", lowerBound=lower, upperBound=upper, numPartitions=partitions, properties=options
    )


def _required(content: str) -> Column:
    return F.coalesce(F.col(content), F.raise_error(F.lit("content must not be null")).cast("string"))


def _numbered(records: DataFrame, order: list[str], start: int) -> DataFrame:
    """Records with ids from ``start`` in the given order, which is total and not null; only keys are put in order."""
    rows = records.select(*order, _required("content").alias("content"), F.col("tag").cast("string").alias("tag"))
    return rows.join(number_rows(records.select(*order), list(order), "id", start=start), list(order)).select(*CLAIMS.names)


def reset_claims(records: DataFrame, path: str, order: list[str]) -> DataFrame:
    """Replace the table: ids 1..n in the given order; missing content is an error.  Reservations are forgotten."""
    spark = records.sparkSession
    state = _state(spark, path)
    _commit(spark, path, replace(state, files=_write(_numbered(records, order, 1), path, state), reserved=[]))
    return read_claims_table(spark, path)


def append_claims(records: DataFrame, path: str, order: list[str], batch: str) -> DataFrame:
    """Insert claims with the ids that follow the largest one.

    ``batch`` names the insertion, which reserves its ids before it writes: run again it gets the same
    ids, adds the rows that are missing and leaves the others, with the tags they have by now.  Another number
    of rows under a name that is taken is an error.
    """
    spark = records.sparkSession
    state, rows = _state(spark, path), records.count()
    held = next((r for r in state.reserved if r[0] == batch), None)
    if held is None:
        last = _read(spark, path, state.files).agg(F.max("id")).first()[0] or 0
        held = (batch, max([last, *(first + n - 1 for _, first, n in state.reserved)]) + 1, rows)
        state = replace(state, reserved=[*state.reserved, held])
        _commit(spark, path, state)
        state = replace(state, n=state.n + 1)
    elif held[2] != rows:
        raise ValueError(f"batch {batch!r} had {held[2]} rows, not {rows}")
    stored = _read(spark, path, state.files).where(F.col("id").between(held[1], held[1] + rows - 1)).select("id")
    missing = _numbered(records, order, held[1]).join(stored, "id", "left_anti")
    _commit(spark, path, replace(state, files=state.files + _write(missing, path, state)))
    return read_claims_table(spark, path)
