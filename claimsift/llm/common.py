"""What several operators of this subpackage share: columns by role, word cutting on bytes, components."""

from __future__ import annotations

import zlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimsift.operators.numbering import ROW_BITS
from claimsift.session import materialise

#: Lower-cases A-Z and leaves every other byte as it is; ``bytes.split()`` then cuts at [\x20\x09-\x0D]+.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_bytes(name: str = "text") -> Column:
    """The UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def text_of_rows(rows: pa.StructArray) -> pa.Array:
    """The texts of structs of documents, so that they need not be sent beside them a second time; null counts as empty."""
    names = [field.name.lower() for field in rows.type]
    return pc.fill_null(rows.flatten()[names.index("text")], "")


def crc(doc_id: Column) -> Column:
    """Unsigned crc32 of the id as text; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def remainder(doc_id: Column, modulus: int) -> Column:
    return crc(doc_id) % modulus


def py_remainder(doc_id, modulus: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges(a, b)``, long values; component is the least node reachable.

    Large-star and small-star steps in turn, one written table per round, until the edges stay the
    same; every step is a minimum per node and a join with one row per node, so a hub with very
    many edges is combined before the shuffle and split by the adaptive join.  Null ends and
    loops are ignored, repeated edges are one, no edges give no rows.
    """
    spark = edges.sparkSession
    ends = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    links = materialise(ends.where("a <> b").distinct(), "links")
    before = None
    while True:
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = large.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        large = materialise(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(
            least.select("a", F.col("m").alias("b")))
        links = materialise(small.where("a <> b").distinct(), "small-star")
    nodes = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return nodes.unionAll(roots) if state[0] else spark.createDataFrame([], "node long, component long")


def number_within(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Add ``pos`` (0, 1, ... inside each value of ``group``, in ``order``) and ``n`` (rows of the group).

    ``group`` is not null.  Rows are dealt by ranges of (group, order) and written, so a group that
    holds most rows is spread over tasks; offsets come from one row per group and task.  The order
    may have ties only between rows that are equal in it.
    """
    place = F.monotonically_increasing_id()
    placed = materialise(
        df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
        .withColumn("_part", F.shiftright(place, ROW_BITS)).withColumn("_row", place.bitwiseAND(F.lit((1 << ROW_BITS) - 1))),
        "placed",
    )
    sizes = placed.groupBy(group, "_part").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_size"))
    parts = W.partitionBy(group).orderBy("_part")  # one row per task that has rows of the group
    offsets = sizes.select(
        group, "_part", (F.sum("_size").over(parts) - F.col("_size") - F.col("_first")).alias("_offset"),
        F.sum("_size").over(W.partitionBy(group)).alias("n"))
    offsets = materialise(offsets, "offsets")
    return placed.join(offsets, [group, "_part"]).withColumn("pos", F.col("_row") + F.col("_offset")).drop("_part", "_row", "_offset", "_first")
