"""Dense row numbers without a one-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimsift.session import materialise

ROW_BITS = 33  # monotonically_increasing_id keeps the row number of a partition in its low bits


def number_rows(df: DataFrame, order: list[Column | str], name: str, start: Column | int = 1) -> DataFrame:
    """Add ``name``: positions ``start``, ``start + 1``, ... in the given order.

    Rows are range-partitioned, sorted inside their partition and written with partition and row
    number; the offsets are a running sum over one row per partition.  The order must be total.
    """
    place = F.monotonically_increasing_id()
    placed = materialise(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_part", F.shiftright(place, ROW_BITS))
        .withColumn("_row", place.bitwiseAND(F.lit((1 << ROW_BITS) - 1))),
        "numbered",
    )
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row per partition
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    first = F.lit(start) if isinstance(start, int) else start
    return (
        placed.join(F.broadcast(offsets), "_part")  # bounded by the number of shuffle partitions
        .withColumn(name, F.col("_offset") + F.col("_row") + first)
        .drop("_part", "_row", "_offset")
    )
