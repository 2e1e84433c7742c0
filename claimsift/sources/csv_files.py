"""CSV with quoted multi-line text, read by many tasks.

A file is read in byte ranges, as lines.  Whether a line starts a record or lies inside a quoted value
depends on all that comes before it, so every range first says in which of the two states it ends for
either state at its start; putting these answers together in file order, one row per range, gives
the real state at every start.  Then the ranges cut their lines into records, and the few records that cross
ranges are put together from their pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimsift.fixed_values import NULL_WORDS
from claimsift.session import materialise

# Header of the source file -> column of the library.
SOURCE_COLUMNS = {
    "Date received": "date_received",
    "Tag": "tag",
    "Consumer Claim": "claim",
    "Company": "company",
}

READ_OPTIONS = {
    "header": True, "multiLine": True, "quote": '"', "escape": '"', "mode": "FAILFAST",
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}
WRITE_OPTIONS = {
    "header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}

_QUOTED = re.compile(rb'(?:[^"]++|"")*+')  # the rest of a quoted value, up to its closing quote
_BOM = b"\xef\xbb\xbf"


def ends_inside(line: bytes, inside: bool) -> bool:
    """Whether a line ends inside a quoted value, given whether it starts inside one.

    A value is quoted if it starts with a quote; a quote further on in any other value means nothing, and
    what follows a closing quote belongs to no quoted value.
    """
    at = 0
    while True:
        if not inside:
            if line[at:at + 1] != b'"':
                at = line.find(b',"', at) + 1
                if not at:
                    return False
            at += 1
        at = _QUOTED.match(line, at).end()
        if at == len(line):
            return True
        at = line.find(b",", at + 1) + 1  # the value ends at the next comma
        if not at:
            return False
        inside = False


def _runs(batch: pa.RecordBatch, *keys: str) -> Iterator[tuple[tuple, pa.Array]]:
    """The lines of a batch in stretches of equal keys."""
    size = batch.num_rows
    if not size:
        return
    columns = [batch.column(k) for k in keys]
    change = np.zeros(size, bool)
    change[0] = True
    for column in columns:
        change[1:] |= pc.not_equal(column.slice(1), column.slice(0, size - 1)).to_numpy(zero_copy_only=False)
    starts = [*np.flatnonzero(change), size]
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        yield tuple(column[a].as_py() for column in columns), batch.column("line").slice(a, b - a)


def _range_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per range: how it ends if it starts at a record, and how if it starts inside a value."""
    key, ends = None, [False, True]

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"range": key[0], "file": key[1], "start": key[2], "from_record": ends[0], "from_value": ends[1]}])

    for batch in batches:
        for here, lines in _runs(batch, "range", "file", "start"):
            if here != key:
                if key:
                    yield row()
                key, ends = here, [False, True]
            for line in lines.filter(pc.match_substring(lines, b'"')).to_pylist():
                ends = [ends_inside(line, ends[0])] * 2 if ends[0] == ends[1] else [ends_inside(line, e) for e in ends]
    if key:
        yield row()


def _states(ranges: DataFrame) -> DataFrame:
    """Add ``inside``, the state at the start of each range: one row per range, in file order.

    The last range before that ends alike from either state decides, turned round once for each range since
    that swaps the states.
    """
    order = W.partitionBy("file").orderBy("start")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    swaps = F.when(F.col("from_record") & ~F.col("from_value"), 1).otherwise(0)
    known = F.when(F.col("from_record") == F.col("from_value"), F.struct("from_record", "turns"))
    turned = ranges.withColumn("turns", F.sum(swaps).over(order))
    placed = turned.withColumn("known", F.last(known, ignorenulls=True).over(before)).withColumn("past", F.lag("turns", 1, 0).over(order))
    odd = (F.col("past") - F.coalesce("known.turns", F.lit(0))) % 2 == 1
    return placed.select("range", "file", "start", (F.coalesce("known.from_record", F.lit(False)) != odd).alias("inside"))


def _pieces(lines: DataFrame, inside: np.ndarray) -> DataFrame:
    """(range, k, open, text): record k of its range, -1 for the rest of a record that started before it.

    ``open`` records go on in the next range.  Blank lines between records are no records.
    """
    shared = lines.sparkSession.sparkContext.broadcast(inside)  # ranges that start inside a value, eight bytes each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, k, within, held = None, 0, False, []

        def made(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.bool_(), pa.binary()), strict=True)], names=["range", "k", "open", "text"])

        for batch in batches:
            rows = []
            for (here,), lines in _runs(batch, "range"):
                if here != key:
                    if within:
                        rows.append((key, k, True, b"\n".join(held)))
                    at = np.searchsorted(shared.value, here)
                    within = bool(at < len(shared.value) and shared.value[at] == here)
                    key, k, held = here, -1 if within else 0, []
                for line in lines.to_pylist():
                    if not within and line in (b"", b"\r"):
                        continue
                    held.append(line)
                    within = ends_inside(line, within) if b'"' in line else within
                    if not within:
                        rows.append((key, k, False, b"\n".join(held).removesuffix(b"\r")))
                        k, held = k + 1, []
            yield made(rows)
        if within:
            yield made([(key, k, True, b"\n".join(held))])

    return lines.select("range", "line").mapInArrow(run, "range long, k long, open boolean, text binary")


def _joined(pieces: DataFrame, ranges: DataFrame) -> DataFrame:
    """Records that cross ranges: an open record with the pieces that follow it, at most two rows per range."""
    parts = pieces.where("open OR k < 0").join(ranges.select("range", "file", "start"), "range")
    order = W.partitionBy("file").orderBy("start", "k")
    first = F.last(F.when(F.col("k") >= 0, F.struct("range", "k")), ignorenulls=True).over(order)
    keys = materialise(parts.select("range", "k", first.alias("head"), "start"), "record-keys")
    texts = keys.where("head IS NOT NULL").join(pieces.where("open OR k < 0").select("range", "k", "text"), ["range", "k"])
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("start", "k", F.col("text").cast("string").alias("text")))), lambda p: p["text"])
    return texts.groupBy("head").agg(F.array_join(ordered, "\n").alias("text")).select("head.range", "head.k", "text")


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, text): the records of the files of ``path`` but for their headers, numbered from 1 in each file.

    Both passes over the files read them in ranges of ``spark.sql.files.maxPartitionBytes``; compressed files are one range.
    What reaches the driver is eight bytes for every range that starts inside a value.  Lines end with
    ``\\n`` or ``\\r\\n``; line ends inside values stay as they are.  A value that is never closed ends with its file.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    file, start = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    line = F.col("value").cast("binary")
    line = F.when((start == 0) & F.startswith(line, F.lit(_BOM)), F.substring(line, len(_BOM) + 1, 1 << 30)).otherwise(line)
    lines = lines.select(F.xxhash64(file, start).alias("range"), file.alias("file"), start.alias("start"), line.alias("line"))
    ends = lines.mapInArrow(_range_ends, "range long, file string, start long, from_record boolean, from_value boolean")
    ranges = materialise(_states(materialise(ends, "csv-ranges")), "csv-states")
    if ranges.count() != ranges.select("range").distinct().count():
        raise ValueError("two ranges of the files have one hash")
    inside = np.sort(np.array([r[0] for r in ranges.where("inside").select("range").collect()], np.int64))
    pieces = materialise(_pieces(lines, inside), "csv-pieces")
    whole = pieces.where("NOT open AND k >= 0").select("range", "k", F.col("text").cast("string").alias("text"))
    sizes = pieces.where("k >= 0").groupBy("range").agg(F.count(F.lit(1)).alias("size"))
    upto = F.sum("size").over(W.partitionBy("file").orderBy("start"))
    offsets = materialise(ranges.join(sizes, "range").select("range", "file", (upto - F.col("size")).alias("offset")), "csv-offsets")
    records = whole.unionByName(_joined(pieces, ranges)).join(offsets, "range")
    return records.select("file", (F.col("offset") + F.col("k")).alias("record"), "text").where("record > 0")


def read_claims_csv(
    spark: SparkSession, path: str, columns: Mapping[str, str] = SOURCE_COLUMNS,
    null_words: Sequence[str] = NULL_WORDS, row_id: str | None = "claim_id",
) -> DataFrame:
    """The wanted columns as text, null words as null, rows numbered from 1 in file order.

    Column names come from the header, all columns are text: nothing is inferred.  The records are
    parsed and landed as Parquet once; numbers are those within the file and an offset per file.
    """
    names = spark.read.options(**READ_OPTIONS).csv(path).columns  # the header of one file
    options = {k: str(v).lower() if isinstance(v, bool) else v for k, v in READ_OPTIONS.items() if k != "header"}
    schema = ", ".join("`" + name.replace("`", "``") + "` string" for name in names)
    parsed = csv_records(spark, path).select("file", "record", F.from_csv("text", schema, options).alias("r"))
    landed = parsed.select("file", "record", "r.*").select(
        F.col("file").alias("_file"), F.col("record").alias("_record"),
        *[F.when(~F.col(f"`{old}`").isin(list(null_words)), F.col(f"`{old}`")).alias(new) for old, new in columns.items()])
    if row_id is None:
        return landed.drop("_file", "_record")
    landed = materialise(landed, "landed-csv")
    before = W.orderBy("_file").rowsBetween(W.unboundedPreceding, -1)  # one row per file
    sizes = landed.groupBy("_file").agg(F.max("_record").alias("_size"))
    offsets = materialise(sizes.select("_file", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")), "csv-offsets")
    return landed.join(offsets, "_file").select((F.col("_offset") + F.col("_record")).alias(row_id), *columns.values())


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header, doubled quotes, blanks and line breaks kept."""
    df.write.mode(mode).options(**WRITE_OPTIONS).csv(path)
