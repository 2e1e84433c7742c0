import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from claimsift.schemas import SPLIT
from claimsift.sources import claims_table, reports, splits
from claimsift.schemas import CLAIMS
from claimsift.sources.claims_table import append_claims, change_tags, read_claim, read_claims_of, read_claims_table, replace_claims, reset_claims
from claimsift.sources.csv_files import csv_records, ends_inside, read_claims_csv

GOLDEN_CSV = (
    'Company,Date received,Issue,Tag,Consumer Claim\n'
    'A,2020-01-01,i,Mortgage,"first line\nsecond, line"\n'
    'B,2020-01-02,i,Debt collection,"he said ""no"" twice"\n'
    'C,2020-01-03,i,N/A,"back\\slash, comma"\n'
    'D,2020-01-04,i,Mortgage,None\n'
    'E,2020-01-05,i,Mortgage,"   "\n'
    'F,2020-01-06,i,,last\n'
)


def test_hostile_csv(spark, tmp_path):
    path = tmp_path / "claims.csv"
    path.write_bytes(GOLDEN_CSV.encode())
    rows = read_claims_csv(spark, str(path)).orderBy("claim_id").collect()
    assert [r["claim_id"] for r in rows] == [1, 2, 3, 4, 5, 6]
    assert [r["claim"] for r in rows] == [
        "first line\nsecond, line", 'he said "no" twice', "back\\slash, comma", None, "   ", "last"]
    assert [r["tag"] for r in rows] == ["Mortgage", "Debt collection", None, "Mortgage", "Mortgage", None]
    assert rows[0]["company"] == "A" and rows[0]["date_received"] == "2020-01-01"
    path.write_bytes(GOLDEN_CSV.replace("\n", "\r\n").encode())
    rows = read_claims_csv(spark, str(path)).orderBy("claim_id").collect()
    assert [r["claim"] for r in rows][1:] == ['he said "no" twice', "back\\slash, comma", None, "   ", "last"]


def test_csv_files_are_numbered_in_file_order(spark, tmp_path):
    for k, size in enumerate((3, 700, 20)):
        lines = "".join(f"d,t,{k}-{i},c\n" for i in range(size))
        (tmp_path / f"part-{k}.csv").write_text("Date received,Tag,Consumer Claim,Company\n" + lines)
    rows = read_claims_csv(spark, str(tmp_path)).orderBy("claim_id").collect()
    assert [r["claim_id"] for r in rows] == list(range(1, 724))
    assert [r["claim"] for r in rows] == [f"{k}-{i}" for k, n in enumerate((3, 700, 20)) for i in range(n)]


@pytest.fixture
def small_ranges(spark):
    """Files are cut into ranges of so many bytes."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    yield lambda size: spark.conf.set(name, size)
    spark.conf.set(name, before)


def _hostile_rows(rows):
    rng = random.Random(5)
    cells = ["plain", "", 'say ""', '"', '""', "a,b", ',"', '",', "line\nbreak", "\n", "\n\n", 'x\n"y",\n"', "Ünï", 'no "quote', " "]
    return [[f"{k}", "t", "".join(rng.choices(cells, k=rng.randint(0, 4))) + "z", "c"] for k in range(rows)]


@pytest.mark.parametrize(("size", "end"), [(19, "\n"), (23, "\r\n"), (97, "\n")])
def test_records_are_whole_wherever_a_file_is_cut(spark, tmp_path, small_ranges, size, end):
    rows, wanted = _hostile_rows(12 if size < 90 else 60), []
    for name, part in (("a", rows[:-3]), ("b", rows[-3:])):
        out = io.StringIO()
        csv.writer(out, lineterminator=end).writerows([["Date received", "Tag", "Consumer Claim", "Company"], *part])
        (tmp_path / f"{name}.csv").write_bytes(out.getvalue().encode())
        wanted += part
    small_ranges(size)
    got = read_claims_csv(spark, str(tmp_path)).orderBy("claim_id").collect()
    assert [r["claim_id"] for r in got] == list(range(1, len(rows) + 1))
    assert [[r["date_received"], r["tag"], r["claim"], r["company"]] for r in got] == wanted


def test_one_file_is_many_tasks(spark, tmp_path, small_ranges):
    (tmp_path / "one.csv").write_text('a,b\n' + "".join(f'{k},"x\n{k}"\n' for k in range(300)))
    small_ranges(400)
    assert spark.read.option("lineSep", "\n").text(str(tmp_path)).rdd.getNumPartitions() > 5
    texts = {(r["record"], r["text"]) for r in csv_records(spark, str(tmp_path)).collect()}
    assert texts == {(k + 1, f'{k},"x\n{k}"') for k in range(300)}


def test_csv_edges(spark, tmp_path, small_ranges):
    head = "Date received,Tag,Consumer Claim,Company\n"
    (tmp_path / "a.csv").write_bytes(b"\xef\xbb\xbf" + f'{head}\n\nd,5" pipe,"q""",c\n\nd,t,"a ""b""","never closed\nx'.encode())
    (tmp_path / "b.csv").write_text(head)
    for size in (23, 1 << 20):
        small_ranges(size)
        got = read_claims_csv(spark, str(tmp_path), {"Tag": "tag", "Consumer Claim": "claim", "Company": "c"}).orderBy("claim_id").collect()
        assert [tuple(r) for r in got] == [(1, '5" pipe', 'q"', "c"), (2, "t", 'a "b"', "never closed\nx")]


def test_states_of_lines():
    assert [ends_inside(x, False) for x in (b'a,b', b'"a', b'a,"b', b'a,"b"', b'a"b,"c""', b'"a"b"c', b'"a"x,"b', b',"', b'""', b'"""')] == [
        False, True, True, False, True, False, True, True, False, True]
    assert [ends_inside(x, True) for x in (b"a", b'a"', b'a""', b'a",b', b'","', b'"\r')] == [True, False, True, False, True, False]


@pytest.fixture
def split(spark):
    rows = [(1, " a\n\"b\", c ", "x", False, "train"), (2, "None", "x", True, "test"), (3, "t", "y", False, "test")]
    return spark.createDataFrame(rows, SPLIT)


def test_split_table_prunes_partitions(spark, split, tmp_path):
    path = str(tmp_path / "split")
    splits.write_split(split, path)
    train = splits.read_split(spark, path, "train")
    assert [r["claim"] for r in train.collect()] == [" a\n\"b\", c "]
    assert {r["claim_id"] for r in splits.read_split(spark, path, "sample").collect()} == {2}
    plan = train._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


def test_split_csv(spark, split, tmp_path):
    path = str(tmp_path / "csv")
    splits.write_split_csv(split, path, "train")
    back = read_claims_csv(spark, path, {"Consumer Claim": "claim", "Tag_Clean": "tag_clean"}, row_id=None)
    assert [tuple(r) for r in back.collect()] == [(" a\n\"b\", c ", "x")]


def test_seed_json_keeps_nulls(spark, tmp_path):
    rows = spark.createDataFrame([(" b ", "y", 2), ("a", "x", 1)], "claim string, tag_clean string, position bigint")
    reports.write_seed_json(rows, str(tmp_path / "seed"))
    lines = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "seed")).collect()]
    assert sorted(lines, key=lambda r: r["content"]) == [
        {"content": "a", "tag": None, "_expected_tag": "x"}, {"content": "b", "tag": None, "_expected_tag": "y"}]


def test_claims_table(spark, tmp_path):
    path = str(tmp_path / "claims")
    first = spark.createDataFrame([(3, "c", None), (1, "a", "x"), (2, "b", None)], "p int, content string, tag string")
    assert [tuple(r) for r in reset_claims(first, path, ["p"]).orderBy("id").collect()] == [
        (1, "a", "x"), (2, "b", None), (3, "c", None)]
    append_claims(first, path, ["p"], "one")
    append_claims(first, path, ["p"], "one")  # a retry
    assert [r["id"] for r in read_claims_table(spark, path).orderBy("id").collect()] == [1, 2, 3, 4, 5, 6]
    bad = first.withColumn("content", F.when(F.col("p") == 2, None).otherwise(F.col("content")))
    with pytest.raises(Exception, match="content must not be null"):
        append_claims(bad, path, ["p"], "two")
    reset_claims(first.limit(0), path, ["p"])
    assert read_claims_table(spark, path).count() == 0
    assert append_claims(first, path, ["p"], "one").agg(F.max("id")).first()[0] == 3


def test_a_table_can_be_replaced_by_what_is_computed_from_it(spark, tmp_path):
    path = str(tmp_path / "claims")
    rows = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], CLAIMS)
    stored = replace_claims(rows, path)
    again = replace_claims(stored.withColumn("tag", F.coalesce("tag", F.lit("new"))), path)
    assert sorted(map(tuple, again.collect())) == [(1, "a", "x"), (2, "b", "new")]
    assert sorted(map(tuple, read_claims_table(spark, path).collect())) == [(1, "a", "x"), (2, "b", "new")]


def test_a_batch_that_is_run_again_keeps_its_ids_and_tags(spark, tmp_path):
    path = str(tmp_path / "claims")
    rows = spark.createDataFrame([(1, "a", None), (2, "b", None), (3, "c", None)], "p int, content string, tag string")
    reset_claims(rows, path, ["p"])
    append_claims(rows.limit(2), path, ["p"], "x/../y")
    append_claims(rows, path, ["p"], "second")
    change_tags(spark.createDataFrame([(4, "set"), (99, "nowhere")], "id bigint, tag string"), path)
    again = append_claims(rows.limit(2), path, ["p"], "x/../y")
    assert sorted(map(tuple, again.collect())) == [
        (1, "a", None), (2, "b", None), (3, "c", None), (4, "a", "set"), (5, "b", None), (6, "a", None), (7, "b", None), (8, "c", None)]
    with pytest.raises(ValueError, match="had 2 rows"):
        append_claims(rows, path, ["p"], "x/../y")


def test_an_insertion_that_failed_gets_the_ids_it_reserved(spark, tmp_path):
    path = str(tmp_path / "claims")
    rows = spark.createDataFrame([(1, "a", None), (2, "b", None)], "p int, content string, tag string")
    reset_claims(rows, path, ["p"])
    with pytest.raises(Exception, match="content must not be null"):
        append_claims(rows.withColumn("content", F.lit(None).cast("string")), path, ["p"], "one")
    append_claims(rows, path, ["p"], "two")
    assert sorted(r["id"] for r in append_claims(rows, path, ["p"], "one").collect()) == [1, 2, 3, 4, 5, 6]


def test_a_change_reads_and_writes_only_the_buckets_of_its_ids(spark, tmp_path):
    path = str(tmp_path / "claims")
    rows = spark.range(1, 2001).selectExpr("id", "concat('text ', id) AS content", "CAST(NULL AS STRING) AS tag")
    before = replace_claims(rows, path)
    changes = spark.createDataFrame([(7, "x"), (8, None)], "id bigint, tag string")
    touched = {f.split("bucket=")[1].split("/")[0] for f in read_claims_of(changes, path).inputFiles()}
    assert 1 <= len(touched) <= 2 and len(before.inputFiles()) >= 30
    after = change_tags(changes, path)
    kept = set(before.inputFiles()) & set(after.inputFiles())
    assert {f.split("bucket=")[1].split("/")[0] for f in set(after.inputFiles()) - kept} == touched
    assert after.count() == 2000 and [tuple(r) for r in after.where("tag IS NOT NULL").collect()] == [(7, "text 7", "x")]


def _rows_scanned(df):
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(k).metrics().get("numOutputRows").get().value() for k in range(leaves.size()))


def test_look_ups_skip_row_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(claims_table, "ROW_GROUP_BYTES", 8 << 10)
    path = str(tmp_path / "claims")
    rows = spark.range(1, 60001).selectExpr("id", "sha2(string(id), 256) AS content", "concat('tag ', id % 40) AS tag")
    stored = replace_claims(rows, path)
    found = read_claim(spark, path, 777)
    assert [r["id"] for r in found.collect()] == [777] and read_claim(spark, path, 60001).count() == 0
    bucket = read_claims_of(spark.createDataFrame([(777,)], "id bigint"), path)
    assert _rows_scanned(found) < bucket.count() / 4 < 60000 / 32
    assert _rows_scanned(stored.where("tag = 'tag 1x'")) == 0 < _rows_scanned(stored.where("tag = 'tag 17'"))
