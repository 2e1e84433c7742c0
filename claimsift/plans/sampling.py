"""Queries of sampling, splitting and the files written from splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimsift import flows
from claimsift.operators import sampling
from claimsift.plans.exploration import CLEAN
from claimsift.plans.tables import TAXONOMY, corpus_sql, documents, raw_claims, sample_sql, sides_sql, split_table
from claimsift.schemas import SEED_RECORDS
from claimsift.session import new_path
from claimsift.sources import reports, splits
from claimsift.sources.csv_files import read_claims_csv


def _docs(spark, sf):
    return documents(spark, sf).select(F.col("doc_id").alias("claim_id"), F.col("lang").alias("tag_clean"))


def nested_stratified_sample(spark, sf):
    sides = sampling.stratified_split(_docs(spark, sf))
    size = sides.where("split = 'test'").count() // 2
    return sampling.nested_sample(sides, size).select("claim_id", "tag_clean", "split", "in_sample")


def split_report(spark, sf):
    rows = documents(spark, sf).select(
        F.col("doc_id").alias("claim_id"), F.col("lang").alias("tag_clean"), F.sha2("text", 256).alias("digest")
    )
    return sampling.split_report(sampling.stratified_split(rows))


def _seed_rows(spark, sf):
    keys = sampling.balanced_seed(_docs(spark, sf))
    texts = documents(spark, sf).select(F.col("doc_id").alias("claim_id"), F.col("text").alias("claim"))
    return texts.join(F.broadcast(keys), "claim_id")  # a hundred keys


def seed_json_round_trip(spark, sf):
    path = new_path(spark, "seed")
    reports.write_seed_json(_seed_rows(spark, sf), path)
    kept_nulls = F.col("value").contains('"tag":null')
    lines = spark.read.text(path).select(
        F.from_json("value", SEED_RECORDS).alias("r"), kept_nulls.alias("null_tag_written")
    )
    return lines.select(
        F.md5("r.content").alias("digest"), "r.tag", F.col("r._expected_tag").alias("expected_tag"), "null_tag_written"
    )


def split_round_trip(spark, sf):
    """Written as the partitioned table and read back side by side."""
    path = new_path(spark, "splits")
    splits.write_split(split_table(spark, sf, sample=True), path)
    sides = [
        splits.read_split(spark, path, side).select(
            F.lit(side).alias("side"), "claim_id", "tag_clean", F.md5("claim").alias("digest"))
        for side in ("train", "test", "sample")
    ]
    return sides[0].unionByName(sides[1]).unionByName(sides[2])


def split_csv_round_trip(spark, sf):
    """The published two-column file of the test side."""
    path = new_path(spark, "split-csv")
    splits.write_split_csv(split_table(spark, sf, sample=True), path, "test")
    back = read_claims_csv(spark, path, {"Consumer Claim": "claim", "Tag_Clean": "tag_clean"}, row_id=None)
    return back.groupBy("tag_clean", F.md5("claim").alias("digest")).agg(F.count(F.lit(1)).alias("n"))


def make_splits(spark, sf):
    """The flow from raw claims to the written split table, with the default support and a sample of 20."""
    path = new_path(spark, "splits")
    flows.make_splits(raw_claims(spark, sf), path, TAXONOMY, sample_size=20)
    sides = [splits.read_split(spark, path, side) for side in ("train", "test")]
    return sides[0].unionByName(sides[1]).select("claim_id", "tag_clean", "split", "in_sample", F.md5("claim").alias("digest"))


def shuffle_rows(spark, sf):
    return sampling.shuffle_rows(_docs(spark, sf)).select("claim_id", "position")


QUERIES = {
    "sample_n": lambda s, d: sampling.sample_n(_docs(s, d), 500),
    "stratified_split": lambda s, d: sampling.stratified_split(_docs(s, d)).select("claim_id", "tag_clean", "split"),
    "nested_stratified_sample": nested_stratified_sample,
    "split_report": split_report,
    "balanced_per_class": lambda s, d: sampling.balanced_per_class(_docs(s, d)),
    "balanced_seed": lambda s, d: sampling.balanced_seed(_docs(s, d)).select("claim_id", "tag_clean", "position"),
    "shuffle_rows": shuffle_rows,
    "head_n": lambda s, d: sampling.head_n(shuffle_rows(s, d), 20),
    "seed_json_round_trip": seed_json_round_trip,
    "split_round_trip": split_round_trip,
    "split_csv_round_trip": split_csv_round_trip,
    "make_splits": make_splits,
}

DOCS = "docs AS (SELECT doc_id AS claim_id, lang AS tag_clean FROM documents)"
H = "md5(concat('42:', claim_id))"
SEED = f"""{DOCS},
ranked AS (SELECT *, row_number() OVER (PARTITION BY tag_clean ORDER BY {H}, claim_id) AS rn FROM docs),
picked AS (SELECT claim_id, tag_clean FROM ranked WHERE rn <= 10),
rest AS (SELECT claim_id, tag_clean, row_number() OVER (ORDER BY {H}, claim_id) AS rn FROM docs
         WHERE claim_id NOT IN (SELECT claim_id FROM picked)),
seed_rows AS (SELECT * FROM picked UNION ALL
  SELECT claim_id, tag_clean FROM rest WHERE rn <= 100 - (SELECT count(*) FROM picked)),
placed AS (SELECT *, row_number() OVER (ORDER BY md5(concat('shuffle:', claim_id)), claim_id) AS position FROM seed_rows)"""
SHUFFLED = f"""{DOCS},
shuffled AS (SELECT claim_id, row_number() OVER (ORDER BY md5(concat('shuffle:', claim_id)), claim_id) AS position FROM docs)"""
CORPUS = f"{corpus_sql()},{sides_sql()},{sample_sql()}"
NULL_LIST = "('', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', '<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null')"

ORACLES = {
    "sample_n": f"WITH {DOCS} SELECT * FROM docs ORDER BY {H}, claim_id LIMIT 500",
    "stratified_split": f"WITH {DOCS},{sides_sql('docs')} SELECT claim_id, tag_clean, split FROM sides",
    "nested_stratified_sample": f"""WITH {DOCS},{sides_sql('docs')},{sample_sql()}
SELECT claim_id, tag_clean, split, in_sample FROM sampled""",
    "split_report": f"""WITH {DOCS},{sides_sql('docs')},
t AS (SELECT text, count(*) FILTER (split = 'train') AS a, count(*) FILTER (split = 'test') AS b
      FROM sides JOIN documents ON doc_id = claim_id GROUP BY text)
SELECT CAST(sum(a) AS BIGINT) AS n_train, CAST(sum(b) AS BIGINT) AS n_test, count(*) FILTER (a > 0 AND b > 0) AS n_leaked_texts FROM t""",
    "balanced_per_class": f"WITH {SEED} SELECT * FROM picked",
    "balanced_seed": f"WITH {SEED} SELECT claim_id, tag_clean, position FROM placed",
    "shuffle_rows": f"WITH {SHUFFLED} SELECT * FROM shuffled",
    "head_n": f"WITH {SHUFFLED} SELECT * FROM shuffled ORDER BY position LIMIT 20",
    "seed_json_round_trip": f"""WITH {SEED}
SELECT md5(regexp_replace(regexp_replace(text, '^[\\s\\x{{85}}\\x{{a0}}]+', ''), '[\\s\\x{{85}}\\x{{a0}}]+$', '')) AS digest,
       CAST(NULL AS VARCHAR) AS tag, tag_clean AS expected_tag, true AS null_tag_written
FROM placed JOIN documents ON doc_id = claim_id""",
    "split_round_trip": f"""WITH {CORPUS}
SELECT side, claim_id, tag_clean, md5(claim) AS digest FROM (
  SELECT split AS side, * FROM sampled UNION ALL SELECT 'sample' AS side, * FROM sampled WHERE in_sample)""",
    "make_splits": f"""WITH {CLEAN},
kept AS (SELECT claim_id, tag_clean, claim FROM clean WHERE tag_clean IN (
  SELECT tag_clean FROM clean GROUP BY tag_clean HAVING count(*) >= 50)),{sides_sql('kept')},{sample_sql('20')}
SELECT claim_id, tag_clean, split, in_sample, md5(claim) AS digest FROM sampled""",
    "split_csv_round_trip": f"""WITH {CORPUS}
SELECT tag_clean, md5(CASE WHEN claim IN {NULL_LIST} THEN NULL ELSE claim END) AS digest, count(*) AS n
FROM sampled WHERE split = 'test' GROUP BY 1, 2""",
}
