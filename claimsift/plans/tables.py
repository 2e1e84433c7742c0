"""The given tables in the roles the library needs, and the matching SQL for the checks.

Column expressions shared by Spark and DuckDB are kept once, as text both engines understand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimsift.operators.cleaning import unique_keys, usable_text
from claimsift.operators.sampling import nested_sample, stratified_split
from claimsift.session import materialise, spread

# A short literal list, the same in queries and checks; the library takes any list.
STOPS = [
    "the", "of", "to", "and", "in", "is", "it", "that", "for", "on", "with", "as", "was", "be", "by", "this",
    "de", "la", "le", "les", "un", "une", "et", "du", "der", "die", "das", "und", "el", "los", "en", "que",
]

RAW_CLAIMS = {
    "claim_id": "doc_id",
    "tag": "CASE WHEN doc_id % 17 = 0 THEN NULL ELSE source END",
    "claim": """CASE WHEN doc_id % 7 = 3 THEN NULL
       WHEN doc_id % 23 = 5 THEN concat(' ', chr(9), chr(10))
       WHEN doc_id % 5 = 1 THEN concat(chr(10), ' ', text, ' XXXX xx XXXXXXXX 00 ', chr(9))
       ELSE text END""",
    "company": "concat('company ', CAST(doc_id % 12 AS VARCHAR(10)))",
    "label": "lang",
}

# src0..src17 -> cat0..cat8, two raw tags fall through
TAXONOMY = {f"src{n}": f"cat{n // 2}" for n in range(18)}

PREDICTIONS_A = {
    "claim_id": "doc_id",
    "y_true": "lang",
    "y_pred": """CASE WHEN doc_id % 11 = 0 THEN 'Autre / Inconnu' WHEN doc_id % 6 = 1 THEN 'en'
       WHEN lang = 'es' AND doc_id % 2 = 0 THEN 'fr' ELSE lang END""",
    "latency_sec": "CAST(n_chars AS DOUBLE) / 1000",
}
PREDICTIONS_B = {
    "claim_id": "doc_id",
    "y_true": "lang",
    "y_pred": """CASE WHEN doc_id % 7 = 0 THEN 'Autre / Inconnu' WHEN doc_id % 5 = 1 THEN 'en'
       WHEN lang = 'es' AND doc_id % 2 = 0 THEN 'fr' ELSE lang END""",
    "latency_sec": "CAST(n_chars AS DOUBLE) / 100000",
}

APP_CLAIMS = {
    "id": "doc_id + 1",
    "content": "text",
    "tag": "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source END",
}

TAG_EVENTS = {
    "event_id": "event_id",
    "ts": "ts",
    "claim_id": "user_id * 7",
    "tag": """CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 9 = 1 THEN '' WHEN event_id % 9 = 2 THEN '   '
       WHEN event_id % 9 = 3 THEN concat(' ', event_type, chr(9)) ELSE event_type END""",
    "engine": "CASE event_id % 3 WHEN 0 THEN 'manual' WHEN 1 THEN 'ml' ELSE 'external' END",
    "confidence": "CASE WHEN event_id % 3 = 1 THEN value / 500 END",
}

TAG_REQUESTS = {
    "request_id": "event_id",
    "id": """CASE event_id % 8 WHEN 0 THEN concat(CAST(user_id AS VARCHAR(20)), 'abc')
       WHEN 1 THEN concat('  ', CAST(user_id AS VARCHAR(20)))
       WHEN 2 THEN concat('-', CAST(user_id AS VARCHAR(20)), '.9') WHEN 3 THEN 'abc' WHEN 4 THEN ''
       WHEN 5 THEN NULL ELSE CAST(user_id * 7 AS VARCHAR(20)) END""",
}

ANSWERS = {
    "claim_id": "doc_id + 1",
    "prediction_raw": """CASE doc_id % 14 WHEN 0 THEN 'Mortgage' WHEN 1 THEN 'mortgage.' WHEN 2 THEN '  Student loan '
       WHEN 3 THEN 'Debt collection or Mortgage' WHEN 4 THEN 'Erreur' WHEN 5 THEN 'Credit' WHEN 6 THEN ''
       WHEN 7 THEN NULL WHEN 8 THEN 'PAYDAY & PERSONAL LOAN' WHEN 9 THEN 'loan' WHEN 10 THEN 'Erreur (Quota dépassé)'
       WHEN 11 THEN concat('Answer: ', lang, ' / Vehicle loan / Lease') WHEN 12 THEN source
       ELSE 'Credit card / Prepaid card' END""",
}

REQUEST_TEXTS = {
    "request_id": "conv_id * 1000 + turn",
    "user_claim": """CASE WHEN conv_id % 6 = 0 THEN NULL WHEN conv_id % 6 = 1 THEN substring(text, 1, 2)
       WHEN conv_id % 6 = 2 THEN concat('  ', chr(10), chr(9)) ELSE text END""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts, which cost CPU per row."""
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def planted(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{expr} AS {name}" for name, expr in columns.items()])


def planted_sql(name: str, columns: dict[str, str], source: str = "documents") -> str:
    body = ", ".join(f"{expr} AS {column}" for column, expr in columns.items())
    return f"{name} AS (SELECT {body} FROM {source})"


def raw_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planted(documents(spark, sf_dir), RAW_CLAIMS)


def corpus_keys(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Usable texts, and the keys of the unique ones with the language as class."""
    usable = usable_text(documents(spark, sf_dir).selectExpr("doc_id AS claim_id", "lang AS tag", "text AS claim"))
    keys = materialise(unique_keys(usable).withColumnRenamed("tag", "tag_clean"), "keys")
    return usable.select("claim_id", "claim"), keys


def split_table(spark: SparkSession, sf_dir: str, sample: bool = False) -> DataFrame:
    """Unique texts with class, side and (if asked for) the nested sample: half of the test side.

    Everything up to the sides works on keys; texts are joined last and the table is written once.
    """
    texts, keys = corpus_keys(spark, sf_dir)
    sides = stratified_split(keys.drop("digest"))
    if sample:
        sides = materialise(sides, "sides")
        size = sides.where("split = 'test'").count() // 2
        sides = nested_sample(sides, size)
    return spread(materialise(texts.join(sides, "claim_id"), "split"), "claim_id")


# ---- the same in SQL ---------------------------------------------------------------------------


def words_sql(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def quota_sql(name: str, sizes: str, total: str) -> str:
    """Largest-remainder quotas from (stratum, size); ``total`` is an expression over n."""
    return f"""
{name} AS (
  SELECT stratum, CAST(base + CASE WHEN row_number() OVER (ORDER BY rest DESC, stratum) <=
           any_value(total) OVER () - sum(base) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota
  FROM (SELECT stratum, total, CAST(size AS HUGEINT) * total // n AS base, CAST(size AS HUGEINT) * total % n AS rest
        FROM (SELECT stratum, size, n, CAST({total} AS HUGEINT) AS total
              FROM (SELECT stratum, size, sum(size) OVER () AS n FROM {sizes}))))"""


def corpus_sql() -> str:
    """claim_id, tag_clean, claim of the unique usable texts."""
    return """
corpus AS (
  SELECT min(doc_id) AS claim_id, lang AS tag_clean, claim
  FROM (SELECT doc_id, lang, regexp_replace(regexp_replace(text, '^[\\s\\x{85}\\x{a0}]+', ''), '[\\s\\x{85}\\x{a0}]+$', '') AS claim
        FROM documents WHERE text IS NOT NULL)
  WHERE claim <> '' GROUP BY lang, claim)"""


def sides_sql(source: str = "corpus") -> str:
    """``sides``: source with split, by plain ranking inside each class."""
    return f"""
class_sizes AS (SELECT tag_clean AS stratum, count(*) AS size FROM {source} GROUP BY tag_clean),
{quota_sql("test_quota", "class_sizes", "ceil(CAST(0.2 AS DOUBLE) * n)")},
sides AS (
  SELECT r.*, CASE WHEN rn <= quota THEN 'test' ELSE 'train' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY tag_clean ORDER BY md5(concat('42:', claim_id)), claim_id) AS rn
        FROM {source}) r JOIN test_quota ON tag_clean = stratum)"""


def sample_sql(total: str = "n // 2") -> str:
    """``sampled``: sides with in_sample, by default half of the test side."""
    return f"""
test_sizes AS (SELECT tag_clean AS stratum, count(*) AS size FROM sides WHERE split = 'test' GROUP BY tag_clean),
{quota_sql("sample_quota", "test_sizes", total)},
sampled AS (
  SELECT r.* EXCLUDE (rank), split = 'test' AND rank <= quota AS in_sample
  FROM (SELECT *, row_number() OVER (PARTITION BY tag_clean, split ORDER BY md5(concat('sample:', claim_id)), claim_id)
               AS rank FROM sides) r JOIN sample_quota ON tag_clean = stratum)"""
