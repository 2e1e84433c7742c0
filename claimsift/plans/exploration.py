"""Queries of the exploration: cleaning, counts, lengths, expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimsift.fixed_values import MASKS_PROFILE, VOCABULARY_FULL
from claimsift.functions.text import ngrams, remove_words, tokenise, word_count
from claimsift.operators import cleaning, features, profile
from claimsift.plans.tables import RAW_CLAIMS, STOPS, TAXONOMY, documents, planted_sql, raw_claims, table, words_sql
from claimsift.session import new_path
from claimsift.sources.csv_files import read_claims_csv, write_csv

RAW = planted_sql("claims_raw", RAW_CLAIMS)
WS = "[\\s\\x{85}\\x{a0}]+"
USABLE = f"""{RAW},
usable AS (
  SELECT * FROM (SELECT * REPLACE (regexp_replace(regexp_replace(claim, '^{WS}', ''), '{WS}$', '') AS claim)
                 FROM claims_raw WHERE claim IS NOT NULL) WHERE claim <> '')"""
CLEAN = f"""{USABLE},
uniq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY claim, tag ORDER BY claim_id) AS rn FROM usable) WHERE rn = 1),
clean AS (
  SELECT *, CASE WHEN regexp_matches(tag, '^src([0-9]|1[0-7])$')
                 THEN concat('cat', CAST(substring(tag, 4) AS INT) // 2) ELSE tag END AS tag_clean,
         len(list_filter(regexp_split_to_array(claim, '{WS}'), lambda x: x <> '')) AS word_count
  FROM uniq)"""
TOKENS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]{{2,}}')"


def _usable(spark, sf):
    return cleaning.usable_text(raw_claims(spark, sf))


def _ids(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("claim_id"))


def _profile(spark, sf):
    return cleaning.claim_profile(raw_claims(spark, sf), TAXONOMY)


def _lengths(spark, sf):
    return cleaning.length_cap(_profile(spark, sf))


def _text(df, *columns):
    """Keys with length and digest of the text: the whole text is compared without being returned."""
    return df.select(*columns, F.char_length("claim").cast("bigint").alias("n_chars"), F.md5("claim").alias("digest"))


def csv_round_trip(spark, sf):
    path = new_path(spark, "csv")
    rows = raw_claims(spark, sf).select(
        F.col("claim_id").cast("string").alias("key"), F.col("tag").alias("Tag"),
        F.col("claim").alias("Consumer Claim"), F.col("company").alias("Company"),
    )
    write_csv(rows, path)
    columns = {"key": "key", "Tag": "tag", "Consumer Claim": "claim", "Company": "company"}
    back = read_claims_csv(spark, path, columns)
    span = back.agg((F.max("claim_id") - F.min("claim_id") + 1).alias("span"))  # dense numbers
    return _text(back.withColumn("span", span.scalar()), F.col("key").cast("bigint").alias("key"), "tag", "company", "span")


def token_arrays(spark, sf):
    rows = documents(spark, sf).select(F.col("doc_id").alias("claim_id"), tokenise("text").alias("t"))
    return rows.select("claim_id", F.size("t").cast("bigint").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


def _filtered(spark, sf, words):
    rows = raw_claims(spark, sf).where("claim IS NOT NULL")
    rows = rows.select("claim_id", remove_words(tokenise("claim"), words).alias("t"))
    return rows.select("claim_id", F.size("t").cast("bigint").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


def term_arrays(spark, sf):
    rows = documents(spark, sf).select(
        F.col("doc_id").alias("claim_id"), remove_words(tokenise("text"), STOPS).alias("t")
    ).withColumn("b", ngrams("t", 2))
    return rows.select(
        "claim_id", F.size("b").cast("bigint").alias("n_bigrams"), F.md5(F.array_join("b", "|")).alias("bigrams"),
        F.size(F.concat("t", "b")).cast("bigint").alias("n_terms"),
    )


def _terms(spark, sf, low=1, high=2):
    rows = documents(spark, sf).select(F.col("doc_id").alias("claim_id"), F.col("text").alias("claim"))
    return features.with_terms(rows, "claim", STOPS, low, high)


QUERIES = {
    "profile_table": lambda s, d: profile.profile_table(raw_claims(s, d)),
    "profile_preview": lambda s, d: _text(profile.preview(raw_claims(s, d)), "claim_id", "tag", "company", "label"),
    "csv_round_trip": csv_round_trip,
    "usable_text": lambda s, d: _text(_usable(s, d), "claim_id", "tag"),
    "coverage": lambda s, d: cleaning.coverage(raw_claims(s, d)),
    "text_presence_share": lambda s, d: cleaning.text_presence_share(raw_claims(s, d)),
    "dedup_exact": lambda s, d: _text(cleaning.dedup_exact(_usable(s, d)), "claim_id", "tag"),
    "harmonise_tag": lambda s, d: cleaning.harmonise_tag(raw_claims(s, d), TAXONOMY).select("claim_id", "tag", "tag_clean"),
    "word_count": lambda s, d: _usable(s, d).select("claim_id", word_count("claim").cast("bigint").alias("word_count")),
    "tag_counts_raw": lambda s, d: cleaning.tag_counts(_profile(s, d), "tag", keep_null=True),
    "tag_counts_clean": lambda s, d: cleaning.tag_counts(_profile(s, d), "tag_clean"),
    "distinct_tags": lambda s, d: cleaning.distinct_tags(_profile(s, d)),
    "clean_claims": lambda s, d: _text(cleaning.clean_claims(raw_claims(s, d), TAXONOMY), "claim_id", "tag_clean", "word_count"),
    "min_support_filter": lambda s, d: cleaning.min_support_filter(_profile(s, d)).select("claim_id", "tag_clean"),
    "length_histogram": lambda s, d: profile.length_histogram(_lengths(s, d)),
    "length_density": lambda s, d: profile.length_density(_lengths(s, d)),
    "length_box_stats": lambda s, d: profile.length_box_stats(_lengths(s, d)),
    "tokenise": token_arrays,
    "remove_stop_words": lambda s, d: _filtered(s, d, STOPS),
    "remove_masks": lambda s, d: _filtered(s, d, [*STOPS, *MASKS_PROFILE]),
    "ngrams": term_arrays,
    "top_bigrams_raw": lambda s, d: profile.top_bigrams(_usable(s, d), STOPS, pool=_ids(s, d)),
    "top_bigrams_clean": lambda s, d: profile.top_bigrams(_usable(s, d), STOPS, MASKS_PROFILE, pool=_ids(s, d)),
    "document_frequency": lambda s, d: features.document_frequency(_terms(s, d, 1, 1)),
    "vocabulary": lambda s, d: features.top_terms(features.term_totals(_terms(s, d)), VOCABULARY_FULL),
}


def _filter_oracle(words):
    return f"""WITH {RAW}, t AS (
  SELECT claim_id, list_filter({TOKENS.format("claim")}, lambda x: x NOT IN ({words_sql(words)})) AS t
  FROM claims_raw WHERE claim IS NOT NULL)
SELECT claim_id, CAST(len(t) AS BIGINT) AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM t"""


def _bigram_oracle(words):
    return f"""WITH {USABLE},
drawn AS (SELECT * FROM usable ORDER BY md5(concat('42:', claim_id)), claim_id LIMIT 20000),
t AS (SELECT list_filter({TOKENS.format("claim")}, lambda x: x NOT IN ({words_sql(words)})) AS t FROM drawn),
b AS (SELECT unnest(list_transform(range(1, len(t)), lambda i: concat(t[i], ' ', t[i + 1]))) AS term FROM t)
SELECT term, count(*) AS n FROM b GROUP BY term ORDER BY n DESC, term LIMIT 15"""


_DOC_TOKENS = f"t AS (SELECT doc_id AS claim_id, list_filter({TOKENS.format('text')}, lambda x: x NOT IN ({words_sql(STOPS)})) AS t FROM documents)"
_COLUMNS = ["claim_id", "tag", "claim", "company", "label"]

ORACLES = {
    "clean_claims": f"""WITH {CLEAN} SELECT claim_id, tag_clean, CAST(word_count AS INT) AS word_count,
  length(claim) AS n_chars, md5(claim) AS digest FROM clean""",
    "profile_preview": f"""WITH {RAW} SELECT claim_id, tag, company, label, length(claim) AS n_chars, md5(claim) AS digest
FROM claims_raw ORDER BY claim_id LIMIT 5""",
    "profile_table": f"WITH {RAW} " + " UNION ALL ".join(
        f"SELECT CAST({i} AS INT) AS position, '{c}' AS column_name, count({c}) AS n_non_null, count(*) AS n_rows FROM claims_raw"
        for i, c in enumerate(_COLUMNS)
    ),
    "csv_round_trip": f"""WITH {RAW}
SELECT claim_id AS key, tag, company, (SELECT count(*) FROM claims_raw) AS span,
       length(claim) AS n_chars, md5(claim) AS digest FROM claims_raw""",
    "usable_text": f"WITH {USABLE} SELECT claim_id, tag, length(claim) AS n_chars, md5(claim) AS digest FROM usable",
    "coverage": f"""WITH {USABLE} SELECT n_rows, n_usable, round(n_usable * CAST(100 AS DOUBLE) / n_rows, 6) AS pct_usable
FROM (SELECT (SELECT count(*) FROM claims_raw) AS n_rows, (SELECT count(*) FROM usable) AS n_usable)""",
    "text_presence_share": f"""WITH {RAW}
SELECT has_text, n, round(n * CAST(100 AS DOUBLE) / (SELECT count(*) FROM claims_raw), 6) AS pct
FROM (SELECT claim IS NOT NULL AS has_text, count(*) AS n FROM claims_raw GROUP BY 1)""",
    "dedup_exact": f"WITH {CLEAN} SELECT claim_id, tag, length(claim) AS n_chars, md5(claim) AS digest FROM uniq",
    "harmonise_tag": f"""WITH {RAW} SELECT claim_id, tag, CASE WHEN regexp_matches(tag, '^src([0-9]|1[0-7])$')
  THEN concat('cat', CAST(substring(tag, 4) AS INT) // 2) ELSE tag END AS tag_clean FROM claims_raw""",
    "word_count": f"""WITH {USABLE} SELECT claim_id, CAST(len(list_filter(regexp_split_to_array(claim, '{WS}'),
  lambda x: x <> '')) AS BIGINT) AS word_count FROM usable""",
    "tag_counts_raw": f"WITH {CLEAN} SELECT tag, count(*) AS n FROM clean GROUP BY tag",
    "tag_counts_clean": f"WITH {CLEAN} SELECT tag_clean, count(*) AS n FROM clean WHERE tag_clean IS NOT NULL GROUP BY tag_clean",
    "distinct_tags": f"WITH {CLEAN} SELECT count(DISTINCT tag) AS n_raw_tags, count(DISTINCT tag_clean) AS n_clean_tags FROM clean",
    "min_support_filter": f"""WITH {CLEAN} SELECT claim_id, tag_clean FROM clean
WHERE tag_clean IN (SELECT tag_clean FROM clean GROUP BY tag_clean HAVING count(*) >= 50)""",
    "length_histogram": f"""WITH {CLEAN},
capped AS (SELECT word_count AS x FROM clean WHERE word_count <= 1000),
ext AS (SELECT min(x) AS lo, max(x) AS hi FROM capped),
bins AS (SELECT unnest(range(50)) AS bin),
filled AS (SELECT least((x - lo) * 50 // (hi - lo), 49) AS bin, count(*) AS n FROM capped, ext GROUP BY 1)
SELECT CAST(bins.bin AS INT) AS bin, round(lo + bins.bin * (CAST(hi - lo AS DOUBLE) / 50), 6) AS bin_start,
       round(lo + (bins.bin + 1) * (CAST(hi - lo AS DOUBLE) / 50), 6) AS bin_end, coalesce(n, 0) AS n
FROM bins LEFT JOIN filled ON filled.bin = bins.bin, ext""",
    "length_density": f"""WITH {CLEAN},
capped AS (SELECT CAST(word_count AS DOUBLE) AS x FROM clean WHERE word_count <= 1000),
ext AS (SELECT min(x) AS lo, max(x) AS hi, stddev_samp(x) * pow(count(*), -CAST(0.2 AS DOUBLE)) AS bw FROM capped),
grid AS (SELECT p, lo + p * (hi - lo) / 199 AS g FROM (SELECT unnest(range(200)) AS p), ext)
SELECT CAST(p AS INT) AS point, round(g, 6) AS x,
       round(sum(exp(-(g - capped.x) * (g - capped.x) / (2 * bw * bw)) / (bw * sqrt(2 * pi()))) * any_value((hi - lo) / 50), 6) AS density
FROM grid, capped, ext GROUP BY p, g""",
    "length_box_stats": f"""WITH {CLEAN},
capped AS (SELECT tag_clean, word_count AS x FROM clean WHERE word_count <= 1000 AND tag_clean IS NOT NULL),
q AS (SELECT tag_clean, count(*) AS n, quantile_cont(CAST(x AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(x AS DOUBLE), 0.5) AS median,
             quantile_cont(CAST(x AS DOUBLE), 0.75) AS q3 FROM capped GROUP BY tag_clean)
SELECT tag_clean, n, q1, median, q3,
       least(min(CASE WHEN x >= q1 - 1.5 * (q3 - q1) THEN CAST(x AS DOUBLE) END), q1) AS whisker_low,
       greatest(max(CASE WHEN x <= q3 + 1.5 * (q3 - q1) THEN CAST(x AS DOUBLE) END), q3) AS whisker_high,
       count(CASE WHEN x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1) THEN 1 END) AS n_outliers
FROM capped JOIN q USING (tag_clean) GROUP BY tag_clean, n, q1, median, q3""",
    "tokenise": f"""SELECT doc_id AS claim_id, CAST(len(t) AS BIGINT) AS n_tokens, md5(array_to_string(t, ' ')) AS digest
FROM (SELECT doc_id, {TOKENS.format("text")} AS t FROM documents)""",
    "remove_stop_words": _filter_oracle(STOPS),
    "remove_masks": _filter_oracle([*STOPS, *MASKS_PROFILE]),
    "ngrams": f"""WITH {_DOC_TOKENS},
b AS (SELECT claim_id, t, list_transform(range(1, len(t)), lambda i: concat(t[i], ' ', t[i + 1])) AS b FROM t)
SELECT claim_id, CAST(len(b) AS BIGINT) AS n_bigrams, md5(array_to_string(b, '|')) AS bigrams,
       CAST(len(t) + len(b) AS BIGINT) AS n_terms FROM b""",
    "top_bigrams_raw": _bigram_oracle(STOPS),
    "top_bigrams_clean": _bigram_oracle([*STOPS, *MASKS_PROFILE]),
    "document_frequency": f"""WITH {_DOC_TOKENS}, d AS (SELECT unnest(list_distinct(t)) AS term FROM t)
SELECT term, count(*) AS df FROM d GROUP BY term""",
    "vocabulary": f"""WITH {_DOC_TOKENS},
terms AS (SELECT unnest(t) AS term FROM t UNION ALL
  SELECT unnest(list_transform(range(1, len(t)), lambda i: concat(t[i], ' ', t[i + 1]))) FROM t)
SELECT term, count(*) AS n FROM terms GROUP BY term ORDER BY n DESC, term LIMIT 50000""",
}
