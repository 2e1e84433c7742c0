"""Queries around the table of claims and the three ways of tagging."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimsift.fixed_values import ALLOWED_TAGS, MASKS_TRAINING
from claimsift.functions import answers
from claimsift.operators import tagging
from claimsift.plans.modelling import bayes_sql, naive_bayes
from claimsift.plans.tables import (
    ANSWERS, APP_CLAIMS, REQUEST_TEXTS, STOPS, TAG_EVENTS, TAG_REQUESTS, documents, planted, planted_sql, table,
    words_sql,
)
from claimsift.session import new_path
from claimsift.sources.claims_table import append_claims, change_tags, read_claim, read_claims_table, replace_claims, reset_claims
from claimsift.streaming import auto_tag

INBOX = "src5"


def _claims(spark, sf):
    return planted(table(spark, sf, "documents"), APP_CLAIMS)


def _events(spark, sf):
    return planted(table(spark, sf, "events"), TAG_EVENTS)


def _requests(spark, sf):
    return planted(table(spark, sf, "events"), TAG_REQUESTS)


def _answers(spark, sf):
    return planted(table(spark, sf, "documents"), ANSWERS)


def _shown(claims):
    return claims.select("id", F.md5("content").alias("digest"), "tag")


def read_table(spark, sf):
    """Written as the application's table, read back through its schema."""
    path = new_path(spark, "claims")
    replace_claims(_claims(spark, sf), path)
    return _shown(read_claims_table(spark, path))


def _records(spark, sf):
    return table(spark, sf, "documents").selectExpr("doc_id AS position", "text AS content", "CAST(NULL AS STRING) AS tag")


def reset(spark, sf):
    return _shown(reset_claims(_records(spark, sf), new_path(spark, "claims"), ["position"]))


def append(spark, sf):
    """The conversations are inserted after the documents."""
    path = new_path(spark, "claims")
    reset_claims(_records(spark, sf), path, ["position"])
    more = table(spark, sf, "conversations").selectExpr("conv_id", "turn", "text AS content", "role AS tag")
    return _shown(append_claims(more, path, ["conv_id", "turn"], "conversations"))


def build_prompt(spark, sf):
    return documents(spark, sf).select(F.col("doc_id").alias("claim_id"), F.md5(answers.build_prompt("text")).alias("digest"))


def normalise_prediction(spark, sf):
    rows = _answers(spark, sf)
    return rows.select("claim_id", "prediction_raw", answers.normalise_prediction("prediction_raw", ALLOWED_TAGS).alias("prediction"))


def normalise_tag(spark, sf):
    return _answers(spark, sf).select("claim_id", "prediction_raw", answers.normalise_tag("prediction_raw").alias("tag"))


def clean_manual_tag(spark, sf):
    return _events(spark, sf).select("event_id", answers.clean_manual_tag("tag").alias("tag"))


def validate_requests(spark, sf):
    rows = tagging.validate_requests(planted(table(spark, sf, "conversations"), REQUEST_TEXTS))
    return rows.select("request_id", "status")


def resolve_requests(spark, sf):
    rows = tagging.resolve_requests(_requests(spark, sf), _claims(spark, sf))
    return rows.select("request_id", "claim_id", "status", F.md5("content").alias("digest"))


def apply_tags(spark, sf):
    return _shown(tagging.apply_tags(_claims(spark, sf), tagging.manual_changes(_events(spark, sf))))


def apply_tags_stored(spark, sf):
    """The table is stored, and the buckets of the changed claims are stored again."""
    path = new_path(spark, "claims")
    replace_claims(_claims(spark, sf), path)
    changes = tagging.latest_changes(tagging.manual_changes(_events(spark, sf)), "tag")
    return _shown(change_tags(changes.withColumnRenamed("claim_id", "id"), path))


def claim_by_id(spark, sf):
    return _shown(tagging.claim_by_id(_claims(spark, sf), 77))


def claim_by_id_stored(spark, sf):
    """Looked up in the stored table, where one bucket is read."""
    path = new_path(spark, "claims")
    replace_claims(_claims(spark, sf), path)
    return _shown(read_claim(spark, path, 77))


def tag_state(spark, sf):
    rows = tagging.tag_state(tagging.manual_changes(_events(spark, sf)))
    return rows.withColumn("confidence", F.round("confidence", 6))


def auto_tag_external(spark, sf):
    return tagging.auto_tag_external(_requests(spark, sf), _claims(spark, sf), _answers(spark, sf))


def auto_tag_external_table(spark, sf):
    claims = _claims(spark, sf)
    return _shown(tagging.apply_results(claims, auto_tag_external(spark, sf)))


def auto_tag_ml(spark, sf):
    _, model = naive_bayes(spark, sf)
    claims = planted(documents(spark, sf), APP_CLAIMS)
    return tagging.auto_tag_ml(_requests(spark, sf), claims, model)


def auto_tag_ml_table(spark, sf):
    """Tags of the model end up in the stored table."""
    path = new_path(spark, "claims")
    replace_claims(_claims(spark, sf), path)
    return _shown(replace_claims(tagging.apply_results(read_claims_table(spark, path), auto_tag_ml(spark, sf)), path))


def auto_tag_stream(spark, sf):
    """The documents arrive as files of the shared folder and are tagged in micro-batches."""
    _, model = naive_bayes(spark, sf)
    inbox, target, checkpoint = (new_path(spark, name) for name in ("arrivals", "tagged", "stream"))
    documents(spark, sf).selectExpr("doc_id AS claim_id", "text AS content", "doc_id AS arrived").write.parquet(inbox)
    arrivals = auto_tag.read_arrivals(spark, inbox, spark.read.parquet(inbox).schema, max_files=4)
    auto_tag.auto_tag_stream(arrivals, model, target, checkpoint).awaitTermination()
    auto_tag.compact_tagged(spark, target)
    return auto_tag.read_tagged(spark, target).drop("arrived", "digest")


QUERIES = {
    "read_claims_table": read_table,
    "reset_claims": reset,
    "append_claims": append,
    "inbox_all": lambda s, d: _shown(tagging.inbox_filter(_claims(s, d), "all")),
    "inbox_untagged": lambda s, d: _shown(tagging.inbox_filter(_claims(s, d), "untagged")),
    "inbox_by_tag": lambda s, d: _shown(tagging.inbox_filter(_claims(s, d), INBOX)),
    "build_prompt": build_prompt,
    "normalise_prediction": normalise_prediction,
    "normalise_tag": normalise_tag,
    "clean_manual_tag": clean_manual_tag,
    "validate_requests": validate_requests,
    "resolve_requests": resolve_requests,
    "apply_tags": apply_tags,
    "apply_tags_stored": apply_tags_stored,
    "claim_by_id": claim_by_id,
    "claim_by_id_stored": claim_by_id_stored,
    "tag_state": tag_state,
    "auto_tag_external": auto_tag_external,
    "auto_tag_external_table": auto_tag_external_table,
    "auto_tag_ml": auto_tag_ml,
    "auto_tag_ml_table": auto_tag_ml_table,
    "auto_tag_stream": auto_tag_stream,
}

CLAIMS = planted_sql("claims", APP_CLAIMS)
EVENTS = planted_sql("tag_events", TAG_EVENTS, "events")
REQUESTS = planted_sql("requests", TAG_REQUESTS, "events")
ANSWERED = planted_sql("answers", ANSWERS)
TRIM = "trim({}, concat(' ', chr(9), chr(10), chr(13)))"
ALLOWED = "allowed AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(ALLOWED_TAGS)) + ") v(ord, tag))"
TYPED = f"typed AS (SELECT * REPLACE (CASE WHEN tag IS NULL OR tag = '' THEN NULL ELSE {TRIM.format('tag')} END AS tag) FROM tag_events)"
LAST = "last AS (SELECT * FROM typed QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY ts DESC, event_id DESC) = 1)"
PARSED = """parsed AS (SELECT request_id, TRY_CAST(nullif(regexp_extract(id, '^\\s*([+-]?[0-9]+)', 1), '') AS BIGINT) AS claim_id FROM requests)"""
STATUS = "CASE WHEN claim_id IS NULL THEN 'invalid_id' WHEN id IS NULL THEN 'not_found' ELSE {} END"
NORMAL_TAG = f"""normal AS (
  SELECT claim_id, prediction_raw, coalesce(
    (SELECT arg_min(tag, ord) FROM allowed WHERE lower(tag) = lower({TRIM.format('prediction_raw')}) AND prediction_raw <> ''),
    (SELECT arg_min(tag, ord) FROM allowed WHERE prediction_raw <> '' AND (contains(lower({TRIM.format('prediction_raw')}), lower(tag))
       OR contains(lower(tag), lower({TRIM.format('prediction_raw')})))),
    'Credit reporting') AS tag FROM answers)"""
EXTERNAL = f"""{CLAIMS}, {REQUESTS}, {ANSWERED}, {ALLOWED}, {PARSED}, {NORMAL_TAG},
result AS (SELECT request_id, p.claim_id, {STATUS.replace("claim_id", "p.claim_id").format("'tagged'")} AS status,
       CASE WHEN id IS NOT NULL THEN coalesce({TRIM.format("prediction_raw")}, '') END AS prediction_raw, n.tag
FROM parsed p LEFT JOIN claims ON id = p.claim_id LEFT JOIN normal n ON n.claim_id = id)"""
REQUEST_STATUS = "CASE WHEN {0} IS NULL OR length({0}) < 3 THEN 'too_short' WHEN {1} = '' THEN 'empty' ELSE '{2}' END"
PROMPT = "concat('Réclamation client :', chr(10), '\"\"\"', chr(10), text, chr(10), '\"\"\"', chr(10), chr(10), 'Catégorie :')"
# Any text can be asked for a tag, not only the held-out ones: weights of all documents against the fitted vocabulary.
ALL_TEXTS = """
all_tok AS (SELECT doc_id AS claim_id, text, list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}'), lambda x: x NOT IN (STOPWORDS)) AS t FROM documents),
all_terms AS (SELECT claim_id, unnest(t) AS term FROM all_tok UNION ALL
  SELECT claim_id, unnest(list_transform(range(1, len(t)), lambda i: concat(t[i], ' ', t[i + 1]))) FROM all_tok),
all_tf AS (SELECT claim_id, term, (1 + ln(count(*))) * any_value(idf) AS x FROM all_terms JOIN idf USING (term) GROUP BY 1, 2),
all_w AS (SELECT claim_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY claim_id)) AS w FROM all_tf),
all_raw AS (SELECT claim_id, label, sum(w * theta) AS s FROM all_w JOIN theta USING (term) GROUP BY 1, 2),
all_score AS (SELECT c.claim_id, c.text, k.label, k.prior + coalesce(s, 0) AS s
  FROM all_tok c CROSS JOIN classes k LEFT JOIN all_raw r ON r.claim_id = c.claim_id AND r.label = k.label),
all_prob AS (SELECT *, exp(s - m) / sum(exp(s - m)) OVER (PARTITION BY claim_id) AS p,
    row_number() OVER (PARTITION BY claim_id ORDER BY round(s, 9) DESC, label) AS place
  FROM (SELECT *, max(s) OVER (PARTITION BY claim_id) AS m FROM all_score)),
all_tagged AS (SELECT claim_id, CASE WHEN length(text) < 3 THEN 'too_short' ELSE 'tagged' END AS status,
    CASE WHEN length(text) >= 3 THEN label END AS tag, CASE WHEN length(text) >= 3 THEN round(p, 4) END AS confidence
  FROM all_prob WHERE place = 1)"""


def all_texts_sql() -> str:
    return f"{bayes_sql()},{ALL_TEXTS.replace('STOPWORDS', words_sql([*STOPS, *MASKS_TRAINING]))}"


ORACLES = {
    "read_claims_table": f"WITH {CLAIMS} SELECT id, md5(content) AS digest, tag FROM claims",
    "reset_claims": "SELECT row_number() OVER (ORDER BY doc_id) AS id, md5(text) AS digest, CAST(NULL AS VARCHAR) AS tag FROM documents",
    "append_claims": """SELECT row_number() OVER (ORDER BY doc_id) AS id, md5(text) AS digest, CAST(NULL AS VARCHAR) AS tag FROM documents
UNION ALL SELECT (SELECT count(*) FROM documents) + row_number() OVER (ORDER BY conv_id, turn), md5(text), role FROM conversations""",
    "inbox_all": f"WITH {CLAIMS} SELECT id, md5(content) AS digest, tag FROM claims ORDER BY id DESC",
    "inbox_untagged": f"WITH {CLAIMS} SELECT id, md5(content) AS digest, tag FROM claims WHERE tag IS NULL",
    "inbox_by_tag": f"WITH {CLAIMS} SELECT id, md5(content) AS digest, tag FROM claims WHERE tag = '{INBOX}'",
    "build_prompt": f"SELECT doc_id AS claim_id, md5({PROMPT}) AS digest FROM documents",
    "normalise_prediction": f"""WITH {ANSWERED}, {ALLOWED}
SELECT claim_id, prediction_raw, coalesce((SELECT min(tag) FROM allowed WHERE contains(lower(prediction_raw), lower(tag))),
  'Autre / Inconnu') AS prediction FROM answers""",
    "normalise_tag": f"WITH {ANSWERED}, {ALLOWED}, {NORMAL_TAG} SELECT claim_id, prediction_raw, tag FROM normal",
    "clean_manual_tag": f"WITH {EVENTS}, {TYPED} SELECT event_id, tag FROM typed",
    "validate_requests": f"""WITH {planted_sql("r", REQUEST_TEXTS, "conversations")}
SELECT request_id, {REQUEST_STATUS.format("user_claim", TRIM.format("user_claim"), "valid")} AS status FROM r""",
    "resolve_requests": f"""WITH {CLAIMS}, {REQUESTS}, {PARSED}
SELECT request_id, claim_id, {STATUS.format("'found'")} AS status, md5(content) AS digest
FROM parsed LEFT JOIN claims ON id = claim_id""",
    "apply_tags": f"""WITH {CLAIMS}, {EVENTS}, {TYPED}, {LAST}
SELECT id, md5(content) AS digest, CASE WHEN l.claim_id IS NOT NULL THEN l.tag ELSE c.tag END AS tag
FROM claims c LEFT JOIN last l ON l.claim_id = c.id""",
    "claim_by_id": f"WITH {CLAIMS} SELECT id, md5(content) AS digest, tag FROM claims WHERE id = 77",
    "tag_state": f"WITH {EVENTS}, {TYPED}, {LAST} SELECT claim_id, tag, engine, round(confidence, 6) AS confidence FROM last",
    "auto_tag_external": f"WITH {EXTERNAL} SELECT * FROM result",
    "auto_tag_external_table": f"""WITH {EXTERNAL}
SELECT c.id, md5(c.content) AS digest, coalesce(r.tag, c.tag) AS tag
FROM claims c LEFT JOIN (SELECT DISTINCT claim_id, tag FROM result WHERE status = 'tagged') r ON r.claim_id = c.id""",
    "auto_tag_ml_table": f"""WITH {CLAIMS}, {REQUESTS}, {PARSED}, {all_texts_sql()}
SELECT c.id, md5(c.content) AS digest, CASE WHEN a.status = 'tagged' AND c.id IN (SELECT claim_id FROM parsed) THEN a.tag ELSE c.tag END AS tag
FROM claims c JOIN all_tagged a ON a.claim_id + 1 = c.id""",
    "auto_tag_ml": f"""WITH {REQUESTS}, {PARSED}, {all_texts_sql()}
SELECT request_id, p.claim_id, CASE WHEN p.claim_id IS NULL THEN 'invalid_id' ELSE coalesce(a.status, 'not_found') END AS status,
       a.tag, a.confidence, CASE WHEN a.status = 'tagged' THEN 'ml' END AS engine
FROM parsed p LEFT JOIN all_tagged a ON a.claim_id + 1 = p.claim_id""",
    "auto_tag_stream": f"WITH {all_texts_sql()} SELECT claim_id, status, tag, confidence FROM all_tagged",
}
ORACLES["apply_tags_stored"] = ORACLES["apply_tags"]
ORACLES["claim_by_id_stored"] = ORACLES["claim_by_id"]
