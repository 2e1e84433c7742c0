"""The registered queries of the operators, over whole tables, and SQL where it can express one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimsift.llm import (
    benchmark_suffixes, entropy_mix, hidden_markov, host_suffixes, label_sharding, latent_neighbours, merkle_manifest,
    periodic_runs, private_spans, simhash_tables, simhash_trie, toxic_segments, warc_segments,
)
from claimsift.llm.common import crc, documents


def op1_benchmark_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = benchmark_suffixes.scan(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "row.doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), "contaminated")


def op2_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hidden_markov.score(documents(spark, sf_dir))


def op3_host_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_suffixes.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy_mix.mix(documents(spark, sf_dir)).drop("rate")


def op5_private_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_spans.private_data(documents(spark, sf_dir))


def op6_simhash_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_tables.fingerprint_documents(documents(spark, sf_dir))


def op7_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_segments.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_trie.near_duplicates(documents(spark, sf_dir))
    return found.select(
        "doc_id", simhash_trie.hexadecimal(found.fingerprint).alias("fingerprint"), "component_id", "n_links")


def op9_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_segments.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_latent_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latent_neighbours.quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """``docs`` whose texts repeat a stretch of words up to their end where ten divides the crc32 of the id."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    cut = docs.select("doc_id", "text", crc(F.col("doc_id")).alias("h")).withColumn("w", F.when(F.col("h") % 10 == 0, words))
    cut = cut.withColumn("n", F.size("w")).withColumn("g", F.expr("h div 10"))
    cut = cut.withColumn("a", F.when(F.col("n") > 0, (F.col("g") % F.col("n")).cast("int")))
    period = F.expr("int(1 + (n - a) div (3 + g % 8))")
    repeated = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, period), F.expr("int(ceil((n - a) / (1 + (n - a) div (3 + g % 8))))")))
    planted = F.array_join(F.slice(F.concat(F.slice("w", F.lit(1), F.col("a")), repeated), F.lit(1), F.col("n")), " ")
    return cut.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(with_planted_periods(documents(spark, sf_dir)))
    exact = F.reduce("runs", F.struct(*[F.lit(None).cast("bigint").alias(c) for c in ("start", "length", "period")]), lambda best, r: F.when(
        # lengths and periods are numbers of words: the products stay far below 2^63
        best["start"].isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return found.withColumn("best", exact).select(
        "row.doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(crc(F.col("doc_id")) % 7 == 0, merkle_manifest.leaf_hash(n_chars=F.col("n_chars") + 1))
    checked = merkle_manifest.verify(merkle_manifest.manifest(documents(spark, sf_dir), tampered))
    return checked.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(F.lower(F.hex("witness")), 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_label_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_sharding.balanced_shards(documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {
    "op1_benchmark_suffixes": op1_benchmark_suffixes,
    "op2_hidden_markov": op2_hidden_markov,
    "op3_host_suffixes": op3_host_suffixes,
    "op4_entropy_mix": op4_entropy_mix,
    "op5_private_spans": op5_private_spans,
    "op6_simhash_tables": op6_simhash_tables,
    "op7_warc_segments": op7_warc_segments,
    "op8_simhash_trie": op8_simhash_trie,
    "op9_toxic_segments": op9_toxic_segments,
    "op10_latent_neighbours": op10_latent_neighbours,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_label_sharding": op13_label_sharding,
}
ORACLES = {
    "op1_benchmark_suffixes": r"""
        WITH cut AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM documents),
        items AS (
            SELECT CAST(item_id AS VARCHAR) AS item_id, w, least(13, len(w)) AS size
            FROM (SELECT item_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)
            WHERE len(w) > 0),
        windows AS (
            SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS s
            FROM items, unnest(range(1, len(w) - size + 2)) AS t(i)),
        places AS (
            SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS s
            FROM cut, (SELECT DISTINCT size FROM items), unnest(range(1, len(w) - size + 2)) AS t(i)),
        hits AS (SELECT doc_id, item_id, i, size FROM places JOIN windows USING (size, s)),
        covered AS (
            SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + size)) AS t(p) GROUP BY doc_id),
        named AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
            FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
            CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
            coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM cut LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op7_warc_segments": """
        WITH p AS (
            SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
        k AS (
            SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
        w AS (
            SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keeper FROM k)
        SELECT page_id, payload_bytes, payload_digest,
            CASE WHEN payload_bytes >= 1000 AND keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN payload_bytes >= 1000 AND keeper <> page_id THEN keeper END AS refers_to
        FROM w""",
    "op4_entropy_mix": r"""
        WITH sized AS (
            SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key
            FROM documents),
        sources AS (
            SELECT source, source_size, 3 * source_size AS most,
                [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
            FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source)),
        stopped AS (
            SELECT (total - held) / rest AS level, most / weight AS next, held
            FROM (SELECT *, sum(source_size) OVER () AS total,
                coalesce(sum(most) OVER before, 0) AS held,
                sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS rest
                FROM sources
                WINDOW before AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))),
        targets AS (
            SELECT source, source_size, CASE WHEN most < weight * level THEN CAST(most AS DOUBLE) ELSE weight * level END AS target
            FROM sources, (SELECT level FROM stopped WHERE level <= next ORDER BY held LIMIT 1)),
        rates AS (
            SELECT *, CAST(floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END + 1e-9) AS BIGINT) AS whole
            FROM targets),
        running AS (
            SELECT doc_id, source, size, key, sum(size) OVER (PARTITION BY source ORDER BY key
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS upto
            FROM sized)
        SELECT doc_id, size, source_size, target,
            whole + CASE WHEN upto + size / 2 <= target - whole * source_size THEN 1 ELSE 0 END AS copies,
            (whole + CASE WHEN upto + size / 2 <= target - whole * source_size THEN 1 ELSE 0 END) * size AS taken
        FROM running JOIN rates ON running.source IS NOT DISTINCT FROM rates.source""",
    "op12_merkle_manifest": """
        WITH RECURSIVE
        crcs AS (
            SELECT list(v ORDER BY i) AS crcs FROM (
                SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
                FROM range(256) AS r(i))),
        marked AS (
            SELECT doc_id, source, lang, n_chars, text, xor(4294967295, list_reduce(
                [4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
                lambda c, b: xor(c >> 8, crcs[1 + xor(c & 255, b)]))) % 7 = 0 AS tampered
            FROM documents, crcs),
        parts AS (
            SELECT doc_id, lang, tampered, n_chars AS plain, n_chars + 1 AS more,
                coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                    || coalesce(strlen(lang) || ':' || lang, '-') AS head,
                coalesce(strlen(text) || ':' || text, '-') AS tail
            FROM marked),
        hashed AS (
            SELECT doc_id, lang,
                sha256(head || coalesce(strlen(CAST(plain AS VARCHAR)) || ':' || plain, '-') || tail) AS leaf,
                CASE WHEN tampered THEN sha256(head || coalesce(strlen(CAST(more AS VARCHAR)) || ':' || more, '-') || tail) END AS shown
            FROM parts),
        leaves AS (
            SELECT *, row_number() OVER () AS id,
                row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n
            FROM hashed),
        nodes AS (
            SELECT lang, 0 AS level, pos, n, leaf AS h FROM leaves
            UNION ALL
            SELECT lang, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos))
            FROM nodes WHERE n > 1 GROUP BY lang, level, pos // 2, n),
        subroots AS (
            SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
        tops AS (
            SELECT 0 AS level, pos, n, subroot AS h FROM subroots
            UNION ALL
            SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY level, pos // 2, n),
        below AS (
            SELECT id, lang, 0 AS level, pos, n, coalesce(shown, leaf) AS h, '' AS proof FROM leaves
            UNION ALL
            SELECT b.id, b.lang, b.level + 1, b.pos // 2, (b.n + 1) // 2,
                sha256(CASE WHEN s.h IS NULL THEN b.h WHEN b.pos % 2 = 1 THEN s.h || b.h ELSE b.h || s.h END), b.proof || coalesce(s.h, '')
            FROM below AS b LEFT JOIN nodes AS s
                ON s.lang IS NOT DISTINCT FROM b.lang AND s.level = b.level AND s.pos = xor(b.pos, 1)
            WHERE b.n > 1),
        above AS (
            SELECT b.id, r.subroot, 0 AS level, r.pos, r.n, b.h, b.proof
            FROM below AS b JOIN subroots AS r ON r.lang IS NOT DISTINCT FROM b.lang WHERE b.n = 1
            UNION ALL
            SELECT b.id, b.subroot, b.level + 1, b.pos // 2, (b.n + 1) // 2,
                sha256(CASE WHEN s.h IS NULL THEN b.h WHEN b.pos % 2 = 1 THEN s.h || b.h ELSE b.h || s.h END), b.proof || coalesce(s.h, '')
            FROM above AS b LEFT JOIN tops AS s ON s.level = b.level AND s.pos = xor(b.pos, 1)
            WHERE b.n > 1)
        SELECT l.doc_id, l.leaf, a.subroot, (SELECT h FROM tops WHERE n = 1) AS root, sha256(a.proof) AS proof_sha256,
            a.h AS folded_root, a.h = (SELECT h FROM tops WHERE n = 1) AS verified
        FROM above AS a JOIN leaves AS l USING (id) WHERE a.n = 1""",
}
