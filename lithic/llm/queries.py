"""The thin queries over the operators, with their contracts' columns, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithic.llm import ctw, decontam, exact_dedup, line_dedup, near_dedup, packing, quality, token_counts, toxicity, url_filter
from lithic.llm.common import OWN, fold, table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = exact_dedup.DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}")
    try:
        rows = exact_dedup.dedup_rows(index, table(spark, sf_dir, "documents"))
    finally:
        index.drop()
    return rows.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_decisions(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_lines", F.size("dropped").cast("long").alias("n_dropped"), "dropped")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = quality.with_sites(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages"))
    out = quality.quality(docs, table(spark, sf_dir, "labels"), host=OWN + "host", path=OWN + "path")
    return out.select(F.col("id").alias("doc_id"), (fold(F.col("id")) % 5 == 0).alias("held_out"), "text_score", "host_mean", "path_mean", "score",
                      F.col("kept").cast("int").alias("predicted"), "kept")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")


#: The rules of the contract: (host, path, verdict).
URL_RULES = [url_filter.Rule("net", "/", "block"), url_filter.Rule("example.net", "/en/", "allow"), url_filter.Rule("example.com", "/de/", "block"), url_filter.Rule("org", "/fr/", "allow")]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), URL_RULES)
    return judged.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


OP7_SQL = r"""
WITH p AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
y AS (
  SELECT doc_id, max(CASE WHEN coalesce(quality = 0 OR toxic = 1, false) THEN 1 ELSE 0 END) AS y
  FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
h AS (
  SELECT host, count(y) AS n, coalesce(sum(y), 0) AS b, string_split(regexp_replace(host, ':[0-9]*$', ''), '.') AS parts,
    regexp_replace(host, ':[0-9]*$', '') AS bare
  FROM p LEFT JOIN y ON page_id = doc_id GROUP BY host),
s AS (
  SELECT *, regexp_matches(bare, '^[0-9.]+$|^\[') AS address,
    CASE WHEN len(parts) >= 3 AND length(parts[-1]) = 2 AND parts[-2] IN ('co', 'com', 'org', 'net', 'gov', 'edu', 'ac') THEN 2 ELSE 1 END AS k
  FROM h),
d AS (
  SELECT host, n, b,
    CASE WHEN address THEN bare ELSE array_to_string(list_slice(parts, greatest(len(parts) - k + 1, 1), len(parts)), '.') END AS suffix,
    CASE WHEN address THEN bare ELSE array_to_string(list_slice(parts, greatest(len(parts) - k, 1), len(parts)), '.') END AS domain
  FROM s),
g AS (SELECT (sum(b) + 1.0) / (sum(n) + 2.0) AS m FROM d),
sm AS (SELECT suffix, (sum(b) + 20.0 * any_value(m)) / (sum(n) + 20.0) AS ms FROM d, g GROUP BY suffix),
dm AS (SELECT domain, suffix, (sum(b) + 20.0 * any_value(ms)) / (sum(n) + 20.0) AS md FROM d JOIN sm USING (suffix) GROUP BY domain, suffix),
hm AS (SELECT host, n, (b + 20.0 * md) / (n + 20.0) AS m FROM d JOIN dm USING (domain, suffix)),
r AS (
  SELECT page_id, host, path, m - 1.645 * sqrt(m * (1 - m) / (n + 21.0)) > 0.5 AS bad,
    CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM p JOIN hm USING (host))
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN bad THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        F.col("id").alias("doc_id"), (fold(F.col("id")) % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "contaminated", F.transform("matches", lambda m: m["item"]).alias("item_ids"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents),
r AS (
  SELECT doc_id, h, row_number() OVER (PARTITION BY h ORDER BY n DESC, doc_id NULLS LAST) AS k,
         first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id NULLS LAST) AS keep_id,
         count(*) OVER (PARTITION BY h) AS group_size
  FROM d)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, k = 1 AS kept, h AS text_sha256 FROM r
"""

QUERIES = {
    "op1_packing": op1_packing,
    "op2_line_dedup": op2_line_dedup,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_token_counts": op5_token_counts,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_url_filter": op7_url_filter,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_decontamination": op10_decontamination,
}

ORACLE_SQL = {
    "op7_url_filter": OP7_SQL,
    "op8_exact_dedup": OP8_SQL,
}
