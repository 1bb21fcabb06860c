"""Identity, URLs, triples, bodies, passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from lithic.functions import ids, text
from lithic.operators import split, triples
from lithic.plans.catalog import query, read

# ---- SQL macros of the oracle, written out ---------------------------------------------------------------------------


def s_collapsed(x: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace({x}, '[^A-Za-z0-9_-]', '-', 'g'), '-{{2,}}', '-', 'g'), '^[^A-Za-z0-9]+|[^A-Za-z0-9]+$', '', 'g')"


def s_instance(x: str) -> str:
    out = s_collapsed(x)
    return f"CASE WHEN {out} = '' THEN left(sha256({x}), 8) WHEN length({out}) > 60 THEN regexp_replace(left({out}, 51), '[^A-Za-z0-9]+$', '') || '-' || left(sha256({x}), 8) ELSE {out} END"


def s_slug(x: str) -> str:
    return f"CASE WHEN length({s_collapsed(x)}) > 80 THEN left({s_collapsed(x)}, 73) || '-' || left(sha256({s_collapsed(x)}), 6) ELSE {s_collapsed(x)} END"


URL_FLAT = r"regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^?#]*)', 1), '\.git$', '')"


@query("id_system_slug", f"SELECT page_id AS id, {s_slug(URL_FLAT)} AS slug FROM pages UNION ALL SELECT doc_id AS id, {s_slug('source')} AS slug FROM documents")
def id_system_slug(spark, d):
    one = read(spark, d, "pages").select(F.col("page_id").alias("id"), ids.system_slug(F.col("url")).alias("slug"))
    return one.unionByName(read(spark, d, "documents").select(F.col("doc_id").alias("id"), ids.system_slug(F.col("source")).alias("slug")))


@query("id_sanitize_instance", f"SELECT doc_id, {s_instance('text')} AS instance FROM documents")
def id_sanitize_instance(spark, d):
    return read(spark, d, "documents").select("doc_id", ids.sanitize_instance(F.col("text")).alias("instance"))


@query("id_sanitize_segment", """
WITH x AS (SELECT p_partkey, p_name AS s, regexp_replace(regexp_replace(p_name, '[^A-Za-z0-9_-]', '-', 'g'), '^[^A-Za-z0-9]+', '') AS o FROM part)
SELECT p_partkey, CASE WHEN o = '' THEN left(sha256(s), 8) WHEN o = s THEN o ELSE o || '-' || left(sha256(s), 8) END AS segment FROM x""")
def id_sanitize_segment(spark, d):
    return read(spark, d, "part").select("p_partkey", ids.sanitize_segment(F.col("p_name")).alias("segment"))


@query("id_build", r"""
WITH x AS (SELECT doc_id, 'acme.corpus.web.' || source || '.doc' AS head, regexp_replace(text, '[^A-Za-z0-9]+', '-', 'g') AS i FROM documents),
y AS (SELECT *, 255 - length(head) AS room FROM x)
SELECT doc_id, head || '.' || CASE WHEN length(head) + 1 + length(i) <= 256 THEN i
  ELSE regexp_replace(left(i, room - 9), '[^A-Za-z0-9]+$', '') || '-' || left(sha256(i), 8) END AS id FROM y""")
def id_build(spark, d):
    i = F.regexp_replace("text", "[^A-Za-z0-9]+", "-")
    return read(spark, d, "documents").select("doc_id", ids.build(F.lit("acme"), F.lit("web"), F.col("source"), F.lit("doc"), i).alias("id"))


@query("id_parts", r"""
WITH x AS (SELECT c_custkey, lower(c_mktsegment) || '.corpus.config.' || replace(c_name, '#', '-') || '.package.k' || c_custkey AS id FROM customer)
SELECT c_custkey, split_part(id, '.', 1) AS org, split_part(id, '.', 3) AS domain, split_part(id, '.', 4) AS system, split_part(id, '.', 5) AS kind,
  regexp_matches(id, '^([A-Za-z0-9][A-Za-z0-9_-]*\.){5}[A-Za-z0-9][A-Za-z0-9_-]*$') AS valid FROM x""")
def id_parts(spark, d):
    id_ = F.concat_ws(".", F.lower("c_mktsegment"), F.lit("corpus"), F.lit("config"), F.replace(F.col("c_name"), F.lit("#"), F.lit("-")), F.lit("package"), F.concat(F.lit("k"), F.col("c_custkey")))
    x = read(spark, d, "customer").select("c_custkey", id_.alias("id"))
    return x.select("c_custkey", ids.org_of(F.col("id")).alias("org"), ids.part(F.col("id"), 3).alias("domain"), ids.part(F.col("id"), 4).alias("system"), ids.part(F.col("id"), 5).alias("kind"), ids.valid_id(F.col("id")).alias("valid"))


@query("id_versioned_system", f"SELECT doc_id, {s_slug(s_slug('source') + chr(124) * 2 + chr(39) + '-' + chr(39) + chr(124) * 2 + 'lang')} AS system FROM documents")
def id_versioned_system(spark, d):
    return read(spark, d, "documents").select("doc_id", ids.versioned_system(F.col("source"), F.col("lang")).alias("system"))


@query("id_slugify", r"""SELECT s_suppkey, regexp_replace(regexp_replace(regexp_replace(lower(s_name), '[^a-z0-9-]', '-', 'g'), '-{2,}', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM supplier""")
def id_slugify(spark, d):
    return read(spark, d, "supplier").select("s_suppkey", ids.slugify(F.col("s_name")).alias("slug"))


@query("url_canonicalize", r"""
WITH x AS (SELECT page_id, lower(regexp_extract(url, '^(.*?)://', 1)) AS s, regexp_extract(url, '://([^?#]*)', 1) AS r FROM pages)
SELECT page_id, s || '://' || lower(regexp_extract(r, '^([^/]*)', 1)) || regexp_replace(regexp_extract(r, '^[^/]*(.*)$', 1), '/+$', '') AS canonical FROM x""")
def url_canonicalize(spark, d):
    return read(spark, d, "pages").select("page_id", ids.canonical_url(F.col("url")).alias("canonical"))


PAGE_SQL = r"""
x AS (SELECT *, lower(regexp_extract(url, '^([^:/?#]+)://', 1)) AS s, lower(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)) AS h,
  regexp_replace(regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS p, regexp_extract(url, '^[^?#]*(\?[^#]+)', 1) AS q FROM pages),
pg AS (SELECT page_id, url, html, CASE WHEN h = '' THEN 'unknown' ELSE replace(h, '.', '-') END AS system, left(sha256(s || '://' || h || CASE WHEN p = '' THEN '/' ELSE p END || q), 8) AS instance FROM x)
"""


@query("url_page_entity", f"WITH {PAGE_SQL} SELECT page_id, system, instance, 'acme.corpus.web.' || system || '.page.' || instance AS id FROM pg")
def url_page_entity(spark, d):
    u = F.col("url")
    x = read(spark, d, "pages").select("page_id", ids.page_system(u).alias("system"), ids.page_instance(u).alias("instance"))
    return x.withColumn("id", ids.build(F.lit("acme"), F.lit("web"), F.col("system"), F.lit("page"), F.col("instance")))


@query("url_legacy_slug", r"""
WITH x AS (SELECT page_id, regexp_extract(url, '^[^:/?#]+://([^/?#:]*)', 1) AS h, regexp_replace(regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '^/+|/+$', '', 'g') AS p FROM pages),
y AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(replace(h, '.', '-') || CASE WHEN p <> '' THEN '-' || p ELSE '' END), '[^a-z0-9-]', '-', 'g'), '-{2,}', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM x)
SELECT page_id, CASE WHEN length(s) > 80 THEN regexp_replace(left(s, 80), '-+$', '') ELSE s END AS slug FROM y""")
def url_legacy_slug(spark, d):
    return read(spark, d, "pages").select("page_id", ids.legacy_page_slug(F.col("url")).alias("slug"))


@query("url_domain_counts", r"SELECT lower(regexp_extract(url, '^[^:/?#]+://([^/?#:]*)', 1)) AS domain, count(*) AS pages, count(DISTINCT url) AS urls FROM pages GROUP BY 1")
def url_domain_counts(spark, d):
    return read(spark, d, "pages").groupBy(F.lower(ids.host_name(F.col("url"))).alias("domain")).agg(F.count("*").alias("pages"), F.count_distinct("url").alias("urls"))


@query("url_validate", r"""
WITH u AS (SELECT page_id, url FROM pages UNION ALL SELECT * FROM (VALUES (-1, 'https://localhost/x'), (-2, 'https://10.1.2.3/'), (-3, 'https://172.20.0.1/'), (-4, 'https://172.40.0.1/'), (-5, 'https://a.internal/'), (-6, 'https://100.64.1.1/'), (-7, 'https://8.8.8.8/')) t(page_id, url)),
h AS (SELECT page_id, url, regexp_replace(lower(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)), ':[0-9]*$', '') AS h FROM u)
SELECT page_id, starts_with(url, 'https://') AND h <> 'localhost' AND NOT h LIKE '%.local' AND NOT h LIKE '%.internal'
  AND NOT regexp_matches(h, '^(10|127)(\.[0-9]{1,3}){3}$|^192\.168(\.[0-9]{1,3}){2}$|^169\.254(\.[0-9]{1,3}){2}$|^172\.(1[6-9]|2[0-9]|3[01])(\.[0-9]{1,3}){2}$|^100\.(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])(\.[0-9]{1,3}){2}$') AS safe FROM h""")
def url_validate(spark, d):
    more = [(-1, "https://localhost/x"), (-2, "https://10.1.2.3/"), (-3, "https://172.20.0.1/"), (-4, "https://172.40.0.1/"), (-5, "https://a.internal/"), (-6, "https://100.64.1.1/"), (-7, "https://8.8.8.8/")]
    u = read(spark, d, "pages").select("page_id", "url").unionByName(spark.createDataFrame(more, "page_id long, url string"))
    return u.select("page_id", ids.safe_url(F.col("url")).alias("safe"))


@query("page_triples", f"""WITH {PAGE_SQL},
t AS (SELECT 'acme.corpus.web.' || system || '.page.' || instance AS subject, url, system, sha256(html) AS h FROM pg)
SELECT subject, 0 AS ord, 'source.web.type' AS predicate, 'web' AS object FROM t UNION ALL SELECT subject, 1, 'source.web.url', url FROM t
UNION ALL SELECT subject, 2, 'source.web.content-type', 'text/html' FROM t UNION ALL SELECT subject, 3, 'source.web.domain', system FROM t
UNION ALL SELECT subject, 5, 'source.web.content-hash', h FROM t""")
def page_triples(spark, d):
    u = F.col("url")
    p = read(spark, d, "pages").select(ids.build(F.lit("acme"), F.lit("web"), ids.page_system(u), F.lit("page"), ids.page_instance(u)).alias("id"), "url", F.lit("text/html").alias("content_type"),
                                       ids.page_system(u).alias("system"), F.lit("").alias("etag"), F.sha2("html", 256).alias("hash"))
    return triples.page_triples(p).drop("datatype")


def doc_entities(spark, d):
    path = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return read(spark, d, "documents").select("doc_id", "text", path.alias("path"), F.lit("text/plain").alias("mime"), F.sha2("text", 256).alias("hash"),
                                              ids.build(F.lit("acme"), F.lit("web"), ids.system_slug(F.col("source")), F.lit("doc"), ids.sanitize_instance(path)).alias("id"), F.col("doc_id").cast("string").alias("title"))


@query("doc_triples", """
WITH t AS (SELECT 'acme.corpus.web.' || source || '.doc.' || source || '-' || doc_id || '-txt' AS subject, source || '/' || doc_id || '.txt' AS path, sha256(text) AS h, CAST(doc_id AS VARCHAR) AS title FROM documents)
SELECT subject, 0 AS ord, 'source.doc.type' AS predicate, 'document' AS object FROM t UNION ALL SELECT subject, 1, 'source.doc.file-path', path FROM t
UNION ALL SELECT subject, 2, 'source.doc.mime-type', 'text/plain' FROM t UNION ALL SELECT subject, 3, 'source.doc.file-hash', h FROM t
UNION ALL SELECT subject, 4, 'dc.terms.title', title FROM t UNION ALL SELECT subject, 5, 'source.doc.chunk-count', '1' FROM t
UNION ALL SELECT subject, 6, 'entity.role.navigational', 'document' FROM t""")
def doc_triples(spark, d):
    return triples.document_triples(doc_entities(spark, d).withColumn("chunks", F.lit(1))).drop("datatype")


@query("body_store_dedup", "SELECT 'doc:' || sha256(text) AS key, octet_length(encode(text)) AS size, count(*) AS copies, 'text/plain' AS content_type FROM documents WHERE text <> '' GROUP BY 1, 2")
def body_store_dedup(spark, d):
    return triples.bodies(read(spark, d, "documents"), "text", "doc", "text/plain")


@query("body_line_slice", r"""
WITH x AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
SELECT doc_id, sha256(array_to_string(list_slice(l, 2, least(4, len(l))), chr(10))) AS key, len(l) AS n_lines FROM x""")
def body_line_slice(spark, d):
    t = F.col("text")
    return read(spark, d, "documents").select("doc_id", F.sha2(triples.body_slice(t, F.lit(2), F.lit(4)), 256).alias("key"), F.size(F.split(t, "\n")).cast("long").alias("n_lines"))


@query("section_anchor", r"""SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(lower(p_name || ' & ' || p_type), '[ _]', '-', 'g'), '[^a-z0-9-]', '', 'g'), '^-+|-+$', '', 'g') AS anchor FROM part""")
def section_anchor(spark, d):
    return read(spark, d, "part").select("p_partkey", text.section_anchor(F.concat_ws(" & ", "p_name", "p_type")).alias("anchor"))


@query("split_passages")
def split_passages(spark, d):
    p = split.passages(read(spark, d, "documents"), "doc_id", "text")
    return p.select(F.col("id").alias("doc_id"), "ordinal", "heading", F.array_join("heading_path", " § ").alias("path"), "start", "end", F.sha2("body", 256).alias("body_key"))


@query("split_tiling", "SELECT doc_id, octet_length(encode(text)) AS bytes, sha256(text) AS joined FROM documents WHERE text <> ''")
def split_tiling(spark, d):
    p = split.passages(read(spark, d, "documents"), "doc_id", "text")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "body"))), lambda x: x["body"]), "")
    return p.groupBy(F.col("id").alias("doc_id")).agg(F.sum(F.col("end") - F.col("start")).alias("bytes"), F.sha2(whole, 256).alias("joined"))


@query("passage_titles")
def passage_titles(spark, d):
    p = split.passages(read(spark, d, "documents"), "doc_id", "text")
    return p.select(F.col("id").alias("doc_id"), "ordinal", text.passage_title(F.col("id").cast("string"), F.col("heading_path"), F.col("ordinal")).alias("title"))


@query("passage_triples")
def passage_triples(spark, d):
    docs = doc_entities(spark, d)
    p = split.passages(docs.select("doc_id", "text"), "doc_id", "text").join(docs.drop("text", "hash").withColumnRenamed("id", "parent"), F.col("doc_id") == F.col("id")).drop("id")
    chunk = ids.build(F.lit("acme"), F.lit("web"), ids.part(F.col("parent"), 4), F.lit("chunk"), ids.chunk_instance(F.col("path"), F.col("ordinal")))
    title = text.passage_title(F.col("title"), F.col("heading_path"), F.col("ordinal"))
    rows = p.select(chunk.alias("id"), "parent", "path", "mime", title.alias("title"), "ordinal", F.col("heading").alias("section"), F.concat(F.lit("doc:"), F.sha2("body", 256)).alias("body_key"))
    return triples.passage_triples(rows)


@query("validate_entities", r"""
WITH e AS (SELECT s_suppkey, 'acme.corpus.config.' || CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE 'n' || s_nationkey END || '.package.' || CASE WHEN s_suppkey % 7 = 0 THEN s_name || ' x' ELSE 'k' || s_suppkey END AS id,
  CASE WHEN s_suppkey % 3 = 0 THEN 'loud' WHEN s_suppkey % 11 = 0 THEN NULL ELSE 'content' END AS profile FROM supplier)
SELECT s_suppkey, CASE WHEN NOT regexp_matches(id, '^[\x21-\x7E]+$') OR regexp_matches(id, '[ */>\\]') THEN 'illegal key'
  WHEN NOT regexp_matches(id, '^([A-Za-z0-9][A-Za-z0-9_-]*\.){5}[A-Za-z0-9][A-Za-z0-9_-]*$') THEN 'malformed id'
  WHEN profile IS NULL THEN 'no profile' WHEN profile NOT IN ('content', 'control', 'signal', 'trace') THEN 'unknown profile' END AS reason FROM e""")
def validate_entities(spark, d):
    k = F.col("s_suppkey")
    id_ = F.concat(F.lit("acme.corpus.config."), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("n"), F.col("s_nationkey"))), F.lit(".package."), F.when(k % 7 == 0, F.concat(F.col("s_name"), F.lit(" x"))).otherwise(F.concat(F.lit("k"), k)))
    profile = F.when(k % 3 == 0, "loud").when(k % 11 == 0, F.lit(None)).otherwise("content")
    e = read(spark, d, "supplier").select("s_suppkey", id_.alias("id"), id_.alias("subject"), profile.alias("profile"))
    return triples.validate(e).select("s_suppkey", "reason")
