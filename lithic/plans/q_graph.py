"""Resolve, expand, rank, search: orders, customers, nations and parts as a typed graph."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lithic import vocab
from lithic.operators import communities, retrieval, status, triples
from lithic.plans.catalog import query, read

CALLS, CONTAINS, EXTENDS, REFERS = "code.relationship.calls", "code.structure.contains", "code.relationship.extends", "code.relationship.references"

EDGES_SQL = f"""
edges AS (SELECT 'o' || o_orderkey AS src, '{CALLS}' AS predicate, 'c' || o_custkey AS dst FROM orders UNION ALL SELECT 'c' || c_custkey, '{EXTENDS}', 'n' || c_nationkey FROM customer
  UNION ALL SELECT 's' || s_suppkey, '{REFERS}', 'n' || s_nationkey FROM supplier UNION ALL SELECT 'r' || n_regionkey, '{CONTAINS}', 'n' || n_nationkey FROM nation
  UNION ALL SELECT 'n' || n_nationkey, '{EXTENDS}', 'r' || n_regionkey FROM nation)"""


def key(prefix, col):
    return F.concat(F.lit(prefix), F.col(col))


def edges(spark, d):
    e = lambda t, a, ka, p, b, kb: read(spark, d, t).select(key(a, ka).alias("src"), F.lit(p).alias("predicate"), key(b, kb).alias("dst"))
    return (e("orders", "o", "o_orderkey", CALLS, "c", "o_custkey").unionByName(e("customer", "c", "c_custkey", EXTENDS, "n", "c_nationkey")).unionByName(e("supplier", "s", "s_suppkey", REFERS, "n", "s_nationkey"))
            .unionByName(e("nation", "r", "n_regionkey", CONTAINS, "n", "n_nationkey")).unionByName(e("nation", "n", "n_nationkey", EXTENDS, "r", "n_regionkey")))


ROLES_SQL = "roles(predicate, o, i) AS (VALUES " + ", ".join(f"('{p}', '{o}', '{i}')" for p, o, i in vocab.EDGE_ROLES) + ")"
NEIGHBORS = f"""{EDGES_SQL}, {ROLES_SQL}, seeds AS (SELECT 'c' || c_custkey AS id FROM customer UNION ALL SELECT 'n' || n_nationkey FROM nation),
nb AS (SELECT src AS id, o AS role, dst AS other FROM edges JOIN roles USING (predicate) JOIN seeds ON src = id UNION ALL SELECT dst, i, src FROM edges JOIN roles USING (predicate) JOIN seeds ON dst = id)"""


def seeds(spark, d):
    return read(spark, d, "customer").select(key("c", "c_custkey").alias("id")).unionByName(read(spark, d, "nation").select(key("n", "n_nationkey").alias("id")))


@query("graph_neighbors", f"WITH {NEIGHBORS} SELECT * FROM nb")
def graph_neighbors(spark, d):
    return retrieval.neighbors(seeds(spark, d), edges(spark, d))


@query("relations_top12", f"WITH {NEIGHBORS} SELECT id, role, other, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id, role ORDER BY other) AS r FROM nb) WHERE r <= 12")
def relations_top12(spark, d):
    return retrieval.relations(retrieval.neighbors(seeds(spark, d), edges(spark, d))).withColumn("rank", F.col("rank").cast("long"))


@query("graph_impact", f"""WITH RECURSIVE {EDGES_SQL}, hops AS (SELECT DISTINCT dst, src FROM edges WHERE predicate <> '{CONTAINS}'),
walk AS (SELECT 'r' || r_regionkey AS seed, 'r' || r_regionkey AS id, 0 AS depth FROM region UNION SELECT seed, src, depth + 1 FROM walk JOIN hops ON dst = id WHERE depth < 6)
SELECT seed, id, CAST(min(depth) AS INT) AS depth FROM walk WHERE depth > 0 GROUP BY 1, 2""")
def graph_impact(spark, d):
    return retrieval.impact(read(spark, d, "region").select(key("r", "r_regionkey").alias("id")), edges(spark, d))


@query("graph_paths", f"""WITH RECURSIVE {EDGES_SQL},
w AS (SELECT 'o' || o_orderkey AS "start", 'o' || o_orderkey AS at_node, 'o' || o_orderkey AS path, 0 AS steps FROM orders
  UNION ALL SELECT w.start, e.dst, w.path || '>' || e.dst, w.steps + 1 FROM w JOIN edges e ON e.src = w.at_node WHERE e.predicate <> '{CONTAINS}' AND w.steps < 4)
SELECT w.start, w.path, CAST(w.steps AS INT) AS steps FROM w WHERE w.steps > 0""")
def graph_paths(spark, d):
    starts = read(spark, d, "orders").select(key("o", "o_orderkey").alias("id"))
    return retrieval.paths(starts, edges(spark, d).where(F.col("predicate") != CONTAINS), 4)


@query("edges_live", f"WITH {EDGES_SQL}, ent AS (SELECT 'c' || c_custkey AS id FROM customer WHERE c_acctbal > 0 UNION ALL SELECT 'r' || r_regionkey FROM region) SELECT src, predicate, dst FROM edges WHERE dst IN (SELECT id FROM ent)")
def edges_live(spark, d):
    ent = read(spark, d, "customer").where("c_acctbal > 0").select(key("c", "c_custkey").alias("id")).unionByName(read(spark, d, "region").select(key("r", "r_regionkey").alias("id")))
    return retrieval.live_edges(edges(spark, d), ent).select("src", "predicate", "dst")


@query("name_resolve_folded", "SELECT p_name AS name, CAST(p_partkey AS VARCHAR) AS id, b AS asked, p_name = b AS exact FROM part JOIN (SELECT DISTINCT upper(p_brand) AS brand, upper(min(p_name)) AS b FROM part GROUP BY 1) q ON lower(p_name) = lower(b)")
def name_resolve_folded(spark, d):
    part = read(spark, d, "part")
    asked = part.groupBy(F.upper("p_brand").alias("brand")).agg(F.upper(F.min("p_name")).alias("asked"))
    return retrieval.resolve_names(part.select(F.col("p_name").alias("name"), F.col("p_partkey").cast("string").alias("id")).join(asked.select("asked"), F.lower("name") == F.lower("asked")), F.col("asked"))


@query("name_resolve_exact", "SELECT c_name AS name, CAST(c_custkey AS VARCHAR) AS id, true AS exact FROM customer WHERE c_name = (SELECT max(c_name) FROM customer)")
def name_resolve_exact(spark, d):
    c = read(spark, d, "customer")
    asked = c.agg(F.max("c_name")).first()[0]
    return retrieval.resolve_names(c.select(F.col("c_name").alias("name"), F.col("c_custkey").cast("string").alias("id")), F.lit(f" {asked} "), exact=True)


@query("did_you_mean", "SELECT name, levenshtein(lower(name), 'customr#000000042') AS distance FROM (SELECT DISTINCT c_name AS name FROM customer) ORDER BY 2, 1 LIMIT 3")
def did_you_mean(spark, d):
    return retrieval.did_you_mean(read(spark, d, "customer").select(F.col("c_name").alias("name")), "Customr#000000042").withColumn("distance", F.col("distance").cast("long"))


@query("prefix_scan", "SELECT id, true AS truncated FROM (SELECT 'acme.web.' || source || '.' || doc_id AS id FROM documents) WHERE starts_with(id, 'acme.web.src1') ORDER BY id LIMIT 25")
def prefix_scan(spark, d):
    e = read(spark, d, "documents").select(F.concat(F.lit("acme.web."), F.col("source"), F.lit("."), F.col("doc_id")).alias("id"))
    return retrieval.by_prefix(e, "acme.web.src1", 25)


@query("prefix_scan_whole", """
WITH e AS (SELECT 'acme.web.' || source || '.' || doc_id AS id FROM documents),
m AS (SELECT id, row_number() OVER (ORDER BY id) AS r, count(*) OVER () AS n FROM e WHERE starts_with(id, 'acme.web.src1'))
SELECT id, n > 200000 AS truncated FROM m WHERE r <= 200000""")
def prefix_scan_whole(spark, d):
    e = read(spark, d, "documents").select(F.concat(F.lit("acme.web."), F.col("source"), F.lit("."), F.col("doc_id")).alias("id"))
    return retrieval.by_prefix(e, "acme.web.src1", retrieval.MOST_SCANNED)


TRIPLES_SQL = """t AS (SELECT 'd' || doc_id AS id, 'dc.terms.title' AS predicate FROM documents UNION ALL SELECT 'd' || doc_id, 'code.artifact.exported' FROM documents WHERE n_chars % 2 = 0
  UNION ALL SELECT 'd' || doc_id, 'code.artifact.test' FROM documents WHERE n_chars % 3 = 0 UNION ALL SELECT 'd' || doc_id, 'entity.lifecycle.stale' FROM documents WHERE n_chars % 5 = 0
  UNION ALL SELECT 'd' || doc_id, 'code.doc.comment' FROM documents WHERE n_chars % 7 = 0)"""
SALIENCE_SQL = TRIPLES_SQL + ", w(predicate, weight) AS (VALUES " + ", ".join(f"('{p}', {w})" for p, w in vocab.WEIGHTS) + "), sal AS (SELECT id, greatest(max(weight), 0.0) + least(min(weight), 0.0) AS salience FROM t JOIN w USING (predicate) GROUP BY id)"


def facts(spark, d):
    n = F.col("n_chars")
    return triples.unpivot(read(spark, d, "documents").withColumn("id", key("d", "doc_id")), "id", [
        ("dc.terms.title", F.lit("t"), None), ("code.artifact.exported", F.when(n % 2 == 0, "true"), None), ("code.artifact.test", F.when(n % 3 == 0, "true"), None),
        ("entity.lifecycle.stale", F.when(n % 5 == 0, "x"), None), ("code.doc.comment", F.when(n % 7 == 0, "c"), None)])


@query("salience", f"WITH {SALIENCE_SQL} SELECT id, CAST(salience AS DOUBLE) AS salience FROM sal")
def salience(spark, d):
    return retrieval.salience(facts(spark, d))


@query("rank_score", f"""WITH {SALIENCE_SQL}, s AS (SELECT 'd' || doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS i, source AS label FROM documents)
SELECT id, CAST(round(4.0 * (40 - i) + CASE WHEN label = 'src1' THEN 3.0 WHEN starts_with(label, 'src1') THEN 1.0 ELSE 0.0 END + 1.5 * 6 + 3.0 * coalesce(salience, 0), 6) AS DOUBLE) AS score FROM s LEFT JOIN sal USING (id) WHERE i < 40""")
def rank_score(spark, d):
    top = read(spark, d, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(retrieval.SEEDS)  # the seed list is the feature
    s = top.select(key("d", "doc_id").alias("id"), (F.row_number().over(W.orderBy(F.desc("n_chars"), "doc_id")) - 1).alias("i"), F.col("source").alias("label"))
    depth = s.select("id", F.lit(6).alias("specificity"))
    return retrieval.rank(s.select("id", "i"), "src1", s.select("id", "label"), depth, retrieval.salience(facts(spark, d))).select("id", F.round("score", 6).alias("score"))


BM25_SQL = r"""
w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
st AS (SELECT count(*) AS n, avg(len(w)) AS a FROM w),
tf AS (SELECT doc_id, len(w) AS l, t, len(list_filter(w, lambda x: x = t)) AS f FROM w, (VALUES ('erst'), ('thing'), ('lichen')) q(t)),
df AS (SELECT t, count(*) FILTER (f > 0) AS df FROM tf GROUP BY t),
sc AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * l / a))) AS score FROM tf JOIN df USING (t), st WHERE f > 0 GROUP BY doc_id)
"""


@query("bm25_topk", f"WITH {BM25_SQL} SELECT doc_id, round(score, 6) AS score FROM sc ORDER BY 2 DESC, 1 LIMIT 20")
def bm25_topk(spark, d):
    s = retrieval.bm25(read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), ["erst", "Thing", "lichen"])
    return s.select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(20)


@query("cosine_topk", """
WITH q AS (SELECT vec_id AS query, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query, vec_id AS id, list_dot_product(CAST(embedding AS DOUBLE[]), q) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(q, q))) AS score FROM embeddings, q WHERE vec_id <> query)
SELECT query, id, round(score, 6) AS score, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS r FROM s) WHERE r <= 10""")
def cosine_topk(spark, d):
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return retrieval.cosine(v, v.where("id % 20 = 0"), 10).select("query", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("search_matches", """
WITH m AS (SELECT role AS query, conv_id, turn, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) AS rank, count(*) OVER (PARTITION BY role) AS total FROM conversations)
SELECT query, conv_id, turn, rank, total, total > 25 AS truncated FROM m WHERE rank <= 25""")
def search_matches(spark, d):
    found = read(spark, d, "conversations").select(F.col("role").alias("query"), "conv_id", "turn", F.struct("conv_id", "turn").alias("ord"))
    return retrieval.matches(found).select("query", "conv_id", "turn", F.col("rank").cast("long").alias("rank"), "total", "truncated")


@query("search_fallback", """
WITH g AS (SELECT user_id AS query, event_id FROM events WHERE event_type = 'purchase'), s AS (SELECT user_id AS query, event_id FROM events WHERE event_type = 'view')
SELECT *, 'global_search' AS via FROM g UNION ALL SELECT *, 'global_search_empty_semantic_fallback' FROM s WHERE query NOT IN (SELECT query FROM g)""")
def search_fallback(spark, d):
    e = read(spark, d, "events")
    side = lambda t: e.where(F.col("event_type") == t).select(F.col("user_id").alias("query"), "event_id")
    return retrieval.with_fallback(side("purchase"), side("view"))


@query("disclosure", """SELECT conv_id, turn, CASE WHEN role = 'assistant' AND conv_id % 2 = 0 THEN 'llm_answer' WHEN turn % 3 = 0 THEN 'community_summaries' WHEN length(text) % 5 > 0 THEN 'entities_only' ELSE 'unknown' END AS rung FROM conversations""")
def disclosure(spark, d):
    rung = retrieval.disclosure(F.col("role") == "assistant", F.col("conv_id") % 2 == 0, F.col("turn") % 3 == 0, F.length("text") % 5)
    return read(spark, d, "conversations").select("conv_id", "turn", rung.alias("rung"))


@query("short_values", "SELECT doc_id, CASE WHEN octet_length(encode(text)) <= 160 THEN text ELSE 'cut' END AS value FROM documents")
def short_values(spark, d):
    v = retrieval.short_value(F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.when(v.endswith("…") & (F.octet_length(v) <= 160) & F.col("text").startswith(F.rtrim(F.lit("…"), v)), "cut").otherwise(v).alias("value"))


@query("answer_navigation", """
WITH n AS (SELECT conv_id AS answer, turn, CASE WHEN turn % 2 = 0 THEN 'document' ELSE 'function' END AS kind, CASE WHEN length(text) % 3 = 0 THEN '' ELSE text END AS body FROM conversations),
l AS (SELECT *, sum(CASE WHEN body = '' AND kind = 'document' THEN 0 ELSE 1 END) OVER (PARTITION BY answer) AS l FROM n)
SELECT answer, turn, kind FROM l WHERE NOT (body = '' AND kind = 'document') OR l = 0""")
def answer_navigation(spark, d):
    n = read(spark, d, "conversations").select(F.col("conv_id").alias("answer"), "turn", F.when(F.col("turn") % 2 == 0, "document").otherwise("function").alias("kind"), F.when(F.length("text") % 3 == 0, "").otherwise(F.col("text")).alias("body"))
    return retrieval.without_navigation(n).select("answer", "turn", "kind")


@query("hierarchy_entities", r"""
WITH p AS (SELECT DISTINCT list_filter(string_split(regexp_extract(url, '^[^:/?#]+://([^?#]*)', 1), '/'), lambda x: x <> '') AS p FROM pages),
n AS (SELECT DISTINCT array_to_string(list_slice(p, 1, k), '/') AS node, array_to_string(list_slice(p, 1, k - 1), '/') AS folder, CAST(k - 1 AS INT) AS depth FROM p, generate_series(1, 50) g(k) WHERE k <= len(p))
SELECT folder, depth, CASE WHEN folder = '' THEN NULL ELSE regexp_replace(folder, '/?[^/]*$', '') END AS parent, count(*) AS children FROM n GROUP BY 1, 2""")
def hierarchy_entities(spark, d):
    return triples.hierarchy(read(spark, d, "pages").select(F.regexp_extract("url", "^[^:/?#]+://([^?#]*)", 1).alias("path")))


KINDS = "CASE c_custkey % 5 WHEN 0 THEN 'git' WHEN 1 THEN 'web' WHEN 2 THEN 'golang' WHEN 3 THEN 'config' ELSE 'media' END AS domain, CASE c_custkey % 7 WHEN 0 THEN 'commit' WHEN 1 THEN 'page' WHEN 2 THEN 'function' WHEN 3 THEN 'package' WHEN 4 THEN 'image' WHEN 5 THEN 'chunk' ELSE 'doc' END AS kind"
CLASS_SQL = "m(domain, kind, class) AS (VALUES " + ", ".join(f"({'NULL' if a is None else repr(a)}, '{b}', '{c}')" for a, b, c in vocab.CLASS_OF) + ")"


@query("ontology_stamp", f"""WITH {CLASS_SQL}, e AS (SELECT c_custkey AS id, {KINDS} FROM customer)
SELECT id, e.domain, e.kind, coalesce(a.class, b.class) AS class FROM e LEFT JOIN m a ON a.domain = e.domain AND a.kind = e.kind LEFT JOIN m b ON b.domain IS NULL AND b.kind = e.kind""")
def ontology_stamp(spark, d):
    return triples.stamp_class(read(spark, d, "customer").selectExpr("c_custkey AS id", *KINDS.split(", CASE")[:1], "CASE" + KINDS.split(", CASE")[1]))


@query("ontology_distance", "WITH RECURSIVE up(class, parent) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in vocab.SUBCLASS) + """),
cls AS (SELECT class FROM up UNION SELECT parent FROM up), a(class, anc, s) AS (SELECT class, class, 0 FROM cls UNION ALL SELECT a.class, up.parent, s + 1 FROM a JOIN up ON a.anc = up.class)
SELECT x.class AS a, y.class AS b, CAST(min(x.s + y.s) AS INT) AS distance FROM a x JOIN a y USING (anc) GROUP BY 1, 2""")
def ontology_distance(spark, d):
    c = vocab.classes(spark)
    cls = c.select("class").union(c.select("parent")).distinct()
    pairs = cls.select(F.col("class").alias("a"), F.explode(F.array(*[F.lit(x) for x in sorted({*dict(vocab.SUBCLASS), *dict(vocab.SUBCLASS).values()})])).alias("b"))
    return triples.class_distance(spark, pairs)


@query("community_sizes", "SELECT label AS community, count(*) AS size, count(DISTINCT vec_id % 3) AS systems, round(count(*) / (SELECT count(*) FROM embeddings), 9) AS share FROM embeddings GROUP BY 1")
def community_sizes(spark, d):
    m = read(spark, d, "embeddings").select(F.col("label").alias("community"), F.col("vec_id").alias("id"), (F.col("vec_id") % 3).alias("system"))
    return status.community_sizes(m).withColumn("share", F.round("share", 9))


@query("community_labels")
def community_labels(spark, d):
    # The nation stands for the type prefix, its region for the system that holds it.
    nations = read(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
    ent = read(spark, d, "supplier").select(key("s", "s_suppkey").alias("id"), "s_nationkey").join(nations, "s_nationkey", "left")
    base = edges(spark, d).where("predicate <> 'code.relationship.calls'").select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(1.0).alias("w"))
    return communities.label_propagation(base.unionByName(communities.peers(ent, "s_nationkey", "n_regionkey")))
