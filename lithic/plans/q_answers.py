"""Answers, lifecycle, sinks, streams and resolution over the driver's tables, each with rows on both sides."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lithic import sinks
from lithic.operators import answers, resolve, versions
from lithic.operators.retrieval import _shared
from lithic.plans.catalog import query, read
from lithic.streaming import changes

# ---- nodes and the graph facet --------------------------------------------------------------------------------------

S_FACTS = """t AS (SELECT 'p' || p_partkey AS subject, unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS ord, unnest(['dc.terms.title', 'dc.terms.title', 'code.artifact.type', 'code.artifact.path', 'code.metric.start-line', 'code.metric.end-line', 'code.body.store', 'code.body.key']) AS predicate,
  unnest([p_name, 'second', 'function', 'src/' || p_brand || '.go', CAST(p_size AS VARCHAR), CAST(p_size + 9 AS VARCHAR), CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'objectstore' END, 'code:' || sha256(p_type)]) AS object FROM part)"""


def facts(spark, d):
    p = read(spark, d, "part")
    rows = [("dc.terms.title", F.col("p_name")), ("dc.terms.title", F.lit("second")), ("code.artifact.type", F.lit("function")), ("code.artifact.path", F.concat(F.lit("src/"), "p_brand", F.lit(".go"))), ("code.metric.start-line", F.col("p_size").cast("string")),
            ("code.metric.end-line", (F.col("p_size") + 9).cast("string")), ("code.body.store", F.when(F.col("p_partkey") % 5 == 0, "").otherwise("objectstore")), ("code.body.key", F.concat(F.lit("code:"), F.sha2("p_type", 256)))]
    return p.select(F.concat(F.lit("p"), "p_partkey").alias("subject"), F.inline(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(a).alias("predicate"), b.alias("object")) for i, (a, b) in enumerate(rows)])))


@query("code_nodes", """SELECT 'p' || p_partkey AS id, p_name AS label, 'function' AS kind, 'src/' || p_brand || '.go' AS path, p_size AS first, p_size + 9 AS last, '' AS fragment,
CASE WHEN p_partkey % 5 > 0 THEN 'code:' || sha256(p_type) END AS key, CASE WHEN p_partkey % 5 > 0 AND p_type <> 'ECONOMY' THEN 'body of ' || p_type END AS body FROM part""")
def code_nodes(spark, d):
    bodies = read(spark, d, "part").where("p_type <> 'ECONOMY'").select("p_type").distinct().select(F.concat(F.lit("code:"), F.sha2("p_type", 256)).alias("key"), F.concat(F.lit("body of "), "p_type").alias("body"))
    return answers.nodes(facts(spark, d), "code", bodies)


@query("doc_nodes", """SELECT 'd' || doc_id AS id, source AS label, 'passage' AS kind, source || '/' || doc_id AS path, 0 AS first, 0 AS last, 'part-' || doc_id || '-of-' || lang AS fragment, CAST(NULL AS VARCHAR) AS key FROM documents""")
def doc_nodes(spark, d):
    rows = [("dc.terms.title", F.col("source")), ("source.doc.type", F.lit("passage")), ("source.doc.file-path", F.concat_ws("/", "source", "doc_id")), ("source.doc.section", F.concat(F.lit("Part "), "doc_id", F.lit(" of_"), "lang", F.lit("?"))), ("source.doc.body-key", F.lit("k"))]
    t = read(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("subject"), F.inline(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(a).alias("predicate"), b.cast("string").alias("object")) for i, (a, b) in enumerate(rows)])))
    return answers.nodes(t, "docs")


@query("graph_facet_nodes", f"""WITH {S_FACTS}, i AS (SELECT 'p' || p_partkey AS id FROM part WHERE p_partkey % 3 = 0 UNION SELECT 'none')
SELECT id, coalesce(string_agg(predicate || '=' || object, ';' ORDER BY ord) FILTER (predicate <> 'code.artifact.type'), '') AS facts FROM i LEFT JOIN t ON id = subject GROUP BY id""")
def graph_facet_nodes(spark, d):
    ids = read(spark, d, "part").where("p_partkey % 3 = 0").select(F.concat(F.lit("p"), "p_partkey").alias("id")).union(spark.createDataFrame([("none",)], "id string"))
    return answers.graph_nodes(ids, facts(spark, d), ["code.artifact.type"]).select("id", F.array_join("facts", ";").alias("facts"))


@query("graph_facet_edges", """WITH e AS (SELECT DISTINCT 'o' || l_orderkey AS src, 'code.relationship.calls' AS predicate, 'p' || l_partkey AS dst FROM lineitem), i AS (SELECT 'o' || o_orderkey AS id FROM orders WHERE o_orderkey % 50 = 0 UNION SELECT 'p' || p_partkey FROM part WHERE p_partkey % 20 = 0)
SELECT src, predicate, dst, CASE WHEN src IN (SELECT id FROM i) AND dst IN (SELECT id FROM i) THEN 'both' WHEN src IN (SELECT id FROM i) THEN 'out' ELSE 'in' END AS direction FROM e WHERE src IN (SELECT id FROM i) OR dst IN (SELECT id FROM i)""")
def graph_facet_edges(spark, d):
    e = read(spark, d, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("src"), F.lit("code.relationship.calls").alias("predicate"), F.concat(F.lit("p"), "l_partkey").alias("dst")).distinct()
    ids = read(spark, d, "orders").where("o_orderkey % 50 = 0").select(F.concat(F.lit("o"), "o_orderkey").alias("id")).union(read(spark, d, "part").where("p_partkey % 20 = 0").select(F.concat(F.lit("p"), "p_partkey")))
    return answers.graph_edges(ids, e)


# ---- rendered values ------------------------------------------------------------------------------------------------

@query("scalar_rendering", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN CASE WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE CAST(value AS VARCHAR) END WHEN 2 THEN CASE WHEN event_id % 8 = 2 THEN 'true' ELSE 'false' END ELSE '' END AS shown,
CASE WHEN event_id % 2 = 0 THEN event_type ELSE '' END AS segment FROM events""")
def scalar_rendering(spark, d):
    k = F.col("event_id")
    value = F.when(k % 4 == 0, F.col("event_type")).when(k % 4 == 1, F.col("value").cast("string")).when(k % 4 == 2, F.when(k % 8 == 2, "true").otherwise("false")).otherwise(F.col("props"))
    kind = F.when(k % 4 == 0, "string").when(k % 4 == 1, "number").when(k % 4 == 2, "boolean").otherwise("object")
    id_ = F.when(k % 2 == 0, F.concat(F.lit("a.b.c.d."), "event_type", F.lit(".x"))).otherwise("a.b.c.d")
    return read(spark, d, "events").select(k, answers.scalar(value, kind).alias("shown"), answers.type_segment(id_).alias("segment"))


@query("match_properties", f"""WITH {S_FACTS}, a AS (SELECT unnest(['code.artifact.path', 'code.body.store', 'dc.terms.title', 'code.metric.end-line']) AS predicate, unnest([0, 1, 2, 3]) AS place),
o AS (SELECT subject, place, predicate, arg_min(object, ord) AS value FROM t JOIN a USING (predicate) WHERE object <> '' GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY place) AS k FROM o)
SELECT subject, place, predicate, value FROM r WHERE k <= 3""")
def match_properties(spark, d):
    return answers.properties(facts(spark, d), ["code.artifact.path", "code.body.store", "dc.terms.title", "code.metric.end-line"], 3)


@query("title_lookup", "SELECT 'p' || p_partkey AS subject, p_name AS title FROM part")
def title_lookup(spark, d):
    return answers.titles(facts(spark, d))


@query("disclosure_notes", """WITH r AS (SELECT event_id, event_id % 11 > 0 AS readable, event_id % 3 > 0 AS backed, event_id % 4 = 0 AS has_model, event_id % 4 < 2 AS has_answer, event_id % 5 = 0 AS degraded FROM events),
s AS (SELECT *, CASE WHEN NOT readable THEN 'none' WHEN has_model THEN 'llm' WHEN has_answer THEN 'template' ELSE 'none' END AS answer_source FROM r)
SELECT event_id, answer_source, CASE WHEN NOT readable THEN 'unknown' WHEN answer_source = 'llm' THEN 'llm_answer' WHEN backed THEN 'community_summaries' ELSE 'entities_only' END AS rung,
CASE WHEN NOT readable THEN 'The retrieval path is unknown: the response couldn''t be read, so the answer is unattributed.'
ELSE CASE WHEN backed THEN 'Drew on community summaries. ' ELSE 'Did not draw on community summaries. ' END || CASE answer_source WHEN 'llm' THEN 'The answer was written by m1.' WHEN 'template' THEN 'The answer is the fixed template.' ELSE 'No answer was written.' END
  || CASE WHEN NOT degraded THEN '' WHEN event_id % 2 = 0 THEN ' The results come from a semantic fallback.' ELSE ' The synthesis was degraded: slow.' END END AS note FROM s""")
def disclosure_notes(spark, d):
    k = F.col("event_id")
    rows = read(spark, d, "events").select(k, (k % 11 > 0).alias("readable"), (k % 3).alias("summaries"), F.when(k % 4 < 2, "text").alias("answer"), F.when(k % 4 == 0, "m1").alias("model"), (k % 5 == 0).alias("degraded"), F.when(k % 2 == 0, answers.FALLBACK).otherwise("slow").alias("reason"))
    return answers.disclosed(rows).select("event_id", "answer_source", "rung", "note")


# ---- schema, contract, capabilities ---------------------------------------------------------------------------------

@query("predicate_schema", """WITH p AS (SELECT DISTINCT CASE p_partkey % 6 WHEN 0 THEN 'code.relationship.r' WHEN 1 THEN 'code.metric.m' WHEN 2 THEN 'source.git.commit-' WHEN 3 THEN 'source.media.f' WHEN 4 THEN 'source.doc.deep.structure.' ELSE 'other.x.' END || p_size AS name, CASE WHEN p_partkey % 6 = 1 THEN 'int' END AS data_type FROM part
UNION SELECT * FROM (VALUES ('code.artifact.path', NULL), ('dc.terms.title', 'string'), ('source.media.keyframe-of', 'entity_id'), ('source.doc.content', 'string')) v(name, data_type)),
x AS (SELECT * FROM (VALUES ('ast', 'code.'), ('ast', 'dc.'), ('ast', 'agentic.'), ('git', 'source.git.'), ('docs', 'source.doc.'), ('video', 'source.media.'), ('audio', 'source.media.')) v(source_type, prefix))
SELECT DISTINCT source_type, name, coalesce(data_type, 'string') AS data_type, CASE WHEN name = 'code.artifact.path' THEN 'location' WHEN name = 'dc.terms.title' THEN 'identity' WHEN name = 'source.doc.content' THEN 'content' WHEN name = 'source.media.keyframe-of' OR contains(name, '.relationship.') OR contains(name, '.structure.') THEN 'relationship'
 WHEN contains(name, '.metric.') THEN 'metric' ELSE 'metadata' END AS role FROM p JOIN x ON starts_with(name, prefix)""")
def predicate_schema(spark, d):
    k = F.col("p_partkey") % 6
    head = F.when(k == 0, "code.relationship.r").when(k == 1, "code.metric.m").when(k == 2, "source.git.commit-").when(k == 3, "source.media.f").when(k == 4, "source.doc.deep.structure.").otherwise("other.x.")
    p = read(spark, d, "part").select(F.concat(head, "p_size").alias("name"), F.when(k == 1, "int").alias("data_type")).distinct()
    more = spark.createDataFrame([("code.artifact.path", None), ("dc.terms.title", "string"), ("source.media.keyframe-of", "entity_id"), ("source.doc.content", "string")], "name string, data_type string")
    return answers.predicate_schema(p.unionByName(more), ["ast", "git", "docs", "video", "audio", "ftp"])


@query("contract_listing", """WITH p AS (SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN 'code.x.' WHEN p_partkey % 3 = 1 THEN 'source.y.' ELSE 'entity.z.' END || p_size AS name FROM part)
SELECT 'source' AS group_name, name AS predicate FROM p WHERE starts_with(name, 'code.') OR starts_with(name, 'source.')
UNION SELECT 'source', unnest(['agentic.capability.name', 'agentic.capability.description', 'agentic.capability.tools', 'agentic.capability.inputs', 'agentic.capability.outputs', 'dc.terms.title', 'dc.terms.created', 'dc.terms.modified']) UNION SELECT 'lifecycle', 'entity.lifecycle.stale'""")
def contract_listing(spark, d):
    k = F.col("p_partkey") % 3
    return answers.contract(read(spark, d, "part").select(F.concat(F.when(k == 0, "code.x.").when(k == 1, "source.y.").otherwise("entity.z."), "p_size").alias("name")).distinct())


@query("capability_document", """WITH c AS (SELECT user_id % 37 AS capability, user_id % 37 > 4 AS supported, value > 20 AS healthy, event_type = 'error' AS required FROM events)
SELECT capability, CASE WHEN NOT bool_or(supported) THEN 'unsupported' WHEN bool_and(NOT (required AND supported) OR healthy) THEN 'ready' ELSE 'not_ready' END AS status FROM c GROUP BY 1""")
def capability_document(spark, d):
    return answers.capabilities(read(spark, d, "events").select((F.col("user_id") % 37).alias("capability"), (F.col("user_id") % 37 > 4).alias("supported"), (F.col("value") > 20).alias("healthy"), (F.col("event_type") == "error").alias("required")))


@query("grep_arm", r"""WITH q AS (SELECT item_id AS question, lower(text) AS query FROM benchmark WHERE item_id % 10 = 0),
t AS (SELECT DISTINCT question, term FROM (SELECT question, unnest(regexp_split_to_array(query, '[^a-z0-9_]+')) AS term FROM q) WHERE term <> '' AND term NOT IN ('a', 'an', 'and', 'are', 'as', 'at', 'be', 'by', 'for', 'from', 'how', 'in', 'is', 'it', 'of', 'on', 'or', 'that', 'the', 'to', 'what', 'when', 'where', 'which', 'who', 'why', 'with')),
f AS (SELECT conv_id || '-' || turn AS file, lower(text) AS text, octet_length(encode(text)) AS bytes FROM conversations),
h AS (SELECT question, file, bytes, term, (length(text) - length(replace(text, term, ''))) // length(term) AS n FROM f JOIN t ON contains(text, term)),
g AS (SELECT question, file, bytes, sum(n) AS n, list(term) AS terms FROM h GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY n DESC, file) AS rank FROM g), a AS (SELECT question, count(DISTINCT term) AS every FROM h GROUP BY 1),
s AS (SELECT r.*, every, coalesce(len(list_distinct(flatten(list(terms) OVER (PARTITION BY question ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))), 0) AS seen FROM r JOIN a USING (question) WHERE rank <= 5)
SELECT question, file, CAST(rank AS INTEGER) AS rank, bytes FROM s WHERE seen < every""")
def grep_arm(spark, d):
    q = read(spark, d, "benchmark").where("item_id % 10 = 0").select(F.col("item_id").alias("question"), F.col("text").alias("query"))
    return answers.read_files(q, read(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("file"), "text"))


# ---- lifecycle ------------------------------------------------------------------------------------------------------

S_SCOPE = "e AS (SELECT CASE WHEN p_partkey % 4 = 0 THEN 'other' ELSE 'acme' END || '.corpus.golang.s' || (p_partkey % 6) || '.function.f' || p_partkey AS id, p_partkey % 5 = 0 AS marked FROM part)"


def scope(spark, d):
    k = F.col("p_partkey")
    return read(spark, d, "part").select(F.concat(F.when(k % 4 == 0, "other").otherwise("acme"), F.lit(".corpus.golang.s"), k % 6, F.lit(".function.f"), k).alias("id"), (k % 5 == 0).alias("marked"))


@query("lifecycle_scope", f"WITH {S_SCOPE} SELECT id FROM e WHERE starts_with(id, 'acme.') AND split_part(id, '.', 4) IN ('s1', 's2')")
def lifecycle_scope(spark, d):
    return versions.in_scope(scope(spark, d), "acme", "corpus", ["s1", "s2"]).select("id")


@query("lifecycle_source_removed", f"WITH {S_SCOPE} SELECT id, 'mark' AS action, 'source_removed' AS reason FROM e WHERE starts_with(id, 'acme.') AND split_part(id, '.', 4) IN ('s1', 's2', 's5') AND NOT marked")
def lifecycle_source_removed(spark, d):
    return versions.source_removed(versions.in_scope(scope(spark, d), "acme", "corpus", ["s1", "s2", "s5"]))


@query("lifecycle_path_missing", f"WITH {S_SCOPE} SELECT id, 'mark' AS action, 'path_missing' AS reason FROM e WHERE split_part(id, '.', 4) <> 's3' AND NOT marked")
def lifecycle_path_missing(spark, d):
    return versions.root_missing(scope(spark, d), False, ["s3"])


# ---- lineage and calls with rows on both sides ----------------------------------------------------------------------

S_VERSIONS = """v AS (SELECT 'acme.x.' || p_partkey || '.' || k AS id, 'acme' AS org, 'proj' AS project, CASE k WHEN 0 THEN 'v1.2.0' WHEN 1 THEN 'v1.10.0' ELSE 'v2.0.0' END AS version, 'src/' || p_brand AS path, p_name || p_partkey AS name, k,
  CASE WHEN p_partkey % 7 = 0 AND k = 1 THEN '' WHEN p_partkey % 3 = 0 THEN 'same' ELSE 'h' || k END AS h FROM part, (SELECT unnest([0, 1, 2]) AS k) WHERE k < 2 OR p_partkey % 2 = 0)"""


def versioned(spark, d):
    k = F.col("k")
    p = read(spark, d, "part").withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).where("k < 2 OR p_partkey % 2 = 0")
    h = F.when((F.col("p_partkey") % 7 == 0) & (k == 1), "").when(F.col("p_partkey") % 3 == 0, "same").otherwise(F.concat(F.lit("h"), k))
    return p.select(F.concat_ws(".", F.lit("acme.x"), "p_partkey", "k").alias("id"), F.lit("acme").alias("org"), F.lit("proj").alias("project"), F.when(k == 0, "v1.2.0").when(k == 1, "v1.10.0").otherwise("v2.0.0").alias("version"), F.concat(F.lit("src/"), "p_brand").alias("path"),
                    F.concat("p_name", "p_partkey").alias("name"), F.lit("function").alias("ctype"), F.lit("pkg").alias("pkg"), h.alias("body_hash"), F.when(h == "", "").otherwise("hash").alias("body_hash_kind"))


S_LINEAGE = f"""{S_VERSIONS}, a AS (SELECT id, lag(id) OVER w AS older, h, lag(h) OVER w AS oh FROM v WINDOW w AS (PARTITION BY path, name ORDER BY k)), b AS (SELECT * FROM a WHERE older IS NOT NULL),
l AS (SELECT id AS subject, 'code.lineage.supersedes' AS predicate, older AS object FROM b UNION ALL SELECT older, 'code.lineage.superseded-by', id FROM b
UNION ALL SELECT id, 'code.lineage.change', CASE WHEN h = oh THEN 'unchanged' ELSE 'changed' END FROM b WHERE h <> '' AND oh <> '')"""


@query("lineage_of_versions", f"WITH {S_LINEAGE} SELECT * FROM l")
def lineage_of_versions(spark, d):
    return versions.lineage(versioned(spark, d))


@query("lineage_missing", f"WITH {S_LINEAGE} SELECT * FROM l WHERE NOT (predicate = 'code.lineage.supersedes' AND subject LIKE '%5.1')")
def lineage_missing(spark, d):
    want = versions.lineage(versioned(spark, d))
    return versions.delta(want, want.where((F.col("predicate") == "code.lineage.supersedes") & F.col("subject").endswith("5.1")))


@query("lineage_counts", f"""WITH {S_VERSIONS}, a AS (SELECT h, lag(h) OVER w AS oh, lag(id) OVER w AS o FROM v WINDOW w AS (PARTITION BY path, name ORDER BY k)), g AS (SELECT count(*) AS n FROM v GROUP BY path, name)
SELECT (SELECT count(*) FROM v) AS entities, (SELECT count(*) FROM g) AS groups, (SELECT count(*) FROM g WHERE n > 1) AS corresponding, count(o) AS supersedes, 0 AS incomparable,
count(*) FILTER (o IS NOT NULL AND h <> '' AND oh <> '' AND h <> oh) AS changed, count(*) FILTER (o IS NOT NULL AND h <> '' AND oh <> '' AND h = oh) AS unchanged FROM a""")
def lineage_counts(spark, d):
    return versions.pass_stats(versioned(spark, d))


@query("diff_counters", f"""WITH {S_VERSIONS}, o AS (SELECT * FROM v WHERE k = 0), n AS (SELECT * FROM v WHERE k = 2), j AS (SELECT coalesce(o.path, n.path) AS path, coalesce(o.name, n.name) AS name, CASE WHEN n.id IS NULL THEN 'removed' WHEN o.h = n.h THEN 'unchanged' ELSE 'changed' END AS status FROM o FULL JOIN n USING (path, name)),
c AS (SELECT count(*) AS n FROM j WHERE status <> 'unchanged') SELECT least(n, 60) AS listed, greatest(n - 60, 0) AS dropped, 30 AS bodies, least(n, 60) - 30 AS omitted, 0 AS failed FROM c""")
def diff_counters(spark, d):
    v = versioned(spark, d)
    ch = versions.diff(v.withColumn("indexed_at", F.lit(1)), "proj", "v1.2.0", "v2.0.0")
    return versions.diff_counters(ch, ch.select(*versions.KEY, F.lit(100).alias("size")), 60, 3050)


@query("calls_of_unique_names", """WITH defs AS (SELECT p_name || (p_partkey % 500) AS name, p_brand || (p_partkey % 3) AS file, p_partkey AS line, 'p' || p_partkey AS id FROM part), u AS (SELECT name, arg_min(id, (line, id)) AS id FROM defs GROUP BY name HAVING count(DISTINCT file) = 1),
c AS (SELECT DISTINCT 'o' || l_orderkey AS src, p_name || (p_partkey % 500) AS name FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT DISTINCT src, id AS dst FROM c JOIN u USING (name) WHERE NOT (src LIKE '%7' AND name LIKE '%1')""")
def calls_of_unique_names(spark, d):
    p = read(spark, d, "part").withColumn("name", F.concat("p_name", F.col("p_partkey") % 500))
    defs = p.select("name", F.concat("p_brand", F.col("p_partkey") % 3).alias("file"), F.col("p_partkey").alias("line"), F.concat(F.lit("p"), "p_partkey").alias("id"))
    calls = read(spark, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.concat(F.lit("o"), "l_orderkey").alias("src"), "name").distinct()
    return resolve.resolve_calls(calls, defs, calls.where(F.col("src").endswith("7") & F.col("name").endswith("1")))


@query("calls_in_package", """WITH defs AS (SELECT p_brand AS dir, p_name AS name, CASE WHEN p_partkey % 4 = 0 THEN 'a_test.go' ELSE 'f' || (p_partkey % 9) || '.go' END AS file, p_partkey AS line, 'p' || p_partkey AS id FROM part), f AS (SELECT dir, name, arg_min(id, (file, line, id)) AS dst FROM defs WHERE file NOT LIKE '%_test.go' GROUP BY 1, 2)
SELECT DISTINCT 'o' || l_orderkey AS src, dst FROM lineitem JOIN part ON l_partkey = p_partkey JOIN f ON dir = p_brand AND name = p_name""")
def calls_in_package(spark, d):
    p = read(spark, d, "part")
    defs = p.select(F.col("p_brand").alias("dir"), F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 4 == 0, "a_test.go").otherwise(F.concat(F.lit("f"), F.col("p_partkey") % 9, F.lit(".go"))).alias("file"), F.col("p_partkey").alias("line"), F.concat(F.lit("p"), "p_partkey").alias("id"))
    calls = read(spark, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.concat(F.lit("o"), "l_orderkey").alias("src"), F.col("p_brand").alias("dir"), F.col("p_name").alias("name"))
    return resolve.in_package(calls, defs)


# ---- sinks: what was written is read back ---------------------------------------------------------------------------

def place(spark):
    return f"{_shared(spark)}/sinks-{uuid.uuid4().hex}"


@query("sink_entities", """WITH a AS (SELECT DISTINCT 'acme.corpus.config.s.part.p' || l_partkey AS subject, 'x.' || l_returnflag AS predicate, CAST(l_linenumber AS VARCHAR) AS object FROM lineitem), b AS (SELECT * FROM a WHERE object <= '3'), c AS (SELECT subject, predicate, object || 'n' AS object FROM a WHERE object = '4' AND predicate <> 'x.A' OR predicate = 'x.A' AND object = '5'),
k AS (SELECT b.* FROM b WHERE predicate = 'x.A' OR NOT EXISTS (SELECT 1 FROM c WHERE c.subject = b.subject AND c.predicate = b.predicate)) SELECT * FROM k UNION SELECT * FROM c""")
def sink_entities(spark, d):
    a = read(spark, d, "lineitem").select(F.concat(F.lit("acme.corpus.config.s.part.p"), "l_partkey").alias("subject"), F.concat(F.lit("x."), "l_returnflag").alias("predicate"), F.col("l_linenumber").cast("string").alias("object")).distinct()
    new = a.where("object = '4' AND predicate <> 'x.A' OR predicate = 'x.A' AND object = '5'").withColumn("object", F.concat("object", F.lit("n")))
    store = sinks.EntityStore(spark, place(spark))
    store.put(a.where("object <= '3'"))
    for _ in range(2):  # a write that runs again changes nothing
        store.put(new, ["x.A"])
    return store.read().select("subject", "predicate", "object")


@query("sink_bodies", "SELECT 'doc/' || doc_id AS key, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE source END AS body FROM documents WHERE doc_id % 4 > 0")
def sink_bodies(spark, d):
    docs = read(spark, d, "documents")
    key = F.concat(F.lit("doc/"), "doc_id").alias("key")
    store = sinks.BodyStore(spark, place(spark))
    store.put(docs.select(key, F.col("source").alias("body")))
    store.put(docs.where("doc_id % 3 = 0").select(key, F.lit("new").alias("body")))
    store.delete(docs.where("doc_id % 4 = 0").select(key).union(spark.createDataFrame([("never",)], "key string")))
    return store.get(store.under("doc/"))


# ---- streams, run as streams ----------------------------------------------------------------------------------------

def streamed(spark, d, make, name):
    """What a stream over the events table gives when it has read all that is there."""
    source = read(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("path"), F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "click", "delete").otherwise("write").alias("op"), F.col("event_type").alias("hash"))
    root = place(spark)
    source.coalesce(1).write.parquet(f"{root}/in")
    out = make(changes.event_stream(spark, f"{root}/in", source.schema))
    q = out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{root}/out")


@query("stream_suppress", """WITH e AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'click' THEN NULL ELSE event_type END AS h, lag(CASE WHEN event_type = 'click' THEN NULL ELSE event_type END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)
SELECT CAST(user_id AS VARCHAR) AS path, event_id, CASE WHEN h IS NULL THEN 'delete' WHEN b IS NULL THEN 'create' ELSE 'modify' END AS change FROM e WHERE h IS DISTINCT FROM b""")
def stream_suppress(spark, d):
    return streamed(spark, d, changes.suppress_unchanged, "suppress").select("path", "event_id", "change")


@query("stream_polls", """WITH o AS (SELECT * FROM events WHERE event_type <> 'error'), e AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'click' THEN NULL ELSE event_type END AS h, lag(CASE WHEN event_type = 'click' THEN NULL ELSE event_type END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM o)
SELECT CAST(user_id AS VARCHAR) AS path, event_id, CASE WHEN h IS NULL THEN 'delete' WHEN b IS NULL THEN 'create' ELSE 'modify' END AS change FROM e WHERE h IS DISTINCT FROM b""")
def stream_polls(spark, d):
    return streamed(spark, d, changes.polled, "polls").select("path", "event_id", "change")


@query("publish_errors", """SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'cancelled' WHEN event_type = 'view' OR event_type = 'signup' AND event_id % 2 = 0 THEN 'retryable' ELSE 'terminal' END AS class FROM events""")
def publish_errors(spark, d):
    t, k = F.col("event_type"), F.col("event_id")
    message = F.when(t == "view", "timeout").when(t == "signup", "maximum bytes exceeded").otherwise("bad request")
    return read(spark, d, "events").select(k, changes.publish_error(message, F.when(k % 2 == 0, 10077).otherwise(10058), k % 9 == 0).alias("class"))


@query("reindex_due", """SELECT event_id AS source FROM events WHERE epoch(TIMESTAMP '2024-01-20 00:00:00') - epoch(date_trunc('second', ts)) >= 60 AND (event_id % 3 = 0 OR event_id % 2 = 1)""")
def reindex_due(spark, d):
    k = F.col("event_id")
    rows = read(spark, d, "events").select(k.alias("source"), F.concat(F.lit("h"), k % 2).alias("hash"), F.when(k % 3 > 0, "h0").alias("seen_hash"), F.col("ts").cast("timestamp").alias("last"))
    return changes.reindex_due(rows, F.lit("2024-01-20 00:00:00").cast("timestamp")).select("source")


@query("late_reports", """WITH r AS (SELECT user_id, min(ts) AS removed, CASE WHEN user_id % 2 = 0 THEN max(ts) END AS added FROM events WHERE user_id % 3 = 0 GROUP BY user_id)
SELECT event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM r WHERE added IS NULL OR added <= removed)""")
def late_reports(spark, d):
    e = read(spark, d, "events").withColumnRenamed("user_id", "instance")
    removed = e.where("instance % 3 = 0").groupBy("instance").agg(F.min("ts").alias("removed"), F.max("ts").alias("last")).select("instance", "removed", F.when(F.col("instance") % 2 == 0, F.col("last")).alias("added"))
    return changes.welcome_reports(e, removed).select("event_id")


@query("bounded_buffer", "SELECT user_id AS batch, least(count(*), 10) AS kept, greatest(count(*) - 10, 0) AS dropped FROM events GROUP BY 1")
def bounded_buffer(spark, d):
    return changes.bounded(read(spark, d, "events").select(F.col("user_id").alias("batch")), 10)
