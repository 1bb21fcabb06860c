"""Versioned entities: documents as symbols whose versions are buckets of their ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from lithic.functions import text
from lithic.operators import versions
from lithic.plans.catalog import query, read

CANDS = """
c AS (SELECT 'acme.corpus.golang.' || source || '-v' || doc_id % 4 || '.function.d' || doc_id AS id, 'acme' AS org, source AS project, 'v1.' || (doc_id % 4) * 5 || '.0' AS version,
  lang AS path, 'n' || n_chars // 400 AS name, 'function' AS ctype, '' AS pkg, CASE WHEN doc_id % 9 = 0 THEN '' ELSE sha256(text) END AS body_hash,
  CASE WHEN doc_id % 9 = 0 THEN '' WHEN doc_id % 10 = 1 THEN 'hash' ELSE 'bodykey' END AS body_hash_kind, doc_id AS indexed_at, doc_id % 4 AS o FROM documents)"""
KEY = "org, project, path, name, ctype, pkg"


def cands(spark, d):
    i = F.col("doc_id")
    hash_ = F.when(i % 9 == 0, "").otherwise(F.sha2("text", 256))
    kind = F.when(i % 9 == 0, "").when(i % 10 == 1, "hash").otherwise("bodykey")
    return read(spark, d, "documents").select(
        F.concat(F.lit("acme.corpus.golang."), F.col("source"), F.lit("-v"), i % 4, F.lit(".function.d"), i).alias("id"), F.lit("acme").alias("org"), F.col("source").alias("project"),
        F.concat(F.lit("v1."), (i % 4) * 5, F.lit(".0")).alias("version"), F.col("lang").alias("path"), F.concat(F.lit("n"), F.floor(F.col("n_chars") / 400)).alias("name"),
        F.lit("function").alias("ctype"), F.lit("").alias("pkg"), hash_.alias("body_hash"), kind.alias("body_hash_kind"), i.alias("indexed_at"))


PAIRS = f"""{CANDS},
l AS (SELECT id AS newer, o, body_hash AS h, body_hash_kind AS k, lag(id) OVER w AS older, lag(o) OVER w AS oo, lag(body_hash) OVER w AS oh, lag(body_hash_kind) OVER w AS ok
  FROM c WINDOW w AS (PARTITION BY {KEY} ORDER BY o, id)),
p AS (SELECT older, newer, o <> oo AS comparable, CASE WHEN h = '' OR oh = '' OR k <> ok THEN NULL WHEN h = oh THEN 'unchanged' ELSE 'changed' END AS change FROM l WHERE older IS NOT NULL)"""
EDGES = f"""{PAIRS},
e AS (SELECT newer AS subject, 'code.lineage.supersedes' AS predicate, older AS object FROM p WHERE comparable UNION ALL SELECT older, 'code.lineage.superseded-by', newer FROM p WHERE comparable
  UNION ALL SELECT newer, 'code.lineage.change', change FROM p WHERE comparable AND change IS NOT NULL)"""


@query("version_lineage", f"WITH {EDGES} SELECT * FROM e")
def version_lineage(spark, d):
    return versions.lineage(cands(spark, d))


@query("lineage_delta", f"WITH {EDGES} SELECT * FROM e WHERE NOT (predicate = 'code.lineage.supersedes' AND subject LIKE '%5')")
def lineage_delta(spark, d):
    desired = versions.lineage(cands(spark, d))
    return versions.delta(desired, desired.where("predicate = 'code.lineage.supersedes' AND subject LIKE '%5'"))


@query("version_pass_stats", f"""WITH {PAIRS}, g AS (SELECT count(*) AS n FROM c GROUP BY {KEY})
SELECT (SELECT CAST(sum(n) AS BIGINT) FROM g) AS entities, (SELECT count(*) FROM g) AS groups, (SELECT count(*) FROM g WHERE n > 1) AS corresponding, count(*) FILTER (comparable) AS supersedes,
  count(*) FILTER (NOT comparable) AS incomparable, count(*) FILTER (comparable AND change = 'changed') AS changed, count(*) FILTER (comparable AND change = 'unchanged') AS unchanged FROM p""")
def version_pass_stats(spark, d):
    return versions.pass_stats(cands(spark, d))


DIFF = f"""{CANDS},
a AS (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY indexed_at DESC, id DESC) AS r FROM c WHERE o = 1),
b AS (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY indexed_at DESC, id DESC) AS r FROM c WHERE o = 2),
f AS (SELECT coalesce(x.project, y.project) AS project, coalesce(x.path, y.path) AS path, coalesce(x.name, y.name) AS name, x.id AS old_id, y.id AS new_id,
  CASE WHEN x.id IS NULL THEN 'added' WHEN y.id IS NULL THEN 'removed' WHEN x.body_hash = '' OR y.body_hash = '' OR x.body_hash_kind <> y.body_hash_kind THEN 'indeterminate'
    WHEN x.body_hash = y.body_hash THEN 'unchanged' ELSE 'changed' END AS status
  FROM (SELECT * FROM a WHERE r = 1) x FULL OUTER JOIN (SELECT * FROM b WHERE r = 1) y USING ({KEY}))"""


def every_diff(spark, d):
    """The diff of two versions in every project at once: the project is part of the key."""
    c = cands(spark, d)
    return versions.diff(c.withColumns({"pkg": F.col("project"), "project": F.lit("p")}), "p", "v1.5.0", "v1.10.0").select(F.col("pkg").alias("project"), "path", "name", "status", "old_id", "new_id")


@query("version_diff", f"WITH {DIFF} SELECT project, path, name, status, old_id, new_id FROM f WHERE status <> 'unchanged'")
def version_diff(spark, d):
    return every_diff(spark, d).where("status <> 'unchanged'")


@query("version_diff_counts", f"WITH {DIFF} SELECT project, status, count(*) AS n FROM f GROUP BY 1, 2")
def version_diff_counts(spark, d):
    return every_diff(spark, d).groupBy("project", "status").agg(F.count("*").alias("n"))


@query("version_candidates", """
WITH t AS (SELECT doc_id, 'acme.corpus.golang.s.function.d' || doc_id AS id, text, source, n_chars FROM documents)
SELECT id, 'acme' AS org, source AS project, 'v' || doc_id % 3 AS version, source || '.go' AS path, 'n' || doc_id AS name, 'function' AS ctype, '' AS pkg,
  CASE WHEN doc_id % 2 = 0 THEN 'code:' || doc_id ELSE sha256(text) END AS body_hash, CASE WHEN doc_id % 2 = 0 THEN 'bodykey' ELSE 'hash' END AS body_hash_kind FROM t WHERE doc_id % 3 > 0""")
def version_candidates(spark, d):
    i = F.col("doc_id")
    from lithic.operators.triples import unpivot

    t = unpivot(read(spark, d, "documents").withColumn("id", F.concat(F.lit("acme.corpus.golang.s.function.d"), i)), "id", [
        ("code.artifact.project", F.col("source"), None), ("code.artifact.version", F.when(i % 3 > 0, F.concat(F.lit("v"), i % 3)), None), ("code.artifact.version", F.lit("late"), None),
        ("code.artifact.path", F.concat(F.col("source"), F.lit(".go")), None), ("dc.terms.title", F.concat(F.lit("n"), i), None), ("code.artifact.type", F.lit("function"), None),
        ("code.body.key", F.when(i % 2 == 0, F.concat(F.lit("code:"), i)), None), ("code.artifact.hash", F.sha2("text", 256), None)])
    return versions.candidates(t).where("version <> 'late'")


@query("version_natural_order", """
SELECT p_partkey, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS place FROM part""")
def version_natural_order(spark, d):
    from pyspark.sql import Window as W

    v = F.concat(F.lit("build"), F.col("p_partkey"))
    return read(spark, d, "part").select("p_partkey", F.row_number().over(W.partitionBy("p_size").orderBy(text.version_key(v))).cast("long").alias("place"))


ENTITIES = """
e AS (SELECT 'd' || doc_id AS id, source || '/' || doc_id // 10 || '.md' AS path, CASE WHEN doc_id % 10 = 0 THEN 'document' ELSE 'passage' END AS kind,
  CASE WHEN doc_id % 10 > 0 THEN doc_id % 10 - 1 END AS chunk_index, CASE WHEN doc_id % 10 = 0 AND doc_id % 70 <> 0 THEN 1 + n_chars % 10 END AS chunk_count, doc_id % 4 = 0 AS marked FROM documents),
live AS (SELECT DISTINCT source || '/' || d.doc_id // 10 || '.md' AS path FROM documents d JOIN labels USING (doc_id)),
k AS (SELECT path, max(chunk_count) AS chunks FROM e WHERE kind = 'document' GROUP BY path),
r AS (SELECT e.*, live.path IS NOT NULL AS alive, chunks FROM e LEFT JOIN live USING (path) LEFT JOIN k USING (path)),
a AS (SELECT id, CASE WHEN (NOT alive OR (kind = 'passage' AND coalesce(chunk_index >= chunks, false))) AND NOT marked THEN 'mark'
  WHEN alive AND marked AND NOT (kind = 'passage' AND (coalesce(chunk_index >= chunks, false) OR chunks IS NULL)) THEN 'clear' END AS action,
  CASE WHEN NOT alive THEN 'file_deleted' WHEN kind = 'passage' AND chunk_index >= chunks THEN 'passage_removed' END AS reason FROM r)"""


def entities(spark, d):
    i = F.col("doc_id")
    path = F.concat(F.col("source"), F.lit("/"), F.floor(i / 10), F.lit(".md"))
    docs = read(spark, d, "documents")
    e = docs.select(F.concat(F.lit("d"), i).alias("id"), path.alias("path"), F.when(i % 10 == 0, "document").otherwise("passage").alias("kind"), F.when(i % 10 > 0, i % 10 - 1).alias("chunk_index"),
                    F.when((i % 10 == 0) & (i % 70 != 0), 1 + F.col("n_chars") % 10).alias("chunk_count"), (i % 4 == 0).alias("marked"))
    return e, docs.join(read(spark, d, "labels"), "doc_id").select(path.alias("path"))


@query("lifecycle_actions", f"WITH {ENTITIES} SELECT id, action, CASE WHEN action = 'mark' THEN reason END AS reason FROM a WHERE action IS NOT NULL")
def lifecycle_actions(spark, d):
    return versions.staleness(*entities(spark, d))


@query("lifecycle_reconcile", f"""WITH {ENTITIES}
SELECT id AS subject, 'entity.lifecycle.stale' AS predicate, 'old' AS object FROM e LEFT JOIN a USING (id) WHERE marked AND action IS NULL
UNION ALL SELECT id, 'entity.lifecycle.stale', reason FROM a WHERE action = 'mark'
UNION ALL SELECT id, 'source.doc.type', kind FROM e""")
def lifecycle_reconcile(spark, d):
    e, live = entities(spark, d)
    t = e.select(F.col("id").alias("subject"), F.lit("source.doc.type").alias("predicate"), F.col("kind").alias("object")).unionByName(
        e.where("marked").select(F.col("id").alias("subject"), F.lit("entity.lifecycle.stale").alias("predicate"), F.lit("old").alias("object")))
    return versions.reconcile_markers(t, versions.staleness(e, live))
