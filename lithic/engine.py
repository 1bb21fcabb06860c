"""A thin facade: one method per question that a client asks of the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithic import vocab
from lithic.operators import retrieval, versions


class QueryError(Exception):
    """An answer that can't be given. code is stable; retryable tells a client to ask again."""

    def __init__(self, code: str, message: str, kind: str = "invalid"):
        super().__init__(message)
        self.code, self.kind, self.retryable = code, kind, kind == "transient"


class Engine:
    """Over tables entities (id, domain, name, kind), edges (src, predicate, dst), triples and bodies (id, text)."""

    def __init__(self, spark: SparkSession, entities: DataFrame, edges: DataFrame, triples: DataFrame, bodies: DataFrame):
        self.spark, self.entities, self.edges, self.triples, self.bodies = spark, entities, edges, triples, bodies

    def seeds(self, query: str, lens: str = "code") -> DataFrame:
        """At most 40 seed ids (id, i): by name, by id prefix, or by words, as the query looks."""
        if not query.strip():
            raise QueryError("INVALID_QUERY", "an empty query")
        scope = retrieval.scoped(self.entities, vocab.CODE_DOMAINS if lens == "code" else ("web", "config"))
        how = retrieval.mode(query, lens)
        if how == "prefix":
            found = retrieval.by_prefix(scope, query.strip()).select("id", F.lit(0.0).alias("s"))
        elif how == "symbol":
            found = retrieval.resolve_names(scope.select("name", "id"), F.lit(query)).select("id", (~F.col("exact")).cast("double").alias("s"))
        else:
            texts = self.bodies.join(scope.select("id"), "id", "left_semi")
            found = retrieval.bm25(texts, query.split()).select("id", (-F.col("score")).alias("s"))
        top = found.orderBy("s", "id").limit(retrieval.SEEDS)
        from pyspark.sql import Window as W

        return top.withColumn("i", F.row_number().over(W.orderBy("s", "id")) - 1).select("id", "i")

    def context(self, query: str, lens: str = "code", most_nodes: int = 20, most_bytes: int = 60_000) -> DataFrame:
        """(id, score, body, bytes): ranked evidence within the budgets."""
        seeds = self.seeds(query, lens)
        labels = self.entities.select("id", F.col("name").alias("label"))
        depth = self.entities.select("id", F.lit(0).alias("specificity"))
        ranked = retrieval.rank(seeds, query, labels, depth, retrieval.salience(self.triples))
        whole = ranked.join(self.bodies.select("id", F.col("text").alias("body")), "id", "left").withColumn("bytes", F.coalesce(F.octet_length("body"), F.lit(0)))
        return retrieval.budget(whole, most_nodes, most_bytes)

    def relations(self, query: str, lens: str = "code") -> DataFrame:
        return retrieval.relations(retrieval.neighbors(self.seeds(query, lens), retrieval.live_edges(self.edges, self.entities)))

    def impact(self, query: str) -> DataFrame:
        """What depends on the named symbols, at most 1000 rows."""
        return retrieval.impact(self.seeds(query), retrieval.live_edges(self.edges, self.entities)).orderBy("depth", "seed", "id").limit(retrieval.MOST_IMPACT)

    def changes(self, candidates: DataFrame, project: str, old: str, new: str) -> DataFrame:
        """The changeset between two versions; an unknown version is an error, not an empty answer."""
        known = {r["version"] for r in candidates.where(F.col("project") == project).select("version").where(F.col("version").isin(old, new)).distinct().collect()}
        if missing := {old, new} - known:
            raise QueryError("VERSION_NOT_FOUND", f"no entities of {project} at {', '.join(sorted(missing))}")
        return versions.changeset(versions.diff(candidates, project, old, new))
