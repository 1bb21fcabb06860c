"""What an answer shows of entities: nodes per lens, the graph facet, rendered values, the predicate schema and contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lithic import vocab
from lithic.functions import text

# Which predicates a lens reads: label, kind, path, first and last line, section, body store and key.
LENSES = {
    "code": ("dc.terms.title", "code.artifact.type", "code.artifact.path", "code.metric.start-line", "code.metric.end-line", None, "code.body.store", "code.body.key"),
    "docs": ("dc.terms.title", "source.doc.type", "source.doc.file-path", None, None, "source.doc.section", "source.doc.body-store", "source.doc.body-key"),
}


def _first(predicate: str | None) -> Column:
    """The first value that an entity has for a predicate."""
    if predicate is None:
        return F.lit(None).cast("string")
    return F.min(F.when(F.col("predicate") == predicate, F.struct("ord", "object")))["object"]


def nodes(triples: DataFrame, lens: str, bodies: DataFrame | None = None) -> DataFrame:
    """(id, label, kind, path, first, last, fragment, key, body) of (subject, ord, predicate, object).

    Without a store and a key there is no handle; with bodies (key, body) the handle is followed. One aggregate over the
    entity's triples, of which only those of the lens are read. It has to sort, so triples are dealt out first: a task then sorts
    its share and not all that was made from one piece of the input.
    """
    label, kind, path, first, last, section, store, key = LENSES[lens]
    wanted = triples.where(F.col("predicate").isin(*[p for p in LENSES[lens] if p]))
    got = wanted.repartition("subject").groupBy(F.col("subject").alias("id")).agg(*[_first(p).alias(n) for p, n in ((label, "label"), (kind, "kind"), (path, "path"), (first, "first"), (last, "last"), (section, "section"), (store, "store"), (key, "k"))])
    out = got.select("id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("label", "kind", "path")], F.coalesce(F.col("first").cast("int"), F.lit(0)).alias("first"), F.coalesce(F.col("last").cast("int"), F.lit(0)).alias("last"),
                     F.coalesce(text.section_anchor(F.col("section")), F.lit("")).alias("fragment"), F.when((F.coalesce("store", F.lit("")) != "") & (F.coalesce("k", F.lit("")) != ""), F.col("k")).alias("key"))
    return out if bodies is None else out.join(bodies.select("key", "body"), "key", "left").select("id", "label", "kind", "path", "first", "last", "fragment", "key", "body")


def graph_nodes(ids: DataFrame, triples: DataFrame, edge_predicates: list[str]) -> DataFrame:
    """(id, facts): the nodes of a projection with their facts that aren't edges, as predicate=value in order."""
    facts = triples.where(~F.col("predicate").isin(*edge_predicates)).join(ids.select(F.col("id").alias("subject")), "subject", "left_semi")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ord", F.concat_ws("=", "predicate", "object").alias("fact")))), lambda x: x["fact"])
    told = facts.groupBy(F.col("subject").alias("id")).agg(listed.alias("facts"))
    return ids.select("id").distinct().join(told, "id", "left").select("id", F.coalesce("facts", F.expr("CAST(array() AS array<string>)")).alias("facts"))


def graph_edges(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, predicate, dst, direction): the edges that touch a node, seen from it: out, in, or both where it touches both ends."""
    own = ids.select("id").distinct()
    starts = edges.join(own.select(F.col("id").alias("src"), F.lit(True).alias("s")), "src", "left").join(own.select(F.col("id").alias("dst"), F.lit(True).alias("t")), "dst", "left")
    both = F.col("s") & F.col("t")
    return starts.where("s OR t").select("src", "predicate", "dst", F.when(both, "both").when(F.col("s"), "out").otherwise("in").alias("direction")).distinct()


def revision(triples: DataFrame) -> DataFrame:
    """(rows, digest): one row that changes with any triple and doesn't depend on their order; nodes and edges of one answer carry the same."""
    return triples.agg(F.count("*").alias("rows"), F.coalesce(F.bit_xor(F.xxhash64("subject", "predicate", "object")), F.lit(0)).alias("digest"))


# ---- rendered values ------------------------------------------------------------------------------------------------

def scalar(value: Column, kind: Column) -> Column:
    """A JSON value as it is shown: texts as they are, numbers in their shortest form, booleans as words; all else is absent (empty).

    value holds the JSON text of the value, kind its type: string, number, boolean, or anything else.
    """
    number = value.cast("double")
    plain = F.when((number == F.floor(number)) & (F.abs(number) < 1e15), number.cast("long").cast("string")).otherwise(number.cast("string"))
    return F.when(kind == "string", value).when(kind == "number", plain).when(kind == "boolean", F.lower(value)).otherwise("")


def type_segment(id_: Column) -> Column:
    """The fifth segment of an id; empty for a shorter one."""
    return F.coalesce(F.try_element_at(F.split(id_, r"\."), F.lit(5)), F.lit(""))


def titles(triples: DataFrame) -> DataFrame:
    """(subject, title): the first title of an entity that isn't empty."""
    some = triples.where((F.col("predicate") == "dc.terms.title") & (F.coalesce("object", F.lit("")) != ""))
    return some.groupBy("subject").agg(F.min(F.struct("ord", "object"))["object"].alias("title"))


def properties(triples: DataFrame, allowed: list[str], most: int = 8, longest: int = 160) -> DataFrame:
    """(subject, place, predicate, value): of the allowed predicates, in their order, the first value of each that isn't empty; so many at most."""
    from lithic.operators.retrieval import short_value

    order = F.broadcast(triples.sparkSession.createDataFrame(list(enumerate(allowed)), "place int, predicate string"))
    some = triples.where(F.coalesce("object", F.lit("")) != "").join(order, "predicate")
    one = some.groupBy("subject", "place", "predicate").agg(F.min(F.struct("ord", "object"))["object"].alias("value"))
    at = F.row_number().over(W.partitionBy("subject").orderBy("place"))  # as many rows as there are allowed predicates
    return one.withColumn("at", at).where(F.col("at") <= most).select("subject", "place", "predicate", short_value(F.col("value"), longest).alias("value"))


# Sentences of a disclosure. Fixed values.
NOTE_UNKNOWN = "The retrieval path is unknown: the response couldn't be read, so the answer is unattributed."
NOTE_BACKED, NOTE_NOT_BACKED = "Drew on community summaries. ", "Did not draw on community summaries. "
NOTE_MODEL, NOTE_TEMPLATE, NOTE_NONE = "The answer was written by ", "The answer is the fixed template.", "No answer was written."
NOTE_FALLBACK, NOTE_DEGRADED = " The results come from a semantic fallback.", " The synthesis was degraded: "
FALLBACK = "global_search_empty_semantic_fallback"


def disclosed(rows: DataFrame) -> DataFrame:
    """Adds answer_source, rung and note to (readable, summaries, answer, model, degraded, reason): by the model's presence, not the degraded flag."""
    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    backed = F.coalesce("summaries", F.lit(0)) > 0
    source = F.when(~F.col("readable"), "none").when(some("model"), "llm").when(some("answer"), "template").otherwise("none")
    rung = F.when(~F.col("readable"), "unknown").when(source == "llm", "llm_answer").when(backed, "community_summaries").otherwise("entities_only")
    said = F.when(source == "llm", F.concat(F.lit(NOTE_MODEL), "model", F.lit("."))).when(source == "template", NOTE_TEMPLATE).otherwise(NOTE_NONE)
    also = F.when(~F.coalesce("degraded", F.lit(False)), "").when(F.col("reason") == FALLBACK, NOTE_FALLBACK).otherwise(F.concat(F.lit(NOTE_DEGRADED), F.coalesce("reason", F.lit("")), F.lit(".")))
    note = F.when(~F.col("readable"), NOTE_UNKNOWN).otherwise(F.concat(F.when(backed, NOTE_BACKED).otherwise(NOTE_NOT_BACKED), said, also))
    return rows.withColumns({"answer_source": source, "rung": rung, "note": note})


# ---- schema and contracts -------------------------------------------------------------------------------------------

# Which predicates a source's entities carry, by prefix.
PREFIXES = [("ast", "code."), ("ast", "dc."), ("ast", "agentic."), ("git", "source.git."), ("docs", "source.doc."), ("config", "source.config."), ("url", "source.web."),
            ("image", "source.media."), ("video", "source.media."), ("audio", "source.media.")]
# Roles that don't follow from a name.
ROLES = {
    "location": ("code.artifact.path", "source.doc.file-path", "source.config.file-path", "source.media.file-path", "source.web.url", "code.metric.start-line", "code.metric.end-line"),
    "identity": ("dc.terms.title", "code.artifact.type", "code.artifact.package", "code.artifact.visibility", "code.artifact.language", "code.artifact.framework", "source.doc.type", "source.web.type",
                 "source.repo.type", "source.media.type", "source.git.commit-sha", "source.git.author-name", "source.git.author-email", "source.git.branch-name", "source.git.commit-subject",
                 "source.config.module-path", "source.config.package-name"),
    "content": ("source.doc.content", "code.doc.comment", "source.media.vision-description", "source.media.vision-text"),
    "relationship": ("source.config.requires", "source.config.depends", "source.config.contains", "source.git.commit-authored-by", "source.git.commit-touches", "source.media.keyframe-of"),
}


def predicate_role(name: Column) -> Column:
    """location, identity, content, relationship, metric or metadata: by name, then by its second or last but one segment."""
    parts = F.split(name, r"\.")
    category = F.array(F.try_element_at(parts, F.lit(-2)), F.try_element_at(parts, F.lit(2)))
    near = lambda *x: F.exists(category, lambda c: c.isin(*x)) & (F.size(parts) >= 3)
    out = F.when(near("relationship", "structure", "dependency"), "relationship").when(near("metric"), "metric").otherwise("metadata")
    for role, names in ROLES.items():
        out = F.when(name.isin(*names), role).otherwise(out)
    return out


def predicate_schema(predicates: DataFrame, kinds: list[str]) -> DataFrame:
    """(source_type, name, data_type, role) of (name, data_type) for the kinds of sources there are; a kind without prefixes has none."""
    table = F.broadcast(predicates.sparkSession.createDataFrame([p for p in PREFIXES if p[0] in kinds], "source_type string, prefix string"))
    met = predicates.join(table, F.col("name").startswith(F.col("prefix")))
    return met.select("source_type", "name", F.coalesce("data_type", F.lit("string")).alias("data_type"), predicate_role(F.col("name")).alias("role")).distinct()


# Predicates that are owned though their names don't begin with source. or code.
ALSO_OWNED = ("agentic.capability.name", "agentic.capability.description", "agentic.capability.tools", "agentic.capability.inputs", "agentic.capability.outputs", "dc.terms.title", "dc.terms.created", "dc.terms.modified")


def contract(predicates: DataFrame) -> DataFrame:
    """(group_name, predicate): what the source group and the lifecycle group reconcile, each predicate once."""
    spark = predicates.sparkSession
    own = predicates.where(F.col("name").startswith("source.") | F.col("name").startswith("code.")).select(F.lit("source").alias("group_name"), F.col("name").alias("predicate"))
    also = spark.createDataFrame([("source", p) for p in ALSO_OWNED] + [("lifecycle", "entity.lifecycle.stale")], "group_name string, predicate string")
    return own.unionByName(also).distinct()


def predicates(spark: SparkSession) -> DataFrame:
    """(name, data_type) of the predicates that this library writes."""
    from lithic.operators import triples

    names = {p: "string" for p, _ in vocab.WEIGHTS} | {p: "entity_id" for p, _, _ in vocab.EDGE_ROLES} | {p: "entity_id" for p, _ in triples.RELATIONS}
    names |= {f"source.config.{f}": "string" for facts, _ in triples.PROJECT_FACTS.values() for f in facts}
    names |= {f"source.media.{f}": "string" for facts in triples.MEDIA_FACTS.values() for f in facts} | {p: "string" for names_ in ROLES.values() for p in names_}
    return spark.createDataFrame(sorted(names.items()), "name string, data_type string")


def capabilities(components: DataFrame) -> DataFrame:
    """(capability, status) of (capability, supported, healthy, required): ready if all that it requires is healthy; unsupported if nothing supports it."""
    needed = F.col("required") & F.col("supported")
    return components.groupBy("capability").agg(F.when(~F.bool_or("supported"), "unsupported").when(F.bool_and(~needed | F.col("healthy")), "ready").otherwise("not_ready").alias("status"))


# ---- the reading arm ------------------------------------------------------------------------------------------------

STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "how", "in", "is", "it", "of", "on", "or", "that", "the", "to", "what", "when", "where", "which", "who", "why", "with")


def read_files(questions: DataFrame, files: DataFrame, most: int = 5) -> DataFrame:
    """(question, file, rank, bytes): the files a reader would open: by hits, until every term that occurs anywhere was seen, so many at most, each charged whole.

    questions (question, query) are a stated set; files (file, text). The terms of a question are its words but stop words.
    """
    words = F.array_distinct(F.filter(F.split(F.lower("query"), "[^a-z0-9_]+"), lambda w: (w != "") & ~w.isin(*STOP_WORDS)))
    terms = questions.select("question", F.explode(words).alias("term"))
    asked = F.broadcast(terms.select("term").distinct())
    hits = files.select("file", "text", F.octet_length("text").alias("bytes")).join(asked, F.expr("contains(lower(text), term)"))
    counted = hits.select("file", "bytes", "term", F.expr("(length(text) - length(replace(lower(text), term, ''))) div length(term)").alias("n"))
    met = terms.join(counted, "term")
    ranked = met.groupBy("question", "file", "bytes").agg(F.sum("n").alias("n"), F.array_sort(F.collect_set("term")).alias("terms"))
    ranked = ranked.withColumn("rank", F.row_number().over(W.partitionBy("question").orderBy(F.desc("n"), "file"))).where(F.col("rank") <= most)
    findable = met.groupBy("question").agg(F.count_distinct("term").alias("all"))
    before = F.size(F.array_distinct(F.flatten(F.collect_list("terms").over(W.partitionBy("question").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)))))
    return ranked.join(findable, "question").withColumn("seen", before).where(F.col("seen") < F.col("all")).select("question", "file", "rank", "bytes")
