"""Entities to subject-predicate-object rows, containers, classes and bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lithic import vocab
from lithic.functions import ids

REFERENCE = "entity_id"


def unpivot(entities: DataFrame, subject: str, facts: list[tuple[str, Column, str | None]]) -> DataFrame:
    """(subject, ord, predicate, object, datatype): one row per fact that isn't null, in the given order; one pass, no shuffle."""
    rows = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(p).alias("predicate"), o.cast("string").alias("object"), F.lit(t).cast("string").alias("datatype")) for i, (p, o, t) in enumerate(facts)])
    return entities.select(F.col(subject).alias("subject"), F.inline(F.filter(rows, lambda r: r["object"].isNotNull())))


def document_triples(docs: DataFrame) -> DataFrame:
    """From (id, path, mime, hash, title, chunks)."""
    return unpivot(docs, "id", [
        ("source.doc.type", F.lit("document"), None), ("source.doc.file-path", F.col("path"), None), ("source.doc.mime-type", F.col("mime"), None), ("source.doc.file-hash", F.col("hash"), None),
        ("dc.terms.title", F.col("title"), None), ("source.doc.chunk-count", F.col("chunks"), "int"), ("entity.role.navigational", F.lit("document"), None)])


def passage_triples(passages: DataFrame) -> DataFrame:
    """From (id, parent, path, mime, title, ordinal, section, body_key); an empty section or body has no fact."""
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    return unpivot(passages, "id", [
        ("source.doc.type", F.lit("passage"), None), ("source.doc.file-path", F.col("path"), None), ("source.doc.mime-type", F.col("mime"), None), ("dc.terms.title", F.col("title"), None),
        ("source.doc.chunk-index", F.col("ordinal"), "int"), ("code.structure.belongs", F.col("parent"), REFERENCE), ("source.doc.section", some("section"), None),
        ("source.doc.body-store", F.when(some("body_key").isNotNull(), "objectstore"), None), ("source.doc.body-key", some("body_key"), None)])


def page_triples(pages: DataFrame) -> DataFrame:
    """From (id, url, content_type, system, etag, hash); etag and hash only where present."""
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    return unpivot(pages, "id", [
        ("source.web.type", F.lit("web"), None), ("source.web.url", F.col("url"), None), ("source.web.content-type", F.col("content_type"), None), ("source.web.domain", F.col("system"), None),
        ("source.web.etag", some("etag"), None), ("source.web.content-hash", some("hash"), None)])


def code_triples(symbols: DataFrame) -> DataFrame:
    """Identity facts of (id, path, language, package, project, version, kind, name, visibility, exported, test, start, end)."""
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    versioned = F.col("version") != ""
    return unpivot(symbols, "id", [
        ("dc.terms.title", F.col("name"), None), ("code.artifact.type", F.col("kind"), None), ("code.artifact.path", some("path"), None), ("code.artifact.language", some("language"), None),
        ("code.artifact.package", some("package"), None), ("code.artifact.project", F.when(versioned, some("project")), None), ("code.artifact.version", some("version"), None),
        ("code.artifact.visibility", some("visibility"), None), ("code.artifact.exported", F.when(F.col("exported"), "true"), "bool"), ("code.artifact.test", F.when(F.col("test"), "true"), "bool"),
        ("code.metric.start-line", F.when(F.col("start") > 0, F.col("start")), "int"), ("code.metric.end-line", F.when(F.col("end") > 0, F.col("end")), "int"),
        ("code.metric.lines", F.when((F.col("start") > 0) & (F.col("end") > 0), F.col("end") - F.col("start") + 1), "int")])


def unpivot_lists(entities: DataFrame, subject: str, facts: list[tuple[str, Column, str | None]]) -> DataFrame:
    """As unpivot, for arrays: one row per element, in the order of the facts and then of the elements; empty ones left out."""
    one = lambda p, t: (lambda o, i: F.struct(i.cast("int").alias("at"), F.lit(p).alias("predicate"), o.cast("string").alias("object"), F.lit(t).cast("string").alias("datatype")))
    nothing = F.expr("CAST(array() AS array<struct<at:int,predicate:string,object:string,datatype:string>>)")
    rows = F.concat(*[F.coalesce(F.transform(values, one(p, t)), nothing) for p, values, t in facts])
    kept = F.filter(rows, lambda r: r["object"].isNotNull() & (r["object"] != ""))
    return entities.select(F.col(subject).alias("subject"), F.posexplode(kept).alias("ord", "r")).select("subject", "ord", "r.predicate", "r.object", "r.datatype")


def capability_triples(symbols: DataFrame) -> DataFrame:
    """From (id, capability struct<name, description, tools, inputs, outputs>): nothing for an absent capability."""
    c = lambda f: F.col(f"capability.{f}")
    return unpivot_lists(symbols, "id", [("agentic.capability.name", F.array(c("name")), None), ("agentic.capability.description", F.array(c("description")), None),
                                         ("agentic.capability.tools", c("tools"), None), ("agentic.capability.inputs", c("inputs"), None), ("agentic.capability.outputs", c("outputs"), None)])


# Fixed order in which a symbol's relations are told, and where each comes from; the first and the receiver are single values.
RELATIONS = [
    ("code.structure.belongs", "contained_by"), ("code.structure.contains", "contains"), ("code.dependency.imports", "imports"), ("code.relationship.implements", "implements"),
    ("code.relationship.extends", "extends"), ("code.relationship.embeds", "embeds"), ("code.relationship.calls", "calls"), ("code.relationship.references", "references"),
    ("code.relationship.returns", "returns"), ("code.relationship.receiver", "receiver"), ("code.relationship.parameter", "parameters"),
]
SINGLE = ("contained_by", "receiver")


def relationship_triples(symbols: DataFrame) -> DataFrame:
    """From (id, and a column for each of RELATIONS; absent columns have no facts). Edges carry no datatype."""
    has = [(p, F.array(F.col(c)) if c in SINGLE else F.col(c), None) for p, c in RELATIONS if c in symbols.columns]
    return unpivot_lists(symbols, "id", has)


# ---- build files ----------------------------------------------------------------------------------------------------

def _config_id(org: Column, system: Column, kind: str, instance: Column) -> Column:
    return ids.build(org, F.lit("config"), system, F.lit(kind), instance)


def dependency_id(org: Column, system: Column, name: Column, version: Column) -> Column:
    """One id for one name and version, whichever file asks for it."""
    return _config_id(org, system, "dependency", ids.short_hash(F.concat(name, F.lit("@"), version)))


def named_or_hashed(name: Column, other: Column) -> Column:
    return ids.let(ids.slugify(name), lambda s: F.when(s == "", ids.short_hash(other)).otherwise(s))


def _spread(rows: DataFrame, subject: Column, facts: list[tuple[str, Column]]) -> DataFrame:
    array = F.array(*[F.struct(F.lit(p).alias("predicate"), o.cast("string").alias("object")) for p, o in facts])
    return rows.select(subject.alias("subject"), F.inline(F.filter(array, lambda r: r["object"].isNotNull())))


def dependency_triples(deps: DataFrame) -> DataFrame:
    """(subject, predicate, object) of (org, system, name, version, dep_kind, and indirect, scope or configuration where the kind has one)."""
    facts = [("dc.terms.title", F.col("name")), ("source.config.dependency-name", F.col("name")), ("source.config.dependency-version", F.col("version")), ("source.config.dependency-kind", F.col("dep_kind"))]
    if "indirect" in deps.columns:
        facts.append(("source.config.dependency-indirect", F.when(F.col("indirect"), "true").when(~F.col("indirect"), "false")))
    facts += [(f"source.config.dependency-{c}", F.when(F.col(c) != "", F.col(c))) for c in ("scope", "configuration") if c in deps.columns]
    return _spread(deps, dependency_id(F.col("org"), F.col("system"), F.col("name"), F.col("version")), facts).distinct()


# What each kind of file's own entity says, and by what edge it needs its dependencies.
PROJECT_FACTS = {
    "gomod": (["module-path", "module-go-version", "file-path"], "requires"),
    "package": (["package-name", "package-version", "file-path"], "depends"),
    "image": (["image-name", "file-path"], None),
    "project": (["project-group-id", "project-artifact-id", "project-version", "project-packaging", "file-path"], "requires"),
    "gradle": (["project-artifact-id", "project-build", "file-path"], "requires"),
}


def project_triples(rows: DataFrame, kind: str) -> DataFrame:
    """(subject, predicate, object) of the entities that stand for build files.

    rows: org, system, name (what the entity is called), file, `values` (an array: the facts of PROJECT_FACTS in order, but the
    last, which is the file), needs (array of dependency ids), parts (array of ids of modules), ports (array).
    """
    names, edge = PROJECT_FACTS[kind]
    entity = "project" if kind == "gradle" else kind
    subject = _config_id(F.col("org"), F.col("system"), entity, named_or_hashed(F.col("name"), F.col("file")))
    facts = [("dc.terms.title", F.col("name"))] + [("source.config." + n, F.element_at("values", i + 1)) for i, n in enumerate(names[:-1])] + [("source.config.file-path", F.col("file"))]
    out = _spread(rows, subject, facts)
    lists = [(edge, "needs"), ("contains", "parts"), ("image-exposed-ports", "ports")]
    for predicate, column in lists:
        if predicate and column in rows.columns:
            out = out.unionByName(rows.select(subject.alias("subject"), F.lit("source.config." + predicate).alias("predicate"), F.explode(column).alias("object")))
    return out.distinct()


def module_triples(rows: DataFrame) -> DataFrame:
    """(subject, predicate, object) of the modules that a project names: (org, system, name, file)."""
    return _spread(rows, module_id(F.col("org"), F.col("system"), F.col("name")), [("dc.terms.title", F.col("name")), ("source.config.module-path", F.col("name")), ("source.config.file-path", F.col("file"))]).distinct()


def module_id(org: Column, system: Column, name: Column) -> Column:
    return _config_id(org, system, "gomod", named_or_hashed(name, name))


# ---- history and media ----------------------------------------------------------------------------------------------

def author_id(org: Column, system: Column, email: Column) -> Column:
    return ids.build(org, F.lit("git"), system, F.lit("author"), ids.sanitize_instance(email))


def commit_triples(commits: DataFrame) -> DataFrame:
    """(subject, predicate, object, datatype) of (org, system, sha, author, email, subject_line, files)."""
    org, system = F.col("org"), F.col("system")
    subject = ids.build(org, F.lit("git"), system, F.lit("commit"), F.substring("sha", 1, 7))
    rows = commits.withColumn("of", subject)
    one = [("dc.terms.title", F.array("subject_line"), None), ("source.git.commit-sha", F.array("sha"), None), ("source.git.commit-short-sha", F.array(F.substring("sha", 1, 7)), None),
           ("source.git.commit-author", F.array("author"), None), ("source.git.commit-subject", F.array("subject_line"), None), ("source.git.commit-touches", F.col("files"), None),
           ("source.git.commit-authored-by", F.when(F.col("email") != "", F.array(author_id(org, system, F.col("email")))), REFERENCE)]
    return unpivot_lists(rows, "of", one).drop("ord")


def author_triples(commits: DataFrame) -> DataFrame:
    """(subject, predicate, object) of each distinct email's author: the name of its first commit (position)."""
    first = commits.groupBy("org", "system", "email").agg(F.min(F.struct("position", "author"))["author"].alias("author"))
    return _spread(first, author_id(F.col("org"), F.col("system"), F.col("email")), [("dc.terms.title", F.col("author")), ("source.git.author-name", F.col("author")), ("source.git.author-email", F.col("email"))])


def branch_triples(branches: DataFrame) -> DataFrame:
    """(subject, predicate, object) of (org, system, branch, head)."""
    subject = ids.build(F.col("org"), F.lit("git"), F.col("system"), F.lit("branch"), ids.sanitize_instance(F.col("branch")))
    return _spread(branches, subject, [("dc.terms.title", F.col("branch")), ("source.git.branch-name", F.col("branch")), ("source.git.branch-head-sha", F.substring("head", 1, 7))])


# What a medium of each type says, in order; a storage or thumbnail reference only where there is one.
MEDIA_FACTS = {
    "image": ["file-path", "mime-type", "file-hash", "file-size", "format", "width", "height"],
    "video": ["file-path", "mime-type", "file-hash", "file-size", "format", "duration", "frame-rate", "width", "height", "codec", "bitrate", "keyframe-count"],
    "audio": ["file-path", "mime-type", "file-hash", "file-size", "format", "duration", "codec", "bitrate", "sample-rate", "channels", "bit-depth"],
    "keyframe": ["timestamp", "frame-index", "width", "height"],
    "blob": ["mime-type", "file-path", "file-hash", "file-size", "format", "byte-range", "extraction-finding"],
}


def media_triples(media: DataFrame, kind: str) -> DataFrame:
    """(subject, predicate, object, datatype) of (id, storage_ref, thumbnail_ref or keyframe_of where the kind has one, and a column for each fact, with _ for -)."""
    facts = [("source.media.type", F.lit("binary" if kind == "blob" else kind), None)] + [("source.media." + f, F.col(f.replace("-", "_")), None) for f in MEDIA_FACTS[kind]]
    facts += [("source.media." + f, F.when(F.col(c) != "", F.col(c)), t) for f, c, t in (("storage-ref", "storage_ref", None), ("thumbnail-ref", "thumbnail_ref", None), ("keyframe-of", "keyframe_of", REFERENCE)) if c in media.columns]
    return unpivot(media, "id", facts).drop("ord")


VISION = ("labels", "description", "confidence", "objects", "text", "model")
VISION_BYTES = 10 << 20


def vision_triples(media: DataFrame, see: Column) -> DataFrame:
    """(subject, predicate, object) that a provider's answer adds to images and keyframes with a storage reference and 10 MiB at most.

    `see` is the provider: a column of a struct with the fields of VISION, such as a pandas UDF of the stored bytes gives.
    """
    wanted = media.where(F.col("type").isin("image", "keyframe") & (F.coalesce("storage_ref", F.lit("")) != "") & (F.col("size") <= VISION_BYTES)).withColumn("seen", see)
    return _spread(wanted, F.col("id"), [("source.media.vision-" + f, F.col(f"seen.{f}")) for f in VISION])


def hierarchy(paths: DataFrame, path: str = "path") -> DataFrame:
    """(folder, depth, parent, children): every ancestor folder of slash-separated file paths; '' is the root."""
    parts = F.filter(F.split(F.col(path), "/"), lambda p: p != "")
    chain = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(
        F.array_join(F.slice(parts, 1, n), "/").alias("node"), F.array_join(F.slice(parts, 1, n - 1), "/").alias("folder"), (n - 1).alias("depth")))
    links = paths.where(F.size(parts) > 0).select(F.inline(chain)).distinct()
    parent = F.when(F.col("folder") == "", F.lit(None)).otherwise(F.regexp_replace("folder", "/?[^/]*$", ""))
    return links.groupBy("folder", "depth").agg(F.count("*").alias("children")).select("folder", F.col("depth").cast("int").alias("depth"), parent.alias("parent"), "children")


def stamp_class(entities: DataFrame) -> DataFrame:
    """Adds class: (domain, kind) first, then kind alone; null where none is known. The table has a fixed 29 rows."""
    t = F.broadcast(vocab.class_of(entities.sparkSession))
    own = t.where("domain IS NOT NULL").select("domain", "kind", F.col("class").alias("c1"))
    any_ = t.where("domain IS NULL").select("kind", F.col("class").alias("c2"))
    return entities.join(own, ["domain", "kind"], "left").join(any_, "kind", "left").withColumn("class", F.coalesce("c1", "c2")).drop("c1", "c2")


def class_distance(spark: SparkSession, pairs: DataFrame) -> DataFrame:
    """(a, b, distance) over classes: steps through their lowest common ancestor, -1 where there is none."""
    up = F.broadcast(spark.createDataFrame(vocab.closure(), "class string, anc string, steps int"))
    a = up.select(F.col("class").alias("a"), "anc", F.col("steps").alias("sa"))
    b = up.select(F.col("class").alias("b"), "anc", F.col("steps").alias("sb"))
    met = a.join(b, "anc").groupBy("a", "b").agg(F.min(F.col("sa") + F.col("sb")).alias("d"))
    return pairs.join(met, ["a", "b"], "left").select("a", "b", F.coalesce("d", F.lit(-1)).cast("int").alias("distance"))


def bodies(texts: DataFrame, text: str, prefix: str, content_type: str) -> DataFrame:
    """(key, size, content_type, copies): content-addressed, each once; an empty body has no row."""
    key = F.concat(F.lit(prefix + ":"), F.sha2(F.col(text), 256))
    return texts.where(F.col(text) != "").groupBy(key.alias("key"), F.octet_length(text).cast("long").alias("size")).agg(F.count("*").alias("copies")).withColumn("content_type", F.lit(content_type))


def body_slice(text: Column, start: Column, end: Column) -> Column:
    """Lines start to end of a text, counted from 1, the end clamped."""
    lines = F.split(text, "\n")
    return F.array_join(F.slice(lines, start, F.greatest(F.least(end, F.size(lines)) - start + 1, F.lit(0))), "\n")


def validate(triples: DataFrame) -> DataFrame:
    """Adds reason: why an entity's row can't be stored, or null. From (subject, id, profile)."""
    return triples.withColumn("reason", F.when(~ids.valid_key(F.col("id")), "illegal key").when(~ids.valid_id(F.col("id")), "malformed id").when(F.col("subject") != F.col("id"), "foreign subject")
                              .when(F.col("profile").isNull(), "no profile").when(~F.col("profile").isin("content", "control", "signal", "trace"), "unknown profile"))
