"""Resolve, expand, rank and assemble: from a question to ranked evidence."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lithic import vocab

# Fixed values of the answer surface.
SEEDS = 40
PER_ROLE = 12
MOST_IMPACT = 1000
MOST_SCANNED = 200_000
# Query vectors that one pass sends to all tasks.
MOST_QUERIES = 10_000
CODE_SUFFIXES = tuple(e for e, _ in vocab.ROUTES)
DOC_SUFFIXES = (".adoc", ".md", ".mdx", ".txt")
WANTS = {"callers": ("body", "relations"), "callees": ("body", "relations"), "impact": ("body", "impact", "relations"), "file": ("body",), "search": ("body",)}


def mode(query: str, lens: str = "code") -> str:
    """nl for several words, prefix for something like a path, else symbol (code) or nl (docs)."""
    q = query.strip()
    if re.search(r"\s", q):
        return "nl"
    if "/" in q or (lens == "code" and "\\" in q) or q.endswith(CODE_SUFFIXES if lens == "code" else DOC_SUFFIXES):
        return "prefix"
    return "symbol" if lens == "code" else "nl"


def scoped(entities: DataFrame, domains: tuple[str, ...]) -> DataFrame:
    """A scope as IN over the partition column, which prunes files."""
    return entities.where(F.col("domain").isin(*domains))


def by_prefix(entities: DataFrame, prefix: str, most: int | None = None) -> DataFrame:
    """Ids under a prefix in order; with `most`, that many and a truncated flag."""
    found = entities.where(F.col("id").startswith(prefix))
    if most is None:
        return found
    return found.orderBy("id").limit(most).withColumn("truncated", F.lit(found.limit(most + 1).count() > most))


def resolve_names(names: DataFrame, query: Column, exact: bool = False) -> DataFrame:
    """(name, id, exact): by case-folded name, exact case marked; with exact only those."""
    found = names.where(F.lower("name") == F.lower(F.trim(query))).withColumn("exact", F.col("name") == F.trim(query))
    return found.where("exact") if exact else found


def did_you_mean(names: DataFrame, query: str, most: int = 3) -> DataFrame:
    """(name, distance): the nearest distinct names, a report of `most` rows."""
    return names.select("name").distinct().select("name", F.levenshtein(F.lower("name"), F.lit(query.lower())).alias("distance")).orderBy("distance", "name").limit(most)


def live_edges(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges whose target exists; markers and dangling ids fall away."""
    return edges.join(entities.select(F.col("id").alias("dst")), "dst", "left_semi")


def neighbors(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, role, other): both directions of typed edges, named by role. The role table has a fixed seven rows."""
    roles = F.broadcast(edges.sparkSession.createDataFrame(vocab.EDGE_ROLES, "predicate string, out string, `in` string"))
    typed = edges.join(roles, "predicate")
    out = typed.join(seeds.select(F.col("id").alias("src")), "src").select(F.col("src").alias("id"), F.col("out").alias("role"), F.col("dst").alias("other"))
    back = typed.join(seeds.select(F.col("id").alias("dst")), "dst").select(F.col("dst").alias("id"), F.col("in").alias("role"), F.col("src").alias("other"))
    return out.unionByName(back)


def relations(found: DataFrame, most: int = PER_ROLE) -> DataFrame:
    """At most so many neighbours per entity and role, in order (row_number under a bound: pruned before the shuffle)."""
    rank = F.row_number().over(W.partitionBy("id", "role").orderBy("other"))
    return found.withColumn("rank", rank).where(F.col("rank") <= most)


def impact(seeds: DataFrame, edges: DataFrame, most_depth: int = 12) -> DataFrame:
    """(seed, id, depth): what depends on each seed through edges of impact, by its shortest way.

    Breadth first, frontier by frontier: each round joins the frontier with the edges and drops what was reached, and its
    result is written to the shared folder, so plans stay short and a lost executor costs one round.
    """
    hops = edges.where(F.col("predicate").isin(*vocab.IMPACT)).select(F.col("dst").alias("at"), F.col("src").alias("next")).distinct()
    frontier = seeds.select(F.col("id").alias("seed"), F.col("id").alias("at")).distinct()
    reached = frontier.select("seed", F.col("at").alias("id"), F.lit(0).alias("depth"))
    for depth in range(1, most_depth + 1):
        new = frontier.join(hops, "at").select("seed", F.col("next").alias("id")).distinct().join(reached, ["seed", "id"], "left_anti")
        new = _checkpointed(new.withColumn("depth", F.lit(depth)))
        if new.isEmpty():
            break
        reached = reached.unionByName(new)
        frontier = new.select("seed", F.col("id").alias("at"))
    return reached.where("depth > 0")


def paths(starts: DataFrame, edges: DataFrame, most_steps: int) -> DataFrame:
    """(start, path, steps): every walk along (src, dst) from each start (id), its nodes joined by >, up to so many steps.

    One join per step: a recursive query would stop at Spark's limit of rows. The exchanges of a step are the same in all later
    ones and are reused; cycles end with the steps.
    """
    hops = edges.select(F.col("src").alias("at"), "dst")
    walks = starts.select(F.col("id").alias("start"), F.col("id").alias("at"), F.col("id").alias("path"))
    rounds = []
    for _ in range(most_steps):
        walks = walks.join(hops, "at").select("start", F.col("dst").alias("at"), F.concat("path", F.lit(">"), "dst").alias("path"))
        rounds.append(walks.select("start", "path", F.lit(len(rounds) + 1).alias("steps")))
    return reduce(DataFrame.unionByName, rounds)


def _shared(spark: SparkSession) -> str:
    """The folder that driver and executors share; in local mode, where none is named, one of our own."""
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        named = "file://" + tempfile.mkdtemp(prefix="lithic-")
    spark.sparkContext.setCheckpointDir(named)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def _checkpointed(df: DataFrame) -> DataFrame:
    _shared(df.sparkSession)
    return df.checkpoint()


def rank(seeds: DataFrame, query: str, labels: DataFrame, depth: DataFrame, salience: DataFrame) -> DataFrame:
    """(id, score) from (id, i): seed order, whole-query match of the label, ontology depth, salience."""
    q, label = F.lit(query.strip()), F.coalesce(F.col("label"), F.lit(""))
    lexical = F.when(label == q, 3.0).when(F.lower(label) == F.lower(q), 2.0).when(F.lower(label).startswith(F.lower(q)), 1.0).otherwise(0.0)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    score = 4.0 * (SEEDS - F.col("i")) + lexical + 1.5 * zero("specificity") + 3.0 * zero("salience")
    return seeds.join(labels, "id", "left").join(depth, "id", "left").join(salience, "id", "left").select("id", score.alias("score"))


def salience(triples: DataFrame) -> DataFrame:
    """(id, salience): the highest positive weight of an entity's predicates and the lowest negative one, added."""
    w = F.broadcast(vocab.weights(triples.sparkSession))  # ten fixed rows
    found = triples.join(w, "predicate").groupBy(F.col("subject").alias("id")).agg(F.max("weight").alias("up"), F.min("weight").alias("down"))
    return found.select("id", (F.greatest("up", F.lit(0.0)) + F.least("down", F.lit(0.0))).alias("salience"))


def budget(ranked: DataFrame, most_nodes: int, most_bytes: int) -> DataFrame:
    """The best nodes up to a number and a running sum of bytes; the answer is a list of bounded length."""
    top = ranked.orderBy(F.desc("score"), "id").limit(most_nodes)
    run = W.orderBy(F.desc("score"), "id").rowsBetween(W.unboundedPreceding, W.currentRow)
    return top.withColumn("bytes_so_far", F.sum("bytes").over(run)).where(F.col("bytes_so_far") <= most_bytes)


def without_navigation(nodes: DataFrame) -> DataFrame:
    """Drops bodyless documents and unknowns from an answer, unless nothing would be left. Answers are small."""
    nav = (F.col("body") == "") & F.col("kind").isin("document", "unknown")
    left = F.sum(F.when(~nav, 1).otherwise(0)).over(W.partitionBy("answer"))
    return nodes.withColumn("left", left).where(~nav | (F.col("left") == 0)).drop("left")


# ---- lexical and vector search --------------------------------------------------------------------------------------

def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def bm25(docs: DataFrame, query: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score) of documents (id, text) that hold a query term: Lucene's idf, one scan for lengths and one for terms.

    Only the query's terms are exploded, so what is shuffled grows with the hits.
    """
    terms = sorted({w.lower() for w in query})
    words = docs.select("id", tokens(F.col("text")).alias("w"))
    stats = words.agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("avg")).first()
    n, avg = stats["n"], stats["avg"] or 1.0
    hits = words.select("id", F.size("w").alias("len"), F.explode(F.filter("w", lambda w: w.isin(*terms))).alias("term"))
    tf = hits.groupBy("id", "len", "term").agg(F.count("*").alias("tf"))
    df = F.broadcast(tf.groupBy("term").agg(F.count("*").alias("df")))  # one row per query term
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / avg))
    return tf.join(df, "term").groupBy("id").agg(F.sum(part).alias("score"))


def cosine(vectors: DataFrame, queries: DataFrame, most: int) -> DataFrame:
    """(query, id, score, rank): the nearest rows to each query vector.

    Up to MOST_QUERIES queries are broadcast; more go in blocks of about half as many, each block's answer checkpointed
    before the next is sent.
    """
    n = queries.count()
    if n <= MOST_QUERIES:
        return _cosine(vectors, queries, most)
    blocks = -(-2 * n // MOST_QUERIES)
    of = F.pmod(F.xxhash64("id"), F.lit(blocks))
    out = None
    for k in range(blocks):
        found = _checkpointed(_cosine(vectors, queries.where(of == k), most))
        out = found if out is None else out.unionByName(found)
    return out


def _cosine(vectors: DataFrame, queries: DataFrame, most: int) -> DataFrame:
    """The queries (at most MOST_QUERIES) are sent to all tasks; a task multiplies them with its vectors batch by batch and keeps its best of each."""
    from collections.abc import Iterator

    import numpy as np
    import pyarrow as pa

    kind = vectors.schema["id"].dataType.simpleString()
    got = queries.where("embedding IS NOT NULL").select("id", F.col("embedding").cast("array<double>").alias("embedding")).toArrow()
    sent = vectors.sparkSession.sparkContext.broadcast((got.column(0).combine_chunks(), _matrix(got.column(1).combine_chunks())))

    def best(query, score, ids):
        order = np.lexsort((ids, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        return [x[place < most] for x in (query, score, ids)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = sent.value
        names_np = names.to_numpy(zero_copy_only=False)
        held, size, floor = [], 0, np.full(len(names), -np.inf)
        id_type = None
        for whole in batches:
            id_type = whole.schema.field(0).type
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                own, v = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1))
                if not len(names) or not len(own):
                    continue
                s = np.round(v @ q.T, 9)
                s[own[:, None] == names_np[None, :]] = -np.inf
                k = min(most, len(own))
                least = np.maximum(np.partition(s, len(own) - k, axis=0)[len(own) - k], floor)
                row, query = np.nonzero((s >= least) & (s > -np.inf))
                held.append((query, s[row, query], own[row]))
                size += len(row)
                if size > 8 * most * len(names):
                    held = [best(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                    size = len(held[0][0])
                    full = np.bincount(held[0][0], minlength=len(names)) >= most
                    low = np.full(len(names), np.inf)
                    np.minimum.at(low, held[0][0], held[0][1])
                    floor = np.where(full, low, -np.inf)
        if held:
            query, score, ids = best(*(np.concatenate(x) for x in zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([names.take(pa.array(query)), pa.array(ids, id_type), pa.array(score)], names=["query", "id", "score"])

    scored = vectors.where("embedding IS NOT NULL").select("id", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, f"query {kind}, id {kind}, score double")
    order = W.partitionBy("query").orderBy(F.desc("score"), "id")  # at most `most` rows of a task and query
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def _matrix(column):
    """Rows of one length as a matrix of unit vectors."""
    import numpy as np

    m = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True)) if len(m) else m


# ---- search answers -------------------------------------------------------------------------------------------------

def disclosure(has_answer: Column, has_model: Column, has_summaries: Column, n_entities: Column) -> Column:
    """Which rung of retrieval an answer came from."""
    return F.when(has_answer & has_model, "llm_answer").when(has_summaries, "community_summaries").when(n_entities > 0, "entities_only").otherwise("unknown")


def matches(found: DataFrame, most: int = 25) -> DataFrame:
    """The first rows of each search with its total and whether it was cut: a report of at most `most` rows a query."""
    rows = W.partitionBy("query")
    ranked = found.withColumns({"rank": F.row_number().over(rows.orderBy("ord")), "total": F.count("*").over(rows)})
    return ranked.where(F.col("rank") <= most).withColumn("truncated", F.col("total") > most)


def with_fallback(global_search: DataFrame, semantic: DataFrame) -> DataFrame:
    """The global search's rows per query, else the semantic ones, labelled so."""
    first = global_search.withColumn("via", F.lit("global_search"))
    rest = semantic.join(global_search.select("query").distinct(), "query", "left_anti").withColumn("via", F.lit("global_search_empty_semantic_fallback"))
    return first.unionByName(rest)


def short_value(value: Column, most: int = 160) -> Column:
    """A value of at most so many UTF-8 bytes; a cut one ends in an ellipsis, never inside a character."""
    chars = F.transform(F.sequence(F.lit(1), F.lit(most)), lambda i: F.substring(value, F.lit(1), i))
    cut = F.element_at(F.filter(chars, lambda c: F.octet_length(c) <= most - 3), -1)
    return F.when(F.octet_length(value) <= most, value).otherwise(F.concat(cut, F.lit("…")))
