"""Correspondence of entities across versions: lineage, changesets, staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lithic.functions import text
from lithic.operators.retrieval import _checkpointed

#: What makes two versioned entities the same thing.
KEY = ["org", "project", "path", "name", "ctype", "pkg"]


def candidates(triples: DataFrame) -> DataFrame:
    """(id, org, project, version, path, name, ctype, pkg, body_hash, body_hash_kind): entities with a version.

    From (subject, ord, predicate, object); of several values the first counts, and a body key goes before a file hash.
    """
    first = lambda p: F.min(F.when(F.col("predicate") == p, F.struct("ord", "object")))["object"]
    out = triples.repartition("subject").groupBy(F.col("subject").alias("id")).agg(  # it sorts: dealt out first, as in answers.nodes
        first("code.artifact.project").alias("project"), first("code.artifact.version").alias("version"), first("code.artifact.path").alias("path"), first("dc.terms.title").alias("name"),
        first("code.artifact.type").alias("ctype"), first("code.artifact.package").alias("pkg"), first("code.body.key").alias("k"), first("code.artifact.hash").alias("h")).where("version <> ''")
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    kind = F.when(empty("k") != "", "bodykey").when(empty("h") != "", "hash").otherwise("")
    hash_ = F.when(empty("k") != "", F.col("k")).otherwise(empty("h"))
    return out.select("id", F.substring_index("id", ".", 1).alias("org"), *[empty(c).alias(c) for c in ("project", "version", "path", "name", "ctype", "pkg")], hash_.alias("body_hash"), kind.alias("body_hash_kind"))


def _change(old_hash: Column, old_kind: Column, new_hash: Column, new_kind: Column) -> Column:
    """changed or unchanged, or null where the hashes can't be compared."""
    return F.when((old_hash == "") | (new_hash == "") | (old_kind != new_kind), F.lit(None)).when(old_hash == new_hash, "unchanged").otherwise("changed")


def adjacent(cands: DataFrame) -> DataFrame:
    """(older, newer, comparable, change): neighbours in the version order of each group of corresponding entities."""
    order = W.partitionBy(*KEY).orderBy(text.version_key(F.col("version")), "id")
    rows = cands.select(*KEY, F.col("id").alias("newer"), F.col("version").alias("v"), F.col("body_hash").alias("h"), F.col("body_hash_kind").alias("k"),
                        *[F.lag(c).over(order).alias(a) for c, a in (("id", "older"), ("version", "ov"), ("body_hash", "oh"), ("body_hash_kind", "ok"))])
    new, old = F.col("v"), F.col("ov")
    same = text.is_semver(new) == text.is_semver(old)
    differ = F.when(text.is_semver(new), text.semver_key(new) != text.semver_key(old)).otherwise(new != old)
    return rows.where("older IS NOT NULL").select("older", "newer", (same & differ).alias("comparable"), _change(F.col("oh"), F.col("ok"), F.col("h"), F.col("k")).alias("change"))


def lineage(cands: DataFrame) -> DataFrame:
    """(subject, predicate, object): supersedes, its inverse, and the change where known."""
    pairs = adjacent(cands).where("comparable")
    row = lambda s, p, o: F.struct(s.alias("subject"), F.lit(p).alias("predicate"), o.alias("object"))
    rows = F.array(row(F.col("newer"), "code.lineage.supersedes", F.col("older")), row(F.col("older"), "code.lineage.superseded-by", F.col("newer")), row(F.col("newer"), "code.lineage.change", F.col("change")))
    return pairs.select(F.inline(F.filter(rows, lambda r: r["object"].isNotNull())))


def delta(desired: DataFrame, existing: DataFrame) -> DataFrame:
    """What is desired and not there yet: appending it is idempotent."""
    return desired.join(existing, ["subject", "predicate", "object"], "left_anti")


def pass_stats(cands: DataFrame) -> DataFrame:
    pairs = adjacent(cands).agg(F.count(F.when(F.col("comparable"), 1)).alias("supersedes"), F.count(F.when(~F.col("comparable"), 1)).alias("incomparable"),
                                F.count(F.when(F.col("comparable") & (F.col("change") == "changed"), 1)).alias("changed"), F.count(F.when(F.col("comparable") & (F.col("change") == "unchanged"), 1)).alias("unchanged"))
    sizes = cands.groupBy(*KEY).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("entities"), F.count("*").alias("groups"), F.count(F.when(F.col("n") > 1, 1)).alias("corresponding"))
    return sizes.join(pairs, how="cross")  # one row beside one row


def diff(cands: DataFrame, project: str, old: str, new: str) -> DataFrame:
    """(KEY, status, old_id, new_id): the newest entity of each side; unchanged ones included."""
    # The aggregate sorts: rows are dealt out first, as in answers.nodes.
    side = lambda v, p: cands.where((F.col("project") == project) & (F.col("version") == v)).repartition(*KEY).groupBy(*KEY).agg(F.max(F.struct("indexed_at", "id", "body_hash", "body_hash_kind")).alias(p))
    both = side(old, "o").join(side(new, "n"), KEY, "full_outer")
    change = _change(F.col("o.body_hash"), F.col("o.body_hash_kind"), F.col("n.body_hash"), F.col("n.body_hash_kind"))
    status = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise(F.coalesce(change, F.lit("indeterminate")))
    return both.select(*KEY, status.alias("status"), F.col("o.id").alias("old_id"), F.col("n.id").alias("new_id"))


def changeset(changes: DataFrame, most: int = 2000) -> DataFrame:
    """What the answer lists: all but the unchanged, in order, at most so many."""
    return changes.where("status <> 'unchanged'").orderBy("path", "pkg", "name", "status", "ctype").limit(most)


def within_budget(rows: DataFrame, order: list[str], size: str, most: int) -> DataFrame:
    """The rows of a list of bounded length (a changeset) whose bodies fit a byte budget, greedily: one too large is passed over.

    Only the list itself goes to one task; what it is made from stays in as many as it has.
    """
    from collections.abc import Iterator

    import pandas as pd

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = pd.concat(list(parts))
        left, keep = most, []
        for n in whole[size].fillna(0):
            keep.append(n <= left)
            left -= n if n <= left else 0
        yield whole[keep]

    return rows.repartition(1).sortWithinPartitions(*order).mapInPandas(run, rows.schema)


# ---- staleness ------------------------------------------------------------------------------------------------------

def staleness(entities: DataFrame, live: DataFrame) -> DataFrame:
    """(id, action, reason): marks and clearings that the live paths call for. From (id, path, kind, chunk_index, chunk_count, marked)."""
    count = entities.where("kind = 'document'").groupBy("path").agg(F.max("chunk_count").alias("chunks"))
    seen = live.select("path").distinct().withColumn("alive", F.lit(True))
    rows = entities.where("path IS NOT NULL").join(seen, "path", "left").join(count, "path", "left")
    passage, vanished = F.col("kind") == "passage", F.col("chunk_index") >= F.col("chunks")
    reason = F.when(F.col("alive").isNull(), "file_deleted").when(passage & vanished, "passage_removed")
    clear = F.col("alive") & F.col("marked") & ~(passage & (vanished | F.col("chunks").isNull()))
    action = F.when(reason.isNotNull() & ~F.col("marked"), "mark").when(F.coalesce(clear, F.lit(False)), "clear")
    return rows.select("id", action.alias("action"), F.when(action == "mark", reason).alias("reason")).where("action IS NOT NULL")


def in_scope(entities: DataFrame, org: str, platform: str, systems: list[str]) -> DataFrame:
    """Entities (id) of an organisation whose system is one of those given."""
    parts = F.split("id", r"\.")
    return entities.where(F.col("id").startswith(f"{org}.{platform}.") & F.coalesce(F.try_element_at(parts, F.lit(4)).isin(*systems), F.lit(False)))


def source_removed(entities: DataFrame, reason: str = "source_removed") -> DataFrame:
    """(id, action, reason): with no folder to look at, every entity in scope that isn't marked yet is marked; none is deleted. From (id, marked)."""
    return entities.where(~F.coalesce("marked", F.lit(False))).select("id", F.lit("mark").alias("action"), F.lit(reason).alias("reason"))


def root_missing(entities: DataFrame, present: bool, frozen: list[str] | None = None) -> DataFrame:
    """(id, action, reason) for a source whose folder isn't there: path_missing, but for frozen systems, which are never marked."""
    if present:
        return source_removed(entities).limit(0)
    system = F.try_element_at(F.split("id", r"\."), F.lit(4))
    return source_removed(entities.where(~system.isin(*(frozen or [""]))), "path_missing")


def diff_counters(changes: DataFrame, sizes: DataFrame, most: int = 2000, most_bytes: int = 512 * 1024) -> DataFrame:
    """One row (listed, dropped, bodies, omitted, failed): how much of a changeset an answer shows.

    sizes (key of changes, size): the bytes of a change's body, null where it couldn't be read. Bodies that don't fit the
    budget are passed over, smaller ones after them still count.
    """
    shown = _checkpointed(changeset(changes, most))  # a list of bounded length, made once
    total = changes.where("status <> 'unchanged'").count()
    own = sizes.join(F.broadcast(shown.select(*KEY).distinct()), KEY, "left_semi")
    rows = _checkpointed(shown.join(own, KEY, "left"))
    fit = within_budget(rows.where("size IS NOT NULL"), ["path", "pkg", "name", "status", "ctype"], "size", most_bytes)
    n, readable, kept = shown.count(), rows.where("size IS NOT NULL").count(), fit.count()
    return changes.sparkSession.createDataFrame([(n, total - n, kept, readable - kept, n - readable)], "listed long, dropped long, bodies long, omitted long, failed long")


def reconcile_markers(triples: DataFrame, actions: DataFrame, predicate: str = "entity.lifecycle.stale") -> DataFrame:
    """The triples with each acted-on entity's marker group replaced: exactly one marker, or none. Idempotent."""
    kept = triples.join(actions.select(F.col("id").alias("subject"), F.lit(predicate).alias("predicate")).distinct(), ["subject", "predicate"], "left_anti")
    new = actions.where("action = 'mark'").select(F.col("id").alias("subject"), F.lit(predicate).alias("predicate"), F.col("reason").alias("object"))
    return kept.unionByName(new)
