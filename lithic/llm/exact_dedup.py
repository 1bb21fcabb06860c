"""Exact dedup against a persistent digest index.

The index is a table bucketed and sorted by digest. A batch is reduced to one row per digest (partial aggregation, so a
text that a third of all rows share costs one row per task), anti-joined with the index bucket by bucket, and what is new
is appended. Rows then meet their group's decision in a join that AQE can split, never in one task.

Defined results: null text counts as empty, all empty texts are one group; a null id sorts last and may stay; repeated
rows (same id, same text) keep exactly one; an empty table gives no rows; other columns are never looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithic.llm.common import OWN, WHITE, stage, text_or_empty, unstage


#: Groups are broadcast up to this many (some 120 bytes each: 24 MB); beyond it they are joined by a shuffle.
BROADCAST_GROUPS = 200_000


def normalised(text):
    """Text without white space."""
    return F.regexp_replace(text_or_empty(text), WHITE + "+", "")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(uid, id, digest, n_points) of each row; n_points counts the code points of the original text."""
    return docs.select(
        F.monotonically_increasing_id().alias("uid"),
        F.col(id_col).alias("id"),
        F.sha2(normalised(text_col), 256).alias("digest"),
        F.length(text_or_empty(text_col)).cast("long").alias("n_points"),
    )


def grouped(rows: DataFrame) -> DataFrame:
    """One row per digest: its best row (longest original, smallest id) and its size."""
    best = F.min(F.struct((-F.col("n_points")).alias("neg"), F.col("id").isNull().alias("no_id"), "id", "uid"))
    return rows.groupBy("digest").agg(best.alias("best"), F.count("*").alias("n_rows")).select(
        "digest", F.col("best.id").alias("keep_id"), F.col("best.uid").alias("keep_uid"), (-F.col("best.neg")).alias("keep_points"), "n_rows")


#: Digests that a bucket of a new index is meant to hold, and the least and most buckets.
PER_BUCKET, LEAST_BUCKETS, MOST_BUCKETS = 1_000_000, 64, 1 << 16


class DigestIndex:
    """A table of the catalog, bucketed and sorted by digest: digest, keep_id, keep_points, n_rows, batch, fresh.

    Rows are only ever appended: one per digest that a batch brings, which is fresh where no earlier batch held it. A batch is
    known by its name: one that is added again, after a crash before its result was used, gets the same result and is
    recorded once. The number of buckets is chosen by the first batch, unless it is given.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None):
        self.spark, self.name, self.buckets = spark, name, buckets

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def read(self) -> DataFrame:
        """(digest, keep_id, keep_points, n_rows): one row per known digest, n_rows over all batches; a bucket is read by itself."""
        return _known(self.rows())

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def _count_buckets(self, groups: DataFrame) -> int:
        if self.exists():
            held = self.spark.sql(f"DESCRIBE EXTENDED {self.name}").where("col_name = 'Num Buckets'").first()
            return int(held["data_type"])
        return self.buckets or min(max(LEAST_BUCKETS, 1 << (groups.count() // PER_BUCKET).bit_length()), MOST_BUCKETS)

    def _append(self, new: DataFrame, buckets: int) -> None:
        (new.repartition(buckets, "digest").write.mode("append").format("parquet")
         .bucketBy(buckets, "digest").sortBy("digest").saveAsTable(self.name))

    def add(self, rows: DataFrame, batch: str = "0") -> DataFrame:
        """Adds a batch of digests() rows and returns a decision per digest of the batch.

        (digest, keep_id, keep_uid, group_size): keep_uid is null where an earlier batch already holds the text; group_size
        counts the batch's rows and those of all earlier batches.
        """
        groups = stage(grouped(rows), "exact-groups")
        buckets = self._count_buckets(groups)
        columns = ["digest", "keep_id", "keep_points", "n_rows", F.lit(batch).alias("batch")]
        # An index that isn't there yet holds nothing: its first batch is anti-joined with no rows.
        if not self.exists():
            self._append(groups.limit(0).select(*columns, F.lit(True).alias("fresh")), buckets)
        before = self.rows().where(F.col("batch") != batch)
        keyed = groups.repartition(buckets, "digest")
        new = keyed.join(before.where("fresh").select("digest").hint("merge"), "digest", "left_anti")
        # Old digests are looked up before the append, so that the append can't be read half done.
        known = _known(before).select("digest", F.col("keep_id").alias("old_id"), F.col("n_rows").alias("old_rows"))
        old = keyed.join(known.hint("merge"), "digest")
        decided = stage(
            new.select("digest", "keep_id", "keep_uid", "keep_points", "n_rows", F.col("n_rows").alias("group_size"), F.lit(True).alias("fresh"))
            .unionByName(old.select("digest", F.col("old_id").alias("keep_id"), F.lit(None).cast("long").alias("keep_uid"), "keep_points", "n_rows",
                                    (F.col("n_rows") + F.col("old_rows")).alias("group_size"), F.lit(False).alias("fresh"))),
            "exact-decided")
        if self.rows().where(F.col("batch") == batch).isEmpty():
            self._append(decided.select(*columns, "fresh"), buckets)
        unstage(groups)
        return decided


def _known(rows: DataFrame) -> DataFrame:
    first = lambda c: F.max(F.when(F.col("fresh"), F.col(c))).alias(c)
    return rows.groupBy("digest").agg(first("keep_id"), first("keep_points"), F.sum("n_rows").alias("n_rows"))


def dedup_rows(index: DigestIndex, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str = "0") -> DataFrame:
    """A row per document of the batch: id, keep_id, group_size, kept, digest."""
    rows = stage(digests(docs, id_col, text_col), "exact-rows")
    decided = index.add(rows, batch)
    found = decided.select("digest", "keep_id", "keep_uid", "group_size")
    return rows.join(found, "digest").select(
        "id", "keep_id", "group_size", F.coalesce(F.col("uid") == F.col("keep_uid"), F.lit(False)).alias("kept"), "digest")


def dedup(index: DigestIndex, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str = "0") -> DataFrame:
    """The batch's documents that stay, with all their columns.

    Only texts that occur more than once, or that the index held, are looked up; the look-up is broadcast while it has at
    most BROADCAST_GROUPS rows. Of rows that share the best place in their group, with one id, one stays.
    """
    rows = stage(digests(docs, id_col, text_col), "exact-rows")
    decided = index.add(rows, batch)
    ties = rows.groupBy("digest", "id", "n_points").agg(F.count("*").alias("ties")).where("ties > 1")
    d, n, k, p, t, b = (OWN + x for x in ("digest", "points", "keep", "keep_points", "ties", "first"))
    groups = decided.where("n_rows > 1 OR NOT fresh").join(
        ties, (decided["digest"] == ties["digest"]) & decided["keep_id"].eqNullSafe(ties["id"]) & (decided["keep_points"] == ties["n_points"]), "left")
    groups = stage(groups.select(decided["digest"].alias(d), F.col("keep_id").alias(k), F.col("keep_points").alias(p), (F.col("ties") > 1).alias(t), F.col("fresh").alias(b)), "exact-looked-up")
    side = F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups
    whole = docs.withColumns({OWN + "own": F.sha2(normalised(text_col), 256), n: F.length(text_or_empty(text_col)).cast("long")}).join(side, F.col(OWN + "own") == F.col(d), "left")
    best = F.col(b) & F.col(id_col).eqNullSafe(F.col(k)) & (F.col(n) == F.col(p))
    kept = whole.where(F.col(d).isNull() | (best & F.col(t).isNull()))
    if groups.where(F.col(t) & F.col(b)).limit(1).count():
        kept = kept.unionByName(whole.where(best & F.col(t)).dropDuplicates([d]))
    return kept.select(*docs.columns)
