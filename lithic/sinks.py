"""Where results are kept: entity triples, bodies by key, snapshots. Every write is idempotent, so a job that runs again changes nothing."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithic.sources.plane import key_contained


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


class Versioned:
    """A table of Parquet folders, one per write, and a pointer to the last: readers never see half a write."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _last(self) -> int | None:
        held = _read(self.spark, f"{self.root}/pointer")
        return None if held is None else held.agg(F.max("version")).first()[0]

    def read(self) -> DataFrame | None:
        last = self._last()
        return None if last is None else self.spark.read.parquet(f"{self.root}/v{last}")

    def replace(self, rows: DataFrame, partition_by: list[str] | None = None) -> None:
        version = (self._last() or 0) + 1
        writer = rows.write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.root}/v{version}")
        self.spark.createDataFrame([(version,)], "version long").coalesce(1).write.mode("append").parquet(f"{self.root}/pointer")


class EntityStore(Versioned):
    """Triples (subject, predicate, object, ...), partitioned by the domain of their subject."""

    def put(self, triples: DataFrame, append_only: list[str] | None = None) -> None:
        """Replaces, of the subjects and predicates that triples has, what was stored; those of append_only predicates are added to."""
        new = triples.distinct().withColumn("domain", F.element_at(F.split("subject", r"\."), 3))
        old = self.read()
        if old is not None:
            replaced = new.where(~F.col("predicate").isin(*(append_only or [""]))).select("subject", "predicate").distinct()
            new = old.join(replaced, ["subject", "predicate"], "left_anti").unionByName(new.select(*old.columns)).distinct()
        self.replace(new, ["domain"])


class BodyStore(Versioned):
    """Bodies (key, body): one per key, the last put stays; keys that could leave the store are refused."""

    def put(self, bodies: DataFrame) -> None:
        if not bodies.where(~F.coalesce(key_contained(F.col("key")), F.lit(False))).isEmpty():
            raise ValueError("a key is empty, or holds a segment of two dots")
        new = bodies.select("key", "body").groupBy("key").agg(F.max("body").alias("body"))
        old = self.read()
        self.replace(new if old is None else old.join(new.select("key"), "key", "left_anti").unionByName(new))

    def get(self, keys: DataFrame) -> DataFrame:
        """(key, body) of those keys that are there."""
        held = self.read()
        return keys.select("key", F.lit(None).cast("string").alias("body")).limit(0) if held is None else held.join(keys.select("key").distinct(), "key", "left_semi")

    def under(self, prefix: str) -> DataFrame:
        """(key) under a prefix, in order."""
        held = self.read()
        return held.where(F.col("key").startswith(prefix)).select("key").orderBy("key")

    def delete(self, keys: DataFrame) -> None:
        """Deletes what is there of the keys; others are no error."""
        held = self.read()
        if held is not None:
            self.replace(held.join(keys.select("key").distinct(), "key", "left_anti"))


def snapshot(rows: DataFrame, root: str, name: str) -> None:
    """A named snapshot (manifest, status, predicates): the last one is read."""
    Versioned(rows.sparkSession, f"{root.rstrip('/')}/{name}").replace(rows)
