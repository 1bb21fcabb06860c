"""Status, summaries and readiness from source reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(reports: DataFrame, key: str = "instance", ts: str = "ts", tie: str = "report_id") -> DataFrame:
    """The last report of each instance: an aggregate, so no sort of an instance's reports."""
    cols = [c for c in reports.columns if c != key]
    return reports.groupBy(key).agg(F.max(F.struct(ts, tie, *[c for c in cols if c not in (ts, tie)])).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in cols])


def aggregate_phase(last: DataFrame, expected: int, deadline_passed: bool = False) -> DataFrame:
    """One row: seeding, ready or degraded from the latest report of each instance (instance, phase, seed_lost)."""
    agg = last.agg(F.count("*").alias("reported"), F.coalesce(F.bool_and(F.col("phase").isin("watching", "idle")), F.lit(False)).alias("calm"),
                   F.coalesce(F.bool_or(F.col("phase") == "errored"), F.lit(False)).alias("errored"), F.coalesce(F.bool_or(F.col("seed_lost") > 0), F.lit(False)).alias("lossy"))
    all_in = F.col("reported") >= expected
    phase = F.when(F.col("errored") | F.col("lossy"), "degraded").when(all_in & F.col("calm"), "ready").when(F.lit(deadline_passed), "degraded").otherwise("seeding")
    return agg.withColumn("phase", phase)


def delivery(reports: DataFrame) -> DataFrame:
    """(instance, in_flight, seed_loss): offered = delivered + lost + in flight; losses since the pass began, 0 at least."""
    return reports.select("instance", F.greatest(F.col("offered") - F.col("delivered") - F.col("lost"), F.lit(0)).alias("in_flight"), F.greatest(F.col("lost") - F.col("baseline"), F.lit(0)).alias("seed_loss"))


def type_counts(entities: DataFrame) -> DataFrame:
    """(domain, kind, n) of distinct ids, with subtotals: the same however often an id is published."""
    return entities.select("id", "domain", "kind").distinct().rollup("domain", "kind").agg(F.count("*").alias("n"))


def summary(entities: DataFrame) -> DataFrame:
    """(domain, entities, types, sources): types by count, then name."""
    kinds = entities.select("id", "domain", "kind").distinct().groupBy("domain", "kind").agg(F.count("*").alias("n"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("neg"), "kind"))), lambda x: F.concat(x["kind"], F.lit(":"), (-x["neg"]).cast("string"))), ",")
    sources = entities.select("domain", "source").distinct().groupBy("domain").agg(F.count("*").alias("sources"))
    return kinds.groupBy("domain").agg(F.sum("n").alias("entities"), listed.alias("types")).join(sources, "domain")


def transitions(states: DataFrame, key: str, ts: str, tie: str, state: str) -> DataFrame:
    """Rows at which an instance's state differs from the one before: edges, not levels."""
    from pyspark.sql import Window as W

    before = F.lag(state).over(W.partitionBy(key).orderBy(ts, tie))
    return states.withColumn("before", before).where(F.col("before").isNull() | (F.col("before") != F.col(state)))


def community_sizes(members: DataFrame) -> DataFrame:
    """(community, size, share, systems) of (community, id, system)."""
    total = members.agg(F.count("*").alias("total"))
    return members.groupBy("community").agg(F.count("*").alias("size"), F.count_distinct("system").alias("systems")).join(total, how="cross").withColumn("share", F.col("size") / F.col("total")).drop("total")
