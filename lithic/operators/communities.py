"""Communities by synchronous label propagation over weighted edges, with synthesised peers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lithic.operators.retrieval import _checkpointed


#: Rows of one block of `ring`: a block is what one task orders.
BLOCK = 1 << 16


def ring(entities: DataFrame, group: str, weight: float, most: int, block: int = BLOCK) -> DataFrame:
    """(a, b, w): each entity with the next `most` of its group in id order - peers without all pairs of a group.

    Rows are ordered by group and id in ranges, numbered, and cut into blocks of `block` rows (more than `most`); the first `most` rows of a block also
    go to the one before it. So no task holds a whole group, however large. Rows whose group is null form a group; repeated ids count as often as they occur.
    """
    rows = entities.select(F.col("id"), F.col(group).alias("g"))
    ranged = _checkpointed(rows.repartitionByRange("g", "id").withColumn("part", F.spark_partition_id()))
    # One row for each range: few, whatever the number of entities.
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    place = F.col("before") + F.row_number().over(W.partitionBy("part").orderBy("g", "id")) - 1
    placed = ranged.join(F.broadcast(before), "part").select("id", "g", place.alias("at"))
    own = F.floor(F.col("at") / block)
    also = F.when((F.col("at") % block < most) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    held = placed.select("id", "g", "at", own.alias("own"), F.explode(also).alias("block"))
    order = W.partitionBy("block").orderBy("at")
    nexts = [F.lead(F.struct("g", "id"), k).over(order) for k in range(1, most + 1)]
    ahead = held.select(F.col("id").alias("a"), "g", (F.col("own") == F.col("block")).alias("mine"), F.array(*nexts).alias("next")).where("mine")
    pairs = ahead.select("a", "g", F.explode("next").alias("n")).where(F.col("n").isNotNull() & F.col("n.g").eqNullSafe(F.col("g")))
    return pairs.select("a", F.col("n.id").alias("b"), F.lit(weight).alias("w"))


def peers(entities: DataFrame, kind: str, system: str) -> DataFrame:
    """(a, b, w): siblings of one type prefix (0.7, 10 at most) and peers of one system (0.3, 15 at most), the reference's defaults."""
    return ring(entities, kind, 0.7, 10).unionByName(ring(entities, system, 0.3, 15))


def label_propagation(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """(id, community) from (a, b, w): each node takes the label of most weight around it, the smallest of equals."""
    both = edges.select("a", "b", "w").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).where("a <> b")
    both = _checkpointed(both.groupBy("a", "b").agg(F.max("w").alias("w")))
    labels = _checkpointed(both.select(F.col("a").alias("id"), F.col("a").alias("community")).distinct())
    for _ in range(rounds):
        votes = both.join(labels.select(F.col("id").alias("b"), "community"), "b").groupBy("a", "community").agg(F.sum("w").alias("w"))
        best = votes.groupBy("a").agg(F.min(F.struct((-F.round("w", 9)).alias("neg"), "community"))["community"].alias("community"))
        new = _checkpointed(best.select(F.col("a").alias("id"), "community"))
        same = new.join(labels.withColumnRenamed("community", "old"), "id").where("community <> old").isEmpty()
        labels = new
        if same:
            break
    return labels
