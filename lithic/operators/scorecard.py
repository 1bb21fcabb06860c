"""Grading of answers against stated phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _has(answer: Column, phrases: Column, every: bool) -> Column:
    test = lambda p: F.contains(F.lower(answer), F.lower(p))
    return F.forall(phrases, test) if every else F.exists(phrases, test)


def grade(rows: DataFrame) -> DataFrame:
    """Adds verdict from (answer, top, all_of, any_of, none_of, top_all, top_none, failed); empty lists ask nothing."""
    a, top = F.coalesce(F.col("answer"), F.lit("")), F.coalesce(F.col("top"), F.lit(""))
    right = _has(a, F.col("all_of"), True) & ((F.size("any_of") == 0) | _has(a, F.col("any_of"), False))
    # The first item is judged twice, for what it must hold and for what it could be mistaken for, and the two are combined.
    holds, twin = _has(top, F.col("top_all"), True), _has(top, F.col("top_none"), False)
    of_top = F.when(holds & twin, "IMPRECISE").when(twin, "MISLEADING").when(~holds, "miss").otherwise("correct")
    verdict = F.when(_has(a, F.col("none_of"), False), "FABRICATED").when(F.col("failed"), "error").when(~right, "miss").otherwise(of_top)
    return rows.withColumn("verdict", verdict)


def unstable(graded: DataFrame) -> DataFrame:
    """(question, verdict): UNSTABLE where repeats disagree."""
    return graded.groupBy("question").agg(F.when(F.count_distinct("verdict") > 1, "UNSTABLE").otherwise(F.min("verdict")).alias("verdict"))


def table(graded: DataFrame) -> DataFrame:
    """(band, arm, correct, asked, bytes, median_ms, p95_ms)."""
    return graded.groupBy("band", "arm").agg(F.count(F.when(F.col("verdict") == "correct", 1)).alias("correct"), F.count("*").alias("asked"), F.sum("bytes").alias("bytes"),
                                             F.percentile("ms", F.lit(0.5)).alias("median_ms"), F.percentile("ms", F.lit(0.95)).alias("p95_ms"))
