"""Change streams: debounce, hash suppression, message dedup, windows and upserts as Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: The window in which a message id counts as seen.
DEDUP_WINDOW = "2 minutes"


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream, rate limited instead of dropping; timestamps become zoned, as watermarks need."""
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    for field in schema.fields:
        if field.dataType.typeName() in ("timestamp_ntz", "timestamp"):
            s = s.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return s


def _suppress(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    before = state.get[0] if state.exists else None
    for pdf in batches:
        rows = pdf.sort_values(["ts", "event_id"])
        out = []
        for r in rows.itertuples():
            if r.op == "delete":
                if before is not None:
                    out.append((key[0], r.event_id, "delete", None))
                before = None
            elif r.hash != before:
                out.append((key[0], r.event_id, "create" if before is None else "modify", r.hash))
                before = r.hash
        yield pd.DataFrame(out, columns=["path", "event_id", "change", "hash"])
    if before is None:
        if state.exists:
            state.remove()
    else:
        state.update((before,))


def suppress_unchanged(changes: DataFrame) -> DataFrame:
    """(path, event_id, change, hash) of (path, event_id, ts, op, hash): only where the content differs from the last; state is one hash per path."""
    return changes.groupBy("path").applyInPandasWithState(_suppress, "path string, event_id long, change string, hash string", "hash string", "append", GroupStateTimeout.NoTimeout)


def debounced(changes: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """(path, start, end, n, last_op): the last operation of each burst of changes of a path, once the burst is over."""
    return changes.withWatermark("ts", late).groupBy("path", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.max_by("op", F.struct("ts", "event_id")).alias("last_op")).select(
        "path", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "last_op")


def message_id(entity: str = "id", payload: str = "payload") -> Column:
    return F.concat_ws(":", F.col(entity), F.substring(F.sha2(payload, 256), 1, 12))


def deduplicated(messages: DataFrame, ts: str = "ts") -> DataFrame:
    """Each message id once within the window."""
    return messages.withColumn("msg_id", message_id()).withWatermark(ts, DEDUP_WINDOW).dropDuplicatesWithinWatermark(["msg_id"])


def windowed(events: DataFrame, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums per event type in tumbling or sliding windows (an addition: the rest has no event-time windows)."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def _shrunk(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    before = state.get[0] if state.exists else None
    for pdf in batches:
        out = []
        for r in pdf.sort_values(["ts"]).itertuples():
            if before is not None and r.chunks < before:
                out.append((key[0], int(before), int(r.chunks)))
            before = int(r.chunks)
        yield pd.DataFrame(out, columns=["path", "before", "after"])
    state.update((before,))


def shrunk_documents(counts: DataFrame) -> DataFrame:
    """(path, before, after) of (path, ts, chunks): only decreases; the first sighting never."""
    return counts.groupBy("path").applyInPandasWithState(_shrunk, "path string, before long, after long", "chunks long", "append", GroupStateTimeout.NoTimeout)


def upsert(target: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: the batch's keys replace those of the stored rows. A batch that runs again gives the same.

    The new state is written beside the old and then named in a pointer file of one row, so readers never see half a batch.
    """
    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = read_upserted(spark, target)
        new = batch if old is None else old.join(batch.select(*keys).distinct(), keys, "left_anti").unionByName(batch)
        path = f"{target}/state-{number}"
        new.write.mode("overwrite").parquet(path)
        spark.createDataFrame([(number,)], "batch long").coalesce(1).write.mode("append").parquet(f"{target}/pointer")

    return run


def read_upserted(spark: SparkSession, target: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        last = spark.read.parquet(f"{target}/pointer").agg(F.max("batch")).first()[0]
    except AnalysisException:
        return None
    return spark.read.parquet(f"{target}/state-{last}")


def polled(states: DataFrame) -> DataFrame:
    """(path, event_id, change, hash) of polls (path, event_id, ts, op, hash): a head or a content hash that is seen first is a create, later only a change counts.

    Polls that failed (op is error) say nothing about the content.
    """
    return suppress_unchanged(states.where("op <> 'error'"))


# Errors of a publish by what can be done about them. Fixed values.
RETRYABLE = ("circuit open", "not connected", "timeout", "deadline exceeded", "no responders")
CAPACITY = ("maximum bytes exceeded", "maximum messages exceeded", "maximum messages per subject exceeded")
CAPACITY_CODE = 10077


def publish_error(message: Column, code: Column, cancelled: Column) -> Column:
    """cancelled, retryable or terminal: a full stream is worth another try, any other refusal isn't."""
    return F.when(cancelled, "cancelled").when(message.isin(*RETRYABLE) | ((code == CAPACITY_CODE) & message.isin(*CAPACITY)), "retryable").otherwise("terminal")


def reindex_due(sources: DataFrame, now: Column, every: int = 60) -> DataFrame:
    """Sources (source, hash, seen_hash, last) whose period of `every` seconds is over and whose content changed: unchanged ones are skipped."""
    return sources.where((F.unix_timestamp(now) - F.unix_timestamp("last") >= every) & (F.col("seen_hash").isNull() | (F.col("hash") != F.col("seen_hash"))))


def welcome_reports(reports: DataFrame, removals: DataFrame) -> DataFrame:
    """Reports (instance, ts, ...) of sources that aren't removed: a late one of a removed source is ignored until it is added again.

    removals (instance, removed, added): the last removal, and the last addition or null.
    """
    gone = removals.where(F.col("added").isNull() | (F.col("added") <= F.col("removed"))).select("instance").distinct()
    return reports.join(gone, "instance", "left_anti")


def bounded(changes: DataFrame, most: int) -> DataFrame:
    """(batch, kept, dropped) of (batch): what a buffer of `most` events a batch would keep and drop; the streams here slow down instead."""
    return changes.groupBy("batch").agg(F.count("*").alias("n")).select("batch", F.least("n", F.lit(most)).alias("kept"), F.greatest(F.col("n") - most, F.lit(0)).alias("dropped"))
