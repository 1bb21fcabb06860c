"""Status and change streams over events (batch twins of the streaming operators), and the scorecard."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lithic.operators import scorecard, status
from lithic.plans.catalog import query, read

REPORTS = """
r AS (SELECT user_id AS instance, ts, event_id AS report_id, CASE event_type WHEN 'signup' THEN 'ingesting' WHEN 'error' THEN 'errored' WHEN 'view' THEN 'idle' ELSE 'watching' END AS phase,
  CAST(floor(value) AS BIGINT) AS offered, CAST(floor(value / 2) AS BIGINT) AS delivered, CAST(floor(value / 10) AS BIGINT) AS lost, CAST(floor(value / 20) AS BIGINT) AS baseline FROM events),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY instance ORDER BY ts DESC, report_id DESC) AS k FROM r) WHERE k = 1)"""


def reports(spark, d):
    t, v = F.col("event_type"), F.col("value")
    phase = F.when(t == "signup", "ingesting").when(t == "error", "errored").when(t == "view", "idle").otherwise("watching")
    whole = lambda x: F.floor(x).cast("long")
    return read(spark, d, "events").select(F.col("user_id").alias("instance"), "ts", F.col("event_id").alias("report_id"), phase.alias("phase"), whole(v).alias("offered"), whole(v / 2).alias("delivered"), whole(v / 10).alias("lost"), whole(v / 20).alias("baseline"))


@query("status_latest", f"WITH {REPORTS} SELECT instance, report_id, phase FROM l")
def status_latest(spark, d):
    return status.latest(reports(spark, d)).select("instance", "report_id", "phase")


@query("status_phase", f"""WITH {REPORTS} SELECT count(*) AS reported, bool_and(phase IN ('watching', 'idle')) AS calm, bool_or(phase = 'errored') AS errored, bool_or(lost - baseline > 0) AS lossy,
CASE WHEN bool_or(phase = 'errored') OR bool_or(lost - baseline > 0) THEN 'degraded' WHEN count(*) >= 5 AND bool_and(phase IN ('watching', 'idle')) THEN 'ready' ELSE 'seeding' END AS phase FROM l""")
def status_phase(spark, d):
    last = status.latest(reports(spark, d)).withColumn("seed_lost", F.greatest(F.col("lost") - F.col("baseline"), F.lit(0)))
    return status.aggregate_phase(last, 5)


@query("delivery_reconcile", f"WITH {REPORTS} SELECT instance, report_id, greatest(offered - delivered - lost, 0) AS in_flight, greatest(lost - baseline, 0) AS seed_loss FROM r")
def delivery_reconcile(spark, d):
    r = reports(spark, d)
    return r.select("instance", "report_id", F.greatest(F.col("offered") - F.col("delivered") - F.col("lost"), F.lit(0)).alias("in_flight"), F.greatest(F.col("lost") - F.col("baseline"), F.lit(0)).alias("seed_loss"))


@query("distinct_type_counts", "WITH e AS (SELECT DISTINCT l_partkey AS id, l_returnflag AS domain, l_linestatus AS kind FROM lineitem) SELECT domain, kind, count(*) AS n FROM e GROUP BY ROLLUP (domain, kind)")
def distinct_type_counts(spark, d):
    return status.type_counts(read(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_returnflag").alias("domain"), F.col("l_linestatus").alias("kind")))


@query("summary_by_domain", """WITH e AS (SELECT l_partkey AS id, l_returnflag AS domain, l_linestatus AS kind, l_suppkey AS source FROM lineitem), k AS (SELECT domain, kind, count(DISTINCT id) AS n FROM e GROUP BY 1, 2)
SELECT domain, CAST(sum(n) AS BIGINT) AS entities, string_agg(kind || ':' || n, ',' ORDER BY n DESC, kind) AS types, (SELECT count(DISTINCT source) FROM e WHERE e.domain = k.domain) AS sources FROM k GROUP BY domain""")
def summary_by_domain(spark, d):
    return status.summary(read(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_returnflag").alias("domain"), F.col("l_linestatus").alias("kind"), F.col("l_suppkey").alias("source")))


@query("edge_trigger", f"WITH {REPORTS}, t AS (SELECT *, lag(phase) OVER (PARTITION BY instance ORDER BY ts, report_id) AS before FROM r) SELECT instance, report_id, before, phase FROM t WHERE before IS DISTINCT FROM phase")
def edge_trigger(spark, d):
    return status.transitions(reports(spark, d), "instance", "ts", "report_id", "phase").select("instance", "report_id", "before", "phase")


@query("change_suppress", """WITH h AS (SELECT event_id, user_id, event_type, sha256(event_type) AS h, lag(sha256(event_type)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)
SELECT event_id, CASE WHEN b IS NULL THEN 'create' ELSE 'modify' END AS op FROM h WHERE b IS NULL OR b <> h""")
def change_suppress(spark, d):
    e = read(spark, d, "events").withColumn("h", F.sha2("event_type", 256))
    before = F.lag("h").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.withColumn("b", before).where("b IS NULL OR b <> h").select("event_id", F.when(F.col("b").isNull(), "create").otherwise("modify").alias("op"))


@query("debounce_latest", """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, count(*) AS batched, max(event_id) AS last_event FROM (SELECT user_id, s, event_id, ts FROM s) GROUP BY user_id, s""")
def debounce_latest(spark, d):
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(order).cast("timestamp"))
    s = read(spark, d, "events").withColumn("n", F.when(gap <= 3_600_000_000, 0).otherwise(1)).withColumn("s", F.sum("n").over(order))
    return s.groupBy("user_id", "s").agg(F.count("*").alias("batched"), F.max("event_id").alias("last_event")).drop("s")


@query("msg_dedup", "SELECT user_id || ':' || left(sha256(event_type), 12) AS msg_id, min(event_id) AS first_event, count(*) AS copies FROM events GROUP BY 1")
def msg_dedup(spark, d):
    id_ = F.concat(F.col("user_id").cast("string"), F.lit(":"), F.substring(F.sha2("event_type", 256), 1, 12))
    return read(spark, d, "events").groupBy(id_.alias("msg_id")).agg(F.min("event_id").alias("first_event"), F.count("*").alias("copies"))


@query("event_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    return read(spark, d, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").start.cast("timestamp_ntz").alias("start"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


GRADE = """
a AS (SELECT conv_id, turn, role AS arm, text AS answer, left(text, 40) AS top, length(text) AS bytes, turn % 13 = 12 AS failed FROM conversations),
t AS (SELECT *, contains(lower(top), 'an') AS holds, contains(lower(top), 'or ') AS twin FROM a),
g AS (SELECT *, CASE WHEN contains(lower(answer), 'unable') THEN 'FABRICATED' WHEN failed THEN 'error'
  WHEN NOT (contains(lower(answer), 'the') AND (contains(lower(answer), 'ing') OR contains(lower(answer), 'ed'))) THEN 'miss'
  WHEN holds AND twin THEN 'IMPRECISE' WHEN NOT holds AND twin THEN 'MISLEADING' WHEN NOT holds THEN 'miss' ELSE 'correct' END AS verdict FROM t)"""


def graded(spark, d):
    lit = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    rows = read(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("arm"), F.col("text").alias("answer"), F.substring("text", 1, 40).alias("top"), F.length("text").alias("bytes"), (F.col("turn") % 13 == 12).alias("failed"),
                                                  lit("The").alias("all_of"), lit("ing", "ed").alias("any_of"), lit("unable").alias("none_of"), lit("an").alias("top_all"), lit("or ").alias("top_none"))
    return scorecard.grade(rows)


@query("scorecard_grade", f"WITH {GRADE} SELECT conv_id, turn, verdict FROM g")
def scorecard_grade(spark, d):
    return graded(spark, d).select("conv_id", "turn", "verdict")


@query("scorecard_unstable", f"WITH {GRADE} SELECT conv_id AS question, CASE WHEN count(DISTINCT verdict) > 1 THEN 'UNSTABLE' ELSE min(verdict) END AS verdict FROM g GROUP BY 1")
def scorecard_unstable(spark, d):
    return scorecard.unstable(graded(spark, d).withColumn("question", F.col("conv_id")))


@query("scorecard_table", f"WITH {GRADE} SELECT CAST(turn % 3 AS VARCHAR) AS band, arm, count(*) FILTER (verdict = 'correct') AS correct, count(*) AS asked, CAST(sum(bytes) AS BIGINT) AS bytes, quantile_cont(bytes, 0.5) AS median_ms, round(quantile_cont(bytes, 0.95), 6) AS p95_ms FROM g GROUP BY 1, 2")
def scorecard_table(spark, d):
    t = scorecard.table(graded(spark, d).withColumns({"band": (F.col("turn") % 3).cast("string"), "ms": F.col("bytes")}))
    return t.withColumn("p95_ms", F.round("p95_ms", 6))
