"""Queries that run as streams over what arrives in batches, drained."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lanespan.plans.q_segments import STEPS
from lanespan.sources.tables import IV, intervals, load
from lanespan.streaming import events as E
from lanespan.streaming import stateful as T

Q, SQL = {}, {}


def query(name: str, sql: str):
    def keep(f):
        Q[name], SQL[name] = f, sql
        return f

    return keep


@query(
    "stream_interval_union",
    f"""WITH {IV}, p AS (SELECT *, max(e) OVER (PARTITION BY device ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM iv WHERE e > s),
g AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe THEN 1 ELSE 0 END) OVER (PARTITION BY device ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM p)
SELECT device, min(s) AS s, max(e) AS e, count(*) AS n, CAST(sum(e - s) AS BIGINT) AS busy FROM g GROUP BY device, k""",
)
def _(spark, d):
    return E.running_union(spark, d).withColumnRenamed("lane", "device")


#: Each event is a line of its user's log; the log is polled three times. Every third log is begun again before the second poll.
POLLS = """l AS (SELECT user_id AS log, event_id, event_type || ' ' || event_id AS text, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS total FROM events),
v AS (SELECT l.*, poll FROM l, (VALUES (0), (1), (2)) p(poll) WHERE CASE WHEN log % 3 <> 0 OR poll = 0 THEN k * 3 // total <= poll WHEN poll = 1 THEN k * 3 // total = 1 AND k % 2 = 0 ELSE k * 3 // total = 1 AND k % 2 = 0 OR k * 3 // total = 2 END),
lines AS (SELECT log, poll, event_id, text, length(text) + 1 AS size, sum(length(text) + 1) OVER (PARTITION BY log, poll ORDER BY event_id) - length(text) - 1 AS off FROM v)"""


def polls(spark, d):
    """log, poll, end, offset, size, text."""
    w = Window.partitionBy("log").orderBy("event_id")
    x = load(spark, d, "events").select(F.col("user_id").cast("string").alias("log"), "event_id", F.concat_ws(" ", "event_type", "event_id").alias("text"))
    x = x.withColumn("k", F.row_number().over(w) - 1).withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("log")))
    x = x.withColumn("third", F.expr("k * 3 div total")).withColumn("poll", F.explode(F.array(*[F.lit(k).cast("long") for k in range(3)])))
    fresh = (F.col("third") == 1) & (F.col("k") % 2 == 0)
    seen = F.when((F.col("log").cast("long") % 3 != 0) | (F.col("poll") == 0), F.col("third") <= F.col("poll")).when(F.col("poll") == 1, fresh).otherwise(fresh | (F.col("third") == 2))
    x = x.where(seen).withColumn("size", F.length("text").cast("long") + 1)
    upto = F.sum("size").over(Window.partitionBy("log", "poll").orderBy("event_id"))
    return x.select("log", "poll", F.sum("size").over(Window.partitionBy("log", "poll")).alias("end"), (upto - F.col("size")).alias("offset"), "size", "text")


@query(
    "stream_log_tail",
    f"""WITH {POLLS}, s AS (SELECT log, poll, max(off + size) AS e FROM lines GROUP BY 1, 2), b AS (SELECT *, lag(e) OVER (PARTITION BY log ORDER BY poll) AS before FROM s),
c AS (SELECT log, poll, CASE WHEN e < before THEN 0 ELSE coalesce(before, 0) END AS cursor, sum(CASE WHEN e < before THEN 1 ELSE 0 END) OVER (PARTITION BY log ORDER BY poll) AS epoch FROM b),
n AS (SELECT lines.*, epoch, sum(size) OVER (PARTITION BY lines.log, epoch ORDER BY off) AS upto FROM lines JOIN c ON lines.log = c.log AND lines.poll = c.poll WHERE off >= cursor)
SELECT CAST(log AS VARCHAR) AS log, CAST(epoch AS BIGINT) AS epoch, CAST(off AS BIGINT) AS "offset", CASE WHEN upto > 400 THEN '[log is full]' ELSE text END AS text FROM n WHERE upto - size < 400""",
)
def _(spark, d):
    stream = T.arrivals(polls(spark, d).withColumn("batch", F.col("poll")), "batch", 3)
    return T.drained(T.tail(stream, 400))


@query(
    "stream_template_stats",
    f"""WITH {STEPS}, t AS (SELECT device, step, string_agg(stream, '>' ORDER BY s, id) AS template FROM ins GROUP BY device, step),
q AS (SELECT i.*, sha256(t.template) AS template, row_number() OVER (PARTITION BY i.device, i.step ORDER BY s, id) - 1 AS pos FROM ins i JOIN t ON i.device = t.device AND i.step = t.step)
SELECT template, pos, count(*) AS n, min(e - s) AS low, max(e - s) AS high, round(avg(e - s), 3) AS mean FROM q GROUP BY template, pos""",
)
def _(spark, d):
    iv = intervals(spark, d).select(F.col("device").alias("lane"), "s", "id", F.col("stream").alias("name"), "e", F.expr("stream = 'signup'").alias("marks"))
    span = iv.agg(F.min("s").alias("lo"), F.max("s").alias("hi")).first()
    rows = iv.withColumn("batch", F.least(F.lit(2), ((F.col("s") - (span.lo or 0)) * 3 / ((span.hi or 0) - (span.lo or 0) + 1)).cast("int")))
    return T.accepted(T.arrivals(rows, "batch", 3)).withColumn("mean", F.round("mean", 3))
