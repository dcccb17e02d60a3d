"""Queries of the interval algebra."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lanespan.operators import intervals as I
from lanespan.sources.tables import IV, intervals

Q, SQL = {}, {}

LANE = ["device"]
#: A day of the interval view, in microseconds.
DAY = 86_400_000_000
#: Running end of the intervals before, in SQL.
PE = "p AS (SELECT *, max(e) OVER (PARTITION BY device ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM iv)"
ISLANDS = """isl AS (SELECT device, min(s) AS s, max(e) AS e FROM (
  SELECT *, sum(CASE WHEN pe IS NULL OR s > pe THEN 1 ELSE 0 END) OVER (PARTITION BY device ORDER BY s, e, id ROWS UNBOUNDED PRECEDING) AS k FROM p) GROUP BY device, k)"""


def query(name: str, sql: str):
    def keep(f):
        Q[name], SQL[name] = f, sql
        return f

    return keep


@query("interval_union_per_device", f"WITH {IV}, {PE} SELECT device, CAST(sum(e - s) AS BIGINT) AS busy_sum, CAST(sum(greatest(0, e - greatest(s, coalesce(pe, s)))) AS BIGINT) AS busy_union, max(e) - min(s) AS wall FROM p GROUP BY device")
def _(spark, d):
    return I.union_length(intervals(spark, d), LANE)


@query("interval_holes", f"WITH {IV}, {PE} SELECT device, pe AS hole_start, s AS hole_end FROM p WHERE s > pe")
def _(spark, d):
    return I.holes(intervals(spark, d), LANE)


@query(
    "interval_holes_clipped_window",
    f"""WITH {IV}, {PE}, {ISLANDS}, r AS (SELECT min(s) // 86400000000 AS lo, (max(e) - 1) // 86400000000 AS hi FROM iv),
w AS (SELECT device, k * 86400000000 AS a, (k + 1) * 86400000000 AS b FROM (SELECT DISTINCT device FROM iv), (SELECT unnest(range(lo, hi + 1)) AS k FROM r)),
c AS (SELECT w.device, a, b, greatest(s, a) AS s, least(e, b) AS e FROM w JOIN isl ON w.device = isl.device AND e > a AND s < b UNION ALL SELECT device, a, b, b, b FROM w),
g AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY device, a ORDER BY s, e), a) AS h FROM c)
SELECT device, a, b, h AS hole_start, s AS hole_end FROM g WHERE s > h""",
)
def _(spark, d):
    iv = intervals(spark, d)
    span = iv.agg(F.min(F.expr(f"s div {DAY}")).alias("lo"), F.max(F.expr(f"(e - 1) div {DAY}")).alias("hi"))
    days = span.select(F.explode(F.expr("sequence(lo, hi)")).alias("k"))
    windows = iv.select("device").distinct().crossJoin(F.broadcast(days)).select("device", (F.col("k") * DAY).alias("a"), ((F.col("k") + 1) * DAY).alias("b"))
    return I.holes_in(iv, windows, LANE)


@query(
    "gap_threshold_excluding_spans",
    f"""WITH {IV}, o AS (SELECT * FROM iv WHERE stream <> 'view'), v AS (SELECT * FROM iv WHERE stream = 'view'),
p AS (SELECT *, max(e) OVER (PARTITION BY device ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM o)
SELECT device, pe AS hole_start, s AS hole_end FROM p WHERE s - pe > 1800000000 AND NOT EXISTS (SELECT 1 FROM v WHERE v.device = p.device AND v.s < p.s AND v.e > p.pe)""",
)
def _(spark, d):
    iv = intervals(spark, d)
    return I.wide_gaps(iv.where("stream <> 'view'"), iv.where("stream = 'view'"), LANE, 1_800_000_000)


@query(
    "interval_concurrency",
    f"""WITH {IV}, j AS (SELECT a.id, greatest(a.s, b.s) AS s, least(a.e, b.e) AS e FROM iv a JOIN iv b ON a.device = b.device AND a.stream <> b.stream AND a.s < b.e AND b.s < a.e),
p AS (SELECT *, max(e) OVER (PARTITION BY id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM j),
u AS (SELECT id, sum(greatest(0, e - greatest(s, coalesce(pe, s)))) AS shared FROM p GROUP BY id)
SELECT iv.id, round(coalesce(CAST(shared AS DOUBLE) / (e - s), 0), 6) AS ratio FROM iv LEFT JOIN u ON iv.id = u.id""",
)
def _(spark, d):
    return I.concurrency(intervals(spark, d)).select("id", F.round("ratio", 6).alias("ratio"))


@query("overlap_pct_per_device", f"WITH {IV}, {PE} SELECT device, round((sum(e - s) - sum(greatest(0, e - greatest(s, coalesce(pe, s))))) * 100.0 / sum(e - s), 6) AS overlap_pct FROM p GROUP BY device")
def _(spark, d):
    u = I.union_length(intervals(spark, d), LANE)
    return u.select("device", F.coalesce(F.round(F.try_divide((F.col("busy_sum") - F.col("busy_union")) * 100.0, F.col("busy_sum")), 6), F.lit(float("nan"))).alias("overlap_pct"))


def busy_steps(iv):
    """Steps between starts of the marker stream, cut where the body stream begins and ends: device, a, b, n (how many equal steps), part, s, e."""
    marks = iv.where("stream = 'signup'").select("device", F.col("s").alias("a"))
    steps = marks.withColumn("b", F.lead("a").over(Window.partitionBy("device").orderBy("a"))).where("b is not null").groupBy("device", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    clicks = iv.where("stream = 'click'").select("device", "s", (F.col("s") + 1).alias("e"), F.col("e").alias("end"))  # a click belongs where it begins
    body = I.overlap_join(steps.withColumnsRenamed({"a": "s", "b": "e"}), clicks, LANE)
    body = body.groupBy("device", F.col("s").alias("a")).agg(F.min("s2").alias("x"), F.max("end2").alias("y"))
    cut = steps.join(body, ["device", "a"], "left").select("device", "a", "b", "n", F.coalesce("x", "b").alias("x"), F.least(F.coalesce("y", "b"), "b").alias("y"))
    parts = F.array(*[F.struct(F.lit(n).alias("part"), F.col(lo).alias("s"), F.col(hi).alias("e")) for n, lo, hi in (("prologue", "a", "x"), ("body", "x", "y"), ("tail", "y", "b"))])
    return cut.select("device", "a", "b", "n", F.explode(parts).alias("p")).select("device", "a", "b", "n", "p.part", "p.s", "p.e")


def decomposition(iv):
    return I.decomposed(busy_steps(iv).withColumnRenamed("b", "end"), iv, LANE, "a", ["prologue", "body", "tail"])


DECOMPOSITION = f"""{IV}, {PE}, {ISLANDS}, m AS (SELECT device, s AS a, lead(s) OVER (PARTITION BY device ORDER BY s) AS b FROM iv WHERE stream = 'signup'),
st AS (SELECT * FROM m WHERE b IS NOT NULL),
bd AS (SELECT st.device, a, min(s) AS x, max(e) AS y FROM st JOIN iv ON iv.device = st.device AND stream = 'click' AND s >= a AND s < b GROUP BY 1, 2),
ct AS (SELECT st.device, st.a, b, coalesce(x, b) AS x, least(coalesce(y, b), b) AS y FROM st LEFT JOIN bd ON st.device = bd.device AND st.a = bd.a),
cv AS (SELECT ct.device, a, b,
  sum(greatest(0, least(e, x) - greatest(s, a))) AS prologue, sum(greatest(0, least(e, y) - greatest(s, x))) AS body, sum(greatest(0, least(e, b) - greatest(s, y))) AS tail
  FROM ct LEFT JOIN isl ON isl.device = ct.device AND s < b AND e > a GROUP BY 1, 2, 3)"""


@query(
    "busy_decomposition",
    f"WITH {DECOMPOSITION} SELECT device, a, b - a AS period, CAST(coalesce(prologue, 0) AS BIGINT) AS prologue, CAST(coalesce(body, 0) AS BIGINT) AS body, CAST(coalesce(tail, 0) AS BIGINT) AS tail, CAST(b - a - coalesce(prologue + body + tail, 0) AS BIGINT) AS gap FROM cv",
)
def _(spark, d):
    return decomposition(intervals(spark, d))


@query(
    "timeline_layout",
    f"""WITH {IV}, g AS (SELECT device, min(s) AS lo, max(e) AS hi FROM iv GROUP BY device)
SELECT id, CAST(dense_rank() OVER (PARTITION BY iv.device ORDER BY stream) - 1 AS BIGINT) AS lane, round((s - lo) * 100.0::DOUBLE / (hi - lo), 6) AS left_pct, round(greatest((e - s) * 100.0::DOUBLE / (hi - lo), 0.12), 6) AS width_pct
FROM iv JOIN g ON iv.device = g.device""",
)
def _(spark, d):
    out = I.layout(intervals(spark, d))
    return out.select("id", "lane", F.round("left_pct", 6).alias("left_pct"), F.round("width_pct", 6).alias("width_pct"))
