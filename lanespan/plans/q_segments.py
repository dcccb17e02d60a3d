"""Queries of sequence segmentation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lanespan.operators import origin as O
from lanespan.operators import pipeline as P
from lanespan.operators import segments as S
from lanespan.sources.tables import IV, intervals, load

Q, SQL = {}, {}
LANE = ["device"]


def signup():
    return F.expr("stream = 'signup'")


def dur():
    return F.col("e") - F.col("s")


def query(name: str, sql: str):
    def keep(f):
        Q[name], SQL[name] = f, sql
        return f

    return keep


def long(c: str) -> F.Column:
    return F.col(c).cast("long").alias(c)


@query(
    "kernel_index_window",
    f"""WITH {IV}, n AS (SELECT *, row_number() OVER (PARTITION BY device ORDER BY s, id) - 1 AS idx FROM iv), w AS (SELECT * FROM n WHERE idx BETWEEN 5 AND 14)
SELECT device, idx, id, e - s AS duration FROM w UNION ALL SELECT device, -1, -1, CAST(sum(e - s) AS BIGINT) FROM w GROUP BY device""",
)
def _(spark, d):
    rows = S.numbered(intervals(spark, d), LANE).where("idx between 5 and 14").select("device", "idx", "id", dur().alias("duration"))
    minus = F.lit(-1).cast("long")
    return rows.unionByName(rows.groupBy("device").agg(minus.alias("idx"), minus.alias("id"), F.sum("duration").alias("duration")))


@query(
    "group_contiguous_order",
    f"""WITH {IV}, g AS (SELECT *, min(s) OVER (PARTITION BY device, stream) AS fs, first_value(id) OVER (PARTITION BY device, stream ORDER BY s, id) AS fi FROM iv)
SELECT device, stream, id, row_number() OVER (PARTITION BY device ORDER BY fs, fi, s, id) AS ord FROM g""",
)
def _(spark, d):
    g = Window.partitionBy("device", "stream")
    rows = intervals(spark, d).withColumns({"fs": F.min("s").over(g), "fi": F.first("id").over(g.orderBy("s", "id"))})
    return rows.select("device", "stream", "id", F.row_number().over(S.lane(LANE, ["fs", "fi", "s", "id"])).cast("long").alias("ord"))


RUNS = f"""{IV}, r AS (SELECT *, CASE WHEN lag(stream) OVER (PARTITION BY device ORDER BY s, id) IS NOT DISTINCT FROM stream THEN 0 ELSE 1 END AS new FROM iv)"""


@query("noncontiguous_groups", f"WITH {RUNS} SELECT device, stream, CAST(sum(new) AS BIGINT) AS islands FROM r GROUP BY ALL HAVING sum(new) > 1")
def _(spark, d):
    return S.islands_of(intervals(spark, d), "stream", LANE).where("islands > 1")


@query("single_stream_violations", f"WITH {IV} SELECT device, s // 86400000000 AS day, count(DISTINCT stream) AS n_streams FROM iv GROUP BY ALL HAVING count(DISTINCT stream) > 1")
def _(spark, d):
    return intervals(spark, d).groupBy("device", F.expr("s div 86400000000").alias("day")).agg(F.countDistinct("stream").alias("n_streams")).where("n_streams > 1")


BLOCKS = f"""{IV}, b0 AS (SELECT *, sum(CASE WHEN stream = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY device ORDER BY s, id ROWS UNBOUNDED PRECEDING) - 1 AS block,
  sum(CASE WHEN stream = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY device) AS anchors FROM iv),
bl AS (SELECT device, stream, id, s, e, CAST(block AS BIGINT) AS block, CAST(block // 4 AS BIGINT) AS pass, CAST((block % 4) // 2 AS BIGINT) AS layer, CAST(block % 2 AS BIGINT) AS half
  FROM b0 WHERE block >= 0 AND block < ((anchors - 1) // 4) * 4)"""


def blocks(spark, d):
    return S.anchor_blocks(intervals(spark, d), signup(), LANE, layers=2, per_layer=2)


@query("anchor_blocks", f"WITH {BLOCKS} SELECT id, block, pass, layer, half FROM bl")
def _(spark, d):
    return blocks(spark, d).select("id", "block", "pass", "layer", "half")


@query("layer_wall_and_sum", f"WITH {BLOCKS} SELECT device, pass, layer, max(e) - min(s) AS wall, CAST(sum(e - s) AS BIGINT) AS total, count(*) AS n FROM bl GROUP BY ALL")
def _(spark, d):
    return blocks(spark, d).groupBy("device", "pass", "layer").agg((F.max("e") - F.min("s")).alias("wall"), F.sum(dur()).alias("total"), F.count(F.lit(1)).alias("n"))


STREAMS = ["click", "error", "purchase", "signup", "view"]


@query(
    "layer_category_pivot",
    f"WITH {BLOCKS} SELECT device, pass, layer, " + ", ".join(f"CAST(coalesce(sum(CASE WHEN stream = '{x}' THEN e - s END), 0) AS BIGINT) AS {x}" for x in STREAMS) + " FROM bl GROUP BY device, pass, layer",
)
def _(spark, d):
    return S.pivoted(blocks(spark, d), ["device", "pass", "layer"], "stream", STREAMS, dur())


@query(
    "cluster_stats",
    f"""WITH {BLOCKS}, y AS (SELECT device, pass, layer, max(e) - min(s) AS wall, sum(e - s) AS total, sum(CASE WHEN stream = 'click' THEN e - s ELSE 0 END) AS click FROM bl GROUP BY ALL)
SELECT r_name, count(*) AS n, round(avg(wall), 3) AS avg_wall, round(sum(click) * 100.0 / sum(total), 6) AS click_pct FROM y JOIN nation ON device % 25 = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""",
)
def _(spark, d):
    layers = blocks(spark, d).groupBy("device", "pass", "layer").agg((F.max("e") - F.min("s")).alias("wall"), F.sum(dur()).alias("total"), F.sum(F.when(F.col("stream") == "click", dur()).otherwise(0)).alias("click"))
    names = load(spark, d, "nation").join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    out = layers.join(names, F.col("device") % 25 == F.col("n_nationkey"))
    return out.groupBy("r_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("wall"), 3).alias("avg_wall"), F.round(F.sum("click") * 100.0 / F.sum("total"), 6).alias("click_pct"))


@query(
    "forward_pass_growth",
    f"""WITH {BLOCKS}, q AS (SELECT device, pass, max(e) - min(s) AS duration FROM bl GROUP BY ALL),
g AS (SELECT *, CAST(duration AS DOUBLE) / lag(duration) OVER (PARTITION BY device ORDER BY pass) - 1 AS growth FROM q)
SELECT device, pass, duration, round(growth, 6) AS growth, CASE WHEN growth IS NULL THEN 'cold' WHEN abs(growth) <= 0.05 THEN 'steady' WHEN growth > 0 THEN 'growing' ELSE 'shrinking' END AS label FROM g WHERE pass < 30""",
)
def _(spark, d):
    q = blocks(spark, d).groupBy("device", "pass").agg((F.max("e") - F.min("s")).alias("duration"))
    return S.growth(q, LANE, "pass", "duration").where("pass < 30").withColumn("growth", F.round("growth", 6))


CV = f"""{IV}, gp AS (SELECT *, s - lag(s) OVER (PARTITION BY device, stream ORDER BY s, id) AS gap FROM iv),
cv AS (SELECT device, stream, count(*) AS launches, stddev_pop(gap) / avg(gap) AS cv FROM gp GROUP BY device, stream HAVING count(*) BETWEEN 3 AND 20000 AND min(gap) > 0)"""


@query("marker_cv_candidates", f"WITH {CV} SELECT device, stream, launches, round(cv, 6) AS cv FROM cv")
def _(spark, d):
    return S.gap_cv(intervals(spark, d), ["device", "stream"]).withColumn("cv", F.round("cv", 6))


@query(
    "marker_consensus",
    f"""WITH {CV}, t AS (SELECT unnest([0, 1, 2]) AS tier, unnest([0.75, 1.0, 1.5]) AS most),
n AS (SELECT device, tier, launches, count(*) AS agreeing FROM cv JOIN t ON cv <= most GROUP BY ALL),
m AS (SELECT *, row_number() OVER (PARTITION BY device, tier ORDER BY agreeing DESC, launches DESC) AS r FROM n),
f AS (SELECT *, row_number() OVER (PARTITION BY device ORDER BY tier) AS q FROM m WHERE r = 1 AND (tier = 0 OR agreeing >= 2))
SELECT device, CAST(tier AS BIGINT) AS tier, launches, agreeing FROM f WHERE q = 1""",
)
def _(spark, d):
    return S.consensus(S.gap_cv(intervals(spark, d), ["device", "stream"]), LANE, [0.75, 1.0, 1.5], agree=2)


STEPS = f"""{IV}, m0 AS (SELECT device, s AS a, lead(s) OVER (PARTITION BY device ORDER BY s, id) AS b, row_number() OVER (PARTITION BY device ORDER BY s, id) - 1 AS step FROM iv WHERE stream = 'signup'),
st AS (SELECT * FROM m0 WHERE b IS NOT NULL), ins AS (SELECT iv.*, step, a, b FROM st JOIN iv ON iv.device = st.device AND s >= a AND s < b)"""


def in_steps(spark, d):
    return S.in_steps(intervals(spark, d), signup(), LANE)


@query(
    "step_windows",
    f"""WITH {STEPS}, t AS (SELECT *, count(*) OVER (PARTITION BY device) AS total FROM st)
SELECT device, step, a, b FROM t WHERE step >= greatest(0, least(total // 4, total - 8)) AND step < greatest(0, least(total // 4, total - 8)) + 8""",
)
def _(spark, d):
    return S.middle(S.steps(intervals(spark, d), signup(), LANE), LANE, 8).select("device", "step", "a", "b")


COUNTS = f"""{STEPS}, k AS (SELECT device, step, name, (SELECT 0) AS z FROM st, (SELECT DISTINCT stream AS name FROM iv)),
c AS (SELECT device, step, stream, count(*) AS n FROM ins GROUP BY ALL),
mc AS (SELECT k.device, k.step, name AS stream, coalesce(n, 0) AS n FROM k LEFT JOIN c ON k.device = c.device AND k.step = c.step AND name = c.stream)"""


def counts(spark, d):
    rows = in_steps(spark, d)
    per = rows.groupBy("device", "step").pivot("stream", STREAMS).count().na.fill(0)
    return per.select("device", "step", F.explode(F.array(*[F.struct(F.lit(x).alias("stream"), F.col(x).alias("n")) for x in STREAMS])).alias("x")).select("device", "step", "x.stream", "x.n")


@query("marker_count_per_step", f"WITH {COUNTS} SELECT device, step, stream, n FROM mc")
def _(spark, d):
    return counts(spark, d)


@query("once_per_step_names", f"WITH {COUNTS} SELECT device, stream, CAST(sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_exact, count(*) AS n_steps, min(n) = 1 AND max(n) = 1 AS every_step FROM mc GROUP BY device, stream")
def _(spark, d):
    return counts(spark, d).groupBy("device", "stream").agg(F.count_if(F.col("n") == 1).alias("n_exact"), F.count(F.lit(1)).alias("n_steps"), ((F.min("n") == 1) & (F.max("n") == 1)).alias("every_step"))


@query(
    "second_launch_offset",
    f"""WITH {STEPS}, k AS (SELECT *, row_number() OVER (PARTITION BY device, step, stream ORDER BY s, id) AS r FROM ins)
SELECT device, stream, count(*) AS n, round(avg(CAST(s - a AS DOUBLE) / (b - a)), 6) AS mean_offset FROM k WHERE r = 2 GROUP BY device, stream""",
)
def _(spark, d):
    x = P.second_launches(in_steps(spark, d).withColumnRenamed("stream", "name"))
    return x.groupBy("device", F.col("name").alias("stream")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("x"), 6).alias("mean_offset"))


@query("tail_k_events", f"WITH {STEPS}, k AS (SELECT *, row_number() OVER (PARTITION BY device, step ORDER BY s DESC, id DESC) AS r FROM ins) SELECT device, step, id, r FROM k WHERE r <= 2")
def _(spark, d):
    return S.last_of_steps(in_steps(spark, d), ["device", "step"], 2).select("device", "step", "id", "r")


@query(
    "phase_split",
    f"""WITH {STEPS}, x AS (SELECT device, step, a, b, min(CASE WHEN stream = 'purchase' THEN s END) AS d, least(max(CASE WHEN stream = 'purchase' THEN e END), b) AS e FROM ins GROUP BY device, step, a, b),
y AS (SELECT x.device, x.step, x.a, x.b, x.d, x.e, max(CASE WHEN i.stream <> 'purchase' AND i.s < x.d THEN least(i.e, x.d) END) AS t FROM x JOIN ins i ON i.device = x.device AND i.step = x.step WHERE x.d IS NOT NULL GROUP BY ALL)
SELECT device, step, b - a AS period, coalesce(t, a) - a AS target, d - coalesce(t, a) AS prep, e - d AS draft, b - e AS rest FROM y WHERE a <= coalesce(t, a) AND coalesce(t, a) <= d AND d <= e AND e <= b""",
)
def _(spark, d):
    own = F.col("stream") == "purchase"
    rows = in_steps(spark, d).withColumn("d", F.min(F.when(own, F.col("s"))).over(Window.partitionBy("device", "step")))
    x = rows.groupBy("device", "step", "a", "b", "d").agg(F.least(F.max(F.when(own, F.col("e"))), F.col("b")).alias("e"), F.max(F.when(~own & (F.col("s") < F.col("d")), F.least("e", "d"))).alias("t"))
    x = x.where("d is not null").withColumn("t", F.coalesce("t", "a")).where("a <= t and t <= d and d <= e and e <= b")
    return x.selectExpr("device", "step", "b - a AS period", "t - a AS target", "d - t AS prep", "e - d AS draft", "b - e AS rest")


@query(
    "core_block_flush",
    f"""WITH {IV}, o AS (SELECT *, count(CASE WHEN stream = 'purchase' THEN 1 END) OVER (PARTITION BY device ORDER BY s DESC, id DESC) AS g FROM iv),
h AS (SELECT device, g, id AS owner FROM o WHERE stream = 'purchase') SELECT o.id, coalesce(owner, -1) AS owner FROM o LEFT JOIN h ON o.device = h.device AND o.g = h.g""",
)
def _(spark, d):
    return S.owner_ahead(intervals(spark, d), LANE, F.col("stream") == "purchase", "id").select("id", F.coalesce("owner", F.lit(-1)).alias("owner"))


@query(
    "truncate_at_wide_gap",
    f"""WITH {BLOCKS}, p AS (SELECT *, max(e) OVER (PARTITION BY device, block ORDER BY s, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM bl),
c AS (SELECT *, sum(CASE WHEN s - pe > 7200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY device, block ORDER BY s, id ROWS UNBOUNDED PRECEDING) AS k FROM p)
SELECT device, block, max(e) AS busy_end, count(*) AS n FROM c WHERE k = 0 GROUP BY device, block""",
)
def _(spark, d):
    return S.busy_until_gap(blocks(spark, d), ["device", "block"], 7_200_000_000)


@query(
    "heaviest_repeated",
    f"""WITH {IV}, g AS (SELECT *, s - lag(s) OVER (PARTITION BY device, stream ORDER BY s, id) AS gap FROM iv),
a AS (SELECT device, stream, CAST(sum(e - s) AS BIGINT) AS total, median(gap) AS stride FROM g GROUP BY device, stream HAVING count(*) > 1),
r AS (SELECT *, row_number() OVER (PARTITION BY device ORDER BY total DESC, stream) AS k FROM a) SELECT device, stream, total, round(stride, 3) AS stride FROM r WHERE k = 1""",
)
def _(spark, d):
    return S.heaviest_repeated(intervals(spark, d), LANE, "stream").withColumn("stride", F.round("stride", 3))


@query(
    "period_score",
    f"""WITH {IV}, o AS (SELECT device, e - s AS v, row_number() OVER (PARTITION BY device ORDER BY s, id) AS i, count(*) OVER (PARTITION BY device) AS n FROM iv),
sc AS (SELECT x.device, y.i - x.i AS period, avg(least(x.v, y.v)::DOUBLE / greatest(x.v, y.v)) AS score FROM o x JOIN o y ON x.device = y.device AND y.i - x.i BETWEEN 2 AND 10 AND 2 * (y.i - x.i) <= x.n GROUP BY ALL)
SELECT device, period, round(score, 6) AS score FROM sc""",
)
def _(spark, d):
    out = S.period_scores(intervals(spark, d).withColumn("v", dur()), "v", LANE, range(2, 11))
    return out.withColumn("score", F.round("score", 6))


@query(
    "periodic_pattern_check",
    """WITH o AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations),
f AS (SELECT *, first_value(role) OVER (PARTITION BY conv_id, i % 2 ORDER BY i) AS r FROM o) SELECT conv_id, bool_and(role = r) AS ok, count(*) AS n FROM f GROUP BY conv_id""",
)
def _(spark, d):
    return S.pattern_holds(load(spark, d, "conversations"), ["conv_id"], ["turn"], "role", 2)


@query(
    "representative_window",
    f"""WITH {STEPS}, w AS (SELECT device, step, a, b - a AS span, count(*) AS n FROM ins GROUP BY device, step, a, b),
c AS (SELECT device, n, count(*) AS k FROM w GROUP BY device, n), md AS (SELECT device, arg_max(n, k * 1000000 + n) AS modal FROM c GROUP BY device),
v AS (SELECT w.* FROM w JOIN md ON w.device = md.device AND n = modal), me AS (SELECT device, median(span) AS mid FROM v GROUP BY device),
r AS (SELECT v.*, row_number() OVER (PARTITION BY v.device ORDER BY abs(span - mid), span, a) AS k FROM v JOIN me ON v.device = me.device) SELECT device, step, n, span FROM r WHERE k = 1""",
)
def _(spark, d):
    iv = intervals(spark, d)
    w = S.steps(iv, signup(), LANE).select("device", F.col("step").alias("unit"), "a", "b")
    return O.representative(iv, w).select("device", F.col("unit").alias("step"), "n", (F.col("b") - F.col("a")).alias("span"))


@query(
    "degraded_step_estimate",
    f"""WITH {CV}, r AS (SELECT *, row_number() OVER (PARTITION BY device ORDER BY cv, stream) AS k FROM cv), g AS (SELECT device, max(e) - min(s) AS span FROM iv GROUP BY device)
SELECT g.device, stream, launches, round(span::DOUBLE / launches, 3) AS step_us FROM g JOIN r ON g.device = r.device AND k = 1""",
)
def _(spark, d):
    x = P.degraded(intervals(spark, d).withColumnRenamed("stream", "name")).where("steps is not null")
    return x.select("device", F.col("name").alias("stream"), F.col("steps").alias("launches"), F.round(F.col("step_us") * 1000, 3).alias("step_us"))


@query(
    "device_ranking_by_mix",
    f"""WITH {IV}, n AS (SELECT device, count(*) AS n, {' + '.join(f"abs(count(CASE WHEN stream = '{x}' THEN 1 END)::DOUBLE / count(*) - 0.2)" for x in STREAMS)} AS dev FROM iv GROUP BY device)
SELECT device, n, round(dev, 3) AS deviation, row_number() OVER (ORDER BY round(dev, 3), n DESC, device) AS rank FROM n""",
)
def _(spark, d):
    x = P.device_ranking(intervals(spark, d).withColumnRenamed("stream", "name"), {x: x for x in STREAMS}, dict.fromkeys(STREAMS, 1))
    return x.select("device", F.col("launches").alias("n"), "deviation", F.col("rank").cast("long").alias("rank"))


def template_positions(spark, d):
    return O.templates(in_steps(spark, d), ["device", "step"], ["s", "id"], "stream")


def position_stats(t):
    return O.position_stats(t).withColumn("mean", F.round("mean", 3))


@query(
    "stable_position_stats",
    f"""WITH {STEPS}, t AS (SELECT device, step, string_agg(stream, '>' ORDER BY s, id) AS template FROM ins GROUP BY device, step), c AS (SELECT template, count(*) AS k FROM t GROUP BY template),
top AS (SELECT template FROM c ORDER BY k DESC, template LIMIT 20),
q AS (SELECT i.*, t.template, row_number() OVER (PARTITION BY i.device, i.step ORDER BY s, id) - 1 AS pos FROM ins i JOIN t ON i.device = t.device AND i.step = t.step JOIN top ON t.template = top.template)
SELECT template, pos, count(*) AS n, min(e - s) AS low, max(e - s) AS high, round(avg(e - s), 3) AS mean, max(e - s) - min(e - s) AS diff FROM q GROUP BY template, pos""",
)
def _(spark, d):
    t = template_positions(spark, d)
    top = t.where("pos = 0").groupBy("template").count().orderBy(F.desc("count"), "template").limit(20).select("template")
    return position_stats(t.join(top, "template"))


@query(
    "stable_position_stats_all",
    f"""WITH {STEPS}, t AS (SELECT device, step, string_agg(stream, '>' ORDER BY s, id) AS template FROM ins GROUP BY device, step),
q AS (SELECT i.*, t.template, row_number() OVER (PARTITION BY i.device, i.step ORDER BY s, id) - 1 AS pos FROM ins i JOIN t ON i.device = t.device AND i.step = t.step)
SELECT template, pos, count(*) AS n, min(e - s) AS low, max(e - s) AS high, round(avg(e - s), 3) AS mean, max(e - s) - min(e - s) AS diff FROM q GROUP BY template, pos""",
)
def _(spark, d):
    return position_stats(template_positions(spark, d))


@query(
    "inactivity_sessions",
    f"""WITH {IV}, g AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY device ORDER BY s, id) > 21600000000 THEN 1 ELSE 0 END AS new FROM iv),
k AS (SELECT *, sum(new) OVER (PARTITION BY device ORDER BY s, id ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT device, min(s) AS session_start, max(s) AS session_end, count(*) AS n FROM k GROUP BY device, session""",
)
def _(spark, d):
    return S.sessions(intervals(spark, d), LANE, "s", 21_600_000_000, ["s", "id"])
