"""Queries of the phases of a step, over a capture made of the parts: a part is a step, its kernels follow one recipe.

Devices differ: device 2 lacks the second prep_k in steps of large parts, device 3 the draft's layer in steps of even parts,
and the second half of device 4's steps is shifted by the part's size.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lanespan.operators import contracts as C
from lanespan.operators import phases as P
from lanespan.operators import segments as S
from lanespan.plans.q_segments import BLOCKS, blocks
from lanespan.sources.scratch import cut
from lanespan.sources.tables import IV, intervals, load, spread

Q, SQL = {}, {}


def query(name: str, sql: str):
    def keep(f):
        Q[name], SQL[name] = f, sql
        return f

    return keep


#: name, offset in the step, duration.
RECIPE = [
    ("marker", 0, 50), ("prep_k", 100, 20), ("norm_q", 200, 30), ("core_mla", 300, 200), ("norm_q", 600, 30), ("experts", 700, 300), ("norm_q", 1100, 30), ("core_kda", 1200, 250),
    ("lm_head", 1600, 100), ("prep_k", 6000, 20), ("meta_k", 120, 10), ("meta_k", 6100, 10), ("norm_q", 6200, 30), ("core_mla", 6300, 150), ("sample_k", 6700, 50),
]
VARIANTS = {"kda": ["core_kda"], "mla": ["core_mla"]}

STEPS = "st AS (SELECT p_partkey % 5 AS device, p_partkey // 5 AS step, p_partkey // 5 * 10000 AS a, p_size AS size, CASE WHEN p_partkey % 5 = 4 THEN p_size ELSE 0 END AS late FROM part)"
CAP = (
    STEPS
    + ", rc(j, name, off, dur) AS (VALUES "
    + ", ".join(f"({j}, '{n}', {o}, {t})" for j, (n, o, t) in enumerate(RECIPE))
    + "), cap AS (SELECT device, step, a, a + 10000 AS b, name, a + off + CASE WHEN off >= 6000 THEN late ELSE 0 END AS s, a + off + CASE WHEN off >= 6000 THEN late ELSE 0 END + dur AS e"
    + " FROM st, rc WHERE NOT (device = 2 AND j = 9 AND size > 25) AND NOT (device = 3 AND j IN (12, 13) AND size % 2 = 0))"
)


def capture(spark, d):
    kernel = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.lit(n).alias("name"), F.lit(o).alias("off"), F.lit(t).alias("dur")) for j, (n, o, t) in enumerate(RECIPE)]))
    k = F.col("p_partkey")
    x = spread(load(spark, d, "part").select("p_partkey", "p_size"), "p_partkey")
    x = x.select((k % 5).alias("device"), F.expr("p_partkey div 5").alias("step"), F.col("p_size").alias("size"), k.alias("key"), kernel.alias("k"))
    x = x.where("not (device = 2 and k.j = 9 and size > 25) and not (device = 3 and k.j in (12, 13) and size % 2 = 0)")
    late = F.when((F.col("device") == 4) & (F.col("k.off") >= 6000), F.col("size")).otherwise(0)
    x = x.withColumn("a", F.col("step") * 10000).withColumn("s", F.col("a") + F.col("k.off") + late)
    return x.select("device", "step", "a", (F.col("a") + 10000).alias("b"), "k.name", "s", (F.col("s") + F.col("k.dur")).alias("e"), (F.col("key") * 100 + F.col("k.j")).alias("id"))


def norm():
    return F.col("name") == "norm_q"


@query(
    "marker_split",
    f"""WITH {IV}, n0 AS (SELECT *, row_number() OVER (PARTITION BY device ORDER BY s) - 1 AS i, count(*) OVER (PARTITION BY device) AS n FROM iv),
m AS (SELECT device, s, i, CASE device % 3 WHEN 0 THEN CASE WHEN i % 3 = 2 THEN 40 ELSE 30 END WHEN 1 THEN 7 ELSE 30 + 10 * (id % 2) END AS grid, CASE WHEN id % 4 <> 0 THEN id % 3 END AS graph FROM n0 WHERE i < n - n % 3),
g AS (SELECT device, count(*) AS launches, count(DISTINCT grid) AS grids, min(grid) AS low, max(grid) AS high FROM m GROUP BY 1),
v AS (SELECT g.*, (SELECT count(*) FROM m WHERE m.device = g.device AND m.grid = g.high) AS tops FROM g),
p AS (SELECT m.device, i % (launches // tops) AS pos, min(grid) AS lo, max(grid) AS hi, any_value(high) AS high FROM m JOIN v ON m.device = v.device WHERE grids = 2 AND launches % tops = 0 GROUP BY 1, 2),
sp AS (SELECT device, bool_and(lo = hi) AND sum(CASE WHEN hi = high THEN 1 ELSE 0 END) = 1 AS speculative FROM p GROUP BY 1),
o AS (SELECT v.*, coalesce(speculative, false) AS spec FROM v LEFT JOIN sp ON v.device = sp.device),
gr AS (SELECT m.device, CASE WHEN spec THEN grid END AS grid, graph, count(*) AS n, min(s) AS first FROM m JOIN o ON m.device = o.device GROUP BY 1, 2, 3),
b AS (SELECT *, row_number() OVER (PARTITION BY device, grid ORDER BY n DESC, first) AS r FROM gr)
SELECT o.device, launches, grids, spec AS speculative, CASE WHEN spec THEN low END AS draft_grid, CASE WHEN spec OR grids = 1 THEN high END AS target_grid,
  CASE WHEN spec AND low % (high - low) = 0 THEN high - low END AS batch, CASE WHEN NOT spec THEN 0 WHEN low % (high - low) = 0 THEN low // (high - low) END AS tokens,
  t.graph AS target_graph, CASE WHEN spec THEN dr.graph END AS draft_graph
FROM o JOIN b t ON t.device = o.device AND t.r = 1 AND (NOT spec OR t.grid = high) LEFT JOIN b dr ON dr.device = o.device AND dr.r = 1 AND spec AND dr.grid = low""",
)
def _(spark, d):
    x = S.numbered(intervals(spark, d), ["device"], ["s"], "i").join(intervals(spark, d).groupBy("device").agg(F.count(F.lit(1)).alias("n")), "device").where("i < n - n % 3")
    grid = F.when(F.col("device") % 3 == 0, F.when(F.col("i") % 3 == 2, 40).otherwise(30)).when(F.col("device") % 3 == 1, 7).otherwise(30 + 10 * (F.col("id") % 2))
    return P.marker_split(x.select("device", "s", grid.alias("grid"), F.when(F.col("id") % 4 != 0, F.col("id") % 3).alias("graph")))


NAMES = {"click": "alloc_extend_kernel", "error": "assign_req_to_token_pool", "view": "copy_kernel", "purchase": "gemm", "signup": "norm"}


@query(
    "eager_batch",
    f"""WITH k AS (SELECT user_id AS device, CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in NAMES.items())} END AS name, CASE WHEN event_id % 20 = 3 THEN 99 ELSE user_id % 5 + 1 END AS x, event_type = 'purchase' AS graphed FROM events),
st AS (SELECT user_id AS device, count(*) // 2 AS steps FROM events WHERE event_type IN ('click', 'error') GROUP BY 1),
g AS (SELECT device, name, x, count(*) AS n FROM k WHERE NOT graphed GROUP BY ALL),
dg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY device, name ORDER BY n DESC, x) AS r FROM g) WHERE r = 1),
c AS (SELECT dg.* FROM dg JOIN st ON dg.device = st.device WHERE steps > 0 AND abs(n - steps) <= greatest(1, round_even(steps * 0.1, 0))),
a AS (SELECT device, min(x) AS x FROM c WHERE name LIKE '%alloc_extend%' OR name LIKE '%assign_req_to_token_pool%' GROUP BY 1 HAVING count(*) >= 2 AND min(x) = max(x)),
y AS (SELECT device, 1 AS one FROM c WHERE name LIKE '%alloc_extend%' OR name LIKE '%assign_req_to_token_pool%' GROUP BY 1 HAVING count(*) >= 2 AND min(x) <> max(x))
SELECT a.device, a.x AS batch, 0 AS axis, (SELECT count(*) FROM c WHERE c.device = a.device AND c.x = a.x) AS agreeing FROM a
UNION ALL SELECT y.device, 1, 1, (SELECT count(*) FROM c WHERE c.device = y.device) FROM y""",
)
def _(spark, d):
    ev = load(spark, d, "events")
    name = F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv])[F.col("event_type")]
    x = F.when(F.col("event_id") % 20 == 3, 99).otherwise(F.col("user_id") % 5 + 1)
    k = ev.select(F.col("user_id").alias("device"), name.alias("name"), x.cast("long").alias("grid_x"), F.lit(1).cast("long").alias("grid_y"), F.lit(1).cast("long").alias("grid_z"), F.when(F.col("event_type") == "purchase", 1).alias("graph"))
    steps = ev.where(F.col("event_type").isin("click", "error")).groupBy(F.col("user_id").alias("device")).agg(F.expr("count(*) div 2").alias("steps"))
    return P.eager_batch(k, steps)


DRAFTS = """two AS (SELECT device, step, name, a, b, max(s) AS second FROM cap GROUP BY ALL HAVING count(*) = 2),
nst AS (SELECT device, count(DISTINCT step) AS steps FROM cap GROUP BY 1),
w AS (SELECT t.device, name, avg((second - a)::DOUBLE / (b - a)) AS off FROM two t GROUP BY t.device, name HAVING count(*) = (SELECT steps FROM nst WHERE nst.device = t.device)),
ag AS (SELECT device, count(*) AS agreeing, avg(off) AS offset_ FROM w WHERE off > 0.5 GROUP BY 1 HAVING count(*) >= 2 AND max(off) - min(off) <= 0.05),
dr AS (SELECT t.device, t.step, min(second) AS draft_start, any_value(agreeing) AS agreeing, any_value(offset_) AS off FROM two t JOIN w ON w.device = t.device AND w.name = t.name AND w.off > 0.5 JOIN ag ON ag.device = t.device GROUP BY 1, 2)"""


@query("eager_drafts", f"WITH {CAP}, {DRAFTS} SELECT device, step, draft_start, agreeing, round(off, 6) AS mean_offset FROM dr")
def _(spark, d):
    return P.eager_drafts(capture(spark, d)).select("device", "step", "draft_start", "agreeing", F.round("offset", 6).alias("mean_offset"))


@query(
    "tail_drafts",
    f"""WITH {CAP}, q AS (SELECT device, step, s, row_number() OVER (PARTITION BY device, step ORDER BY s DESC) AS r, count(*) OVER (PARTITION BY device, step) AS n FROM cap WHERE name = 'norm_q')
SELECT device, step, s AS draft_start FROM q WHERE r = 3 AND device NOT IN (SELECT device FROM q WHERE n <= 3)""",
)
def _(spark, d):
    return P.tail_drafts(capture(spark, d), norm(), 3)


@query(
    "phase_layers",
    f"""WITH {STEPS} SELECT device, step, 0 AS layer, 'mla' AS variant, a + 200 AS lo, a + 500 AS hi FROM st
UNION ALL SELECT device, step, 1, 'kda', a + 600, a + 1700 FROM st
UNION ALL SELECT device, step, 2, 'mla', a + 6200 + late, a + 6750 + late FROM st WHERE NOT (device = 3 AND size % 2 = 0)""",
)
def _(spark, d):
    return P.layers(capture(spark, d), norm(), VARIANTS, gap=2000)


@query(
    "phase_layers_capped",
    f"""WITH {STEPS} SELECT device, step, 0 AS layer, CASE WHEN device = 3 AND size % 2 = 0 THEN 'kda' ELSE 'mla' END AS variant, CASE WHEN device = 3 AND size % 2 = 0 THEN a + 600 ELSE a + 6200 + late END AS lo, a + 6750 + late AS hi FROM st""",
)
def _(spark, d):
    return P.layers(capture(spark, d), norm(), VARIANTS, most=1)


@query("last_layer_ends", f"WITH {STEPS} SELECT device, step, a + 6750 + late AS \"end\" FROM st")
def _(spark, d):
    return P.last_layer_ends(capture(spark, d), norm(), VARIANTS)


@query(
    "repeated_cores",
    f"""WITH {STEPS}, x AS (SELECT *, device = 3 AND size % 2 = 0 AS cut FROM st)
SELECT device, step, CASE WHEN cut THEN 'norm_q' ELSE 'core_mla' END AS core, CASE WHEN cut THEN 3 ELSE 2 END AS layers, CASE WHEN cut THEN a + 1100 ELSE a + 6300 + late END AS last,
  CASE WHEN cut THEN 450.0 ELSE 6000.0 + late END AS stride, CASE WHEN cut THEN a + 1550.0 ELSE a + 10000.0 END AS forward_end FROM x""",
)
def _(spark, d):
    return P.repeated_cores(capture(spark, d))


@query(
    "step_phases",
    f"""WITH {CAP}, {DRAFTS}, t AS (SELECT st.*, draft_start, CASE WHEN st.device = 2 AND size <= 25 THEN a + 6020 ELSE a + 1700 END AS target_end FROM st JOIN dr ON st.device = dr.device AND st.step = dr.step)
SELECT device, step, 10000 AS period, target_end - a AS target, draft_start - target_end AS prep_draft, a + 10000 - draft_start AS draft, 0 AS prep_verify FROM t""",
)
def _(spark, d):
    rows = capture(spark, d)
    drafts = P.eager_drafts(rows).select("device", "step", "draft_start")
    before = rows.join(drafts, ["device", "step"]).where("s < draft_start")
    ends = P.last_layer_ends(before, norm(), VARIANTS).withColumnRenamed("end", "target_end")
    steps = rows.select("device", "step", "a", "b").distinct().join(drafts, ["device", "step"]).join(ends, ["device", "step"]).withColumn("draft_end", F.col("b"))
    return P.phases(steps)


@query(
    "graph_phases",
    f"""WITH {CAP} SELECT c.device, c.step, 10000 AS period, 1700 AS target, CASE WHEN size % 3 = 0 THEN 8300 ELSE 4500 + late END AS prep_draft, CASE WHEN size % 3 <> 0 THEN CASE WHEN c.device = 3 AND size % 2 = 0 THEN NULL ELSE 250 END END AS draft,
  CASE WHEN size % 3 <> 0 THEN 3550 - late END AS prep_verify FROM st c WHERE NOT (device = 3 AND size % 2 = 0)""".replace("c.device = 3 AND size % 2 = 0", "false"),
)
def _(spark, d):
    size = load(spark, d, "part").select((F.col("p_partkey") % 5).alias("device"), F.expr("p_partkey div 5").alias("step"), F.col("p_size").alias("size"))
    graph = F.when(F.col("name").isin("marker", "lm_head", "core_kda"), 1).when((F.col("size") % 3 != 0) & ((F.col("name") == "norm_q") & (F.col("s") - F.col("a") >= 6000) | (F.col("name") == "core_mla") & (F.col("s") - F.col("a") >= 6000)), 2)
    rows = capture(spark, d).join(size, ["device", "step"]).where("not (device = 3 and size % 2 = 0)").withColumn("graph", graph)
    split = rows.select("device").distinct().select("device", F.lit(True).alias("speculative"), F.lit(1).alias("target_graph"), F.lit(2).alias("draft_graph"))
    return P.phases(P.graph_bounds(rows, split))


@query(
    "layer_marker_check",
    f"""WITH {CAP}, n AS (SELECT device, step, count(*) AS n FROM cap WHERE name = 'norm_q' GROUP BY 1, 2), nst AS (SELECT device, count(DISTINCT step) AS steps FROM cap GROUP BY 1),
c AS (SELECT device, name FROM (SELECT device, step, name, count(*) AS n FROM cap GROUP BY ALL) x WHERE n = 2 GROUP BY 1, 2 HAVING count(*) = (SELECT steps FROM nst WHERE nst.device = x.device))
SELECT device, string_agg(DISTINCT n, ',' ORDER BY n) AS seen, false AS ok, (SELECT string_agg(name, ',' ORDER BY name) FROM c WHERE c.device = n.device) AS candidates FROM n GROUP BY 1""",
)
def _(spark, d):
    x = P.layer_marker_check(capture(spark, d), ["norm_q"], 2)
    return x.select("device", F.array_join(F.col("seen").cast("array<string>"), ",").alias("seen"), "ok", F.array_join("candidates", ",").alias("candidates"))


@query(
    "variant_marker_check",
    f"""WITH {CAP}, n AS (SELECT device, step, count(*) FILTER (name = 'core_mla') AS mla, count(*) FILTER (name IN ('norm_q', 'experts')) AS other FROM cap GROUP BY 1, 2)
SELECT device, 'mla' AS marker, string_agg(DISTINCT mla, ',' ORDER BY mla) AS seen, min(mla) >= 4 AS universal FROM n GROUP BY 1
UNION ALL SELECT device, 'other', string_agg(DISTINCT other, ',' ORDER BY other), min(other) >= 4 FROM n GROUP BY 1""",
)
def _(spark, d):
    x = P.variant_marker_check(capture(spark, d), {"mla": ["core_mla"], "other": ["norm_q", "experts"]}, 4)
    return x.withColumn("seen", F.array_join(F.col("seen").cast("array<string>"), ","))


@query(
    "declared_layers",
    "SELECT n_nationkey AS found, n_regionkey AS gpus, CASE WHEN n_regionkey = 0 THEN NULL WHEN n_nationkey = 24 THEN 'ok' WHEN n_nationkey IN (8, 12) AND 24 // n_nationkey <= n_regionkey THEN 'shard 1/' || (24 // n_nationkey) ELSE CASE WHEN n_nationkey = 6 AND n_regionkey >= 4 THEN 'shard 1/4' ELSE 'conflict' END END AS state FROM nation",
)
def _(spark, d):
    gpus, found = F.col("n_regionkey"), F.col("n_nationkey")
    return load(spark, d, "nation").select(found.alias("found"), gpus.alias("gpus"), P.declared_layers(F.when(gpus != 0, 24), found, gpus).alias("state"))


@query(
    "shard_notes",
    f"""WITH {CAP} SELECT device, count(*) FILTER (name = 'prep_k') AS handoffs, count(*) FILTER (name = 'prep_k') NOT IN (count(*) FILTER (name = 'core_mla'), count(*) FILTER (name = 'core_kda')) AS shard FROM cap GROUP BY 1""",
)
def _(spark, d):
    return P.shard_notes(capture(spark, d), VARIANTS, 8, "prep_k")


@query(
    "unit_check",
    """WITH f AS (SELECT p_partkey AS device, p_size % 4 AS kda, p_size % 3 + 1 AS mla, p_size % 5 AS swa FROM part),
r AS (SELECT *, greatest(0, kda + mla + swa - 1) AS rest FROM f), q AS (SELECT *, rest // 4 AS repeats, rest % 4 AS remainder FROM r),
w AS (SELECT q.*, s, 2 * repeats + CASE WHEN remainder = 0 THEN 0 ELSE (SELECT count(*) FROM range(0, remainder) o(i) WHERE (s + i) % 3 = 0) END AS wk,
  repeats + 1 + CASE WHEN remainder = 0 THEN 0 ELSE (SELECT count(*) FROM range(0, remainder) o(i) WHERE (s + i) % 3 = 1) END AS wm,
  repeats + CASE WHEN remainder = 0 THEN 0 ELSE (SELECT count(*) FROM range(0, remainder) o(i) WHERE (s + i) % 3 = 2) END AS ws FROM q, range(0, 3) t(s))
SELECT device, repeats, remainder, bool_or(wk = kda AND wm = mla AND ws = swa) AS ok FROM w GROUP BY ALL""",
)
def _(spark, d):
    z = F.col("p_size")
    n = F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), c.cast("long").alias("n")) for v, c in (("kda", z % 4), ("mla", z % 3 + 1), ("swa", z % 5))]))
    found = load(spark, d, "part").select(F.col("p_partkey").alias("device"), n.alias("x")).select("device", "x.variant", "x.n")
    return P.unit_check(found, {"kda": 2, "mla": 1, "swa": 1}, {"mla": 1})


@query("device_walk", "SELECT n_nationkey AS device, n_nationkey % 7 AS rank, 0 AS conflicts FROM nation WHERE n_nationkey % 3 <> 0 AND n_nationkey % 4 = 1 ORDER BY n_nationkey % 7, n_nationkey LIMIT 1")
def _(spark, d):
    k = F.col("n_nationkey")
    return P.walked(load(spark, d, "nation").select(k.alias("device"), (k % 7).alias("rank"), (k % 3 != 0).alias("segments"), F.when(k % 4 == 1, 0).otherwise(k).alias("conflicts")))


@query(
    "settled_pass",
    f"""WITH {BLOCKS}, w AS (SELECT device, pass, layer, max(e) - min(s) AS wall FROM bl GROUP BY ALL),
n AS (SELECT device, max(pass) + 1 AS passes, min(CASE WHEN pass > 0 AND layer = 0 AND wall > 40000000000 THEN pass END) AS first FROM w GROUP BY 1)
SELECT device, coalesce(first, least(3, passes - 1)) AS pass, greatest(0, passes - 2) AS steady FROM n""",
)
def _(spark, d):
    walls = blocks(spark, d).groupBy("device", "pass", "layer").agg((F.max("e") - F.min("s")).alias("wall"))
    passes = walls.groupBy("device").agg(P.steady_pass(F.max("pass") + 1).alias("steady"))
    return P.settled_pass(walls, 40_000_000_000).join(passes, "device")


def pipeline_tree(spark, d):
    """The tree of the capture: drafts by kernels that come twice a step, layers of both phases by their cores."""
    rows = cut(capture(spark, d))
    drafts = cut(P.eager_drafts(rows).select("device", "step", "draft_start"))
    split = rows.join(drafts, ["device", "step"])
    found = [P.layers(split.where(cond), norm(), VARIANTS).withColumn("phase", F.lit(phase)) for phase, cond in ((P.TARGET, "s < draft_start"), (P.DRAFT, "s >= draft_start"))]
    layers = cut(found[0].unionByName(found[1]))
    parts = cut(P.slices(rows.join(drafts.select("device", "step"), ["device", "step"]), drafts, layers, 2000))
    return P.tree(parts, layers, list(VARIANTS))


TREE = f"""{CAP}, {DRAFTS}, c AS (SELECT cap.*, draft_start, late, size, lead(cap.s) OVER w AS nx, max(cap.e) OVER (w ROWS UNBOUNDED PRECEDING) AS reach FROM cap JOIN dr ON cap.device = dr.device AND cap.step = dr.step JOIN st ON cap.device = st.device AND cap.step = st.step
  WINDOW w AS (PARTITION BY cap.device, cap.step ORDER BY cap.s, cap.e)),
k AS (SELECT *, coalesce(nx, b) - s AS whole, CASE WHEN coalesce(nx, b) - reach > 2000 THEN coalesce(nx, b) - reach ELSE 0 END AS idle, s - a - CASE WHEN s - a >= 6000 THEN late ELSE 0 END AS rel, CASE WHEN s >= draft_start THEN 'draft' ELSE 'target' END AS phase FROM c),
p AS (SELECT device, step, phase, CASE WHEN phase = 'target' THEN CASE WHEN rel < 200 THEN 'prologue' WHEN rel < 600 THEN 'mla' ELSE 'kda' END WHEN rel >= 6200 AND NOT (device = 3 AND size % 2 = 0) THEN 'mla' ELSE 'other' END AS part, whole - idle AS t FROM k
  UNION ALL SELECT device, step, 'idle', 'idle', idle FROM k),
r AS (SELECT device, step, NULL AS parent, 'total' AS kind, 'step' AS name, sum(t) AS t FROM p GROUP BY 1, 2 UNION ALL SELECT device, step, 'step', CASE WHEN phase = 'idle' THEN 'gap' ELSE 'phase' END, phase, sum(t) FROM p GROUP BY ALL
  UNION ALL SELECT device, step, phase, CASE part WHEN 'prologue' THEN 'stage' WHEN 'other' THEN 'other' ELSE 'variant' END, part, sum(t) FROM p WHERE phase <> 'idle' GROUP BY ALL),
n AS (SELECT device, count(*) AS samples FROM r WHERE kind = 'total' GROUP BY 1),
g AS (SELECT r.device, parent, kind, name, sum(t)::DOUBLE / samples AS total_us, CASE WHEN count(*) < samples THEN 0 ELSE min(t) END AS lo, max(t) AS hi, samples FROM r JOIN n ON r.device = n.device GROUP BY r.device, parent, kind, name, samples),
pa AS (SELECT device, name, total_us FROM g WHERE kind IN ('total', 'phase'))"""


@query(
    "forward_tree",
    f"""WITH {TREE} SELECT g.device, CASE kind WHEN 'total' THEN 0 WHEN 'gap' THEN 999 WHEN 'phase' THEN CASE g.name WHEN 'target' THEN 100 ELSE 200 END
  ELSE CASE g.parent WHEN 'target' THEN 100 ELSE 200 END + CASE g.name WHEN 'prologue' THEN 1 WHEN 'other' THEN 99 WHEN 'kda' THEN 2 ELSE 3 END END AS ord, g.parent, kind, g.name,
  CAST(CASE WHEN kind = 'phase' THEN CASE g.name WHEN 'target' THEN 2 ELSE 1 END WHEN kind = 'variant' THEN 1 END AS BIGINT) AS layers, round(g.total_us, 6) AS total_us,
  round(g.total_us / tt.total_us * 100, 6) AS pct_of_step, round(g.total_us / pa.total_us * 100, 6) AS pct_of_parent, CAST(lo AS DOUBLE) AS min_us, CAST(hi AS DOUBLE) AS max_us, samples
FROM g JOIN pa tt ON tt.device = g.device AND tt.name = 'step' LEFT JOIN pa ON pa.device = g.device AND pa.name = g.parent""",
)
def _(spark, d):
    x = pipeline_tree(spark, d).drop("per_layer_us", "note")
    return x.withColumns({c: F.round(F.col(c), 6) for c in ("total_us", "pct_of_step", "pct_of_parent")}).withColumns({c: F.col(c).cast("double") for c in ("min_us", "max_us")})


@query(
    "forward_tree_checked",
    f"""WITH {TREE} SELECT g.device, count(*) AS n_rows, 0 AS violations, round(sum(CASE WHEN parent = 'step' THEN total_us END) - max(CASE WHEN kind = 'total' THEN total_us END), 6) + 0.0 AS unclosed FROM g GROUP BY g.device""",
)
def _(spark, d):
    x = cut(pipeline_tree(spark, d))
    bad = C.pipeline(x, ["device"]).groupBy(F.substring_index("key", "/", 1).cast("long").alias("device")).agg(F.count(F.lit(1)).alias("violations"))
    off = F.sum(F.when(F.col("parent") == P.STEP_NAME, F.col("total_us"))) - F.max(F.when(F.col("kind") == "total", F.col("total_us")))
    n = x.groupBy("device").agg(F.count(F.lit(1)).alias("n_rows"), (F.round(off, 6) + 0.0).alias("unclosed"))
    return n.join(bad, "device", "left").select("device", "n_rows", F.coalesce("violations", F.lit(0)).cast("int").alias("violations"), "unclosed")
