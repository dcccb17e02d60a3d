"""Queries of the analysis document, its contracts, joins by containment, and logs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lanespan.operators import contracts as C
from lanespan.operators import document as D
from lanespan.operators import joins as J
from lanespan.plans.q_rollups import LP, joined
from lanespan.sources.tables import IV, intervals, load
from lanespan.streaming import logs as L

Q, SQL = {}, {}


def query(name: str, sql: str):
    def keep(f):
        Q[name], SQL[name] = f, sql
        return f

    return keep


def ops(spark, d):
    """Operators: a line item is one, its order's priority its module, its part's size its position."""
    x = joined(spark, d)
    return x.select(
        F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("ln"), F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk"), "category", F.col("cents").alias("cents"),
        (F.col("l_partkey") % 40).cast("string").alias("name"), F.concat(F.lit("m"), (F.col("l_suppkey") % 7).cast("string")).alias("module"), (F.col("qty") % 5).alias("region"), (F.col("qty") % 11).cast("double").alias("overlap_pct"),
    )


OPS = f"""{LP}, op AS (SELECT l_orderkey AS ok, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk, category, cents, CAST(l_partkey % 40 AS VARCHAR) AS name, 'm' || (l_suppkey % 7) AS module, qty % 5 AS region, CAST(qty % 11 AS DOUBLE) AS overlap_pct FROM lp)"""
LABEL = "CASE category WHEN 'core' THEN '核心计算' WHEN 'communication' THEN '通信' ELSE '辅助算子' END"


@query(
    "class_shares",
    f"""WITH {OPS}, c AS (SELECT * FROM (SELECT DISTINCT region FROM op), (VALUES (1, 'core'), (2, 'communication'), (3, 'auxiliary')) v(ord, category)),
g AS (SELECT c.region, c.ord, c.category, count(op.cents) AS count, coalesce(sum(op.cents), 0) AS d FROM c LEFT JOIN op ON op.region = c.region AND op.category = c.category GROUP BY 1, 2, 3)
SELECT region, ord, {LABEL} AS name, count, CAST(d AS DOUBLE) AS duration, round(d / 1000000.0, 6) AS duration_pct, round(d * 100.0 / sum(d) OVER (PARTITION BY region), 6) AS share_pct FROM g""",
)
def _(spark, d):
    x = D.class_shares(ops(spark, d).withColumn("duration", F.col("cents").cast("double")), 100_000_000.0, ["region"])
    return x.withColumns({"duration_pct": F.round("duration_pct", 6), "share_pct": F.round("share_pct", 6)})


@query(
    "folded_classes",
    f"""WITH {OPS}, g AS (SELECT category, min(ok * 10 + ln) AS first, sum(cents) AS cents, count(*) AS n FROM op GROUP BY 1)
SELECT category, CAST(cents AS BIGINT) AS cents, n, row_number() OVER (ORDER BY first) AS ord FROM g""",
)
def _(spark, d):
    x = ops(spark, d).groupBy("region", "category").agg(F.sum("cents").alias("cents"), F.count(F.lit(1)).alias("n"), F.min(F.col("ok") * 10 + F.col("ln")).alias("first"))
    return D.folded(x, "category", "first", ["cents", "n"])


@query(
    "renumbered_regions",
    """WITH n AS (SELECT n_regionkey AS region, n_nationkey AS key, CASE WHEN n_nationkey % 5 = 0 THEN 'total' WHEN n_nationkey % 3 = 0 THEN 'pattern' ELSE 'row' END AS kind FROM nation),
r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY region, key) AS k FROM n) SELECT region, key, kind, CASE kind WHEN 'row' THEN CAST(k AS VARCHAR) WHEN 'pattern' THEN 'P' || k END AS number FROM r""",
)
def _(spark, d):
    k = F.col("n_nationkey")
    x = load(spark, d, "nation").select(F.col("n_regionkey").alias("region"), k.alias("key"), F.when(k % 5 == 0, "total").when(k % 3 == 0, "pattern").otherwise("row").alias("kind"))
    return D.renumbered(x, "region", ["key"])


@query(
    "primary_duration",
    """SELECT p_partkey AS key, CASE WHEN p_size % 3 > 1 THEN '结构周期耗时' WHEN p_size % 4 > 1 THEN '平均结构单元耗时' ELSE '结构单元耗时' END AS label,
  round(CASE WHEN p_size % 3 > 1 OR p_size % 4 <= 1 THEN p_retailprice WHEN p_partkey % 2 = 0 THEN 5.0::DOUBLE ELSE p_retailprice / (p_size % 4) END, 6) AS duration FROM part""",
)
def _(spark, d):
    z = F.col("p_size")
    x = load(spark, d, "part").withColumn("d", D.primary_duration(z % 3, z % 4, F.when(F.col("p_partkey") % 2 == 0, 5.0), F.col("p_retailprice")))
    return x.select(F.col("p_partkey").alias("key"), "d.label", F.round("d.duration", 6).alias("duration"))


@query(
    "stage_keys",
    """SELECT p_partkey AS key, CASE WHEN p_size % 6 = 0 THEN p_brand WHEN p_size % 6 = 1 THEN p_size || '::' || p_brand ELSE p_size || '::u' || p_partkey || '::' || p_type || '::' || p_brand END AS stage,
  '{"index":' || p_partkey || ',"name":"' || p_name || '"' || CASE WHEN p_size > 10 THEN ',"durationUs":' || p_size || '.5' ELSE '' END || '}' AS payload FROM part""",
)
def _(spark, d):
    z, none = F.col("p_size"), F.lit(None).cast("string")
    unit = F.when(z % 6 == 0, D.PATTERN).when(z % 6 == 1, "").otherwise(F.concat(F.lit("u"), F.col("p_partkey").cast("string")))
    variant = F.when(z % 6 == 1, none).otherwise(F.col("p_type"))
    n = F.lit(None).cast("double")
    payload = D.operator_json(F.col("p_partkey"), F.col("p_name"), none, none, none, F.lit(None).cast("long"), F.when(z > 10, z + 0.5), n, n)
    return load(spark, d, "part").select(F.col("p_partkey").alias("key"), D.stage_key(z, unit, variant, F.col("p_brand")).alias("stage"), payload.alias("payload"))


@query(
    "kernel_table",
    f"""WITH {OPS}, p AS (SELECT region, name, module, sum(cents) AS d, sum(cents * overlap_pct) AS w, count(*) AS n FROM op GROUP BY 1, 2, 3),
g AS (SELECT region, name, sum(d) AS d, sum(w) AS w, sum(n) AS n, string_agg(module, '、' ORDER BY d DESC, module) AS modules FROM p GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY d DESC, name) AS rank FROM g)
SELECT region, rank, name, modules, CAST(d AS DOUBLE) AS duration, round(d / 10000.0, 6) AS pct, round(w / d, 6) AS overlap_pct, CAST(n AS BIGINT) AS n FROM r WHERE rank <= 10""",
)
def _(spark, d):
    x = D.kernel_table(ops(spark, d).withColumn("duration", F.col("cents").cast("double")), 1_000_000.0, 10, ["region"])
    return x.withColumns({"pct": F.round("pct", 6), "overlap_pct": F.round("overlap_pct", 6)})


@query(
    "best_shares",
    "SELECT p_brand AS brand, count(*) AS operators, CAST(max(CASE WHEN p_size % 4 = 0 THEN 0 ELSE p_size END) AS DOUBLE) AS max_mfu, CAST(0 AS DOUBLE) AS max_mbu FROM part GROUP BY 1",
)
def _(spark, d):
    z = F.col("p_size")
    return D.best_shares(load(spark, d, "part").select(F.col("p_brand").alias("brand"), F.when(z % 4 != 0, z.cast("double")).alias("mfu"), F.lit(None).cast("double").alias("mbu")), ["brand"])


@query(
    "hot_and_view_order",
    """WITH p AS (SELECT p_brand AS brand, p_partkey AS idx, p_size AS duration, p_partkey % 10 AS start, 'layer.' || (p_partkey % 23) AS layer FROM part)
SELECT brand, idx, row_number() OVER (PARTITION BY brand ORDER BY duration DESC, start, idx) AS hot, row_number() OVER (PARTITION BY brand ORDER BY start, idx) AS timed,
  row_number() OVER (PARTITION BY brand ORDER BY idx % 23, idx) AS natural FROM p""",
)
def _(spark, d):
    k = F.col("p_partkey")
    p = load(spark, d, "part").select(F.col("p_brand").alias("brand"), k.alias("idx"), F.col("p_size").alias("duration"), (k % 10).alias("start"), F.concat(F.lit("layer."), (k % 23).cast("string")).alias("layer"))
    by_name = Window.partitionBy("brand").orderBy(*D.natural(F.col("layer")), "idx")
    return p.select("brand", "idx", F.row_number().over(D.hot_order(["brand"])).alias("hot"), D.view_rank(["brand"], True).alias("timed"), F.row_number().over(by_name).alias("natural"))


@query(
    "anchor_device_choice",
    f"WITH {IV}, n AS (SELECT device, count(*) AS n FROM iv WHERE stream = 'signup' GROUP BY 1) SELECT device, n, n % 4 = 0 AS exact FROM n ORDER BY n % 4 = 0 DESC, n DESC, device LIMIT 1",
)
def _(spark, d):
    n = intervals(spark, d).where("stream = 'signup'").groupBy("device").agg(F.count(F.lit(1)).alias("n"))
    return D.chosen_device(n, 4)


@query(
    "small_groups_hidden",
    f"WITH {OPS} SELECT ok, CAST(sum(cents) AS BIGINT) AS total FROM op GROUP BY 1 HAVING sum(cents) >= 20000000",
)
def _(spark, d):
    return D.above(ops(spark, d), ["ok"], "cents", 20_000_000)


@query("prefix_totals", "SELECT p_partkey AS key, p_size + p_partkey AS total FROM part")
def _(spark, d):
    x = load(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_size").alias("mhc"), F.col("p_partkey").alias("mhc_pre"), F.lit(7).alias("mhcx"), F.lit(None).cast("long").alias("mhc_post"))
    return x.select("key", D.prefix_total(x.columns, "mhc").alias("total"))


@query(
    "dispatch_cache_rows",
    f"""WITH {OPS}, r AS (SELECT name AS kernel, ok * 1000000 + ln * 100000 + sk % 100000 AS ord, CASE WHEN ok % 3 = 0 THEN '' ELSE 'f' || (ok % 5) || '.py:1' END AS file_line, 'fn' || (ok % 5) AS fn, module, region, cents FROM op),
u AS (SELECT *, row_number() OVER (PARTITION BY kernel ORDER BY file_line = '', ord, file_line, fn) AS k FROM r),
s AS (SELECT kernel, string_agg(module, ',' ORDER BY first, module) AS submodules FROM (SELECT kernel, module, min(ord) AS first FROM r GROUP BY 1, 2) GROUP BY 1)
SELECT r.kernel, max(CASE WHEN k = 1 THEN file_line END) AS file_line, max(CASE WHEN k = 1 THEN fn END) AS function, any_value(submodules) AS submodules, count(DISTINCT region) AS layers, count(*) AS launches, CAST(sum(cents) AS DOUBLE) AS total_us, max(CASE WHEN k = 1 THEN file_line END) <> '' AS resolved
FROM u r JOIN s ON r.kernel = s.kernel GROUP BY 1""",
)
def _(spark, d):
    ord_ = F.col("ok") * 1000000 + F.col("ln") * 100000 + F.col("sk") % 100000
    place = F.when(F.col("ok") % 3 == 0, "").otherwise(F.concat(F.lit("f"), (F.col("ok") % 5).cast("string"), F.lit(".py:1")))
    r = ops(spark, d).select(F.col("name").alias("kernel"), ord_.alias("ord"), place.alias("file_line"), F.concat(F.lit("fn"), (F.col("ok") % 5).cast("string")).alias("function"), F.col("module").alias("submodule"), F.col("region").alias("layer"), F.col("cents").cast("double").alias("time_us"))
    return D.dispatch_cache(r).withColumn("submodules", F.array_join("submodules", ","))


@query(
    "labels_and_samples",
    """SELECT n_nationkey AS key, CASE n_regionkey WHEN 0 THEN n_name WHEN 1 THEN n_name || ' + b' WHEN 2 THEN n_name WHEN 3 THEN 'told' ELSE 'one complete repeating unit' END AS unit,
  CASE n_regionkey WHEN 0 THEN 'own' WHEN 1 THEN (n_nationkey + 0.5) || ' TFLOPS/GPU effective dense peak' WHEN 2 THEN n_nationkey || ' TFLOPS/GPU effective dense peak' END AS peak,
  CASE n_regionkey WHEN 0 THEN 5 WHEN 1 THEN 7 WHEN 2 THEN 9 END AS samples,
  CASE n_regionkey WHEN 0 THEN 'a/srt/b.py(3): g' WHEN 1 THEN 'x.py(2): f' WHEN 2 THEN 'end' END AS frame FROM nation""",
)
def _(spark, d):
    r, k, name = F.col("n_regionkey"), F.col("n_nationkey"), F.col("n_name")
    parts = F.when(r == 1, F.array(name, F.lit(""), F.lit("b"))).when(r == 2, F.array(name)).otherwise(F.array().cast("array<string>"))
    unit = D.repeating_label(F.when(r == 0, name), parts, F.when(r == 3, "told"))
    peak = D.peak_label(F.when(r == 0, "own"), F.when(r == 1, k + 0.5).when(r == 2, k.cast("double")))
    empty = F.create_map().cast("map<string,bigint>")
    of = lambda key, n: F.create_map(F.lit(key), F.lit(n).cast("bigint"))
    stats = F.when(r == 0, of("accepted_samples", 5)).otherwise(empty)
    manifest = {"sampling": F.when(r == 1, F.map_concat(of("accepted_samples", 8), of("accepted_unit_count", 7))).otherwise(empty), "stable_stats": F.when(r <= 2, of("accepted_sample_count", 9)).otherwise(empty)}
    chain = F.when(r == 0, F.array(F.lit("top.py(1): m"), F.lit("a/srt/b.py(3): g"), F.lit("x.py(2): f"))).when(r == 1, F.array(F.lit("top.py(1): m"), F.lit("x.py(2): f"), F.lit("end"))).when(r == 2, F.array(F.lit("begin"), F.lit("end")))
    return load(spark, d, "nation").select(k.alias("key"), unit.alias("unit"), peak.alias("peak"), D.sample_count(stats, manifest).alias("samples"), D.dispatch_frame(chain, "/srt/").alias("frame"))


TABLES = """pl AS (SELECT p_partkey AS k, ord, CASE ord WHEN 0 THEN 'total' WHEN 1 THEN 'phase' WHEN 2 THEN 'variant' WHEN 3 THEN 'other' WHEN 4 THEN 'phase' WHEN 5 THEN CASE WHEN p_size = 9 THEN 'odd' ELSE 'stage' END ELSE 'gap' END AS kind,
  CASE ord WHEN 0 THEN 1000 WHEN 1 THEN 600 WHEN 2 THEN 400 WHEN 3 THEN CASE WHEN p_size % 7 = 0 THEN 150 ELSE 200 END WHEN 4 THEN 300 WHEN 5 THEN 300 ELSE CASE WHEN p_size % 5 = 0 THEN -100 ELSE 100 END END::DOUBLE AS total_us,
  CASE WHEN ord = 6 AND p_size % 3 <> 0 THEN 'holes' END AS note FROM part, range(0, 7) t(ord) WHERE NOT (p_size = 11 AND ord = 0) AND NOT (p_size = 13 AND ord > 0) AND NOT (p_size = 17 AND ord IN (1, 4)))"""


def pipeline_tables(spark, d):
    rows = load(spark, d, "part").withColumn("ord", F.explode(F.sequence(F.lit(0), F.lit(6))))
    z, o = F.col("p_size"), F.col("ord")
    rows = rows.where("not (p_size = 11 and ord = 0) and not (p_size = 13 and ord > 0) and not (p_size = 17 and ord in (1, 4))")
    kinds = ["total", "phase", "variant", "other", "phase", "stage", "gap"]
    kind = F.when((o == 5) & (z == 9), "odd").otherwise(F.element_at(F.array(*map(F.lit, kinds)), o + 1))
    us = F.element_at(F.array(*map(F.lit, (1000.0, 600.0, 400.0, 200.0, 300.0, 300.0, 100.0))), o + 1)
    us = F.when((o == 3) & (z % 7 == 0), 150.0).when((o == 6) & (z % 5 == 0), -100.0).otherwise(us)
    return rows.select(F.col("p_partkey").alias("k"), "ord", kind.alias("kind"), F.concat(F.lit("r"), o.cast("string")).alias("name"), us.alias("total_us"), F.when((o == 6) & (z % 3 != 0), "holes").alias("note"))


@query(
    "pipeline_contract",
    f"""WITH {TABLES}, p AS (SELECT p_partkey AS k, p_size AS z FROM part)
SELECT 'kind' AS check_id, CAST(k AS VARCHAR) AS key FROM p WHERE z = 9 UNION ALL SELECT 'one_total', CAST(k AS VARCHAR) FROM p WHERE z = 11 UNION ALL SELECT 'total_above_0', CAST(k AS VARCHAR) FROM p WHERE z = 11
UNION ALL SELECT 'has_phase', CAST(k AS VARCHAR) FROM p WHERE z = 17 UNION ALL SELECT 'has_parent', k || '/r' || o FROM p, (VALUES (2), (3), (5)) t(o) WHERE z = 17
UNION ALL SELECT 'phase_closes', k || '/r1' FROM p WHERE z % 7 = 0 AND z NOT IN (11, 13, 17) UNION ALL SELECT 'phase_closes', k || '/r' || o FROM p, (VALUES (1), (4)) t(o) WHERE z = 11
UNION ALL SELECT 'gap_not_negative', k || '/r6' FROM p WHERE z % 5 = 0 AND z <> 13 UNION ALL SELECT 'gap_has_note', k || '/r6' FROM p WHERE z % 3 = 0 AND z <> 13
UNION ALL SELECT 'step_closes', CAST(k AS VARCHAR) FROM p WHERE (z % 5 = 0 OR z IN (11, 17)) AND z <> 13""",
)
def _(spark, d):
    return C.pipeline(pipeline_tables(spark, d), ["k"]).select("check_id", "key")


@query(
    "attribution_contract",
    """WITH r AS (SELECT p_partkey AS seq, p_brand AS v, CAST(p_size % 3 AS VARCHAR) AS pos, p_size * 1.0 AS d, CASE WHEN p_partkey % 4 = 0 THEN 'ncclSendRecv' ELSE 'gemm' END AS op FROM part),
n AS (SELECT v, pos, count(*) AS n FROM r GROUP BY 1, 2), m AS (SELECT v, min(n) AS lo, max(n) AS hi FROM n GROUP BY 1)
SELECT 'longer_than_unit' AS check_id, v || '/' || pos || '/' || seq AS key FROM r WHERE d > 45 * 1.001 UNION ALL SELECT 'handoff', v || '/' || pos || '/' || seq FROM r WHERE op = 'ncclSendRecv' AND d <= 45 * 1.001 AND d > 45 * 0.2
UNION ALL SELECT 'positions_differ', v FROM m WHERE hi > lo * 1.15""",
)
def _(spark, d):
    z = F.col("p_size")
    r = load(spark, d, "part").select(F.col("p_partkey").alias("seq"), F.col("p_brand").alias("unit_variant"), (z % 3).cast("string").alias("unit_position"), z.cast("double").alias("duration"), F.when(F.col("p_partkey") % 4 == 0, "ncclSendRecv").otherwise("gemm").alias("operator_name"))
    return C.attribution(r, F.lit(45.0)).select("check_id", "key")


@query(
    "composition_contract",
    """SELECT 'variants' AS check_id, 'ghost' AS key, 'not shown' AS detail UNION ALL SELECT 'variants', 'v4', 'undeclared' UNION ALL SELECT 'position_shown', '9', 'ghost' UNION ALL SELECT 'position_variant', '2', 'v2,v4'
UNION ALL SELECT 'unscoped', '', 'v' || n_regionkey FROM nation WHERE n_nationkey = 20 UNION ALL SELECT 'modules', 'v1', 'zz' UNION ALL SELECT 'modules', 'ghost', 'a' UNION ALL SELECT 'distinctive', 'v1', 'none shown' UNION ALL SELECT 'sampling', '3', '2' UNION ALL SELECT 'manifest', '1', 'missing' UNION ALL SELECT 'single_sample', '2', 'one sample'""".replace("'sampling', '3', '2'", "'samples', '3', '2'"),
)
def _(spark, d):
    n = load(spark, d, "nation")
    r, k = F.col("n_regionkey"), F.col("n_nationkey")
    position = F.when(k == 20, "").when(r == 4, "2").otherwise(r.cast("string"))
    shown = n.select(position.alias("position"), F.concat(F.lit("v"), r.cast("string")).alias("variant"), F.concat(F.lit("m"), (k % 2).cast("string")).alias("module"))
    declared = spark.createDataFrame([(str(i), f"v{i}") for i in range(4)] + [("9", "ghost")], "position string, variant string")
    modules = spark.createDataFrame([("v0", ["m0", "m1"], ["m1"]), ("v1", ["m0", "zz"], ["zz"]), ("ghost", ["a"], [])], "variant string, modules array<string>, distinctive array<string>")
    manifests = load(spark, d, "region").select(F.col("r_regionkey").cast("string").alias("package"), (F.col("r_regionkey") != 1).alias("present"), (F.col("r_regionkey") == 2).alias("single_sample"), F.when(F.col("r_regionkey") == 3, 2).when(F.col("r_regionkey") == 4, 3).cast("long").alias("accepted"))
    return C.all_violations(C.composition(declared, shown), C.modules_of_variants(modules, shown), C.sampling(manifests))


VOCABULARY = {"blocks": {"attention": {"stages": [{"name": "Brand#1", "deprecated_aliases": ["Brand#2"]}, {"name": "Brand#3"}]}, "moe": {"stages": [{"name": "Brand#4"}, {"name": "Brand#5"}]}}, "communication": [{"name": "Brand#6"}]}


@query(
    "stage_composition",
    """WITH v(module, block) AS (VALUES ('Brand#1', 'attention'), ('Brand#2', 'attention'), ('Brand#3', 'attention'), ('Brand#4', 'moe'), ('Brand#5', 'moe')),
s AS (SELECT CAST(p_size % 10 AS VARCHAR) AS position, p_brand AS module, CAST(sum(p_size * p_size) AS DOUBLE) AS d FROM part GROUP BY 1, 2),
b AS (SELECT position, block, sum(d) AS total FROM s JOIN v USING (module) GROUP BY 1, 2)
SELECT 'deprecated' AS check_id, 'Brand#2' AS key FROM s WHERE module = 'Brand#2' GROUP BY 1, 2 UNION ALL SELECT 'stages_per_position', position FROM s GROUP BY position HAVING count(*) NOT BETWEEN 5 AND 12
UNION ALL SELECT 'thin', module || '@' || s.position FROM s JOIN v USING (module) JOIN b ON b.position = s.position AND b.block = v.block WHERE d / total < 0.02""",
)
def _(spark, d):
    s = load(spark, d, "part").groupBy((F.col("p_size") % 10).cast("string").alias("position"), F.col("p_brand").alias("module")).agg(F.sum(F.col("p_size") * F.col("p_size")).cast("double").alias("duration"))
    return C.stage_composition(s, C.vocabulary_frame(spark, VOCABULARY), 5, 12).select("check_id", "key")


@query(
    "positional_contract",
    """WITH a AS (SELECT row_number() OVER (ORDER BY n_nationkey) AS k, n_name AS v FROM nation), b AS (SELECT row_number() OVER (ORDER BY n_nationkey) AS k, CASE WHEN n_nationkey % 6 = 5 THEN 'x' ELSE n_name END AS v FROM nation WHERE n_nationkey < 23)
SELECT CAST(coalesce(a.k, b.k) AS VARCHAR) AS key FROM a FULL JOIN b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v""",
)
def _(spark, d):
    n = load(spark, d, "nation").withColumn("k", F.row_number().over(Window.orderBy("n_nationkey")))  # 25 rows
    b = n.where("n_nationkey < 23").withColumn("n_name", F.when(F.col("n_nationkey") % 6 == 5, "x").otherwise(F.col("n_name")))
    return C.positional(n, b, "k", "k", "n_name").select("key")


@query(
    "fingerprint_and_drift",
    """SELECT 'fingerprint' AS check_id, CAST(n_nationkey AS VARCHAR) AS key FROM nation WHERE n_nationkey % 4 = 1 AND n_nationkey < 20 UNION ALL SELECT 'drift', CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_nationkey % 7 = 3
UNION ALL SELECT 'too_long', CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_nationkey % 7 = 4 AND n_nationkey > 10""",
)
def _(spark, d):
    n, k = load(spark, d, "nation"), F.col("n_nationkey")
    told = n.select(k.alias("path"), k.alias("size"), F.sha2("n_name", 256).alias("sha256"))
    found = n.where("n_nationkey < 20").select(k.alias("path"), k.alias("size"), F.sha2(F.when(k % 4 == 1, "changed").otherwise(F.col("n_name")), 256).alias("sha256"))
    skeleton = n.select(k.alias("line"), F.when(k % 7 == 4, "text: {{hole}}").otherwise(F.col("n_name")).alias("text"))
    report = n.select(k.alias("line"), F.when(k % 7 == 4, F.concat(F.lit("<b class='a b c'>"), F.repeat(F.lit("ab "), k))).when(k % 7 == 3, "edited").otherwise(F.col("n_name")).alias("text"))
    return C.all_violations(C.fingerprints(told, found), C.report_drift(report, skeleton, "{{hole}}", 20)).select("check_id", "key")


@query(
    "frontend_contract",
    """SELECT 'schema' AS check_id, '4' AS key UNION ALL SELECT 'category', '3' UNION ALL SELECT 'operator_count', '2' UNION ALL SELECT 'scope', '2' UNION ALL SELECT 'variants', '1' UNION ALL SELECT 'unscoped', '3' UNION ALL SELECT 'stages', '1' UNION ALL SELECT 'stages', '3' UNION ALL SELECT 'units', '1' UNION ALL SELECT 'unit_order', '3'""",
)
def _(spark, d):
    n = load(spark, d, "nation").select(F.col("n_regionkey").alias("package"), F.col("n_nationkey").alias("k"), F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")).alias("i"))
    p, i = F.col("package"), F.col("i")
    variant = F.when(p == 1, "only").otherwise(F.when(i % 2 == 0, "even").otherwise("odd"))
    ops_ = n.select("package", F.when((p == 3) & (i == 1), "other").otherwise("core").alias("category"), F.when((p == 3) & (i == 2), None).otherwise(i).alias("position"), F.lit("u").alias("unit"), variant.alias("variant"))
    stages = n.select("package", F.when((p == 3) & (i == 1), None).otherwise(i).alias("position"), F.lit("u").alias("unit"), variant.alias("variant"))
    stages = stages.where("package <> 0").unionByName(n.where("package = 0").select("package", F.lit(None).cast("int").alias("position"), F.lit("__pattern_total__").alias("unit"), F.lit("").alias("variant")))
    units = n.select("package", i.alias("ord"), F.when((p == 3) & (i == 2), 7).otherwise(i).alias("position"), variant.alias("variant"))
    summary = load(spark, d, "region").withColumnRenamed("r_regionkey", "package").select("package", F.when(p == 4, "2.0").otherwise("1.0").alias("schema"), F.when(p == 2, 4).otherwise(5).cast("long").alias("operator_count"), F.when(p == 2, F.array().cast("array<int>")).otherwise(F.array(F.lit(0))).alias("devices"), F.lit(3).alias("samples"), (~p.isin(2, 4)).alias("heterogeneous"), F.array(F.lit("odd"), F.lit("even")).alias("variants"))
    return C.frontend(summary, ops_, stages, units).select("check_id", F.col("key"))


@query(
    "enclosing_frames",
    f"""WITH {IV}, f AS (SELECT * FROM iv WHERE stream IN ('purchase', 'view')), p AS (SELECT * FROM iv WHERE stream = 'click'),
c AS (SELECT p.id, f.id AS frame, f.e >= p.e AS whole, row_number() OVER (PARTITION BY p.id ORDER BY f.e < p.e, f.e - f.s, f.id) AS r FROM p JOIN f ON f.device = p.device AND f.s <= p.s AND p.s <= f.e)
SELECT p.id, frame, coalesce(whole, false) AS whole FROM p LEFT JOIN c ON c.id = p.id AND r = 1""",
)
def _(spark, d):
    iv = intervals(spark, d)
    return J.enclosing(iv.where("stream = 'click'"), iv.where("stream in ('purchase', 'view')"), ["device"], "id").select("id", "frame", "whole")


@query(
    "operators_by_external_id",
    f"""WITH {IV}, x AS (SELECT *, CASE WHEN id % 7 <> 0 THEN device * 10 + id % 3 END AS ext FROM iv), f AS (SELECT * FROM x WHERE stream = 'view'), p AS (SELECT * FROM x WHERE stream = 'click'),
c AS (SELECT p.id, f.id AS op, row_number() OVER (PARTITION BY p.id ORDER BY CASE WHEN f.s <= p.s AND p.s <= f.e THEN CASE WHEN f.e >= p.e THEN 0 ELSE 1 END ELSE 2 END, CASE WHEN f.s <= p.s AND p.s <= f.e THEN f.e - f.s ELSE -f.s END, f.id) AS r FROM p JOIN f ON f.ext = p.ext)
SELECT p.id, op AS operator FROM p LEFT JOIN c ON c.id = p.id AND r = 1""",
)
def _(spark, d):
    x = intervals(spark, d).withColumn("ext", F.when(F.col("id") % 7 != 0, F.col("device") * 10 + F.col("id") % 3))
    return J.operator_of(x.where("stream = 'click'"), x.where("stream = 'view'"), "ext", "id", "id").select("id", "operator")


@query(
    "taxonomy_positions",
    "SELECT p_partkey AS key, CASE WHEN p_size = 1 THEN 'first' WHEN p_size = 2 THEN 'second' WHEN p_name LIKE '%ring%' THEN 'rings' END AS position FROM part",
)
def _(spark, d):
    positions = spark.createDataFrame([("first", 1, None), ("second", 2, None), ("rings", None, "RING")], "position string, layer_id int, pattern string")
    rows = load(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_size").alias("layer_id"), F.when(F.col("p_size") > 2, F.col("p_name")).otherwise("none").alias("module"))
    return J.positioned(rows, positions, "key").select("key", "position")


LOG = "lg AS (SELECT source AS log, doc_id AS ord, coalesce(text, '') AS text, strlen(coalesce(text, '')) + 1 AS size, sum(strlen(coalesce(text, '')) + 1) OVER (PARTITION BY source ORDER BY doc_id) - strlen(coalesce(text, '')) - 1 AS off FROM documents WHERE source IS NOT NULL)"


def log_lines(spark, d):
    size = F.octet_length(F.coalesce("text", F.lit(""))) + 1
    x = load(spark, d, "documents").where("source is not null").select(F.col("source").alias("log"), F.col("doc_id").alias("ord"), F.coalesce("text", F.lit("")).alias("text"), size.cast("long").alias("size"))
    return x.withColumn("offset", F.sum("size").over(Window.partitionBy("log").orderBy("ord")) - F.col("size"))


@query(
    "log_pages",
    f"""WITH {LOG}, e AS (SELECT log, max(off + size) AS e FROM lg GROUP BY 1), c AS (SELECT log, CASE WHEN log = 'src1' THEN 0 ELSE CASE WHEN log = 'src2' THEN 0 ELSE 1500 END END AS cursor, log = 'src2' AS reset FROM e),
r AS (SELECT lg.log, cursor, reset, ord, off, size, min(off) OVER (PARTITION BY lg.log) AS first FROM lg JOIN c ON lg.log = c.log WHERE off >= cursor)
SELECT log, cursor, reset, off AS "offset" FROM r WHERE off = first OR off + size <= cursor + 9000""",
)
def _(spark, d):
    lines = log_lines(spark, d)
    at = F.when(F.col("log") == "src1", 0).when(F.col("log") == "src2", 10**15).otherwise(1500)
    return L.page(lines, lines.select("log").distinct().withColumn("cursor", at.cast("long")), 9000).drop("text")


@query(
    "bounded_logs",
    f"""WITH {LOG} SELECT log, ord, md5(CASE WHEN off + size > 20000 THEN '[log is full]' ELSE text END) AS digest FROM lg WHERE off < 20000""",
)
def _(spark, d):
    return L.bounded(log_lines(spark, d), 20_000).select("log", "ord", F.md5("text").alias("digest"))


@query(
    "idle_lanes",
    f"WITH {IV}, t AS (SELECT max(s) AS now FROM iv) SELECT device, max(s) AS last, any_value(now) - max(s) AS idle, any_value(now) - max(s) > 14400000000 AS stalled FROM iv, t GROUP BY 1",
)
def _(spark, d):
    iv = intervals(spark, d)
    now = iv.agg(F.max("s").alias("now"))  # one row
    return L.idle(iv, ["device"], "s", F.lit(now.first()["now"]), 4 * 3_600_000_000)


@query(
    "accepted_units",
    """WITH u AS (SELECT l_orderkey % 9 AS lane, l_orderkey AS unit, string_agg(l_returnflag, ',' ORDER BY l_linenumber, l_returnflag) AS seq FROM lineitem GROUP BY 1, 2),
g AS (SELECT lane, seq, count(*) AS n FROM u GROUP BY 1, 2) SELECT lane, CAST(sum(n) AS BIGINT) AS units, max(n) AS accepted, max(n) >= 3 AS enough FROM g GROUP BY 1""",
)
def _(spark, d):
    x = load(spark, d, "lineitem").select((F.col("l_orderkey") % 9).alias("lane"), F.col("l_orderkey").alias("unit"), F.col("l_linenumber").alias("ord"), F.col("l_returnflag").alias("name"))
    return L.accepted_units(x, ["lane"], "unit", ["ord"], "name")


CODE = '''import torch

def run(self, x,
        y):
    """Runs."""
    if x > {z}:
        return ops.mla_kernel(x,
                              y)
    else:
        prepare(x)
    return kernel[grid](y)

def other{z}(x):
    return x
'''


@query(
    "source_resolution",
    """WITH p AS (SELECT p_partkey AS id, p_size AS z, p_partkey % 5 AS m FROM part)
SELECT id, CASE m WHEN 3 THEN 13 WHEN 4 THEN NULL WHEN 2 THEN NULL ELSE 3 END AS def_line, CASE WHEN m IN (0, 1) THEN m = 1 WHEN m = 3 THEN true END AS drift,
  CASE m WHEN 0 THEN 7 WHEN 1 THEN 11 END AS line,
  CASE m WHEN 0 THEN '        return ops.mla_kernel(x,' || chr(10) || '                              y)' WHEN 1 THEN '    return kernel[grid](y)' END AS snippet,
  CASE m WHEN 0 THEN 'if x > ' || z || ':' END AS branch, CASE m WHEN 3 THEN '    return x' END AS body,
  CASE m WHEN 0 THEN 'statement' WHEN 1 THEN 'statement' WHEN 3 THEN 'body' WHEN 4 THEN 'no file' ELSE 'no function' END AS evidence FROM p""",
)
def _(spark, d):
    from lanespan.sources import code as S

    p = load(spark, d, "part")
    z, m = F.col("p_size").cast("string"), F.col("p_partkey") % 5
    sources = p.select(z.alias("z")).distinct().select(F.concat(F.lit("f"), "z", F.lit(".py")).alias("path"), F.replace(F.lit(CODE), F.lit("{z}"), F.col("z")).alias("text"))
    function = F.when(m == 2, "gone").when(m == 3, F.concat(F.lit("other"), z)).otherwise("run")
    tokens = F.when(m == 0, S.call_tokens(F.lit(None).cast("array<string>"), F.lit("sgl::unknown"), F.lit("sm90_mla_kernel"))).otherwise(S.call_tokens(F.array(F.lit("nothing")), F.lit("aten::kernel"), F.lit("x")))
    tokens = F.when(m == 0, F.concat(tokens, F.array(F.lit("mla_kernel")))).otherwise(tokens)
    entries = p.select(F.col("p_partkey").alias("id"), F.concat(F.when(m == 4, "none").otherwise("f"), z, F.lit(".py")).alias("path"), function.alias("function"), F.when(m == 1, 5).otherwise(3).alias("hint"), tokens.alias("tokens"))
    return S.resolved(entries, S.index(sources))


@query("source_coverage", "WITH p AS (SELECT p_partkey % 5 AS m FROM part) SELECT count(*) AS total, count(*) FILTER (m IN (0, 1, 3)) AS functions, count(*) FILTER (m IN (0, 1)) AS statements, count(*) FILTER (m = 3) AS bodies, count(*) FILTER (m IN (1, 3)) AS drifted, count(*) FILTER (m IN (2, 4)) AS unresolved FROM p")
def _(spark, d):
    from lanespan.sources import code as S

    return S.coverage(Q["source_resolution"](spark, d))


def packages(spark, d):
    """Operators of five packages: the nations of a region."""
    k, r = F.col("n_nationkey"), F.col("n_regionkey")
    seq = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
    return load(spark, d, "nation").select(
        r.alias("package"), seq.alias("seq"), F.col("n_name").alias("name"), F.when(k % 3 == 0, "core").when(k % 3 == 1, "auxiliary").otherwise("communication").alias("category"), F.lit("m").alias("module"), F.when(seq <= 2, "A").otherwise("B").alias("stage"),
        F.when(seq <= 2, 1).otherwise(2).alias("position"), F.lit("u").alias("unit"), F.when(seq <= 2, "v1").otherwise("v2").alias("variant"), (k * 1000).alias("start"), (k + 1).cast("double").alias("duration"), F.when(k % 2 == 0, k.cast("double")).alias("mfu"), F.lit(None).cast("double").alias("mbu"),
    )


@query(
    "analysis_document",
    """WITH o AS (SELECT n_regionkey AS package, n_nationkey AS k, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS seq, n_name FROM nation)
SELECT package, '1.0' AS version, count(*) AS operators, true AS heterogeneous, max(CASE WHEN k % 2 = 0 THEN k ELSE 0 END)::DOUBLE AS max_mfu, 'v1,v2' AS variants, '1::u::v1::A' AS first_stage, sum(CASE WHEN seq <= 2 THEN k + 1 ELSE 0 END)::DOUBLE AS first_us,
  round(sum(CASE WHEN k % 3 = 0 THEN k + 1 ELSE 0 END) * 100.0 / sum(k + 1), 4)::DOUBLE AS core_share, 2 AS units, max(CASE WHEN seq = 5 THEN n_name END) AS last_name, 0 AS violations FROM o GROUP BY 1""",
)
def _(spark, d):
    from lanespan.operators import report as R

    rows = packages(spark, d)
    unit = load(spark, d, "region").select(F.col("r_regionkey").alias("package"), F.lit(100.0).alias("unit_us"), F.lit(3).alias("samples"), F.array(F.lit(0)).alias("devices"))
    x = R.analysis(rows, unit)
    at = lambda p: F.get_json_object("document", p)
    bad = C.frontend(
        x.select("package", at("$.schemaVersion").alias("schema"), at("$.summary.operatorCount").cast("long").alias("operator_count"), F.array(F.lit(0)).alias("devices"), at("$.summary.stableSamples").cast("int").alias("samples"), F.lit(True).alias("heterogeneous"), F.from_json(at("$.summary.distinctUnitVariants"), "array<string>").alias("variants")),
        rows.select("package", "category", "position", "unit", "variant"), rows.select("package", "position", "unit", "variant").distinct(), rows.select("package", F.col("position").alias("ord"), "position", "variant").distinct(),
    ).groupBy(F.col("key").cast("int").alias("package")).agg(F.count(F.lit(1)).alias("bad"))
    x = x.join(bad, "package", "left")
    return x.select(
        "package", at("$.schemaVersion").alias("version"), F.size(F.from_json(at("$.operators"), "array<struct<name:string>>")).cast("long").alias("operators"), at("$.summary.heterogeneous").cast("boolean").alias("heterogeneous"), at("$.summary.maxMfu").cast("double").alias("max_mfu"),
        F.array_join(F.from_json(at("$.summary.distinctUnitVariants"), "array<string>"), ",").alias("variants"), at("$.stages[0].key").alias("first_stage"), at("$.stages[0].durationUs").cast("double").alias("first_us"), at("$.classifications[0].sharePct").cast("double").alias("core_share"),
        F.size(F.from_json(at("$.units"), "array<struct<id:string>>")).alias("units"), at("$.operators[4].name").alias("last_name"), F.coalesce("bad", F.lit(0)).alias("violations"),
    )


@query(
    "package_manifest",
    """SELECT '{"tables":[{"table":"nation","rows":' || (SELECT count(*) FROM nation) || '},{"table":"region","rows":' || (SELECT count(*) FROM region) || '}],"formulas":{"mfu":"2MNK","pct":"d/t"},"evidence":[' || string_agg('{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}', ',' ORDER BY r_regionkey) || ']}' AS manifest FROM region""",
)
def _(spark, d):
    from lanespan.operators import report as R

    tables = {n: load(spark, d, n) for n in ("region", "nation")}
    return R.manifest(tables, {"pct": "d/t", "mfu": "2MNK"}, tables["region"].select("r_regionkey", "r_name"))


@query(
    "report_lines",
    """SELECT 0 AS section, 1 AS line, '## Regions' AS text UNION ALL SELECT 0, 2, '| r_name | n |' UNION ALL SELECT 0, 3, '|---|---|' UNION ALL SELECT 0, r_regionkey + 4, '| ' || r_name || ' | 5 |' FROM region
UNION ALL SELECT 1, 1, '## Nations' UNION ALL SELECT 1, 2, '| name |' UNION ALL SELECT 1, 3, '|---|' UNION ALL SELECT 1, n_nationkey + 4, '| ' || n_name || '\\| |' FROM nation""",
)
def _(spark, d):
    from lanespan.operators import report as R

    r = load(spark, d, "region").select("r_name", F.lit(5).alias("n"), "r_regionkey")
    n = load(spark, d, "nation").select(F.concat("n_name", F.lit("|")).alias("name"), "n_nationkey")
    return R.lines([("Regions", r, "r_regionkey"), ("Nations", n, "n_nationkey")])


@query("semantic_rules", "SELECT p_partkey AS key, CASE WHEN p_name LIKE '%ring%' THEN 'core' WHEN p_type = 'SMALL' AND p_name LIKE '%bolt%' THEN 'auxiliary' ELSE 'none' END AS category FROM part")
def _(spark, d):
    from lanespan.functions.rules import first_match
    from lanespan.operators import report as R

    rules = R.rules_of({"rules": [{"operator_regex": "RING", "category": "core"}, {"module_regex": "^small$", "operator_regex": "bolt", "category": "auxiliary"}]})
    rows = load(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_type").alias("module"), F.col("p_name").alias("operator_name"))
    return rows.select("key", first_match(rules, "category", "none").alias("category"))
