"""Queries of sources, origin windows, classification, configurations and sinks. Files they read are written to the checkpoint folder first."""

from __future__ import annotations

import os
import sqlite3
import tempfile
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanespan.functions import kernels as K
from lanespan.functions import rules as R
from lanespan.functions import scalars as X
from lanespan.functions.symbols import shell_int, shell_quoted, template_arguments
from lanespan.operators import checks as C
from lanespan.operators import origin as O
from lanespan.operators import pipeline as P
from lanespan.operators import tables as T
from lanespan.operators import validate as V
from lanespan.operators.joins import sent
from lanespan.plans.q_phases import STEPS, capture
from lanespan.sources import capture as M
from lanespan.sources import config as G
from lanespan.sources import delimited as D
from lanespan.sources import packages as A
from lanespan.sources import sinks as W
from lanespan.sources import sqlite as L
from lanespan.sources import trace as J
from lanespan.sources.scratch import cut, folder
from lanespan.sources.tables import IV, intervals, load

Q, SQL = {}, {}


def query(name: str, sql: str):
    def keep(f):
        Q[name], SQL[name] = f, sql
        return f

    return keep


def written(df: DataFrame, column: str = "value") -> str:
    """Path of one text file with the frame's lines."""
    path = f"{folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.select(column).coalesce(1).write.text(path)
    return path


def kernel_file(spark, d) -> str:
    """A capture of the 25 nations; the file is local, as SQLite files are, so its readers have to run on this machine."""
    path = os.path.join(tempfile.mkdtemp(prefix="lanespan-"), "capture.sqlite")
    rows = load(spark, d, "nation").select("n_nationkey", "n_regionkey", "n_name").collect()
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE StringIds (id INTEGER PRIMARY KEY, value TEXT)")
        con.execute("CREATE TABLE CUPTI_ACTIVITY_KIND_KERNEL (start INTEGER, end INTEGER, deviceId INTEGER, shortName INTEGER, demangledName INTEGER, gridX INTEGER, graphNodeId INTEGER, streamId INTEGER)")
        con.executemany("INSERT INTO StringIds VALUES (?, ?)", [x for k, _, n in rows if k % 7 for x in ((k + 1, n), (k + 101, f"void {n}(int)"))])
        con.executemany("INSERT INTO CUPTI_ACTIVITY_KIND_KERNEL VALUES (?, ?, ?, ?, ?, ?, ?, 3)", [(k * 100, k * 100 + r + 1, r, k + 1, k + 101 if k % 2 else None, k % 4, k if k % 3 == 0 else None) for k, r, _ in rows])
    con.close()
    return path


@query(
    "kernel_capture",
    """SELECT n_regionkey AS device, 3 AS stream, n_nationkey * 100 AS s, n_nationkey * 100 + n_regionkey + 1 AS e, CASE WHEN n_nationkey % 7 <> 0 THEN n_name END AS short_name,
  CASE WHEN n_nationkey % 7 <> 0 THEN CASE WHEN n_nationkey % 2 = 1 THEN 'void ' || n_name || '(int)' ELSE n_name END END AS name, CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey END AS graph_id, n_nationkey % 4 AS "gridX", 1 AS "gridY" FROM nation""",
)
def _(spark, d):
    return L.kernels(spark, kernel_file(spark, d), name_mode="demangled").select("device", "stream", "s", "e", "short_name", "name", "graph_id", "gridX", "gridY")


@query(
    "kernel_capture_of_device",
    """SELECT n_nationkey * 100 AS s, n_name AS name, row_number() OVER (ORDER BY n_nationkey * 100, n_nationkey * 100 + n_regionkey + 1) AS k FROM nation WHERE n_regionkey = 2 AND n_nationkey % 7 <> 0 AND n_nationkey % 2 = 1""",
)
def _(spark, d):
    return L.for_alignment(spark, kernel_file(spark, d), 2).select("s", F.regexp_extract("name", r"void (\w.*)\(int\)", 1).alias("name"), "k")


@query("missing_capture_tables", "SELECT 'none' AS missing UNION ALL SELECT 'OTHER'")
def _(spark, d):
    path = kernel_file(spark, d)
    found = L.missing_tables(path) or ["none"]
    return spark.createDataFrame([(x,) for x in [*found, *L.missing_tables(path, ("StringIds", "OTHER"))]], "missing string")


def trace_files(events: DataFrame, file: str, order: str) -> str:
    """Path of trace-event files, one for each value of file, with the structs `event` in order, a line each. No two events of a file have the same place."""
    path = f"{folder(events.sparkSession)}/{uuid.uuid4().hex}"
    # What stands before and behind the events goes with the first and the last: rows put in by a union may be written as files of their own.
    ends = events.groupBy(F.col(file).alias("__file")).agg(F.min(order).alias("first"), F.max(order).alias("last"))
    x = events.join(sent(cut(ends)), F.col(file) == F.col("__file"))
    before = F.when(F.col(order) == F.col("first"), '{"name": "a \\"traceEvents\\": [ b", "devices": [{"id": 0}], "traceEvents": [\n ').otherwise(",")
    behind = F.when(F.col(order) == F.col("last"), '\n], "after": [{"ph": "X"}]}').otherwise("")
    lines = x.select(file, F.col(order).alias("ord"), F.concat(before, F.to_json("event"), behind).alias("value"))
    # A shuffle by the key of the join would be left out as done, and the join's own is read in pieces once it turns out that the ends can be broadcast.
    lines.repartition(F.col(file), F.lit(0)).sortWithinPartitions(file, "ord").select(file, "value").write.partitionBy(file).text(path)
    return path


def launches(spark, d) -> str:
    """Each nation launches a kernel from an operator within two frames, in a file for each region; every fifth kernel has no launch, every third launch no operator."""
    k = F.col("n_nationkey")
    t = (k * 1000).cast("double")
    none = F.create_map().cast("map<string,string>")
    text = lambda c: c.cast("string")
    args = lambda **kv: F.map_from_arrays(F.array(*[F.lit(x.replace("_", " ")) for x in kv]), F.array(*kv.values()))
    event = lambda o, cat, name, ts, dur, a: F.struct((k * 10 + o).alias("ord"), F.struct(F.lit("X").alias("ph"), F.lit(cat).alias("cat"), name.alias("name"), ts.alias("ts"), F.lit(float(dur)).alias("dur"), F.lit("1").alias("pid"), F.lit("7").alias("tid"), a.alias("args")).alias("event"))
    rows = [
        event(0, "python_function", F.lit("top.py(1): main"), t, 900, args(Python_id=text(k * 2 + 1000))),
        event(1, "python_function", F.concat(F.lit("m.py(2): "), "n_name"), t + 10, 800, args(Python_id=text(k * 2 + 1001), Python_parent_id=text(k * 2 + 1000))),
        event(2, "cpu_op", F.concat(F.lit("aten::op"), text(F.col("n_regionkey"))), t + 20, 100, F.when(k % 3 == 0, none).otherwise(args(External_id=text(k + 500)))),
        event(3, "cuda_runtime", F.lit("cudaLaunchKernel"), t + 30, 5, F.when(k % 5 == 0, none).otherwise(args(correlation=text(k + 1), External_id=text(k + 500)))),
        event(4, "kernel", F.concat(F.lit("k_"), "n_name"), t + 500, 20, args(correlation=text(k + 1))),
    ]
    x = load(spark, d, "nation").select(F.col("n_regionkey").alias("file"), F.explode(F.array(*rows)).alias("e")).select("file", "e.ord", "e.event")
    return trace_files(x, "file", "ord")


@query(
    "trace_call_paths",
    """SELECT 'k_' || n_name AS kernel, n_nationkey * 1000000 + 500000 AS s, CAST(20 AS DOUBLE) AS dur_us, CASE WHEN n_nationkey % 5 <> 0 THEN '7' END AS tid, CASE WHEN n_nationkey % 5 <> 0 AND n_nationkey % 3 <> 0 THEN 'aten::op' || n_regionkey END AS op,
  CASE WHEN n_nationkey % 5 <> 0 THEN 'top.py(1): main -> m.py(2): ' || n_name ELSE '' END AS path FROM nation""",
)
def _(spark, d):
    ev = J.events(spark, launches(spark, d), split=512)
    return J.call_paths(ev).withColumn("path", F.array_join("path", " -> ")).drop("kernel_idx", "file")


@query("trace_classes", "SELECT 'cpu' AS class, 25 AS n, 16 AS with_external UNION ALL SELECT 'frame', 50, 0 UNION ALL SELECT 'kernel', 25, 0 UNION ALL SELECT 'runtime', 25, 20")
def _(spark, d):
    c = J.classified(J.events(spark, launches(spark, d), split=512))
    count = lambda n, df: df.agg(F.lit(n).alias("class"), F.count(F.lit(1)).alias("n"), F.count(df["external"] if "external" in df.columns else F.lit(None)).alias("with_external"))
    return C.all_of(*[count(n, df) for n, df in c.items()])


@query(
    "trace_ranges",
    """SELECT CAST(o_orderkey % 8 AS VARCHAR) AS file, o_orderpriority || ' {"[\\' AS name, count(*) AS n, CAST(sum(o_custkey) AS DOUBLE) AS dur, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders GROUP BY 1, 2""",
)
def _(spark, d):
    o = F.col("o_orderkey")
    args = F.create_map(F.lit('a "{'), F.lit("]}"), F.lit("key"), o.cast("string"))
    event = F.struct(F.lit("X").alias("ph"), F.lit("kernel").alias("cat"), F.concat("o_orderpriority", F.lit(' {"[\\')).alias("name"), o.cast("double").alias("ts"), F.col("o_custkey").cast("double").alias("dur"), args.alias("args"))
    path = trace_files(load(spark, d, "orders").select((o % 8).alias("file"), o.alias("ord"), event.alias("event")), "file", "ord")
    ev = J.events(spark, path, split=256 << 10).withColumn("key", F.element_at("args", "key").cast("long"))
    return ev.groupBy(F.regexp_extract("file", r"file=(\d+)", 1).alias("file"), "name").agg(F.count(F.lit(1)).alias("n"), F.sum("dur").alias("dur"), F.min_by("key", "idx").alias("first"), F.max_by("key", "idx").alias("last"))


@query(
    "origin_window",
    f"""WITH {IV}, n AS (SELECT device, s, e, stream AS name, row_number() OVER (PARTITION BY device ORDER BY s, e, stream) - 1 AS idx FROM iv),
w AS (SELECT *, CASE WHEN idx = 12 THEN 'm/twelve' WHEN idx = 13 THEN 'm/pair' WHEN idx - 10 = 4 THEN 'm/pair' WHEN idx - 10 = 0 THEN 'm/first' ELSE 'unknown/' || idx END AS module FROM n WHERE idx BETWEEN 10 AND 15),
g AS (SELECT *, CASE WHEN idx = 13 THEN 'm/pair#1' WHEN idx = 14 THEN 'm/pair#2' ELSE module END AS grp FROM w)
SELECT device, idx, module, grp AS "group", CASE WHEN idx = 12 THEN 'f12' WHEN module = 'm/pair' THEN 'fp' ELSE 'any' END AS python_function, (e - s) / 1000.0 AS duration_us, row_number() OVER (PARTITION BY device ORDER BY s, idx) AS seq FROM g""",
)
def _(spark, d):
    k = intervals(spark, d).withColumnRenamed("stream", "name")
    modules = {"12": "m/twelve", "13": {"module": "m/pair", "occurrence": 1}, "4": {"module": "m/pair", "occurrence": 2}, "0": "m/first", "2": "m/late"}
    w = O.ordered(O.window(k, 10, 15, modules, {"12": "f12", "m/pair": "fp", "*": "any"}))
    return w.select("device", "idx", "module", "group", "python_function", F.col("duration_us").cast("double").alias("duration_us"), "seq")


@query(
    "unit_windows_confirmed",
    f"""WITH {IV}, n AS (SELECT device, s, e, stream, max(CASE WHEN stream = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY device ORDER BY s, e, stream ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS near FROM iv),
h AS (SELECT *, row_number() OVER (PARTITION BY device ORDER BY s, e, stream) - 1 AS unit, lead(s, 2) OVER (PARTITION BY device ORDER BY s, e, stream) AS b FROM n WHERE stream = 'click' AND near = 1)
SELECT device, unit, s AS a, b FROM h WHERE b IS NOT NULL""",
)
def _(spark, d):
    return O.unit_windows(intervals(spark, d).withColumnRenamed("stream", "name"), "click", 2, "view", 3)


@query(
    "skeleton_symbols",
    """WITH f AS (SELECT p_name AS name, p_brand AS short, min(p_partkey) AS f0 FROM part GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY short ORDER BY f0) AS k, row_number() OVER (ORDER BY f0) AS symbol_id FROM f)
SELECT symbol_id, name, CASE WHEN k = 1 THEN short ELSE short || '#' || k END AS short_name FROM k""",
)
def _(spark, d):
    p = load(spark, d, "part")
    return O.skeleton(p.select(F.col("p_partkey").alias("idx"), F.col("p_partkey").alias("s"), F.col("p_partkey").alias("e"), F.col("p_name").alias("name"), F.col("p_brand").alias("short_name")))[0]


#: module, operator, what a rule asks, core kind; and by hand the category and the label.
CLASSIFIED = [
    ("layers/attn_core", "flash_attn_fwd<1>", None, None, "core", "Attention 核心计算"), ("layers/input_norm", "rmsnorm_kernel", None, None, "auxiliary", "Attention 前置归一化"), ("layers/moe/experts", "ncclAllReduce", "core", None, "communication", "MoE Experts"),
    ("layers/mlp", "deep_gemm_x", None, None, "core", "FFN/MLP"), ("x/lm_head", "copy_kernel", "core", None, "auxiliary", "LM Head"), ("x/router", "quant_gemm_topk", "auxiliary", None, "auxiliary", "MoE Gate/TopK 路由"),
    ("layers/attn_core", "my_own", "core", None, "core", "Attention 核心计算"), ("some/thing", "my_own", "core", None, "auxiliary", "其他模型计算"), ("some/qkv_proj", "anything", None, "gemm", "core", "Attention QKV 投影"),
]


@query(
    "classified_operators",
    "WITH c(i, category, label) AS (VALUES " + ", ".join(f"({i}, '{c[4]}', '{c[5]}')" for i, c in enumerate(CLASSIFIED)) + ") SELECT p_partkey AS key, category, label FROM part JOIN c ON p_partkey % 9 = i",
)
def _(spark, d):
    pick = lambda j: F.element_at(F.array(*[F.lit(c[j]).cast("string") for c in CLASSIFIED]), (F.col("p_partkey") % 9 + 1).cast("int"))
    x = load(spark, d, "part").select(F.col("p_partkey").alias("key"), *[pick(j).alias(n) for j, n in enumerate(("module", "operator", "asked", "kind"))])
    c = [F.col(n) for n in ("module", "operator")]
    return x.select("key", K.category(*c, F.substring_index("operator", "<", 1), F.col("asked"), F.col("kind")).alias("category"), K.module_label(c[0]).alias("label"))


@query(
    "frames_and_arguments",
    """SELECT p_partkey AS key, CASE WHEN p_size % 3 = 0 THEN NULL ELSE 'a/' || p_size || '.py' END AS file, CASE WHEN p_size % 3 <> 0 THEN p_partkey END AS line, CASE WHEN p_size % 3 <> 0 THEN replace(lower(p_brand), '#', '') END AS func,
  'f' AS base, '(' || p_size || ', b)|c<d,e>' AS args, CASE WHEN p_size = 1 THEN 'python a.py ''x y'' '''' 1' ELSE 'python a.py ''x y'' '''' ' || p_size END AS command FROM part""",
)
def _(spark, d):
    k, z = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    frame = F.when(F.col("p_size") % 3 == 0, "no frame").otherwise(F.concat(F.lit("a/"), z, F.lit(".py("), k, F.lit("): "), X.normalized_hardware(F.col("p_brand"))))
    t = template_arguments(F.concat(F.lit("f<("), z, F.lit(", b), c<d,e>>")))
    parts = X.frame_parts(frame)
    return load(spark, d, "part").select(F.col("p_partkey").alias("key"), parts["file"].alias("file"), parts["line"].cast("long").alias("line"), parts["func"].alias("func"), t["base"].alias("base"), F.array_join(t["args"], "|").alias("args"), shell_quoted(F.array(F.lit("python"), F.lit("a.py"), F.lit("x y"), F.lit(""), z)).alias("command"))


@query(
    "captured_server_args",
    """SELECT p_partkey AS key, CAST(p_size AS VARCHAR) AS tp_size, 'm/' || p_name AS model_path, CAST(NULL AS VARCHAR) AS dtype, CASE WHEN p_size % 2 = 0 THEN 'True' END AS overlap FROM part""",
)
def _(spark, d):
    z = F.col("p_size").cast("string")
    text = F.concat(F.lit("server_args=ServerArgs(model_path='m/"), "p_name", F.lit("', tp_size="), z, F.lit(", dtype=None"), F.when(F.col("p_size") % 2 == 0, ", overlap=True").otherwise(""), F.lit(")"))
    return load(spark, d, "part").select(F.col("p_partkey").alias("key"), *M.server_args(text, ["tp_size", "model_path", "dtype", "overlap"]))


@query(
    "set_comparisons",
    """SELECT CAST(s_nationkey AS VARCHAR) AS key, 'left' AS side FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_custkey % 3 = 0) GROUP BY 1, 2
UNION ALL SELECT CAST(c_nationkey AS VARCHAR), 'right' FROM customer WHERE c_custkey % 3 = 0 AND c_nationkey NOT IN (SELECT s_nationkey FROM supplier) GROUP BY 1, 2""",
)
def _(spark, d):
    a = load(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("key"))
    b = load(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_nationkey").cast("string").alias("key"))
    return C.same_sets(a, b, "key")


@query(
    "text_filters",
    """SELECT p_partkey AS key, p_name ILIKE '%D_WIDGET%' AS wild, contains(p_name, 'ring') OR contains(p_name, 'Gear') AS plain, contains(lower(p_type), 'eco') AS low FROM part""",
)
def _(spark, d):
    return load(spark, d, "part").select(F.col("p_partkey").alias("key"), R.like_any_case("p_name", "D_WIDGET").alias("wild"), R.contains_any("p_name", ["ring", "Gear"]).alias("plain"), R.contains_any("p_type", ["eco"], lower=True).alias("low"))


@query(
    "markdown_table",
    """SELECT '| n | t |' AS text UNION ALL SELECT '|---|---|' UNION ALL SELECT '| ' || n_nationkey || ' | ' || n_name || '\\| b |' FROM nation""",
)
def _(spark, d):
    x = load(spark, d, "nation").select(F.col("n_nationkey").alias("n"), F.concat("n_name", F.lit("|\n b")).alias("t"))
    return W.markdown(x).select("text")


@query(
    "unit_cycles",
    f"WITH {STEPS} SELECT device, least(count(*), sum(CASE WHEN device = 3 AND size % 2 = 0 THEN 1 ELSE 2 END) / 2.0::DOUBLE) AS cycles FROM st GROUP BY 1",
)
def _(spark, d):
    return P.unit_cycles(capture(spark, d), {"kda": "core_kda", "mla": "core_mla"}, {"kda": 1, "mla": 2})


@query(
    "forward_pipeline",
    f"""WITH {STEPS}, n AS (SELECT *, max(step) OVER (PARTITION BY device) AS total FROM st), b AS (SELECT *, greatest(0, least(total // 4, total - 40)) AS begin FROM n), k AS (SELECT *, device = 3 AND size % 2 = 0 AS cut, device = 2 AND size > 25 AS gone FROM b WHERE step < total AND step >= begin AND step < begin + 40),
p AS (SELECT device, step, 1 AS ord, 'kda' AS part, 1 AS n, 1000 AS t FROM k UNION ALL SELECT device, step, 2, 'mla', CASE WHEN cut THEN 1 ELSE 2 END, CASE WHEN cut THEN 600 WHEN gone THEN 1300 ELSE 1400 END FROM k
  UNION ALL SELECT device, step, 3, 'other', 0, CASE WHEN cut THEN 850 ELSE 50 END FROM k UNION ALL SELECT device, step, 4, 'gap', 2, CASE WHEN gone THEN 7650 ELSE 7550 END FROM k UNION ALL SELECT device, step, 0, 'step', NULL, 10000 FROM k)
SELECT device, ord, part, max(n) AS layers, round(avg(t) / 1000.0, 6) AS mean_us, min(t) / 1000.0 AS min_us, max(t) / 1000.0 AS max_us, round(avg(t) / 100.0, 6) AS pct_of_step, count(*) AS samples FROM p GROUP BY 1, 2, 3""",
)
def _(spark, d):
    x = P.forward_pipeline(capture(spark, d).drop("a", "b", "step", "id"), {"kda": "core_kda", "mla": "core_mla"}, marker="marker", gap_ns=2000)
    return x.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in ("mean_us", "min_us", "max_us", "pct_of_step")})


ORIGIN_RULES = [{"match": {"module": "embed"}, "functional_module": "Input"}, {"match": {"module": "attn"}, "functional_module": "Attention"}, {"match": {"operator_name": "gemm"}, "functional_module": "Product", "category": "core", "introduction": "a product"}]
OG = """og AS (SELECT p_partkey AS seq, CASE WHEN p_partkey % 2 = 0 THEN 'enc' ELSE 'dec' END AS region, CASE p_size % 4 WHEN 0 THEN 'x/embed' WHEN 1 THEN 'x/attn_core' WHEN 2 THEN 'x/proj' ELSE 'x/expert' END AS module,
  CASE p_size % 4 WHEN 2 THEN 'my_gemm' WHEN 1 THEN 'flash_attn_fwd' WHEN 3 THEN 'ncclAllGather' ELSE 'copy_kernel' END AS op, CASE WHEN p_size % 5 = 0 THEN p_size + 0.5 ELSE p_size END::DOUBLE AS d, CAST(p_size % 3 + 1 AS VARCHAR) AS pos FROM part)"""


def origin_rows(spark, d):
    k, z = F.col("p_partkey"), F.col("p_size")
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), z % 4 + 1)
    return load(spark, d, "part").select(
        F.when(k % 2 == 0, "enc").otherwise("dec").alias("region"), k.alias("seq"), pick("x/embed", "x/attn_core", "x/proj", "x/expert").alias("module"), pick("copy_kernel", "flash_attn_fwd", "my_gemm", "ncclAllGather").alias("operator_name"),
        z.cast("double").alias("duration_us"), F.when(z % 5 == 0, z + 0.5).when(z % 5 == 1, 0.0).cast("double").alias("duration_avg_us"), (k * 1000).alias("start_ns"), (k * 1000 + z * 10).alias("end_ns"), (k % 3).cast("int").alias("stream"), F.lit(0).alias("layer_id"),
        (z % 3 + 1).cast("string").alias("unit_position"), F.lit("u").alias("unit_id"), F.lit("v").alias("unit_variant"), F.lit("").alias("function_introduction"),
    )


FM = "CASE module WHEN 'x/embed' THEN 'Input' WHEN 'x/attn_core' THEN 'Attention' WHEN 'x/proj' THEN 'Product' ELSE 'MoE Experts' END"


@query(
    "derived_stages",
    f"""WITH {OG}, f AS (SELECT *, {FM} AS fm FROM og), u AS (SELECT region, (max(seq * 1000 + (SELECT p_size FROM part WHERE p_partkey = seq) * 10) - min(seq * 1000)) / 1000.0::DOUBLE AS unit FROM f GROUP BY 1),
s AS (SELECT f.region, 'row' AS kind, pos, fm, sum(d) AS t, any_value(unit) AS unit FROM f JOIN u ON f.region = u.region GROUP BY 1, 2, 3, 4 UNION ALL SELECT f.region, 'pattern', NULL, fm, sum(d), any_value(unit) FROM f JOIN u ON f.region = u.region GROUP BY 1, 2, 3, 4 UNION ALL SELECT f.region, 'total', NULL, NULL, sum(d), any_value(unit) FROM f JOIN u ON f.region = u.region GROUP BY 1, 2, 3, 4)
SELECT region, kind, pos AS unit_position, fm AS functional_module, round(t, 6) AS module_us, round(t / unit * 100, 6) AS module_pct FROM s""",
)
def _(spark, d):
    t = T.derived(origin_rows(spark, d), ORIGIN_RULES)["stages"]
    return t.select("region", "kind", "unit_position", "functional_module", F.round("module_us", 6).alias("module_us"), F.round("module_pct", 6).alias("module_pct"))


@query(
    "derived_core_order",
    f"""WITH {OG}, f AS (SELECT *, {FM} AS fm FROM og WHERE op IN ('my_gemm', 'flash_attn_fwd')), t AS (SELECT region, {FM} AS fm, sum(d) AS m FROM og GROUP BY 1, 2)
SELECT f.region, row_number() OVER (PARTITION BY f.region ORDER BY f.fm, d DESC, seq) AS ord, f.fm AS functional_module, d AS duration, round(m, 6) AS module_us FROM f JOIN t ON t.region = f.region AND t.fm = f.fm""",
)
def _(spark, d):
    t = T.derived(origin_rows(spark, d), ORIGIN_RULES)["core"].where("kind = 'row'")
    return t.select("region", "ord", "functional_module", "duration", F.round("module_us", 6).alias("module_us"))


@query("derived_tables_valid", "SELECT check_id, 0 AS n_violations FROM (VALUES ('overview_total'), ('core_total'), ('auxiliary_total'), ('stages_total'), ('classes_agree'), ('core_rows_of_overview'), ('auxiliary_rows_of_overview'), ('pattern_rows_close')) t(check_id)")
def _(spark, d):
    return V.derived_tables(T.derived(origin_rows(spark, d), ORIGIN_RULES)).select("check_id", "n_violations")


@query(
    "efficiency_bounds",
    "SELECT 'efficiency_bounds' AS check_id, count(*) AS n_rows, count(*) FILTER (p_size > 45) AS n_violations FROM part UNION ALL SELECT 'shape_for_efficiency', count(*), count(*) FILTER (p_size % 10 = 0) FROM part",
)
def _(spark, d):
    z = F.col("p_size")
    return V.efficiency(load(spark, d, "part").select((z * 100.0 / 45).alias("mfu"), F.lit(None).cast("double").alias("mbu"), F.when(z % 10 != 0, "(M=1,N=1,K=1)").alias("shape")))


@query(
    "package_table_sets",
    """SELECT 'p' || n_nationkey AS prefix, n_nationkey % 4 <> 1 AS complete FROM nation""",
)
def _(spark, d):
    suffix = F.explode(F.array(*[F.lit(s) for s in A.SUFFIXES])).alias("suffix")
    x = load(spark, d, "nation").select("n_nationkey", suffix).where(~((F.col("n_nationkey") % 4 == 1) & (F.col("suffix") == A.SUFFIXES[2])))
    names = x.select(F.concat(F.lit("p"), F.col("n_nationkey").cast("string"), "suffix").alias("name"))
    return A.table_sets(names.unionByName(spark.createDataFrame([("other.txt",)], "name string")))


@query(
    "csv_rows",
    """SELECT CAST(n_nationkey AS VARCHAR) AS k, n_name AS name, CASE WHEN n_regionkey = 0 THEN 'a, b,c' WHEN n_regionkey = 1 THEN 'q "r"' WHEN n_regionkey = 2 THEN NULL ELSE 'x' END AS rest FROM nation""",
)
def _(spark, d):
    r = F.col("n_regionkey")
    rest = F.when(r == 0, ", a, b,c").when(r == 1, ',"q ""r"""').when(r == 2, "").otherwise(", x ")
    lines = load(spark, d, "nation").select(F.concat(F.col("n_nationkey").cast("string"), F.lit(", "), "n_name", F.lit(" "), rest).alias("value"), F.lit(1).alias("o"))
    head = spark.createDataFrame([("﻿k , name, rest", 0)], "value string, o int")
    return D.read_csv(spark, written(head.unionByName(lines).coalesce(1).sortWithinPartitions("o")))


@query(
    "environment_rows",
    """WITH i AS (SELECT 'K' || n_regionkey AS key, n_name || '=x' AS value, n_nationkey AS k FROM nation) SELECT key, arg_max(value, k) AS value FROM i GROUP BY 1 UNION ALL SELECT 'D', '4'""",
)
def _(spark, d):
    item = F.concat(F.lit("K"), F.col("n_regionkey").cast("string"), F.lit("="), "n_name", F.lit("=x"))
    blob = load(spark, d, "nation").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", item.alias("i")))), lambda x: x["i"]), ";").alias("value"))  # 25 items
    rows = blob.select(F.lit("Environment").alias("name"), F.concat("value", F.lit(";=none;C")).alias("value"))
    return D.environment(rows.unionByName(spark.createDataFrame([("DeviceEnvironment", "D=4;K0=old"), ("Other", "E=5")], "name string, value string")))


SCRIPT = "export TP=8\nDP=2  # replicas\npython serve.py --tp-size $TP --dp-size=$DP --chunked-prefill-size $((TP * 1024))\n"
TAXONOMY = {
    "variants": [{"id": "KDA", "marker": "kda_core"}, {"id": "MLA"}],
    "repeating_unit": {"positions": [{"position": 1, "variant": "KDA", "layer_id": 4, "id": "L4"}, {"position": 2, "variant": "MLA", "layer_id": 7, "id": "L7"}, {"position": 3, "variant": "KDA", "module_regex": "x"}]},
    "regions": [{"id": "enc", "layers": [0, 5]}, {"id": "dec", "layers": [5, 9]}],
}


@query(
    "declared_facts",
    """SELECT * FROM (VALUES ('layers', '4'), ('draft', '1'), ('tp', '8'), ('dp', '4'), ('pp', 'None'), ('chunk', '8192'), ('counts', '4,5'), ('ratios', '0,4,4'), ('too few ratios', 'None'), ('anchor', 'b/5'), ('batch', '64'), ('no batch', 'None'),
  ('ratio', 'KDA=2,MLA=1'), ('markers', 'KDA=kda_core'), ('errors', 'regions enc and dec overlap'), ('profile', 'y'), ('words', 'mla_core,ns::x_gemm'), ('sum', '7'), ('cycle', 'None')) t(name, value)""",
)
def _(spark, d):
    flat = {"num_hidden_layers": 4, "num_nextn_predict_layers": 1, "compress_ratios": [0, 4, 4]}
    t = G.topology(flat, SCRIPT, {"dp_size": "4"})
    text = lambda m: ",".join(f"{k}={v}" for k, v in m.items())
    profiles = [{"name": "x", "conditions": [{"key": "num_hidden_layers", "gt": 9}]}, {"name": "y", "conditions": [{"key": "num_hidden_layers", "gt": 3}]}]
    facts = {
        "layers": t["layers"], "draft": t["draft_layers"], "tp": t["tp"], "dp": t["dp"], "pp": t["pp"], "chunk": t["chunk"], "counts": ",".join(map(str, G.layer_counts(flat))), "ratios": ",".join(map(str, G.compress_ratios(flat, 3))), "too few ratios": G.compress_ratios(flat, 9),
        "anchor": "/".join(map(str, G.anchor({"a": 20, "b": 10, "c": 8, "d": 7}, [4, 5]))), "batch": G.cluster_batch(16, 16, 8, 2), "no batch": G.cluster_batch(16, 10, 8, 2), "ratio": text(G.variant_ratio(TAXONOMY)), "markers": text(G.markers(TAXONOMY)), "errors": ";".join(G.taxonomy_errors(TAXONOMY)),
        "profile": G.profile(flat, profiles), "words": ",".join(G.kernel_words("The boundary is mla_core. Not used: bad_kernel. See ns::x_gemm")), "sum": shell_int("$(((N - 3) / 2))", {"TP": "8", "N": "$((TP * 2 + 1))"}), "cycle": shell_int("$A", {"A": "$B", "B": "$A"}),
    }
    return spark.createDataFrame([(k, str(v)) for k, v in facts.items()], "name string, value string")


@query("taxonomy_frames", "SELECT 4 AS layer_id, '1' AS p_position, 'L4' AS p_id, 'KDA' AS p_variant, 'enc' AS region UNION ALL SELECT 7, '2', 'L7', 'MLA', 'dec'")
def _(spark, d):
    r = G.regions(spark, TAXONOMY)
    p = G.positions(spark, TAXONOMY)
    return p.join(r, (p["layer_id"] >= r["low"]) & (p["layer_id"] <= r["high"])).drop("ord", "low", "high")


@query("flow_chart", "SELECT 'flowchart TD' AS line UNION ALL SELECT '  n' || r_regionkey || '[\"' || r_name || ' ‹x› · ' || r_regionkey || '.0 us\"]' FROM region UNION ALL SELECT '  n' || r_regionkey || ' --> n' || (r_regionkey + 1) FROM region WHERE r_regionkey < 4")
def _(spark, d):
    r = load(spark, d, "region")
    nodes = r.select(F.col("r_regionkey").alias("id"), F.concat("r_name", F.lit(" <x>")).alias("label"), F.col("r_regionkey").cast("double").alias("us"))
    edges = r.where("r_regionkey < 4").select(F.col("r_regionkey").alias("a"), (F.col("r_regionkey") + 1).alias("b"))
    return spark.createDataFrame([(x,) for x in W.mermaid(nodes, edges, timed=True).split("\n")], "line string")


@query(
    "workbook_cells",
    """SELECT 'A1' AS ref, 'n' AS value UNION ALL SELECT 'B1', 't & u' UNION ALL SELECT 'A' || (n_nationkey + 2), CAST(n_nationkey AS VARCHAR) FROM nation UNION ALL SELECT 'B' || (n_nationkey + 2), CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE '<' || n_name || '>' END FROM nation""",
)
def _(spark, d):
    x = load(spark, d, "nation").orderBy("n_nationkey").select(F.col("n_nationkey").alias("n"), F.when(F.col("n_nationkey") % 4 != 0, F.concat(F.lit("<"), "n_name", F.lit(">"))).alias("t & u"))
    return spark.createDataFrame(W.cells(W.workbook(x, "nation")[0]), "ref string, value string")
