"""Queries of names, labels and efficiency. Their SQL builds the expected values from the parts that the names are made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanespan.functions import efficiency as E
from lanespan.functions import kernels as K
from lanespan.functions import scalars as X
from lanespan.functions import symbols as Y
from lanespan.functions.labels import identifier_labels
from lanespan.operators import segments as S
from lanespan.sources.tables import IV, intervals, load, spread

Q, SQL = {}, {}


def query(name: str, sql: str):
    def keep(f):
        Q[name], SQL[name] = f, sql
        return f

    return keep


PT = "pt AS (SELECT p_partkey AS key, p_partkey % 6 AS kind, replace(p_name, ' ', '_') AS flat, p_size AS size FROM part)"


def symbols(spark, d):
    p = spread(load(spark, d, "part").select("p_partkey", "p_name", "p_size"), "p_partkey")
    flat, size, key = F.replace("p_name", F.lit(" "), F.lit("_")), F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    kinds = [
        F.concat(F.lit("void at::native::(anonymous namespace)::"), flat, F.lit("<(unsigned int)"), size, F.lit(", (bool)1, "), key, F.lit("u>(int, float)")),
        F.concat(F.lit("ns::"), flat, F.lit("<a::b<c>, "), size, F.lit(">::run(int, float)")),
        F.concat(F.lit("float "), flat, F.lit("(int, float)")),
        F.concat(F.lit("<unnamed>::"), flat, F.lit("_"), key, F.lit("u_k")),
        F.concat(F.lit("ns::"), flat, F.lit("<" + "x" * 100 + ", 16384u, 12.5, sm90, 2048, 16384>(int)")),
        F.lit("  "),
    ]
    text = F.element_at(F.array(*kinds), (F.col("p_partkey") % 6 + 1).cast("int"))
    return p.select(F.col("p_partkey").alias("key"), text.alias("symbol"))


@query(
    "symbol_leaf",
    f"""WITH {PT}, pl AS (SELECT *, 'void at::native::(anonymous namespace)::' || flat || '<(unsigned int)' || size || ', (bool)1, ' || key || 'u>(int, float)' AS long_name FROM pt) SELECT key,
  CASE kind WHEN 3 THEN flat || '_' || key || 'u_k' WHEN 5 THEN '' ELSE flat END AS leaf,
  CASE kind WHEN 0 THEN CASE WHEN length(long_name) > 96 THEN 'void at::native::(anonymous namespace)::' || flat || '<…>' ELSE long_name END WHEN 1 THEN 'run' WHEN 2 THEN flat WHEN 3 THEN flat || '_' || key || 'u_k' WHEN 4 THEN flat || '<…>' ELSE '' END AS simplified,
  CASE kind WHEN 3 THEN '' WHEN 5 THEN '' WHEN 2 THEN 'float ' || flat ELSE flat END AS base
FROM pl""",
)
def _(spark, d):
    c = F.col("symbol")
    return symbols(spark, d).select("key", Y.symbol_leaf(c).alias("leaf"), Y.symbol_simplified(c).alias("simplified"), Y.kernel_base(c).alias("base"))


@query(
    "symbol_normalize",
    f"""WITH {PT} SELECT key, CASE kind WHEN 0 THEN 'at::native::' || flat || '<' || size || ',true,' || key || '>(int,float)' WHEN 1 THEN 'ns::' || flat || '<a::b<c>,' || size || '>::run(int,float)'
  WHEN 2 THEN 'float' || flat || '(int,float)' WHEN 3 THEN flat || '_' || key || 'u_k' WHEN 4 THEN 'ns::' || flat || '<{"x" * 100},16384,12.5,sm90,2048,16384>' ELSE '' END AS normalized FROM pt""",
)
def _(spark, d):
    return symbols(spark, d).select("key", Y.normalized_symbol(F.col("symbol")).alias("normalized"))


@query(
    "template_ints",
    f"""WITH {PT}, l AS (SELECT key, CASE kind WHEN 0 THEN CASE WHEN size = key THEN [size] ELSE [size, key] END WHEN 1 THEN [size] WHEN 4 THEN [16384, 2048] ELSE [] END AS a FROM pt)
SELECT key, array_to_string(list_filter(a, lambda x: x >= 10), ',') AS ints FROM l""",
)
def _(spark, d):
    return symbols(spark, d).select("key", F.array_join(Y.template_ints(F.col("symbol")).cast("array<string>"), ",").alias("ints"))


@query(
    "operator_name_override",
    """SELECT p_partkey AS key, CASE p_partkey % 4 WHEN 0 THEN 'kernel_' || p_size WHEN 1 THEN 'own' WHEN 2 THEN 'own' ELSE 'g<int>' END AS name FROM part""",
)
def _(spark, d):
    m = F.col("p_partkey") % 4
    asked = F.when(m == 0, F.concat(F.lit("void ns::kernel_"), F.col("p_size").cast("string"), F.lit("(int)"))).when(m == 1, "does the attention of a layer").when(m == 3, "float a::g<int>(float)")
    return load(spark, d, "part").select(F.col("p_partkey").alias("key"), Y.table_name(F.lit("void x::own(int)"), asked).alias("name"))


@query(
    "kernel_labels",
    f"""WITH n AS (SELECT DISTINCT p_type AS kind, p_brand AS base, p_size AS size FROM part),
g AS (SELECT *, count(*) OVER (PARTITION BY kind, base) AS sizes, (p_type_long(kind)) AS long_name FROM n)
SELECT kind, base || CASE WHEN long_name THEN '<{"y" * 60}, f<a, b>, ' || size || ', end>' ELSE '<f<a, b>, ' || size || '>' END AS name,
       base || CASE WHEN NOT long_name THEN '<f<a, b>, ' || size || '>' WHEN sizes > 1 THEN '<' || size || ', …>' ELSE '<…>' END AS label
FROM g""".replace("(p_type_long(kind))", "kind IN ('ECONOMY', 'SMALL')"),
)
def _(spark, d):
    size, long_ = F.col("p_size").cast("string"), F.col("p_type").isin("ECONOMY", "SMALL")
    name = F.concat("p_brand", F.when(long_, F.concat(F.lit("<" + "y" * 60 + ", f<a, b>, "), size, F.lit(", end>"))).otherwise(F.concat(F.lit("<f<a, b>, "), size, F.lit(">"))))
    return Y.kernel_labels(load(spark, d, "part").select(F.col("p_type").alias("kind"), name.alias("name")), keys=["kind"])


#: name, and by hand: family, submodule, category and short name.
KERNELS = [
    ("void deep_gemm::sm100_fp8_fp4_gemm_1d1d_impl<128u>(int)", "deep_gemm_1d1d", "mlp", "gemm_fp8", "void deep_gemm::sm100_fp8_fp4_gemm_1d1d_impl<128u>(int)"),
    ("flash_fwd_splitkv_mla_fp8_sparse_kernel", "flash_mla_splitkv", "self_attn", "mla", "flash_fwd_splitkv_mla_fp8_sparse_kernel"),
    ("ncclDevKernel_AllReduce_Sum_bf16_RING_LL(ncclDevKernelArgsStorage<4096ul>)", "ncclDevKernel_AllReduce_Sum_bf16_RING_LL", "comm", "allreduce", "ncclAllReduce_bf16_RING_LL"),
    ("triton_red_fused_rmsnorm_7", "rmsnorm", "norm", "other", "triton_red_fused_rmsnorm_7"),
    ("triton_poi_fused_add_1", "triton_poi_fused_add_1", "other", "other", "triton_poi_fused_add_1"),
    ("nvjet_sm100_tst_128x256", "nvjet_tss_tst", "other", "gemm_bf16", "nvjet_sm100_tst_128x256"),
    ("void at::native::index_elementwise_kernel<4>(long, longer arguments that a table has no room for at all)", "index_elementwise", "other", "other", "index_elementwise_kernel<4>(long, longer arguments that a table has no room f..."),
    ("per_Token_Quant", "per_Token_Quant", "quant", "quant", "per_Token_Quant"),
]


@query(
    "kernel_profiles",
    "WITH k(i, name, family, submodule, category, short) AS (VALUES " + ", ".join(f"({i}, '{n}', '{f}', '{s}', '{c}', '{x}')" for i, (n, f, s, c, x) in enumerate(KERNELS)) + ") SELECT p_partkey AS key, family, submodule, category, short FROM part JOIN k ON p_partkey % 8 = i",
)
def _(spark, d):
    categories, simplify = K.PROFILES["mla"]
    name = F.element_at(F.array(*[F.lit(k[0]) for k in KERNELS]), (F.col("p_partkey") % 8 + 1).cast("int"))
    x = load(spark, d, "part").select(F.col("p_partkey").alias("key"), name.alias("name"))
    c = F.col("name")
    return x.select("key", K.kernel_family(c).alias("family"), K.submodule(c, F.lit("aten::x"), F.lit("")).alias("submodule"), K.profile_category(c, categories)["key"].alias("category"), K.profile_name(c, simplify).alias("short"))


@query(
    "event_source_line",
    """SELECT o_orderkey AS key, CASE o_orderkey % 5 WHEN 0 THEN 'own.py:' || o_custkey WHEN 1 THEN 'b.py:' || o_custkey WHEN 2 THEN 'c.py:7' WHEN 3 THEN '' ELSE 'site:3' END AS line FROM orders""",
)
def _(spark, d):
    m, n = F.col("o_orderkey") % 5, F.col("o_custkey").cast("string")
    args = (
        F.when(m == 0, F.create_map(F.lit("File"), F.concat(F.lit("own.py:"), n), F.lit("Stack"), F.lit("z.py:1")))
        .when(m == 1, F.create_map(F.lit("File"), F.lit(""), F.lit("Call stack"), F.concat(F.lit("start\nframe (/x/y/b.py:"), n, F.lit(")\n/x/c.py:9"))))
        .when(m == 2, F.create_map(F.lit("Call stack"), F.lit("nothing here"), F.lit("stack"), F.lit("c.py:7 d.py:8")))
        .when(m == 3, F.create_map(F.lit("other"), F.lit("e.py:1")))
        .otherwise(F.create_map(F.lit("callsite"), F.lit("site:3")))
    )
    return load(spark, d, "orders").select(F.col("o_orderkey").alias("key"), X.source_line(args).alias("line"))


@query(
    "device_and_model_labels",
    """SELECT p_partkey AS key, CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 1 THEN -p_size WHEN 2 THEN p_size ELSE NULL END AS device,
  CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_name ELSE left(repeat(p_name || '-', 20), 80) END AS model,
  [p_name, p_brand] AS frames, p_name || ' has *** and ***' AS safe FROM part""".replace("[p_name, p_brand] AS frames", "p_name || '|' || p_brand AS frames"),
)
def _(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    device = F.when(k % 4 == 0, F.concat(F.lit("cuda:"), size, F.lit(" (rank 9)"))).when(k % 4 == 1, F.concat(F.lit("GPU -"), size)).when(k % 4 == 2, size).otherwise("none")
    model = F.when(k % 3 == 0, F.concat(F.lit(" "), "p_name", F.lit(" / variant (x)"))).when(k % 3 == 1, "").otherwise(F.repeat(F.concat("p_name", F.lit("-")), F.lit(20)))
    stack = F.concat(F.lit("->"), "p_name", F.lit("  -> "), "p_brand", F.lit("→"))
    said = F.concat("p_name", F.lit(" has key-key-1 and key-1"))
    return load(spark, d, "part").select(k.alias("key"), X.device_id(device).alias("device"), X.model_label(model, F.concat("p_name", F.lit(", model_type=y"))).alias("model"), F.array_join(X.stack_frames(stack), "|").alias("frames"), X.redacted(said, ["key-1", "key-key-1", ""]).alias("safe"))


@query(
    "clipped_lines",
    """WITH t AS (SELECT doc_id, coalesce(text, '') AS t, strlen(coalesce(text, '')) AS n FROM documents),
m AS (SELECT *, chr(10) || '[cut: ' || n || ' bytes]' || chr(10) AS marker FROM t),
c AS (SELECT *, 200 - strlen(marker) AS room FROM m),
k AS (SELECT *, (SELECT max(i) FROM range(0, 201) r(i) WHERE strlen(left(t, i)) <= room) AS fits FROM c)
SELECT doc_id, CASE WHEN n <= 200 THEN md5(t) ELSE md5(left(t, CAST(fits AS BIGINT)) || marker) END AS digest FROM k""",
)
def _(spark, d):
    return load(spark, d, "documents").select("doc_id", F.md5(X.clipped(F.coalesce("text", F.lit("")), 200)).alias("digest"))


@query(
    "layer_types",
    """SELECT n_nationkey AS layer, CASE WHEN n_nationkey = 0 THEN 'FIRST' WHEN n_nationkey >= 23 THEN 'HASH' WHEN n_regionkey = 0 THEN 'FULL_ATTN' WHEN n_regionkey = 1 THEN 'C4_LIGHT' WHEN n_regionkey = 2 THEN 'C128_HEAVY' WHEN n_regionkey = 3 THEN 'CR16' ELSE 'CR-1' END AS label,
  CASE WHEN n_nationkey = 0 THEN 'FIRST' WHEN n_nationkey = 24 THEN 'FINAL' WHEN n_regionkey = 0 THEN 'FULL_ATTN' WHEN n_regionkey = 1 THEN 'C4_LIGHT' WHEN n_regionkey = 2 THEN 'C128_HEAVY' WHEN n_regionkey = 3 THEN 'CR16' ELSE 'CR-1' END AS plain FROM nation""",
)
def _(spark, d):
    r, n = F.col("n_regionkey"), F.col("n_nationkey")
    ratio = F.when(r == 0, 0).when(r == 1, 4).when(r == 2, 128).when(r == 3, 16)
    return load(spark, d, "nation").select(n.alias("layer"), X.layer_type(ratio, n, F.lit(25), F.lit(2)).alias("label"), X.layer_type(ratio, n, F.lit(25), F.lit(0)).alias("plain"))


@query(
    "layer_count_by_period",
    f"""WITH {IV}, b AS (SELECT device, e - s AS dur, row_number() OVER (PARTITION BY device ORDER BY s, id) - 1 AS i, count(*) OVER (PARTITION BY device) AS total FROM iv),
d AS (SELECT *, least(200, total - 1) AS n FROM b WHERE i < least(200, total - 1)),
p AS (SELECT x.device, x.n, per.period, sum(least(x.dur, y.dur)::DOUBLE / greatest(x.dur, y.dur)) AS score
      FROM d x, (SELECT unnest(range(2, 120)) AS period) per, d y
      WHERE x.n >= 4 AND per.period < x.n AND per.period * 2 <= x.n AND x.i < least(per.period, x.n - per.period) AND y.device = x.device AND y.i = x.i + per.period AND x.dur > 0 AND y.dur > 0 GROUP BY 1, 2, 3),
m AS (SELECT device, arg_max(period, (round(score, 6), -period)) AS period, max(round(score, 6)) AS score FROM p GROUP BY 1)
SELECT t.device, CASE WHEN m.score > m.period * 0.7 THEN m.period // 2 ELSE 1 END AS layers FROM (SELECT DISTINCT device FROM b) t LEFT JOIN m ON t.device = m.device""",
)
def _(spark, d):
    iv = intervals(spark, d).withColumn("dur", F.col("e") - F.col("s"))
    return S.layer_count(iv, "dur", ["device"], 2)


HW = "CASE p_partkey % 5 WHEN 0 THEN 'Nvidia B200' WHEN 1 THEN 'b-300' WHEN 2 THEN 'H9' WHEN 3 THEN 'old' END"
DT = "CASE p_size % 5 WHEN 0 THEN 'FP8' WHEN 1 THEN 'bf16' WHEN 2 THEN 'tf32' WHEN 3 THEN NULL ELSE 'fp4' END"


def rules(spark, d):
    k, z = F.col("p_partkey"), F.col("p_size")
    hw = F.when(k % 5 == 0, "Nvidia B200").when(k % 5 == 1, "b-300").when(k % 5 == 2, "H9").when(k % 5 == 3, "old")
    told = F.when(z % 5 == 0, "FP8").when(z % 5 == 1, "bf16").when(z % 5 == 2, "tf32").when(z % 5 == 4, "fp4")
    dtypes = F.when(z % 3 == 0, F.array(F.lit("BF16"), F.lit("bf16"), F.lit("fp32_accum"))).when(z % 3 == 1, F.array(F.lit("fp8"), F.lit("bf16")))
    explicit = F.when(k % 7 == 0, 100.0).when(k % 7 == 1, 0.0)
    return load(spark, d, "part").select(k.alias("key"), hw.alias("hardware"), told.alias("told"), dtypes.alias("dtypes"), explicit.alias("explicit"), z.alias("size"))


@query(
    "peak_resolution",
    f"""WITH r AS (SELECT p_partkey AS key, {HW} AS hw, {DT} AS told, p_size % 3 AS z, p_partkey % 7 AS x FROM part),
c AS (SELECT *, coalesce(lower(told), CASE WHEN z = 0 THEN 'bf16' END) AS dtype FROM r),
k(hw, dtype, tflops) AS (VALUES ('Nvidia B200', 'fp8', 4500.0), ('Nvidia B200', 'bf16', 2250.0), ('Nvidia B200', 'tf32', 1125.0), ('Nvidia B200', 'fp4', 9000.0), ('b-300', 'fp8', 4500.0), ('b-300', 'bf16', 2250.0), ('b-300', 'tf32', 1125.0), ('b-300', 'fp4', 13500.0), ('old', 'bf16', 312.0))
SELECT key, CAST(CASE WHEN x = 0 THEN 100.0 ELSE k.tflops END AS DOUBLE) AS tflops, CASE WHEN x = 0 THEN coalesce(told, 'explicit') WHEN c.hw IS NULL THEN NULL ELSE c.dtype END AS dtype,
  CASE WHEN x = 0 THEN 'rule' WHEN k.tflops IS NULL THEN NULL WHEN c.hw = 'old' THEN 'map' ELSE 'registry' END AS source,
  CAST(CASE c.hw WHEN 'Nvidia B200' THEN 8000 WHEN 'b-300' THEN 8000 WHEN 'old' THEN 2039 END AS DOUBLE) AS gb_per_s
FROM c LEFT JOIN k ON c.hw = k.hw AND c.dtype = k.dtype""",
)
def _(spark, d):
    x = rules(spark, d).withColumn("p", E.peak(F.col("explicit"), F.col("told"), F.col("dtypes"), F.col("hardware"), legacy={"old": {"bf16": 312.0}}))
    s = F.col("p.source")
    kind = F.when(s == "semantic rule", "rule").when(s == "semantic-map hardware_tflops", "map").when(s.isNotNull(), "registry")
    return x.select("key", "p.tflops", "p.dtype", kind.alias("source"), E.bandwidth(F.col("hardware"), legacy={"old": 2039.0}).alias("gb_per_s"))


@query(
    "hardware_registry",
    """WITH a(hardware, top) AS (VALUES ('nvidiab200', 9000.0), ('b200', 9000.0), ('nvidiab300blackwellultra', 13500.0), ('nvidiab300', 13500.0), ('b300', 13500.0), ('blackwellultrab300', 13500.0)),
t(dtype, share) AS (VALUES ('fp4', NULL), ('fp8', 4500.0), ('fp6', 4500.0), ('fp16', 2250.0), ('bf16', 2250.0), ('tf32', 1125.0))
SELECT hardware, dtype, CAST(coalesce(share, top) AS DOUBLE) AS tflops, CAST(8000 AS DOUBLE) AS gb_per_s FROM a, t""",
)
def _(spark, d):
    return E.registry_frame(spark).drop("source")


@query(
    "efficiency_with_rejections",
    """WITH r AS (SELECT p_partkey AS key, (p_size % 7 + 1) * 512 AS m, (p_size % 11 + 1) * 256 AS n, 1024 AS k, CASE WHEN p_partkey % 9 = 0 THEN 0.001 ELSE 900 + p_size END::DOUBLE AS us, p_partkey % 5 AS w FROM part),
b AS (SELECT *, CASE w WHEN 0 THEN m * k * 2.0 + k * n * 4.0 + m * n * 4.0 WHEN 1 THEN (m * k + k * n + m * n) * 1.0 WHEN 2 THEN (m * k + k * n + m * n) * 2.0 WHEN 4 THEN (m * k + k * n + m * n) * 1.0 END AS bytes FROM r),
g AS (SELECT *, bytes / (us / 1e6) / 1e9 AS gb FROM b)
SELECT key, CASE WHEN w = 0 THEN 'rule.storage_dtypes' WHEN w = 1 THEN 'rule.storage_dtypes' WHEN w = 2 THEN 'rule.dtypes' WHEN w = 4 THEN 'compute_dtype' END AS source,
  round(CASE WHEN gb / 8000 <= 1 THEN gb / 8000 * 100 END, 6) AS mbu, CASE WHEN gb / 8000 > 1 THEN round(gb / 8000 * 100, 2) END AS rejected,
  CASE WHEN w = 3 THEN 'no width of storage is known' WHEN gb / 8000 > 1 THEN 'more than the bandwidth' END AS reason,
  round(2.0::DOUBLE * m * n * k / ((900 + m / 512) * 2250.0 * 1e6) * 100, 6) AS mfu FROM g""",
)
def _(spark, d):
    k, z = F.col("p_partkey"), F.col("p_size")
    lit = lambda *x: F.array(*map(F.lit, x))
    w = k % 5
    x = load(spark, d, "part").select(
        k.alias("key"), ((z % 7 + 1) * 512).cast("long").alias("m"), ((z % 11 + 1) * 256).cast("long").alias("n"), F.lit(1024).cast("long").alias("k"), F.when(k % 9 == 0, 0.001).otherwise(900.0 + z).alias("us"),
        F.when(w == 0, lit("bf16", "fp32", "FP32")).when(w == 1, lit("bf16", "no such type", "fp32")).alias("storage"), F.when(w == 1, "fp8").alias("shared"),
        F.when(w == 2, lit("tf32", "bf16", "fp8")).when(w == 3, lit("tf32", "accum_fp32")).alias("dtypes"), F.when(w == 3, "tf32").when(w == 4, "fp6").alias("computed"),
    )
    x = x.withColumn("widths", E.operand_bytes(F.col("storage"), F.col("shared"), F.col("dtypes"), F.col("computed")))
    c = [F.col(v) for v in ("m", "n", "k")]
    x = x.withColumn("b", E.judged_mbu(*c, F.col("us"), F.col("widths"), F.lit(8000.0)))
    return x.select("key", "widths.source", F.round("b.mbu", 6).alias("mbu"), "b.rejected", "b.reason", F.round(E.checked_mfu(*c, 900.0 + F.col("m") / 512, F.lit(2250.0)), 6).alias("mfu"))


FAMILY = """CASE WHEN p_size % 3 = 0 THEN concat('k', p_size % 4, '_', p_partkey) ELSE concat_ws('_', 'k' || (p_size % 4), replace(p_type, ' ', '_'), 'block64x128', 'stages' || (p_size % 7), 'warp4', 'aligned', 'persistent', p_partkey, 'sm100') END"""


@query(
    "identifier_labels",
    f"""WITH n AS (SELECT DISTINCT {FAMILY} AS name FROM part), x AS (SELECT name, string_split(name, '_') AS t, string_split(name, '_')[1] AS family FROM n),
fam AS (SELECT family, max(length(name)) AS longest, max(len(t)) AS widest FROM x GROUP BY 1),
tk AS (SELECT family, name, unnest(list_distinct(t)) AS token FROM x), alone AS (SELECT family, token FROM tk GROUP BY 1, 2 HAVING count(*) = 1),
own AS (SELECT tk.name, list(token) AS own FROM tk JOIN alone USING (family, token) GROUP BY 1),
w AS (SELECT way, keep, stem, cnt FROM (SELECT k - 2 AS way, k AS keep, NULL AS stem, NULL AS cnt FROM (SELECT unnest(range(2, 200)) AS k)) UNION ALL SELECT 1000 + (s - 1) * 3 + c, NULL, s, c FROM (SELECT unnest([1, 2, 3]) AS s), (SELECT unnest([1, 2, 3]) AS c)),
c AS (SELECT x.family, x.name, t, w.*, CASE WHEN keep IS NOT NULL THEN t[1:keep] ELSE list_concat(t[1:stem], list_filter(t[stem + 1:len(t) - 1], lambda e: list_contains(coalesce(own, []), e))[1:cnt]) END AS head
  FROM x JOIN fam ON x.family = fam.family AND longest > 60 LEFT JOIN own ON own.name = x.name JOIN w ON keep IS NULL OR keep <= widest),
d AS (SELECT *, CASE WHEN keep IS NOT NULL THEN t[keep + 1:] ELSE list_filter(t[2:], lambda e: NOT list_contains(head, e)) END AS rest FROM c),
l AS (SELECT family, name, way, array_to_string(list_concat(head, list_concat(CASE WHEN len(rest) > 1 OR len(rest) = 1 AND rest[1] <> t[len(t)] THEN ['…'] ELSE [] END, CASE WHEN len(rest) > 0 AND NOT list_contains(head, t[len(t)]) THEN [t[len(t)]] ELSE [] END)), '_') AS label FROM d),
j AS (SELECT family, way, max(length(label)) AS size FROM l GROUP BY 1, 2 HAVING count(DISTINCT label) = count(*)),
b AS (SELECT family, way FROM j QUALIFY row_number() OVER (PARTITION BY family ORDER BY size > 60, CASE WHEN size <= 60 THEN -size ELSE size END, way) = 1)
SELECT x.name, coalesce(l.label, x.name) AS label FROM x LEFT JOIN b ON x.family = b.family LEFT JOIN l ON l.name = x.name AND l.way = b.way""",
)
def _(spark, d):
    return identifier_labels(load(spark, d, "part").select(F.expr(FAMILY).alias("name")))
