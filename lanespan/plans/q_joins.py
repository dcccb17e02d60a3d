"""Queries of the joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanespan.operators import align as A
from lanespan.operators import joins as J
from lanespan.plans.q_rollups import LP, ORDER, joined, lines
from lanespan.sources import capture as M
from lanespan.sources.tables import IV, intervals, load, micros

Q, SQL = {}, {}


def query(name: str, sql: str):
    def keep(f):
        Q[name], SQL[name] = f, sql
        return f

    return keep


@query(
    "dictionary_join",
    """WITH d AS (SELECT p_partkey, p_name FROM part WHERE p_partkey % 3 <> 0)
SELECT l_returnflag, count(*) AS n_left, count(p_partkey) AS n_inner, count(DISTINCT p_name) AS n_names FROM lineitem LEFT JOIN d ON l_partkey = p_partkey GROUP BY l_returnflag""",
)
def _(spark, d):
    names = load(spark, d, "part").where("p_partkey % 3 <> 0").select("p_partkey", "p_name")
    x = load(spark, d, "lineitem").join(names, F.col("l_partkey") == F.col("p_partkey"), "left")
    return x.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n_left"), F.count("p_partkey").alias("n_inner"), F.countDistinct("p_name").alias("n_names"))


@query(
    "asof_last_event",
    f"""WITH {IV}, c AS (SELECT device, s, max(id) AS id FROM iv WHERE stream = 'click' GROUP BY ALL)
SELECT p.id, c.id AS last_click, p.s - c.s AS age FROM (SELECT * FROM iv WHERE stream = 'error') p ASOF LEFT JOIN c ON p.device = c.device AND p.s >= c.s""",
)
def _(spark, d):
    iv = intervals(spark, d)
    clicks = iv.where("stream = 'click'").select("device", "s", F.col("id").alias("last_click"), F.col("s").alias("t"))
    out = J.asof(iv.where("stream = 'error'").select("device", "id", "s"), clicks, "device", "s", ["last_click", "t"])
    return out.select("id", "last_click", (F.col("s") - F.col("t")).alias("age"))


@query(
    "innermost_containment",
    f"""WITH {IV}, x AS (SELECT p.id, f.id AS frame, f.e - f.s AS d, row_number() OVER (PARTITION BY p.id ORDER BY f.e - f.s, f.id) AS k FROM iv p JOIN iv f ON p.device = f.device AND f.stream <> 'error' AND f.s <= p.s AND p.s < f.e WHERE p.stream = 'error')
SELECT p.id, frame, d AS frame_len FROM (SELECT * FROM iv WHERE stream = 'error') p LEFT JOIN x ON p.id = x.id AND k = 1""",
)
def _(spark, d):
    iv = intervals(spark, d)
    points = iv.where("stream = 'error'").select("device", "id", F.col("s").alias("t"))
    return J.innermost(points, iv.where("stream <> 'error'"), ["device"], "t", "id").select("id", "frame", "frame_len")


BAG = """bag AS (SELECT l_partkey, l_linestatus, row_number() OVER (PARTITION BY l_partkey, l_linestatus) AS n, count(CASE WHEN l_quantity >= 40 THEN 1 END) OVER g AS nc, count(CASE WHEN l_quantity BETWEEN 20 AND 39 THEN 1 END) OVER g AS na
  FROM lineitem WINDOW g AS (PARTITION BY l_partkey, l_linestatus)), bm AS (SELECT l_partkey, l_linestatus, n, CASE WHEN n <= nc THEN 'core' WHEN n <= nc + na THEN 'auxiliary' ELSE 'communication' END AS class FROM bag)"""


def bags(spark, d):
    x = load(spark, d, "lineitem")
    keys = ["l_partkey", "l_linestatus"]
    return J.bag_match(x, keys, [("core", x.where("l_quantity >= 40")), ("auxiliary", x.where("l_quantity between 20 and 39"))], "communication")


@query("bag_match", f"WITH {BAG} SELECT * FROM bm")
def _(spark, d):
    return bags(spark, d)


@query(
    "positional_zip",
    """WITH r AS (SELECT o_orderpriority, o_orderstatus, o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY o_orderkey) AS k FROM orders),
a AS (SELECT * FROM r WHERE o_orderstatus = 'F'), b AS (SELECT * FROM r WHERE o_orderstatus = 'O')
SELECT coalesce(a.o_orderpriority, b.o_orderpriority) AS o_orderpriority, coalesce(a.k, b.k) AS k, a.o_orderkey AS left_key, b.o_orderkey AS right_key, a.o_custkey % 5 IS NOT DISTINCT FROM b.o_custkey % 5 AS agree FROM a FULL JOIN b ON a.o_orderpriority = b.o_orderpriority AND a.k = b.k""",
)
def _(spark, d):
    o = load(spark, d, "orders")
    side = lambda s, n: o.where(F.col("o_orderstatus") == s).select("o_orderpriority", F.col("o_orderkey").alias(f"{n}_key"), (F.col("o_custkey") % 5).alias(f"{n}_m"))
    z = J.zipped(side("F", "left"), side("O", "right"), ["o_orderpriority"], ["left_key"], ["right_key"])
    return z.select("o_orderpriority", "k", "left_key", "right_key", F.col("left_m").eqNullSafe(F.col("right_m")).alias("agree"))


@query(
    "cascade_lookup",
    """WITH k AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) WHEN 2 THEN 'x ' || split_part(p_name, ' ', 2) ELSE 'zzz' END AS symbol FROM part),
c AS (SELECT p_name, count(*) AS n FROM part WHERE p_size <= 12 GROUP BY p_name), nm AS (SELECT lower(replace(p_name, ' ', '')) AS key, p_name FROM c),
lf AS (SELECT key, p_name FROM (SELECT split_part(p_name, ' ', 2) AS key, p_name, row_number() OVER (PARTITION BY split_part(p_name, ' ', 2) ORDER BY n DESC, p_name) AS r FROM c) WHERE r = 1)
SELECT p_partkey, symbol, CASE WHEN c.p_name IS NOT NULL THEN 'exact' WHEN nm.key IS NOT NULL THEN 'normalised' WHEN lf.key IS NOT NULL THEN 'leaf' ELSE 'missing' END AS level, coalesce(c.p_name, nm.p_name, lf.p_name) AS found
FROM k LEFT JOIN c ON symbol = c.p_name LEFT JOIN nm ON lower(replace(symbol, ' ', '')) = nm.key LEFT JOIN lf ON split_part(symbol, ' ', 2) = lf.key""",
)
def _(spark, d):
    part = load(spark, d, "part")
    leaf = lambda c: F.split_part(F.col(c), F.lit(" "), F.lit(2))
    flat = lambda c: F.lower(F.replace(F.col(c), F.lit(" "), F.lit("")))
    m = F.col("p_partkey") % 4
    k = part.select("p_partkey", F.when(m == 0, F.col("p_name")).when(m == 1, F.upper("p_name")).when(m == 2, F.concat(F.lit("x "), leaf("p_name"))).otherwise("zzz").alias("symbol"))
    c = part.where("p_size <= 12").groupBy("p_name").agg(F.count(F.lit(1)).alias("n"))
    leaves = c.groupBy(leaf("p_name").alias("key")).agg(F.min(F.struct((-F.col("n")).alias("neg"), "p_name")).alias("x")).select("key", F.col("x.p_name").alias("p_name"))
    return J.cascade(k, "symbol", [("exact", F.col("symbol"), c.select("p_name", F.col("p_name").alias("name")), "name"), ("normalised", flat("symbol"), c.select(flat("p_name").alias("key"), "p_name"), "p_name"), ("leaf", leaf("symbol"), leaves, "p_name")])


@query(
    "nearest_match",
    """WITH f AS (SELECT o_orderkey, o_custkey, epoch_us(o_orderdate) AS t FROM orders WHERE o_orderstatus = 'F'), o AS (SELECT o_orderkey AS k, o_custkey AS c, epoch_us(o_orderdate) AS u FROM orders WHERE o_orderstatus = 'O'),
x AS (SELECT f.o_orderkey, abs(t - u) AS off, k, row_number() OVER (PARTITION BY f.o_orderkey ORDER BY abs(t - u), k) AS r FROM f JOIN o ON o_custkey = c) SELECT o_orderkey, off AS distance, k AS nearest FROM x WHERE r = 1""",
)
def _(spark, d):
    o = load(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", micros("o_orderdate").alias("t"))
    f = o.where("o_orderstatus = 'F'").select("o_custkey", "o_orderkey", "t")
    got = J.nearest(f, o.where("o_orderstatus = 'O'"), "o_custkey", "t", "o_orderkey", 400 * 86_400_000_000)
    return got.where("nearest is not null").select("o_orderkey", "distance", "nearest")


ALIGN = f"""{IV}, ev AS (SELECT device // 2 AS pair, device % 2 AS side, stream, CAST(json_extract_string(props, '$.k') AS BIGINT) AS name, e - s AS d, row_number() OVER (PARTITION BY device, stream ORDER BY s, id) AS rank FROM iv JOIN events ON id = event_id),
al AS (SELECT x.pair, x.stream, x.rank, CASE WHEN x.name = y.name THEN 'same_order_exact_name' WHEN x.name // 10 = y.name // 10 THEN 'same_order_family' ELSE 'same_order_mismatch' END AS status, y.d - x.d AS delta FROM ev x JOIN ev y ON x.pair = y.pair AND x.stream = y.stream AND x.rank = y.rank AND x.side = 0 AND y.side = 1)"""


def aligned(spark, d):
    """The launches of both devices of each pair, as operators of alignment take them."""
    ev = load(spark, d, "events").select(F.col("event_id").alias("id"), F.get_json_object("props", "$.k").cast("long").alias("name"))
    iv = intervals(spark, d).join(ev, "id").withColumn("pair", F.expr("device div 2"))
    side = lambda m: iv.where(F.col("device") % 2 == m).select("pair", "stream", F.struct("s", "id").alias("place"), "name", F.col("name").alias("plain"), F.expr("name div 10").alias("family"), (F.col("e") - F.col("s")).alias("us"))
    return side(0), side(1)


@query("launch_alignment", f"WITH {ALIGN} SELECT pair, stream, rank, status, delta FROM al")
def _(spark, d):
    x = A.launches(*aligned(spark, d), ["pair", "stream"])
    return x.select("pair", "stream", F.col("k").alias("rank"), "status", F.col("delta_us").alias("delta"))


@query(
    "alignment_summary",
    f"""WITH {ALIGN}, n AS (SELECT pair, stream, count(*) AS n_left FROM ev WHERE side = 0 GROUP BY ALL)
SELECT n.pair, n.stream, n_left, count(CASE WHEN status <> 'same_order_mismatch' THEN 1 END) AS matched, count(status) AS paired, round(count(CASE WHEN status <> 'same_order_mismatch' THEN 1 END)::DOUBLE / n_left, 6) AS match_rate FROM n LEFT JOIN al ON n.pair = al.pair AND n.stream = al.stream GROUP BY n.pair, n.stream, n_left""",
)
def _(spark, d):
    return A.matches(*aligned(spark, d), ["pair", "stream"]).withColumn("match_rate", F.round("match_rate", 6))


@query(
    "set_diff_names",
    """WITH x AS (SELECT p_name || ' ' || p_brand AS name, bool_or(p_size <= 10) AS a, bool_or(p_size > 40) AS b FROM part GROUP BY 1) SELECT name, CASE WHEN a AND b THEN 'common' WHEN a THEN 'only_a' ELSE 'only_b' END AS side FROM x WHERE a OR b""",
)
def _(spark, d):
    x = load(spark, d, "part").groupBy(F.concat_ws(" ", "p_name", "p_brand").alias("name")).agg(F.bool_or(F.col("p_size") <= 10).alias("a"), F.bool_or(F.col("p_size") > 40).alias("b"))
    return x.where("a or b").select("name", F.when(F.col("a") & F.col("b"), "common").when(F.col("a"), "only_a").otherwise("only_b").alias("side"))


@query(
    "full_outer_conflicts",
    """SELECT coalesce(c_custkey, s_suppkey) AS key, c_nationkey AS left_value, s_nationkey AS right_value, CASE WHEN c_custkey IS NULL THEN 'only_right' WHEN s_suppkey IS NULL THEN 'only_left' ELSE 'conflict' END AS status
FROM customer FULL JOIN supplier ON c_custkey = s_suppkey WHERE c_nationkey IS DISTINCT FROM s_nationkey""",
)
def _(spark, d):
    side = lambda t, key, value: load(spark, d, t).select(F.col(key).alias("key"), F.col(value).alias("value"))
    x = M.conflicts(side("customer", "c_custkey", "c_nationkey"), side("supplier", "s_suppkey", "s_nationkey"), missing=True)
    return x.withColumnsRenamed({"captured": "left_value", "declared": "right_value"}).withColumn("status", F.regexp_replace(F.regexp_replace("status", "captured", "left"), "declared", "right"))


RANGES = [(1, 10, "encoder"), (11, 25, "decoder"), (30, 40, "head")]


@query("range_route", "SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 10 THEN 'encoder' WHEN p_size BETWEEN 11 AND 25 THEN 'decoder' WHEN p_size BETWEEN 30 AND 40 THEN 'head' ELSE 'encoder' END AS region FROM part")
def _(spark, d):
    r = spark.createDataFrame(RANGES, "lo int, hi int, region string")
    x = load(spark, d, "part").join(F.broadcast(r), F.col("p_size").between(F.col("lo"), F.col("hi")), "left")
    return x.select("p_partkey", F.coalesce("region", F.lit(RANGES[0][2])).alias("region"))


@query(
    "occurrence_queue",
    f"""WITH {LP}, o AS (SELECT l_partkey, l_orderkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, cents) AS k FROM lp),
c AS (SELECT l_partkey, l_orderkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, cents) AS k FROM lp WHERE qty >= 40)
SELECT c.l_partkey, c.k, c.l_orderkey AS core_order, o.l_orderkey AS origin_order FROM c LEFT JOIN o ON c.l_partkey = o.l_partkey AND c.k = o.k""",
)
def _(spark, d):
    x = lines(spark, d)
    order = lambda n: [f"{n}_order", f"{n}_line", f"{n}_supp", f"{n}_cents"]
    side = lambda df, n: df.select("l_partkey", F.col("l_orderkey").alias(f"{n}_order"), F.col("l_linenumber").alias(f"{n}_line"), F.col("l_suppkey").alias(f"{n}_supp"), F.col("cents").alias(f"{n}_cents"))
    z = J.zipped(side(x.where("qty >= 40"), "core"), side(x, "origin"), ["l_partkey"], order("core"), order("origin"), "left")
    return z.select("l_partkey", "k", "core_order", "origin_order")


@query(
    "recursive_parent_walk",
    """WITH RECURSIVE n AS (SELECT o_orderkey AS node, CASE WHEN o_orderkey > 0 THEN (o_orderkey - 1) // 2 END AS up FROM orders),
w AS (SELECT node, 0 AS depth, CAST(node AS VARCHAR) AS path FROM n WHERE up IS NULL UNION ALL SELECT n.node, depth + 1, path || '/' || n.node FROM n JOIN w ON n.up = w.node WHERE depth < 64)
SELECT node, CAST(depth AS BIGINT) AS depth, path FROM w""",
)
def _(spark, d):
    n = load(spark, d, "orders").select("o_orderkey", F.expr("if(o_orderkey > 0, (o_orderkey - 1) div 2, null)").alias("up"))
    return J.ancestors(n, "o_orderkey", "up").select("node", "depth", F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"))
