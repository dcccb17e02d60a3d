"""Queries of classification, rollups, totals and rankings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lanespan.functions.rules import first_match
from lanespan.operators import intervals as I
from lanespan.operators import rollups as R
from lanespan.sources.tables import IV, intervals, load

Q, SQL = {}, {}


def query(name: str, sql: str):
    def keep(f):
        Q[name], SQL[name] = f, sql
        return f

    return keep


RULES = [
    {"match": {"p_name": "ring|rod", "p_type": "promo|small"}, "category": "core", "prio": 3},
    {"match": {"p_name": "^(red|blue) "}, "category": "communication", "prio": 2},
    {"match": {"p_type": "^economy$"}, "category": "auxiliary", "prio": 1},
    {"match": {"p_name": "gear|bolt"}, "category": "core", "prio": 3},
]
LABELS = [("widget|gizmo", "gadget"), ("ring|rod|bolt", "fastener"), ("plate|anvil", "metal"), ("^hot", "heat")]
CATEGORIES = ["core", "communication", "auxiliary", "unused"]

CASE = """CASE WHEN regexp_matches(p_name, 'ring|rod', 'i') AND regexp_matches(p_type, 'promo|small', 'i') THEN {0} WHEN regexp_matches(p_name, '^(red|blue) ', 'i') THEN {1}
 WHEN regexp_matches(p_type, '^economy$', 'i') THEN {2} WHEN regexp_matches(p_name, 'gear|bolt', 'i') THEN {3} ELSE {4} END"""
CATEGORY = CASE.format("'core'", "'communication'", "'auxiliary'", "'core'", "'auxiliary'")


def parts(spark, d):
    p = load(spark, d, "part")
    return p.withColumn("category", first_match(RULES, "category", "auxiliary")).withColumn("prio", first_match(RULES, "prio", 0))


def lines(spark, d):
    return load(spark, d, "lineitem").withColumn("qty", F.col("l_quantity").cast("long")).withColumn("cents", F.round(F.col("l_extendedprice") * 100).cast("long"))


def joined(spark, d):
    return lines(spark, d).join(parts(spark, d), F.col("l_partkey") == F.col("p_partkey"))


LP = f"lp AS (SELECT *, CAST(l_quantity AS BIGINT) AS qty, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, {CATEGORY} AS category, {CASE.format(3, 2, 1, 3, 0)} AS prio FROM lineitem JOIN part ON l_partkey = p_partkey)"


@query("rule_first_match", f"SELECT p_partkey, CAST({CASE.format(0, 1, 2, 3, -1)} AS BIGINT) AS rule_ord, {CATEGORY} AS category FROM part")
def _(spark, d):
    return parts(spark, d).select("p_partkey", first_match(RULES, "ord", -1).cast("long").alias("rule_ord"), "category")


@query("fallback_label", "SELECT p_partkey, CASE " + " ".join(f"WHEN regexp_matches(p_name, '{p}', 'i') THEN '{x}'" for p, x in LABELS) + " ELSE 'other' END AS label FROM part")
def _(spark, d):
    return load(spark, d, "part").select("p_partkey", first_match([{"match": {"p_name": p}, "label": x} for p, x in LABELS], "label", "other").alias("label"))


TOTALS = f"""{LP}, c AS (SELECT unnest([0, 1, 2, 3]) AS ord, unnest(['core', 'communication', 'auxiliary', 'unused']) AS category),
a AS (SELECT category, count(*) AS n, CAST(sum(cents) AS BIGINT) AS total FROM lp GROUP BY category),
z AS (SELECT CAST(c.ord AS BIGINT) AS ord, c.category, coalesce(n, 0) AS n, coalesce(total, 0) AS total FROM c LEFT JOIN a ON c.category = a.category),
ct AS (SELECT ord, category, n, total, total * 100.0::DOUBLE / (SELECT sum(total) FROM z) AS pct FROM z UNION ALL SELECT 99, 'total', CAST(sum(n) AS BIGINT), CAST(sum(total) AS BIGINT), 100.0 FROM z)"""


def totals(spark, d):
    a = joined(spark, d).groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("total"))
    z = R.kept_zero(a, CATEGORIES, "category", n=0, total=0).select("ord", "category", "n", "total")
    z = z.unionByName(z.agg(F.lit(99).cast("long").alias("ord"), F.lit("total").alias("category"), F.sum("n").alias("n"), F.sum("total").alias("total")))
    whole = F.max(F.when(F.col("ord") == 99, F.col("total"))).over(Window.partitionBy(F.lit(0)))  # five rows
    return z.withColumn("pct", F.col("total") * 100.0 / whole)


@query("category_totals", f"WITH {TOTALS} SELECT ord, category, n, total, round(pct, 4) AS pct FROM ct")
def _(spark, d):
    return totals(spark, d).withColumn("pct", F.round("pct", 4))


ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def module_rollup(spark, d):
    x = joined(spark, d).join(load(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(F.broadcast(load(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    keys = ["n_regionkey", "n_name", "p_type", "category"]
    intro = F.min(F.struct((-F.col("prio")).alias("neg"), *ORDER, "p_name"))
    return R.first_seen(x, keys, ORDER, qty=F.sum("qty"), intro=intro).select(*keys, "qty", F.col("first.l_orderkey").alias("first_order"), F.col("intro.p_name").alias("intro"))


@query(
    "module_rollup_4key",
    f"""WITH {LP} SELECT n_regionkey, n_name, p_type, category, CAST(sum(qty) AS BIGINT) AS qty, min(l_orderkey) AS first_order,
  first(p_name ORDER BY -prio, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS intro FROM lp JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL""",
)
def _(spark, d):
    return module_rollup(spark, d)


@query("pattern_rollup", f"WITH {LP}, a AS (SELECT p_type, CAST(sum(qty) AS BIGINT) AS qty FROM lp GROUP BY p_type) SELECT p_type, qty, row_number() OVER (ORDER BY qty DESC, p_type) AS rank FROM a")
def _(spark, d):
    a = joined(spark, d).groupBy("p_type").agg(F.sum("qty").alias("qty"))
    return a.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("qty"), "p_type")).cast("long"))  # a row for each type


@query(
    "region_partitioned_totals",
    f"""WITH {LP}, a AS (SELECT r_name, p_type, CAST(sum(qty) AS BIGINT) AS qty FROM lp JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)
SELECT r_name, p_type, qty, row_number() OVER (ORDER BY r_name, p_type) AS seq FROM a UNION ALL SELECT r_name, 'total', CAST(sum(qty) AS BIGINT), -1 FROM a GROUP BY r_name""",
)
def _(spark, d):
    nations = load(spark, d, "nation").join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    x = joined(spark, d).join(load(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(F.broadcast(nations), F.col("s_nationkey") == F.col("n_nationkey"))
    a = x.rollup("r_name", "p_type").agg(F.sum("qty").alias("qty"), F.grouping_id().alias("g")).where("g < 2")
    seq = F.when(F.col("g") == 0, F.row_number().over(Window.partitionBy("g").orderBy("r_name", "p_type"))).otherwise(-1)
    return a.select("r_name", F.when(F.col("g") == 0, F.col("p_type")).otherwise("total").alias("p_type"), "qty", seq.cast("long").alias("seq"))


@query(
    "module_total_broadcast",
    f"""WITH {LP}, t AS (SELECT category, sum(cents) AS total FROM lp GROUP BY category), a AS (SELECT sum(cents) AS whole FROM lp)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, cents, round(cents * 100.0::DOUBLE / total, 6) AS own_share, round(total * 100.0::DOUBLE / whole, 6) AS module_share FROM lp JOIN t ON lp.category = t.category, a""",
)
def _(spark, d):
    x = R.module_shares(joined(spark, d), "category", "cents")
    return x.select(*ORDER, "cents", F.round("own_share", 6).alias("own_share"), F.round("module_share", 6).alias("module_share"))


@query(
    "dual_denominator_shares",
    """WITH a AS (SELECT l_returnflag, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty FROM lineitem GROUP BY 1), w AS (SELECT date_diff('day', min(l_shipdate), max(l_shipdate)) AS wall FROM lineitem)
SELECT l_returnflag, qty, round(qty * 100.0::DOUBLE / wall, 4) AS duration_pct, round(qty * 100.0::DOUBLE / sum(qty) OVER (), 4) AS share_pct FROM a, w""",
)
def _(spark, d):
    x = R.dual_shares(lines(spark, d), "l_returnflag", "qty", F.datediff(F.max("l_shipdate"), F.min("l_shipdate")))
    return x.withColumns({c: F.round(c, 4) for c in ("duration_pct", "share_pct")})


@query("truthy_coalesce", "SELECT c_custkey, coalesce(nullif(CAST(floor(c_acctbal / 5000) AS BIGINT), 0), nullif(CAST(c_nationkey AS BIGINT), 0), -1) AS picked, coalesce(CAST(floor(c_acctbal / 5000) AS BIGINT), CAST(c_nationkey AS BIGINT)) AS first_present FROM customer")
def _(spark, d):
    level = F.floor(F.col("c_acctbal") / 5000).cast("long")
    nation = F.col("c_nationkey").cast("long")
    return load(spark, d, "customer").select("c_custkey", F.coalesce(F.nullif(level, F.lit(0)), F.nullif(nation, F.lit(0)), F.lit(-1)).alias("picked"), F.coalesce(level, nation).alias("first_present"))


@query(
    "units_index",
    """WITH a AS (SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty, count(DISTINCT l_partkey) AS n_parts, date_diff('day', min(l_shipdate), max(l_shipdate)) AS wall, min(l_orderkey) AS first_order FROM lineitem GROUP BY 1, 2)
SELECT *, row_number() OVER (ORDER BY l_returnflag NULLS LAST, l_linestatus NULLS LAST) AS ordinal FROM a""",
)
def _(spark, d):
    a = lines(spark, d).groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum("qty").alias("qty"), F.countDistinct("l_partkey").alias("n_parts"), F.datediff(F.max("l_shipdate"), F.min("l_shipdate")).cast("long").alias("wall"), F.min("l_orderkey").alias("first_order"))
    return R.indexed(a, ["l_returnflag", "l_linestatus"])


@query(
    "weighted_overlap_topk",
    f"""WITH {IV}, j AS (SELECT a.id, greatest(a.s, b.s) AS s, least(a.e, b.e) AS e FROM iv a JOIN iv b ON a.device = b.device AND a.stream <> b.stream AND a.s < b.e AND b.s < a.e),
p AS (SELECT *, max(e) OVER (PARTITION BY id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM j),
u AS (SELECT id, sum(greatest(0, e - greatest(s, coalesce(pe, s)))) AS shared FROM p GROUP BY id),
n AS (SELECT stream || '_' || (device % 10) AS name, CAST(sum(e - s) AS BIGINT) AS total, count(*) AS n, sum(coalesce(shared, 0)) * 100.0::DOUBLE / sum(e - s) AS pct, sum(coalesce(shared, 0)) AS sh FROM iv LEFT JOIN u ON iv.id = u.id GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY total DESC, name) AS rank FROM n)
SELECT name, total, n, round(pct, 4) AS pct, rank FROM r WHERE rank <= 15 UNION ALL SELECT 'total', CAST(sum(total) AS BIGINT), CAST(sum(n) AS BIGINT), round(sum(sh) * 100.0::DOUBLE / sum(total), 4), 99 FROM r WHERE rank <= 15""",
)
def _(spark, d):
    name = F.concat("stream", F.lit("_"), (F.col("device") % 10).cast("string")).alias("name")
    n = I.shared(intervals(spark, d)).groupBy(name).agg(F.sum(F.col("e") - F.col("s")).alias("total"), F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("shared", F.lit(0))).alias("sh"))
    order = [F.desc("total"), F.asc_nulls_last("name")]
    top = n.orderBy(*order).limit(15).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))
    both = top.unionByName(top.agg(F.lit("total").alias("name"), F.sum("total").alias("total"), F.sum("n").alias("n"), F.sum("sh").alias("sh"), F.lit(99).cast("long").alias("rank")))
    pct = F.when(F.col("total") == 0, F.lit(float("nan"))).otherwise(F.try_divide(F.col("sh") * 100.0, F.col("total")))
    return both.select("name", "total", "n", F.round(pct, 4).alias("pct"), "rank")


@query("core_operator_table", f"WITH {LP} SELECT p_brand, p_type, p_size, CAST(sum(qty) AS BIGINT) AS qty, count(*) AS n, round(avg(nullif(CAST(round(l_discount * 100) AS BIGINT), 0)), 4) AS mean_discount_pct, min(l_orderkey) AS first_order FROM lp GROUP BY ALL")
def _(spark, d):
    x = R.operator_table(joined(spark, d), ["p_brand", "p_type", "p_size"], "qty", F.round(F.col("l_discount") * 100).cast("long"), "l_orderkey")
    return x.select("p_brand", "p_type", "p_size", "qty", "n", F.round("mean_share", 4).alias("mean_discount_pct"), F.col("first").alias("first_order"))


@query(
    "topk_per_group",
    f"WITH {LP}, r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY cents DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rank FROM lp) SELECT l_returnflag, l_linestatus, l_orderkey, l_linenumber, cents, rank FROM r WHERE rank <= 20",
)
def _(spark, d):
    return R.top_k(lines(spark, d), ["l_returnflag", "l_linestatus"], [F.desc("cents"), *ORDER], 20).select("l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber", "cents", "rank")


@query("rankings_with_percent", f"WITH {LP}, a AS (SELECT p_brand, CAST(sum(cents) AS BIGINT) AS total FROM lp GROUP BY 1) SELECT p_brand, total, round(total * 100.0::DOUBLE / sum(total) OVER (), 6) AS pct, row_number() OVER (ORDER BY total DESC, p_brand) AS rank FROM a")
def _(spark, d):
    return R.ranked_shares(joined(spark, d), "p_brand", "cents").withColumn("pct", F.round("pct", 6))


@query(
    "path_rollup_self_time",
    """WITH c AS (SELECT r_name, n_name, c_name, CAST(round(c_acctbal * 100) AS BIGINT) AS own, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
o AS (SELECT r_name, n_name, c_name, own, coalesce(sum(CAST(round(o_totalprice * 100) AS BIGINT)), 0) AS below FROM c LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
x AS (SELECT concat_ws('/', r_name, n_name, c_name) AS path, 3 AS level, own + below AS inclusive, own AS self FROM o
UNION ALL SELECT concat_ws('/', r_name, n_name), 2, sum(own + below), 0 FROM o GROUP BY r_name, n_name UNION ALL SELECT r_name, 1, sum(own + below), 0 FROM o GROUP BY r_name)
SELECT path, CAST(level AS BIGINT) AS level, CAST(inclusive AS BIGINT) AS inclusive, CAST(self AS BIGINT) AS self_value FROM x""",
)
def _(spark, d):
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    names = load(spark, d, "nation").join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    below = load(spark, d, "orders").groupBy("o_custkey").agg(F.sum(cents("o_totalprice")).alias("below"))
    c = load(spark, d, "customer").join(F.broadcast(names), F.col("c_nationkey") == F.col("n_nationkey")).join(below, F.col("c_custkey") == F.col("o_custkey"), "left")
    c = c.withColumn("below", F.coalesce("below", F.lit(0))).withColumn("all", cents("c_acctbal") + F.col("below"))
    levels = ["r_name", "n_name", "c_name"]
    out = R.path_rollup(c, levels, "all")
    # What is not a child's is the node's own: only customers hold something themselves.
    children = out.where("level > 1").groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("path")).agg(F.sum("inclusive").alias("theirs"))
    orders = c.select(F.concat_ws("/", *levels).alias("path"), F.col("below").alias("theirs"))
    return out.join(children.unionByName(orders), "path", "left").select("path", "level", "inclusive", (F.col("inclusive") - F.col("theirs")).alias("self_value"))


@query(
    "dispatch_cache",
    f"""WITH {LP} SELECT p_name, first(nullif(l_returnflag, 'N') ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) FILTER (WHERE l_returnflag <> 'N') AS site, count(DISTINCT l_suppkey) AS n_layers, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS submodules, count(*) AS launches, CAST(sum(cents) AS BIGINT) AS total FROM lp GROUP BY p_name""",
)
def _(spark, d):
    site = F.min(F.when(F.col("l_returnflag") != "N", F.struct(*ORDER, "l_returnflag")))
    out = joined(spark, d).groupBy("p_name").agg(site.alias("x"), F.countDistinct("l_suppkey").alias("n_layers"), F.array_sort(F.collect_set("l_linestatus")).alias("sub"), F.count(F.lit(1)).alias("launches"), F.sum("cents").alias("total"))
    return out.select("p_name", F.col("x.l_returnflag").alias("site"), "n_layers", F.array_join("sub", ",").alias("submodules"), "launches", "total")


FAMILIES = f"""{LP}, na AS (SELECT p_type, p_brand, count(*) AS na FROM lp WHERE year(l_shipdate) = 1998 GROUP BY ALL), nb AS (SELECT p_type, p_brand, count(*) AS nb FROM lp WHERE year(l_shipdate) = 1999 GROUP BY ALL)"""


def two_years(spark, d):
    x = joined(spark, d).select("p_type", "p_brand", F.year("l_shipdate").alias("y"))
    return x.where("y = 1998"), x.where("y = 1999")


@query(
    "family_jaccard",
    f"""WITH {FAMILIES}, j AS (SELECT coalesce(na.p_type, nb.p_type) AS p_type, coalesce(na, 0) AS na, coalesce(nb, 0) AS nb FROM na FULL JOIN nb ON na.p_type = nb.p_type AND na.p_brand = nb.p_brand)
SELECT p_type, CAST(sum(least(na, nb)) AS BIGINT) AS shared, CAST(sum(greatest(na, nb)) AS BIGINT) AS total, round(sum(least(na, nb))::DOUBLE / sum(greatest(na, nb)), 6) AS jaccard FROM j GROUP BY p_type""",
)
def _(spark, d):
    return R.jaccard(*two_years(spark, d), "p_type", "p_brand").withColumn("jaccard", F.round("jaccard", 6))


@query(
    "top_families_string",
    f"""WITH {FAMILIES}, r AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY na DESC, p_brand) AS k FROM na)
SELECT p_type, string_agg(p_brand || ':' || na, ';' ORDER BY k) AS families FROM r WHERE k <= 8 GROUP BY p_type""",
)
def _(spark, d):
    n = two_years(spark, d)[0].groupBy("p_type", "p_brand").agg(F.count(F.lit(1)).alias("na"))
    return R.top_listed(n, "p_type", "p_brand", "na", 8).withColumnRenamed("listed", "families")
