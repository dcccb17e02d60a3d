"""Queries of the checks, of free-text filtering, streams and workbooks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanespan.operators import checks as C
from lanespan.operators import contracts as V
from lanespan.operators import segments as S
from lanespan.plans.q_intervals import DECOMPOSITION, decomposition
from lanespan.plans.q_joins import BAG, bags
from lanespan.plans.q_rollups import TOTALS, totals
from lanespan.plans.q_segments import BLOCKS, blocks
from lanespan.sources.repair import published
from lanespan.sources.sinks import workbook_of
from lanespan.sources.tables import intervals, load
from lanespan.streaming.events import session_windows
from lanespan.streaming.stateful import new_folder

Q, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


@query(
    "closure_violations",
    f"""WITH {DECOMPOSITION}, x AS (SELECT b - a AS period, coalesce(prologue + body + tail, 0) AS busy, b - a - coalesce(prologue + body + tail, 0) AS gap FROM cv)
SELECT 'parts_close' AS check_id, count(*) AS n_rows, count(CASE WHEN abs(busy + gap - period) > period * 0.005 THEN 1 END) AS n_violations FROM x
UNION ALL SELECT 'gap_not_negative', count(*), count(CASE WHEN gap < 0 THEN 1 END) FROM x UNION ALL SELECT 'gap_below_half', count(*), count(CASE WHEN gap * 2 > period THEN 1 END) FROM x""",
)
def _(spark, d):
    x = decomposition(intervals(spark, d))
    parts = ["prologue", "body", "tail", "gap"]
    return C.all_of(C.check("parts_close", x, C.closure(x, "period", parts, 0.005)), C.check("gap_not_negative", x, F.col("gap") < 0), C.check("gap_below_half", x, F.col("gap") * 2 > F.col("period")))


@query(
    "total_row_violations",
    f"""WITH {TOTALS}, t AS (SELECT count(*) AS k, max(total) AS whole, max(n) AS n FROM ct WHERE category = 'total'), s AS (SELECT sum(total) AS whole, sum(n) AS n FROM ct WHERE category <> 'total')
SELECT 'one_total' AS check_id, count(*) AS n_rows, count(CASE WHEN k <> 1 THEN 1 END) AS n_violations FROM t UNION ALL SELECT 'total_is_sum', count(*), count(CASE WHEN t.whole <> s.whole OR t.n <> s.n THEN 1 END) FROM t, s
UNION ALL SELECT 'categories_used', count(*), count(CASE WHEN n = 0 THEN 1 END) FROM ct""",
)
def _(spark, d):
    x = totals(spark, d)
    own = F.col("category") == "total"
    one = x.agg(F.count_if(own).alias("k"), F.sum(F.when(own, F.col("total"))).alias("t"), F.sum(F.when(~own, F.col("total"))).alias("s"), F.sum(F.when(own, F.col("n"))).alias("tn"), F.sum(F.when(~own, F.col("n"))).alias("sn"))
    return C.all_of(C.check("one_total", one, F.col("k") != 1), C.check("total_is_sum", one, (F.col("t") != F.col("s")) | (F.col("tn") != F.col("sn"))), C.check("categories_used", x, F.col("n") == 0))


@query(
    "membership_violations",
    f"""WITH {BAG}, c AS (SELECT l_partkey, l_linestatus, count(*) AS n FROM lineitem WHERE l_quantity >= 40 GROUP BY ALL), m AS (SELECT l_partkey, l_linestatus, count(*) AS n FROM bm WHERE class = 'core' GROUP BY ALL)
SELECT 'core_in_rows' AS check_id, count(*) AS n_rows, count(CASE WHEN m.n IS DISTINCT FROM c.n THEN 1 END) AS n_violations FROM c LEFT JOIN m ON c.l_partkey = m.l_partkey AND c.l_linestatus = m.l_linestatus
UNION ALL SELECT 'all_classified', count(*), count(CASE WHEN class = 'communication' THEN 1 END) FROM bm""",
)
def _(spark, d):
    keys = ["l_partkey", "l_linestatus"]
    rows = bags(spark, d)
    n = load(spark, d, "lineitem").where("l_quantity >= 40").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    m = rows.where("class = 'core'").groupBy(*keys).agg(F.count(F.lit(1)).alias("m"))
    return C.all_of(C.check("core_in_rows", n.join(m, keys, "left"), ~F.col("n").eqNullSafe(F.col("m"))), C.check("all_classified", rows, F.col("class") == "communication"))


@query(
    "window_alignment_violations",
    f"WITH {BLOCKS}, n AS (SELECT layer, half, device, pass, count(*) AS n FROM bl GROUP BY ALL) SELECT layer, half, min(n) AS low, max(n) AS high, max(n) - min(n) > max(n) * 0.15 AS beyond FROM n GROUP BY layer, half",
)
def _(spark, d):
    x = blocks(spark, d).withColumn("variant", F.struct("layer", "half"))
    return C.spread(x, "variant", ["device", "pass"], 0.15).select("variant.layer", "variant.half", "low", "high", "beyond")


@query(
    "evidence_ratio",
    r"""SELECT source, count(*) AS n, round(avg(CAST(regexp_matches(text, '[A-Z][a-z]+\.') AS INT)), 6) AS sentence, round(avg(CAST(regexp_matches(text, '[0-9]{3}') AS INT)), 6) AS digits, round(avg(CAST(regexp_matches(text, '@|https?://') AS INT)), 6) AS contact FROM documents GROUP BY source""",
)
def _(spark, d):
    out = C.coverage(load(spark, d, "documents"), "source", "text", {"sentence": r"[A-Z][a-z]+\.", "digits": "[0-9]{3}", "contact": "@|https?://"})
    return out.select("source", "n", *[F.round(c, 6).alias(c) for c in ("sentence", "digits", "contact")])


@query(
    "naming_drift",
    """WITH v AS (SELECT * FROM (VALUES ('widget', 'ok'), ('gizmo', 'ok'), ('ring', 'ok'), ('rod', 'alias'), ('bolt', 'ok'), ('gear', 'ok'), ('disc', 'ok')) t(name, kind)), n AS (SELECT split_part(p_name, ' ', 2) AS name, count(*) AS n FROM part GROUP BY 1)
SELECT coalesce(n.name, v.name) AS name, coalesce(n.n, 0) AS n, CASE WHEN v.name IS NULL THEN 'unknown' WHEN n.name IS NULL THEN 'unused' WHEN kind = 'alias' THEN 'deprecated' ELSE 'known' END AS status FROM n FULL JOIN v ON n.name = v.name""",
)
def _(spark, d):
    v = spark.createDataFrame([("widget", "ok"), ("gizmo", "ok"), ("ring", "ok"), ("rod", "alias"), ("bolt", "ok"), ("gear", "ok"), ("disc", "ok")], "name string, kind string")
    n = load(spark, d, "part").groupBy(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return C.name_status(n, v)


@query(
    "free_text_filter_sort",
    """WITH f AS (SELECT * FROM part WHERE p_size BETWEEN 5 AND 30 AND contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'gear') AND p_type <> 'PROMO')
SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS ord FROM f""",
)
def _(spark, d):
    f = load(spark, d, "part").where("p_size between 5 and 30 and p_type <> 'PROMO'")
    f = C.matching(f, " Gear ", ["p_name", "p_brand", "p_type"])
    f = f.withColumn("order", -F.col("p_retailprice"))
    return S.numbered(f, ["p_type"], ["order", "p_partkey"], "ord").select("p_partkey", "p_type", (F.col("ord") + 1).alias("ord"))


@query(
    "stream_session_window",
    """WITH v AS (SELECT user_id, event_id, epoch_us(ts) AS s FROM events), g AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY user_id ORDER BY s, event_id) >= 21600000000 THEN 1 ELSE 0 END AS new FROM v),
k AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, min(s) AS session_start, max(s) + 21600000000 AS session_end, count(*) AS n FROM k GROUP BY user_id, session""",
)
def _(spark, d):
    return session_windows(spark, d)


@query("table_to_workbook")
def _(spark, d):
    return workbook_of(load(spark, d, "nation").orderBy("n_nationkey"), "nation")


@query(
    "repaired_table",
    """WITH t AS (SELECT o_custkey AS customer, count(*) AS orders, min(o_totalprice) AS least FROM orders GROUP BY 1) SELECT 'current' AS place, count(*) AS n_rows, CAST(sum(orders) AS BIGINT) AS orders, 0 AS broken FROM t
UNION ALL SELECT 'rejected', count(*), CAST(sum(CASE WHEN customer % 7 = 0 THEN -1 ELSE orders END) AS BIGINT), count(CASE WHEN customer % 7 = 0 THEN 1 END) FROM t""",
)
def _(spark, d):
    """A table of customers of which every seventh was written wrong is derived again from the orders."""
    build = lambda: load(spark, d, "orders").groupBy(F.col("o_custkey").alias("customer")).agg(F.count(F.lit(1)).alias("orders"))
    wrong = F.when(F.col("customer") % 7 == 0, -1).otherwise(F.col("orders")).cast("long")
    root = new_folder(spark)
    build().withColumn("orders", wrong).write.parquet(f"{root}/current")
    published(spark, root, build, lambda x: V.violations(x, "has_orders", F.col("orders") <= 0, F.col("customer"), F.col("orders")))
    count = lambda n, path: spark.read.parquet(f"{root}/{path}").agg(F.lit(n).alias("place"), F.count(F.lit(1)).alias("n_rows"), F.sum("orders").alias("orders"), F.count_if(F.col("orders") <= 0).cast("int").alias("broken"))
    return count("current", "current").unionByName(count("rejected", "rejected/0"))
