"""Queries of scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanespan.functions import scalars as X
from lanespan.plans.q_rollups import LP, joined
from lanespan.sources.capture import argv
from lanespan.sources.tables import load

Q, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


SHAPE = f"""{LP}, sh AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, category, '(M=' || qty * 64 || ',N=' || (l_partkey % 64 + 1) * 128 || ',K=' || (l_suppkey % 16 + 1) * 256 || ')' AS shape, cents / 10000.0::DOUBLE AS us FROM lp),
sp AS (SELECT *, CAST(regexp_extract(shape, 'M=(\\d+)', 1) AS BIGINT) AS m, CAST(regexp_extract(shape, 'N=(\\d+)', 1) AS BIGINT) AS n, CAST(regexp_extract(shape, 'K=(\\d+)', 1) AS BIGINT) AS k FROM sh)"""


def shapes(spark, d):
    x = joined(spark, d)
    text = F.concat(F.lit("(M="), (F.col("qty") * 64).cast("string"), F.lit(",N="), ((F.col("l_partkey") % 64 + 1) * 128).cast("string"), F.lit(",K="), ((F.col("l_suppkey") % 16 + 1) * 256).cast("string"), F.lit(")"))
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "category", X.shape(text).alias("s"), (F.col("cents") / 10000.0).alias("us"))


@query(
    "shape_parse_mfu_mbu",
    f"""WITH {SHAPE}, v AS (SELECT *, 2.0::DOUBLE * m * n * k / (us * 2250.0 * 1e6) * 100 AS mfu0, (m * k * 2.0::DOUBLE + k * n * 2.0 + m * n * 2.0) / (us / 1e6) / (8000.0 * 1e9) * 100 AS mbu0 FROM sp)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, m, n, k, round(CASE WHEN mfu0 <= 100 THEN mfu0 END, 4) AS mfu, round(CASE WHEN mbu0 <= 100 THEN mbu0 END, 4) AS mbu, CASE WHEN mfu0 > 100 OR mbu0 > 100 THEN 'over 100 percent' END AS reason FROM v""",
)
def _(spark, d):
    s, us = F.col("s"), F.col("us")
    f, b = X.mfu(s, us, F.lit(2250.0)), X.mbu(s, us, F.lit(8000.0))
    x = shapes(spark, d).withColumns({"f": f, "b": b})
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("s.M").alias("m"), F.col("s.N").alias("n"), F.col("s.K").alias("k"), F.round(X.bounded(F.col("f")), 4).alias("mfu"), F.round(X.bounded(F.col("b")), 4).alias("mbu"), F.when((F.col("f") > 100) | (F.col("b") > 100), "over 100 percent").alias("reason"))


@query(
    "projected_module_efficiency",
    f"""WITH {SHAPE}, p AS (SELECT *, CASE category WHEN 'core' THEN 4500 WHEN 'communication' THEN 2250 ELSE 1125 END AS peak, m * n * k AS mnk, CAST(round(us * 10000) AS BIGINT) AS t FROM sp)
SELECT category, count(*) AS n_rows, round(sum(mnk * peak)::DOUBLE / sum(mnk), 4) AS effective_peak, round(2.0 * sum(mnk)::DOUBLE / (sum(t)::DOUBLE / 10000 * (sum(mnk * peak)::DOUBLE / sum(mnk)) * 1e6) * 100, 4) AS mfu FROM p GROUP BY category""",
)
def _(spark, d):
    peak = F.when(F.col("category") == "core", 4500).when(F.col("category") == "communication", 2250).otherwise(1125)
    whole = lambda c: F.sum(c.cast("decimal(38,0)")).cast("double")  # noqa: E731  exact sums, in whatever order
    x = shapes(spark, d).withColumns({"mnk": F.col("s.M") * F.col("s.N") * F.col("s.K"), "peak": peak, "t": F.round(F.col("us") * 10000).cast("long")})
    g = x.groupBy("category").agg(F.count(F.lit(1)).alias("n_rows"), whole(F.col("mnk") * F.col("peak")).alias("fp"), whole(F.col("mnk")).alias("f"), whole(F.col("t")).alias("t"))
    return g.select("category", "n_rows", F.round(F.col("fp") / F.col("f"), 4).alias("effective_peak"), F.round(2.0 * F.col("f") / (F.col("t") / 10000 * (F.col("fp") / F.col("f")) * 1e6) * 100, 4).alias("mfu"))


@query("json_props_extract", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') AS missing FROM events")
def _(spark, d):
    return load(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"), F.get_json_object("props", "$.missing").alias("missing"))


@query(
    "number_parse",
    """WITH t AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size || '.5%' WHEN 1 THEN ' ' || p_retailprice WHEN 2 THEN p_brand WHEN 3 THEN '-' || p_size ELSE '' END AS text FROM part)
SELECT p_partkey, TRY_CAST(regexp_replace(trim(text), '%+$', '') AS DOUBLE) AS value FROM t""",
)
def _(spark, d):
    m = F.col("p_partkey") % 5
    text = F.when(m == 0, F.concat(F.col("p_size").cast("string"), F.lit(".5%"))).when(m == 1, F.concat(F.lit(" "), F.col("p_retailprice").cast("string"))).when(m == 2, F.col("p_brand")).when(m == 3, F.concat(F.lit("-"), F.col("p_size").cast("string"))).otherwise("")
    return load(spark, d, "part").select("p_partkey", X.number(text).alias("value"))


@query(
    "env_to_map",
    """WITH t AS (SELECT n_nationkey, unnest(string_split('NAME=' || n_name || ';R=' || n_regionkey || ';skip;EXPR=a=b;R=' || n_nationkey, ';')) AS item, generate_subscripts(string_split('NAME=' || n_name || ';R=' || n_regionkey || ';skip;EXPR=a=b;R=' || n_nationkey, ';'), 1) AS i FROM nation),
k AS (SELECT n_nationkey, regexp_extract(item, '^([^=]*)=', 1) AS key, regexp_replace(item, '^[^=]*=', '') AS value, i FROM t WHERE contains(item, '='))
SELECT n_nationkey, key, arg_max(value, i) AS value FROM k GROUP BY n_nationkey, key""",
)
def _(spark, d):
    n, r = F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string")
    blob = F.concat(F.lit("NAME="), "n_name", F.lit(";R="), r, F.lit(";skip;EXPR=a=b;R="), n)
    return load(spark, d, "nation").select("n_nationkey", F.explode(X.env_map(blob)).alias("key", "value"))


@query(
    "argv_rebuild",
    """SELECT n_regionkey AS process, count(*) AS n_args, string_agg('--' || n_name, ' ' ORDER BY i) AS command FROM (
  SELECT *, (n_nationkey // 5) + CASE WHEN n_nationkey // 5 >= 3 AND n_regionkey % 2 = 1 THEN 1 ELSE 0 END AS i FROM nation) WHERE NOT (n_regionkey % 2 = 1 AND i > 3) GROUP BY n_regionkey""",
)
def _(spark, d):
    # Arguments 0 to 4 of each process; processes with odd numbers have a hole at 3, at which their list ends.
    i = F.expr("n_nationkey div 5 + if(n_nationkey div 5 >= 3 and n_regionkey % 2 = 1, 1, 0)")
    rows = load(spark, d, "nation").select(F.concat(F.lit("PROCESS_"), F.col("n_regionkey").cast("string"), F.lit(":ARGUMENT_"), i.cast("string")).alias("name"), F.concat(F.lit("--"), "n_name").alias("value"))
    return argv(rows).select(F.col("process").cast("int").alias("process"), F.size("argv").cast("long").alias("n_args"), F.array_join("argv", " ").alias("command"))
