"""The derived tables of an enriched kernel table: overview, core, auxiliary, classes and stages, with their totals.

All regions are computed at once, with region as a key everywhere; nothing is collected. Percentages are of the
region's unit duration and may exceed 100.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanespan.functions import kernels as K
from lanespan.functions.rules import matches
from lanespan.functions.scalars import truthy
from lanespan.operators import intervals as I
from lanespan.sources.scratch import cut

FOOTER = "__layer_total__"
KEY = ["unit_position", "unit_id", "unit_variant", "functional_module"]
PRIORITY = {"core": 3, "communication": 2, "auxiliary": 1}


def rule_value(rules: list[dict], name: str) -> Column:
    """`name` of the first matching rule, null if it has none or none matches. A rule's match has patterns for module and operator_name."""
    chain = None
    for r in rules:
        give = F.lit(r.get(name)).cast("string")
        chain = F.when(matches(r["match"]), give) if chain is None else chain.when(matches(r["match"]), give)
    return chain if chain is not None else F.lit(None).cast("string")


def routed(origin: DataFrame, regions: DataFrame | None) -> DataFrame:
    """origin with region: its own tag, else the region whose layers hold its layer id, else the first. regions: ord, region, low, high."""
    if regions is None:
        return origin.withColumn("region", F.coalesce(truthy(F.col("region"), ""), F.lit("all")) if "region" in origin.columns else F.lit("all"))
    first = regions.orderBy("ord").first()["region"]
    r = regions.select(F.col("region").alias("__region"), "low", "high")
    own = truthy(F.col("region"), "") if "region" in origin.columns else F.lit(None).cast("string")
    x = origin.join(F.broadcast(r), F.col("layer_id").between(F.col("low"), F.col("high")), "left")
    return x.withColumn("region", F.coalesce(own, "__region", F.lit(first))).drop("__region", "low", "high")


def enriched(origin: DataFrame, rules: list[dict], positions: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """Kernel rows with unit fields, duration, module label, category, concurrency and share of their region's unit.

    origin: region, seq, module, operator_name, duration_us, duration_avg_us, start_ns, end_ns, stream, layer_id, unit_position,
    unit_id, unit_variant, function_introduction. positions: layer_id, p_position, p_id, p_variant.
    strict: a row without one of its unit fields where positions are given, and a region whose unit takes no time, are errors.
    """
    footer = F.col("module") == FOOTER
    rows = origin.where(~footer)
    if positions is not None:
        rows = rows.join(positions, "layer_id", "left")
    unit = lambda c, p: F.coalesce(truthy(F.col(c), ""), rule_value(rules, c), F.col(p).cast("string") if positions is not None else F.lit(None), F.lit(""))
    rows = rows.withColumns({c: unit(c, p) for c, p in (("unit_position", "p_position"), ("unit_id", "p_id"), ("unit_variant", "p_variant"))})
    if strict and positions is not None:
        wrong = lambda c: F.raise_error(F.concat(F.lit(f"{c} is missing in row "), F.col("seq").cast("string"))).cast("string")
        rows = rows.withColumns({c: F.when(F.col(c) != "", F.col(c)).otherwise(wrong(c)) for c in ("unit_position", "unit_id", "unit_variant")})
    rows = rows.withColumn("duration", F.coalesce(truthy(F.col("duration_avg_us")), truthy(F.col("duration_us")), F.lit(0.0)))

    names = origin.select("operator_name").distinct().withColumn("operator", K.table_name(F.col("operator_name")))  # once for each name
    rows = rows.join(names, "operator_name").withColumn("leaf", F.substring_index("operator", "<", 1))
    rows = rows.withColumn("functional_module", F.coalesce(rule_value(rules, "functional_module"), K.module_label(F.col("module"))))
    rows = rows.withColumn("category", K.category(F.col("module"), F.col("operator_name"), F.col("leaf"), rule_value(rules, "category"), rule_value(rules, "core_kind")))
    rows = rows.withColumn("introduction", F.coalesce(rule_value(rules, "introduction"), truthy(F.col("function_introduction"), ""), F.lit("")))

    ends = origin.where(footer).groupBy("region").agg(F.max(F.struct("seq", F.coalesce(truthy(F.col("duration_avg_us")), truthy(F.col("duration_us"))).alias("d"))).alias("x")).select("region", F.col("x.d").alias("told"))
    wall = rows.groupBy("region").agg(((F.max("end_ns") - F.min("start_ns")) / 1000.0).alias("wall"))
    total = wall.join(ends, "region", "left").select("region", F.coalesce("told", "wall").alias("unit_us"))
    if strict:
        none = F.raise_error(F.concat(F.lit("the unit takes no time in region "), "region")).cast("double")
        total = total.withColumn("unit_us", F.when(F.col("unit_us") > 0, F.col("unit_us")).otherwise(none))
    lanes = rows.where("end_ns > start_ns").select("region", F.col("stream").cast("string").alias("stream"), F.col("seq").alias("id"), F.col("start_ns").alias("s"), F.col("end_ns").alias("e"))
    lanes = lanes.withColumn("id", F.concat_ws("/", "region", "id"))
    shared = I.concurrency(lanes, "region", "stream").select(F.col("id").alias("__id"), "ratio")
    rows = rows.withColumn("__id", F.concat_ws("/", "region", "seq")).join(shared, "__id", "left").join(total, "region")
    out = rows.withColumns({"concurrency_pct": F.coalesce("ratio", F.lit(0.0)) * 100, "duration_pct": F.col("duration") / F.col("unit_us") * 100})
    return out.drop("__id", "ratio", "leaf")


def module_totals(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sum, first place, and the introduction of the first operator of the highest category, for each key of each region."""
    priority = F.when(F.col("category") == "core", 3).when(F.col("category") == "communication", 2).otherwise(1)
    x = rows.groupBy("region", *keys).agg(F.sum("duration").alias("module_us"), F.min("seq").alias("first"), F.min(F.struct((-priority).alias("p"), "seq", "introduction")).alias("i"), F.max("unit_us").alias("unit_us"))
    return x.select("region", *keys, "module_us", (F.col("module_us") / F.col("unit_us") * 100).alias("module_pct"), "first", F.col("i.introduction").alias("introduction"))


def footers(rows: DataFrame, **sums: Column) -> DataFrame:
    return rows.groupBy("region").agg(*[c.alias(n) for n, c in sums.items()]).withColumn("kind", F.lit("total"))


def overview(rows: DataFrame) -> DataFrame:
    """A row for each kernel with its module's total, and a total for each region."""
    m = module_totals(rows, KEY).select("region", *KEY, "module_us", "module_pct")
    out = rows.join(m, ["region", *KEY]).withColumn("kind", F.lit("row"))
    out = out.select("region", "kind", "seq", *KEY, "module", "operator", "duration", "duration_pct", "concurrency_pct", "module_us", "module_pct", "introduction", "category")
    total = footers(rows, duration=F.sum("duration"), duration_pct=F.sum("duration") / F.max("unit_us") * 100)
    return out.unionByName(total, allowMissingColumns=True)


def of_category(rows: DataFrame, name: str) -> DataFrame:
    """Core or auxiliary operators by module and duration, with the module's total over all units, and a total for each region."""
    m = module_totals(rows, ["functional_module"]).select("region", "functional_module", "module_us", "module_pct")
    some = rows.where(F.col("category") == name)
    ord_ = F.row_number().over(Window.partitionBy("region").orderBy("functional_module", F.desc("duration"), "seq")).cast("long")
    out = some.join(m, ["region", "functional_module"]).withColumn("ord", ord_).withColumn("kind", F.lit("row"))
    out = out.select("region", "kind", "ord", *KEY, "module", "operator", "duration", "duration_pct", "concurrency_pct", "module_us", "module_pct", "introduction")
    whole = rows.groupBy("region").agg(F.sum(F.when(F.col("category") == name, F.col("duration")).otherwise(0.0)).alias("duration"), F.max("unit_us").alias("u"))
    total = whole.select("region", F.lit("total").alias("kind"), "duration", (F.col("duration") / F.col("u") * 100).alias("duration_pct"))
    return out.unionByName(total, allowMissingColumns=True)


def classes(rows: DataFrame) -> DataFrame:
    """region, ord, category, n, duration, duration_pct: the three categories in fixed order, empty ones too, and a total."""
    sums = [F.struct(F.lit(i).alias("ord"), F.lit(c).alias("category"), F.count_if(F.col("category") == c).alias("n"), F.sum(F.when(F.col("category") == c, F.col("duration")).otherwise(0.0)).alias("duration")) for i, c in enumerate(PRIORITY, 1)]
    sums.append(F.struct(F.lit(99).alias("ord"), F.lit("total").alias("category"), F.count(F.lit(1)).alias("n"), F.sum("duration").alias("duration")))
    g = rows.groupBy("region").agg(F.array(*sums).alias("x"), F.max("unit_us").alias("u"))
    g = g.select("region", "u", F.explode("x").alias("x"))
    return g.select("region", F.col("x.ord").cast("long").alias("ord"), "x.category", "x.n", "x.duration", (F.col("x.duration") / F.col("u") * 100).alias("duration_pct"))


def stages(rows: DataFrame) -> DataFrame:
    """Modules by position in order of appearance, then over all positions by duration (kind pattern), then a total whose interval figures cover all kernels."""

    def spans(keys: list[str]) -> DataFrame:
        iv = rows.where("end_ns > start_ns").select("region", *keys, F.col("start_ns").alias("s"), F.col("end_ns").alias("e"))
        u = I.union_length(iv, ["region", *keys])
        return u.select("region", *keys, (F.col("busy_union") / 1000.0).alias("union_us"), (F.col("wall") / 1000.0).alias("wall_us"))

    by_key = module_totals(rows, KEY).join(spans(KEY), ["region", *KEY], "left")
    place = F.coalesce(F.col("unit_position").try_cast("int"), F.lit(0))
    by_key = by_key.withColumn("ord", F.row_number().over(Window.partitionBy("region").orderBy(place, "first")).cast("long")).withColumn("kind", F.lit("row"))
    name = ["functional_module"]
    pattern = module_totals(rows, name).join(spans(name), ["region", *name], "left")
    pattern = pattern.withColumn("ord", F.row_number().over(Window.partitionBy("region").orderBy(F.desc("module_us"), "functional_module")).cast("long")).withColumn("kind", F.lit("pattern"))
    total = footers(rows, module_us=F.sum("duration"), module_pct=F.sum("duration") / F.max("unit_us") * 100).join(spans([]), "region", "left")
    cols = ["region", "kind", "ord", *KEY, "module_us", "module_pct", "union_us", "wall_us", "introduction"]
    out = by_key.select(*cols).unionByName(pattern.drop("first"), allowMissingColumns=True).unionByName(total, allowMissingColumns=True)
    return out.select(*cols)


def derived(origin: DataFrame, rules: list[dict], regions: DataFrame | None = None, positions: DataFrame | None = None) -> dict[str, DataFrame]:
    rows = cut(enriched(routed(origin, regions), rules, positions))  # five tables read it, most of them more than once
    return {"overview": overview(rows), "core": of_category(rows, "core"), "auxiliary": of_category(rows, "auxiliary"), "classes": classes(rows), "stages": stages(rows)}
