"""Contracts of published tables: each function returns its violations as (check_id, key, detail), and no rows where all is well."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CLOSURE = 0.005
# Hand-offs between devices, and the types of pipeline rows.
HANDOFF = r"(?i)SendRecv|Recv|Send"
ROW_TYPES = ["total", "phase", "variant", "stage", "other", "gap"]


def violations(rows: DataFrame, check_id: str, bad: Column, key: Column, detail: Column) -> DataFrame:
    return rows.where(F.coalesce(bad, F.lit(True))).select(F.lit(check_id).alias("check_id"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))


def all_violations(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def pipeline(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys..., check_id, key, detail of pipeline tables (keys, ord, kind, name, total_us, note).

    Each has one total above 0, known kinds and a phase, unless the total stands alone. Rows after a phase belong to it and
    add up to it; phases and gaps add up to the total; both within half a percent of it. Gaps are not negative and have a note.
    """
    own = F.concat_ws("/", *keys)
    up = F.last(F.when(F.col("kind") == "phase", F.struct("ord", "name", "total_us")), True).over(Window.partitionBy(*keys).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    x = rows.withColumn("up", up)
    kind = lambda k: F.col("kind") == k
    t = rows.groupBy(*keys).agg(F.count_if(kind("total")).alias("totals"), F.max(F.when(kind("total"), F.col("total_us"))).alias("step"), F.count_if(~kind("total")).alias("others"), F.count_if(kind("phase")).alias("phases"), F.sum(F.when(F.col("kind").isin("phase", "gap"), F.col("total_us")).otherwise(0.0)).alias("sum"))
    step = t.select(*keys, "step")
    child = x.where(F.col("kind").isin("variant", "stage", "other"))
    sums = child.where("up is not null").groupBy(*keys, "up").agg(F.sum("total_us").alias("sum"), F.count_if(F.col("total_us").isNull()).alias("unknown")).join(step, keys)
    gaps = rows.where("kind = 'gap'")
    some = F.col("others") > 0
    return all_violations(
        violations(rows, "kind", ~F.col("kind").isin(*ROW_TYPES), own, F.col("kind")),
        violations(t, "one_total", F.col("totals") != 1, own, F.col("totals")),
        violations(t, "total_above_0", ~(F.col("step") > 0), own, F.col("step")),
        violations(t, "has_phase", some & (F.col("phases") == 0), own, F.col("phases")),
        violations(child, "has_parent", F.col("up").isNull(), F.concat_ws("/", own, "name"), F.col("kind")),
        violations(sums, "phase_closes", (F.col("unknown") > 0) | (F.abs(F.col("sum") - F.col("up.total_us")) > F.col("step") * CLOSURE), F.concat_ws("/", own, "up.name"), F.round("sum", 1)),
        violations(gaps, "gap_not_negative", F.col("total_us") < 0, F.concat_ws("/", own, "name"), F.round("total_us", 1)),
        violations(gaps, "gap_has_note", F.coalesce(F.col("note"), F.lit("")) == "", F.concat_ws("/", own, "name"), F.lit("")),
        violations(t.where(some), "step_closes", F.abs(F.col("sum") - F.col("step")) > F.col("step") * CLOSURE, own, F.round("sum", 1)),
    )


def column_before(spark: SparkSession, columns: list[str], first: str, then: str) -> DataFrame:
    """A violation unless the column `first` stands immediately before `then`."""
    at = {c: i for i, c in enumerate(columns)}
    ok = first in at and then in at and at[then] == at[first] + 1
    return spark.createDataFrame([] if ok else [("column_order", f"{first},{then}", ",".join(columns))], "check_id string, key string, detail string")


def positional(a: DataFrame, b: DataFrame, order_a: str, order_b: str, value: str) -> DataFrame:
    """Both frames have as many rows, and the same value at each place. order_a and order_b are places from 1."""
    x = a.select(F.col(order_a).alias("k"), F.col(value).alias("va")).join(b.select(F.col(order_b).alias("k"), F.col(value).alias("vb")), "k", "full")
    return violations(x, "positional", ~F.col("va").eqNullSafe(F.col("vb")), F.col("k"), F.concat_ws(" <> ", F.coalesce("va", F.lit("-")), F.coalesce("vb", F.lit("-"))))


def attribution(rows: DataFrame, unit_us: Column) -> DataFrame:
    """Operators longer than their unit, hand-offs that take more than a fifth of it, and variants whose positions differ by more than 15 % in operators."""
    d = F.col("duration")
    key = F.concat_ws("/", "unit_variant", "unit_position", "seq")
    long_ = d > unit_us * 1.001
    wait = (F.coalesce(F.col("unit_position"), F.lit("")) != "") & F.col("operator_name").rlike(HANDOFF) & (d > unit_us * 0.2)
    known = rows.where((unit_us > 0) & (d > 0))
    n = rows.where(F.coalesce(F.col("unit_position"), F.lit("")) != "").groupBy("unit_variant", "unit_position").agg(F.count(F.lit(1)).alias("n"))
    n = n.groupBy("unit_variant").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    return all_violations(
        violations(known, "longer_than_unit", long_, key, F.round(d, 3)),
        violations(known, "handoff", ~long_ & wait, key, F.round(d / unit_us * 100, 3)),
        violations(n, "positions_differ", F.col("hi") > F.col("lo") * 1.15, F.col("unit_variant"), F.concat_ws("-", F.col("lo").cast("string"), F.col("hi").cast("string"))),
    )


def sampling(manifests: DataFrame) -> DataFrame:
    """manifests: package, present, single_sample, accepted. A manifest has to be there, and tell of at least 3 samples where it tells any."""
    return all_violations(
        violations(manifests, "manifest", ~F.col("present"), F.col("package"), F.lit("missing")),
        violations(manifests.where("present"), "single_sample", F.coalesce("single_sample", F.lit(False)), F.col("package"), F.lit("one sample")),
        violations(manifests.where("present and accepted is not null"), "samples", F.col("accepted") < 3, F.col("package"), F.col("accepted")),
    )


def composition(declared: DataFrame, shown: DataFrame) -> DataFrame:
    """Variants of heterogeneous units: declared (position, variant) against shown rows (position, variant).

    The same variants in both, each declared position shown with its variant only, and no shown row without a position.
    """
    v = declared.select("variant").distinct().withColumn("d", F.lit(True)).join(shown.select("variant").where("variant <> ''").distinct().withColumn("s", F.lit(True)), "variant", "full")
    p = shown.groupBy("position").agg(F.collect_set("variant").alias("variants"))
    p = declared.withColumnRenamed("variant", "wanted").join(p, "position", "left")
    side = F.when(F.col("d").isNull(), "undeclared").otherwise("not shown")
    return all_violations(
        violations(v, "variants", F.col("d").isNull() | F.col("s").isNull(), F.col("variant"), side),
        violations(p, "position_shown", F.col("variants").isNull(), F.col("position"), F.col("wanted")),
        violations(p.where("variants is not null"), "position_variant", F.col("variants") != F.array("wanted"), F.col("position"), F.array_join(F.sort_array("variants"), ",")),
        violations(shown, "unscoped", F.coalesce(F.col("position"), F.lit("")) == "", F.lit(""), F.col("variant")),
    )


def modules_of_variants(declared: DataFrame, shown: DataFrame) -> DataFrame:
    """declared: variant, modules, distinctive (arrays); shown: variant, module. All of a variant's modules are shown, and one of those that tell it from others."""
    have = shown.groupBy("variant").agg(F.collect_set("module").alias("have"))
    x = declared.join(have, "variant", "left").withColumn("have", F.coalesce("have", F.array().cast("array<string>")))
    x = x.withColumn("gone", F.array_sort(F.array_except("modules", "have"))).withColumn("variants", F.count(F.lit(1)).over(Window.partitionBy()))  # a row a variant
    told = (F.col("variants") > 1) & (F.size("distinctive") > 0) & (F.size(F.array_intersect("distinctive", "have")) == 0)
    return all_violations(
        violations(x, "modules", F.size("gone") > 0, F.col("variant"), F.array_join("gone", ",")),
        violations(x, "distinctive", told, F.col("variant"), F.lit("none shown")),
    )


def stage_composition(stages: DataFrame, vocabulary: DataFrame, low: int = 5, high: int = 8, thin: float = 0.02) -> DataFrame:
    """Warnings about stages (position, module, duration) by a vocabulary (name, block, canonical: null for canonical names).

    Deprecated names, positions with fewer or more modules than wanted, and modules of less than 2 % of their block, blocks
    for all positions left out.
    """
    rows = stages.where(F.col("position").rlike(r"^\d+$") & (F.coalesce(F.col("module"), F.lit("")) != ""))
    x = rows.join(vocabulary.withColumnRenamed("name", "module"), "module", "left")
    old = x.where("canonical is not null").select("module", "canonical").distinct()
    n = rows.groupBy("position").agg(F.count(F.lit(1)).alias("n"))
    b = x.where("block is not null").groupBy("position", "block").agg(F.sum(F.coalesce("duration", F.lit(0.0))).alias("total"))
    small = x.where("block is not null and block not in ('cross_block', 'communication')").join(b, ["position", "block"]).where("total > 0")
    return all_violations(
        violations(old, "deprecated", F.lit(True), F.col("module"), F.col("canonical")),
        violations(n, "stages_per_position", ~F.col("n").between(low, high), F.col("position"), F.col("n")),
        violations(small, "thin", F.coalesce("duration", F.lit(0.0)) / F.col("total") < thin, F.concat_ws("@", "module", "position"), F.round(F.coalesce("duration", F.lit(0.0)) / F.col("total") * 100, 3)),
    )


def vocabulary_frame(spark: SparkSession, data: dict) -> DataFrame:
    """name, block, canonical: the names of a vocabulary by block, with their deprecated spellings, whose canonical name is told; the first place of a name counts."""
    rows: dict[str, tuple] = {}
    items = [(b, s) for b, body in (data.get("blocks") or {}).items() if isinstance(body, dict) for s in body.get("stages") or []]
    items += [(g, s) for g in ("cross_block", "communication") for s in data.get(g) or []]
    for block, s in items:
        if isinstance(s, dict) and s.get("name"):
            rows[str(s["name"])] = (str(s["name"]), str(block), None)
            for alias in s.get("deprecated_aliases") or []:
                rows.setdefault(str(alias), (str(alias), str(block), str(s["name"])))
    return spark.createDataFrame(list(rows.values()), "name string, block string, canonical string")


def frontend(summary: DataFrame, operators: DataFrame, stages: DataFrame, units: DataFrame, key: str = "package") -> DataFrame:
    """What a document owes its view. summary: key, schema, operator_count, devices, samples, heterogeneous, variants (array),
    duration_label; operators: key, category, position, unit, variant; stages: the same without category; units: key, ord, position, variant."""
    k = F.col(key)
    filled = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    variants = lambda df, n: df.where(filled("variant")).groupBy(key).agg(F.array_sort(F.collect_set("variant")).alias(n))
    count = lambda df, n, bad: df.groupBy(key).agg(F.count(F.lit(1)).alias(n), F.count_if(bad).alias(f"{n}_bad"))
    unscoped = F.col("position").isNull() | ~filled("unit")
    x = summary.join(operators.groupBy(key).agg(F.count(F.lit(1)).alias("ops"), F.count_if(~F.col("category").isin("core", "communication", "auxiliary")).alias("odd"), F.count_if(unscoped).alias("ops_bad")), key, "left")
    x = x.join(variants(operators, "vo"), key, "left").join(count(stages, "st", unscoped), key, "left").join(variants(stages, "vs"), key, "left")
    roll = stages.groupBy(key).agg(F.bool_and(F.coalesce(F.col("unit") == "__pattern_total__", F.lit(False)) & F.col("position").isNull() & ~filled("variant")).alias("rollup"))
    x = x.join(roll, key, "left").join(units.groupBy(key).agg(F.count(F.lit(1)).alias("un"), F.bool_and(F.col("position") == F.col("ord")).alias("in_order")), key, "left").join(variants(units, "vu"), key, "left")
    none = F.array().cast("array<string>")
    v, vo, vs, vu = (F.coalesce(c, none) for c in (F.array_sort("variants"), F.col("vo"), F.col("vs"), F.col("vu")))
    hetero = x.where(F.coalesce("heterogeneous", F.lit(False)))
    return all_violations(
        violations(x, "schema", (F.coalesce("schema", F.lit("")) != "1.0") | F.coalesce(F.col("ops") == 0, F.lit(True)), k, F.col("schema")),
        violations(x, "category", F.coalesce("odd", F.lit(0)) > 0, k, F.col("odd")),
        violations(x, "operator_count", ~F.col("operator_count").eqNullSafe(F.col("ops")), k, F.col("operator_count")),
        violations(x, "scope", (F.coalesce(F.size("devices"), F.lit(0)) < 1) | (F.coalesce("samples", F.lit(0)) < 1), k, F.col("samples")),
        violations(hetero, "variants", (F.size(v) < 2) | (v != vo), k, F.array_join(vo, ",")),
        violations(hetero, "unscoped", F.coalesce("ops_bad", F.lit(0)) > 0, k, F.col("ops_bad")),
        violations(hetero, "stages", ~F.coalesce("rollup", F.lit(False)) & ((vs != v) | (F.coalesce("st_bad", F.lit(0)) > 0)), k, F.array_join(vs, ",")),
        violations(hetero, "units", (F.coalesce("un", F.lit(0)) < 2) | (vu != v), k, F.array_join(vu, ",")),
        violations(hetero, "unit_order", ~F.coalesce("in_order", F.lit(True)), k, F.lit("")),
    )


def fingerprints(told: DataFrame, found: DataFrame, key: str = "path") -> DataFrame:
    """told and found: key, size, sha256. A file that is there has to be the one that was told of."""
    x = told.join(found.withColumnsRenamed({"size": "size2", "sha256": "sha2"}), key)
    return violations(x, "fingerprint", ~(F.col("size").eqNullSafe(F.col("size2")) & F.col("sha256").eqNullSafe(F.col("sha2"))), F.col(key), F.col("size2"))


def report_drift(report: DataFrame, skeleton: DataFrame, hole: str, longest: int) -> DataFrame:
    """report and skeleton: line, text. Lines that were generated have to be as they would be again; lines that hold the hole are free, but no longer than longest characters (markup left out)."""
    x = skeleton.withColumnRenamed("text", "wanted").join(report, "line", "full")
    free = F.coalesce(F.col("wanted").contains(hole), F.lit(False))
    size = F.length(F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "<[^>]*>", ""), r"\s+", ""))
    return all_violations(
        violations(x, "drift", ~free & ~F.col("text").eqNullSafe(F.col("wanted")), F.col("line"), F.coalesce("text", F.lit("-"))),
        violations(x, "too_long", free & (size > longest), F.col("line"), size),
    )
