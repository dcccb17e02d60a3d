"""Checks of derived tables and pipeline tables, each a row of (check_id, n_rows, n_violations)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanespan.operators.checks import all_of, check

SUM_TOLERANCE, CLOSURE = 0.01, 0.005


def derived_tables(t: dict[str, DataFrame]) -> DataFrame:
    """Totals are there once a region and equal the sums; classes agree with the overview; core and auxiliary rows are rows of it; modules add up."""
    over, classes = t["overview"], t["classes"]
    rows = over.where("kind = 'row'")
    out = []
    for name, column in (("overview", "duration"), ("core", "duration"), ("auxiliary", "duration"), ("stages", "module_us")):
        x = t[name].groupBy("region").agg(F.count_if(F.col("kind") == "total").alias("k"), F.sum(F.when(F.col("kind") == "total", F.col(column))).alias("t"), F.sum(F.when(F.col("kind") == "row", F.col(column)).otherwise(0.0)).alias("s"))
        out.append(check(f"{name}_total", x, (F.col("k") != 1) | (F.abs(F.col("t") - F.col("s")) > SUM_TOLERANCE)))
    own = rows.groupBy("region", "category").agg(F.count(F.lit(1)).alias("own_n"), F.sum("duration").alias("own_d"))
    x = classes.where("category <> 'total'").join(own, ["region", "category"], "left").na.fill(0, ["own_n", "own_d"])
    out.append(check("classes_agree", x, (F.col("n") != F.col("own_n")) | (F.abs(F.col("duration") - F.col("own_d")) > SUM_TOLERANCE)))
    key = ["region", "module", "operator", "duration"]
    for name in ("core", "auxiliary"):
        a = t[name].where("kind = 'row'").groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
        b = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("m"))
        out.append(check(f"{name}_rows_of_overview", a.join(b, key, "left"), F.coalesce(F.col("n") > F.col("m"), F.lit(True))))
    modules = t["stages"].where("kind = 'row'").groupBy("region", "functional_module").agg(F.sum("module_us").alias("s"))
    pattern = t["stages"].where("kind = 'pattern'").select("region", "functional_module", "module_us")
    out.append(check("pattern_rows_close", pattern.join(modules, ["region", "functional_module"], "full"), F.coalesce(F.abs(F.col("s") - F.col("module_us")) > SUM_TOLERANCE, F.lit(True))))
    return all_of(*out)


def pipeline_table(table: DataFrame) -> DataFrame:
    """One step row a device; parts add up to the step within half a percent; no negative times."""
    x = table.groupBy("device").agg(F.count_if(F.col("part") == "step").alias("k"), F.sum(F.when(F.col("part") == "step", F.col("mean_us"))).alias("step"), F.sum(F.when(F.col("part") != "step", F.col("mean_us")).otherwise(0.0)).alias("parts"))
    return all_of(check("one_step_row", x, F.col("k") != 1), check("parts_close", x, F.abs(F.col("parts") - F.col("step")) > F.col("step") * CLOSURE), check("no_negative_time", table, F.col("min_us") < 0))


def unit_attribution(rows: DataFrame) -> DataFrame:
    """No operator is longer than its unit, and no position of a variant has a number of operators more than 15 % off the others."""
    n = rows.groupBy("region", "unit_variant", "unit_position").agg(F.count(F.lit(1)).alias("n")).groupBy("region", "unit_variant").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    return all_of(check("operator_within_unit", rows, F.col("duration") > F.col("unit_us") * 1.001), check("positions_alike", n, (F.col("hi") - F.col("lo")) > F.col("hi") * 0.15))


def efficiency(rows: DataFrame) -> DataFrame:
    """mfu and mbu within 0 and 100, and a shape wherever there is one of them."""
    beyond = [F.coalesce((F.col(c) < 0) | (F.col(c) > 100), F.lit(False)) for c in ("mfu", "mbu")]
    return all_of(check("efficiency_bounds", rows, beyond[0] | beyond[1]), check("shape_for_efficiency", rows, F.col("shape").isNull() & (F.col("mfu").isNotNull() | F.col("mbu").isNotNull())))
