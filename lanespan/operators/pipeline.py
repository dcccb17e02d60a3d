"""The forward pipeline of a kernel capture: marker choice, steps, layers by variant, gaps, and the table of their times.

Decisions (which marker, which device) are one-row results of aggregates; everything else is one plan for all devices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanespan.functions.rules import like_any_case
from lanespan.operators import intervals as I
from lanespan.operators import segments as S

TIERS = [0.05, 0.20, 0.40]
GAP_NS, MOST_STEPS = 50_000, 40
ORDER = ["s", "e", "name"]


def variant_of(variants: dict[str, str]) -> Column:
    """Label of the first variant whose needle is in the name, in their order; null for other kernels."""
    chain = None
    for label, needle in variants.items():
        hit = like_any_case("name", needle)
        chain = F.when(hit, label) if chain is None else chain.when(hit, label)
    return chain if chain is not None else F.lit(None).cast("string")


def unit_cycles(kernels: DataFrame, variants: dict[str, str], ratio: dict[str, int]) -> DataFrame:
    """device, cycles: repeating units in the capture, by the variant that shows the fewest against its number in a unit."""
    n = kernels.withColumn("variant", variant_of(variants)).where("variant is not null").groupBy("device", "variant").agg(F.count(F.lit(1)).alias("n"))
    per = F.create_map(*[x for k, v in ratio.items() for x in (F.lit(k), F.lit(v))])
    return n.groupBy("device").agg(F.min(F.expr("n") / per[F.col("variant")]).alias("cycles"))


def markers(kernels: DataFrame, avoid: DataFrame | None = None, tiers: list[float] = TIERS, agree: int = 3, cell: int | float | None = None) -> DataFrame:
    """device, marker, launches, tier: of the kernels that start at even distances the first, among those whose count most of them share.

    avoid (device, cycles): a count within a tenth of the cycles marks repeating units, not steps, and is passed over.
    """
    cv = S.gap_cv(kernels.withColumn("id", F.col("e")), ["device", "name"], cell=cell)
    if avoid is not None:
        cv = cv.join(avoid, "device", "left").where("cycles is null or abs(launches - cycles) > 0.1 * cycles").drop("cycles")
    best = S.consensus(cv, ["device"], tiers, agree)
    first = kernels.groupBy("device", "name").agg(F.min("s").alias("at"))
    limit = F.element_at(F.array(*[F.lit(t) for t in tiers]), (F.col("tier") + 1).cast("int"))
    fit = cv.join(best.select("device", "launches", "tier"), ["device", "launches"]).where(F.col("cv") <= limit).join(first, ["device", "name"])
    pick = fit.groupBy("device", "launches", "tier").agg(F.min(F.struct("at", "name")).alias("x"))
    return pick.select("device", F.col("x.name").alias("marker"), "launches", "tier")


def step_parts(kernels: DataFrame, marker: DataFrame, variants: dict[str, str], gap_ns: int = GAP_NS, most: int = MOST_STEPS, cell: int | float | None = None) -> DataFrame:
    """device, step, a, b, part, n, time: for each sampled step the layers of each variant, what is in none (other), and wide gaps; the times add up to b - a.

    Kernels before a core belong to its layer. A layer ends where the next begins, less the wide gaps in it.
    """
    # One row a device is sent to the kernels: dealt by device, all that follows would stay with one task for each.
    rows = kernels.join(F.broadcast(marker.select("device", "marker")), "device").withColumn("id", F.col("e"))
    rows = S.middle_of(S.in_steps(rows, F.col("name") == F.col("marker"), ["device"], ORDER, cell or I.cell_of(kernels, ["device"], "s")), "device", most)
    w = Window.partitionBy("device", "step").orderBy(*ORDER)
    behind = w.rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("device", "step").orderBy(*map(F.desc, ORDER)).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("variant", variant_of(variants))
    core = F.when(F.col("variant").isNotNull(), F.struct("s", "e", "variant"))
    rows = rows.withColumns({"owner": F.last(core, True).over(ahead), "reach": F.max("e").over(behind), "next": F.coalesce(F.lead("s").over(w), F.col("b"))})
    rows = rows.withColumn("part", F.coalesce("owner.variant", F.lit("other")))
    # From a kernel's start to the next one's: busy up to the furthest end so far, idle beyond; wide idle is gap.
    idle = F.greatest(F.lit(0), F.col("next") - F.greatest(F.col("e"), F.coalesce("reach", "e"), F.col("s")))
    rows = rows.withColumn("gap", F.when(idle > gap_ns, idle).otherwise(0))
    rows = rows.withColumn("time", F.col("next") - F.col("s") - F.col("gap"))
    parts = rows.groupBy("device", "step", "a", "b", "part").agg(F.count("variant").alias("n"), F.sum("time").alias("time"))
    gaps = rows.groupBy("device", "step", "a", "b").agg(F.lit("gap").alias("part"), F.count_if(F.col("gap") > 0).alias("n"), F.sum("gap").alias("time"))
    return parts.unionByName(gaps)


def table(parts: DataFrame, variants: dict[str, str]) -> DataFrame:
    """device, ord, part, layers, mean_us, min_us, max_us, pct_of_step, samples: one row for the step, each variant, other and gap.

    Times are means over the sampled steps, so that they add up; layers are the most in a step.
    """
    order = [*variants, "other", "gap"]
    steps = parts.select("device", "step", "a", "b").distinct()
    whole = steps.groupBy("device").agg(F.count(F.lit(1)).alias("samples"), F.avg(F.col("b") - F.col("a")).alias("step"), F.min(F.col("b") - F.col("a")).alias("lo"), F.max(F.col("b") - F.col("a")).alias("hi"))
    g = parts.groupBy("device", "part").agg(F.max("n").alias("layers"), F.sum("time").alias("total"), F.min("time").alias("lo"), F.max("time").alias("hi"), F.count(F.lit(1)).alias("there"))
    g = g.join(whole.select("device", "samples", "step"), "device")
    lowest = F.when(F.col("there") < F.col("samples"), 0).otherwise(F.col("lo"))  # a part that a step lacks takes no time there
    rank = F.array_position(F.array(*[F.lit(p) for p in order]), F.col("part"))
    us = lambda c: c / 1000.0
    rows = g.select("device", rank.cast("long").alias("ord"), "part", "layers", us(F.col("total") / F.col("samples")).alias("mean_us"), us(lowest).alias("min_us"), us(F.col("hi")).alias("max_us"), (F.col("total") / F.col("samples") / F.col("step") * 100).alias("pct_of_step"), "samples")
    top = whole.select("device", F.lit(0).cast("long").alias("ord"), F.lit("step").alias("part"), F.lit(None).cast("long").alias("layers"), us(F.col("step")).alias("mean_us"), us(F.col("lo")).alias("min_us"), us(F.col("hi")).alias("max_us"), F.lit(100.0).alias("pct_of_step"), "samples")
    return top.unionByName(rows)


def forward_pipeline(kernels: DataFrame, variants: dict[str, str], ratio: dict[str, int] | None = None, marker: str | None = None, gap_ns: int = GAP_NS, most: int = MOST_STEPS) -> DataFrame:
    """The table for all devices. A named marker is taken as it is; else one is chosen, and with a ratio of variants per unit those that mark units are refused."""
    cell = I.cell_of(kernels, ["device"], "s")
    if marker:
        chosen = kernels.select("device").distinct().withColumn("marker", F.lit(marker))
    else:
        chosen = markers(kernels, unit_cycles(kernels, variants, ratio) if ratio else None, cell=cell)
    return table(step_parts(kernels, chosen, variants, gap_ns, most, cell), variants)


def degraded(kernels: DataFrame) -> DataFrame:
    """device, name, span_us, steps, step_us where no marker is found: the span by the count of the most even kernel; steps null if there is none."""
    span = kernels.groupBy("device").agg(((F.max("e") - F.min("s")) / 1000.0).alias("span_us"))
    rows = kernels if "id" in kernels.columns else kernels.withColumn("id", F.col("e"))
    even = S.gap_cv(rows, ["device", "name"]).groupBy("device").agg(F.min(F.struct("cv", "name", "launches")).alias("x"))
    return span.join(even, "device", "left").select("device", "x.name", "span_us", F.col("x.launches").alias("steps"), (F.col("span_us") / F.col("x.launches")).alias("step_us"))


def device_ranking(kernels: DataFrame, variants: dict[str, str], ratio: dict[str, int]) -> DataFrame:
    """device, deviation, launches, rank: by how far the mix of variants is from the declared one, then the busiest."""
    total = sum(ratio.values())
    x = kernels.withColumn("variant", variant_of(variants))
    n = x.groupBy("device").agg(F.count(F.lit(1)).alias("launches"), F.count("variant").alias("cores"), *[F.count_if(F.col("variant") == v).alias(f"n_{i}") for i, v in enumerate(ratio)])
    off = sum((F.abs(F.col(f"n_{i}") / F.col("cores") - k / total) for i, k in enumerate(ratio.values())), F.lit(0.0))
    n = n.withColumn("deviation", F.when(F.col("cores") > 0, F.round(off, 3)).otherwise(F.lit(2.0)))
    return n.select("device", "deviation", "launches", F.row_number().over(Window.orderBy("deviation", F.desc("launches"), "device")).alias("rank"))


def second_forward(kernels: DataFrame, marker: DataFrame, times: int = 2, least: float = 0.5, spread: float = 0.05) -> DataFrame:
    """device, name, offset: kernels that start `times` in every step and whose second start lies past `least` of the step, always at about the same place."""
    rows = S.in_steps(kernels.withColumn("id", F.col("e")).join(F.broadcast(marker.select("device", "marker")), "device"), F.col("name") == F.col("marker"), ["device"], ORDER, I.cell_of(kernels, ["device"], "s"))
    g, steps = second_launches(rows, times), rows.groupBy("device").agg(F.countDistinct("step").alias("steps"))
    g = g.groupBy("device", "name").agg(F.count(F.lit(1)).alias("seen"), F.avg("x").alias("offset"), (F.max("x") - F.min("x")).alias("spread")).join(steps, "device")
    return g.where((F.col("seen") == F.col("steps")) & (F.col("offset") > least) & (F.col("spread") <= spread)).select("device", "name", "offset")


def second_launches(rows: DataFrame, times: int | None = None) -> DataFrame:
    """device, step, name, x: where in its step (from 0 to 1) a kernel starts for the second time; with times only kernels that start so often in it. rows: what in_steps() gives."""
    by = Window.partitionBy("device", "step", "name")
    k = rows.withColumns({"k": F.row_number().over(by.orderBy("s", "id")), "n": F.count(F.lit(1)).over(by)})
    second = k.where("k = 2" + (f" and n = {times}" if times else ""))
    return second.select("device", "step", "name", ((F.col("s") - F.col("a")) / (F.col("b") - F.col("a"))).alias("x"))


def wide_holes(kernels: DataFrame, gap_ns: int = GAP_NS) -> DataFrame:
    return I.holes(kernels.select("device", "s", "e"), ["device"]).where(F.col("hole_end") - F.col("hole_start") > gap_ns)
