"""Phases of a forward step: draft and target, their layers, and checks of what was declared against what a capture shows.

Rows are kernels within steps (device, step, a, b, name, s, e, id), as segments.in_steps gives them. A step fits a task;
captures of any number of steps and devices are computed at once, and decisions are one row a device.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanespan.operators.segments import numbered

STEP = ["device", "step"]
ORDER = ["s", "e", "id"]

# Kernels of the scheduler, which are launched for each request.
SCHEDULER = r"alloc_extend|assign_extend|assign_req_to_token_pool|extend_cache_locs"


def any_of(needles: list[str], name: str = "name") -> Column:
    """True where the name holds one of the needles."""
    out = F.lit(False)
    for n in filter(None, needles):
        out = out | F.col(name).contains(n)
    return out


def variant_rank(variants: dict[str, list[str]], name: str = "name") -> Column:
    """Place, from 0, of the first variant that has a needle in the name; null for other kernels."""
    out = F.lit(None).cast("int")
    for i, needles in reversed(list(enumerate(variants.values()))):
        out = F.when(any_of(needles, name), i).otherwise(out)
    return out


def variant_at(variants: dict[str, list[str]], rank: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in variants]), rank)


def marker_split(markers: DataFrame) -> DataFrame:
    """device, launches, grids, speculative, draft_grid, target_grid, batch, tokens, target_graph, draft_graph.

    markers: device, s, grid, graph. Two grids that come again in one fixed order, the larger once in it, are drafts and
    a target; their difference is the batch if it divides the draft's grid. Any other mixture follows the tokens of each
    step, and is one population. A population's graph is the one most of its launches have, the first on ties.
    """
    n = markers.groupBy("device").agg(F.count(F.lit(1)).alias("launches"), F.countDistinct("grid").cast("long").alias("grids"), F.min("grid").alias("low"), F.max("grid").alias("high"))
    two = n.where("grids = 2").join(markers.groupBy("device", "grid").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("grid", "high"), ["device", "high"])
    two = two.where("launches % n = 0").select("device", "high", F.expr("launches div n").alias("period"))
    at = numbered(markers, ["device"], ["s", "grid", "graph"], "i").join(two, "device").withColumn("at", F.col("i") % F.col("period"))
    same = at.groupBy("device", "at").agg((F.min("grid") == F.max("grid")).alias("one"), (F.max("grid") == F.first("high")).cast("long").alias("top"))
    same = same.groupBy("device").agg((F.bool_and("one") & (F.sum("top") == 1)).alias("speculative"))
    out = n.join(same, "device", "left").withColumn("speculative", F.coalesce("speculative", F.lit(False)))
    group = F.when(F.col("speculative"), F.col("grid"))
    graphs = markers.join(out.select("device", "speculative"), "device").groupBy("device", group.alias("grid"), "graph").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("first"))
    graphs = graphs.groupBy("device", "grid").agg(F.max_by("graph", F.struct("n", -F.col("first"))).alias("graph"))
    by = graphs.groupBy("device").agg(F.min_by("graph", F.coalesce("grid", F.lit(0))).alias("lower"), F.max_by("graph", F.coalesce("grid", F.lit(0))).alias("upper"))
    size = F.col("high") - F.col("low")
    batch = F.when(F.col("speculative") & (F.col("low") % size == 0), size)
    tokens = F.when(~F.col("speculative"), F.lit(0)).when(batch.isNotNull(), F.floor(F.col("low") / F.nullif(size, F.lit(0))))
    target = F.when(F.col("speculative") | (F.col("grids") == 1), F.col("high"))
    return out.join(by, "device").select("device", "launches", "grids", "speculative", F.when(F.col("speculative"), F.col("low")).alias("draft_grid"), target.alias("target_grid"), batch.alias("batch"), tokens.alias("tokens"), F.col("upper").alias("target_graph"), F.when(F.col("speculative"), F.col("lower")).alias("draft_graph"))


def dominant_grids(kernels: DataFrame) -> DataFrame:
    """device, name, grid, n: the grid that most launches of a kernel have, the smallest on ties. kernels: device, name, grid_x, grid_y, grid_z."""
    n = kernels.groupBy("device", "name", F.struct("grid_x", "grid_y", "grid_z").alias("grid")).agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy("device", "name").agg(F.min(F.struct((-F.col("n")).alias("neg"), "grid")).alias("x"))
    return best.select("device", "name", "x.grid", (-F.col("x.neg")).alias("n"))


def eager_batch(kernels: DataFrame, steps: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """device, batch, axis, agreeing: the batch that kernels outside of graphs show.

    Kernels whose main grid is launched about once a step count (within the tolerance). The axis is the first in which all
    of the scheduler's agree, of which there have to be two, and the batch is its value. kernels has graph; steps: device, steps.
    """
    grids = dominant_grids(kernels.where("graph is null")).join(steps, "device")
    band = F.greatest(F.lit(1), F.bround(F.col("steps") * tolerance))
    some = grids.where((F.col("steps") > 0) & (F.abs(F.col("n") - F.col("steps")) <= band))
    axes = F.explode(F.array(*[F.struct(F.lit(i).alias("axis"), F.col(f"grid.grid_{x}").alias("value")) for i, x in enumerate("xyz")]))
    each = some.select("device", "name", axes.alias("x")).select("device", "name", "x.axis", "x.value")
    own = each.where(F.col("name").rlike(SCHEDULER)).groupBy("device", "axis").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("value"), F.max("value").alias("high"))
    pick = own.where("n >= 2 and value = high").groupBy("device").agg(F.min(F.struct("axis", "value")).alias("x")).select("device", "x.axis", "x.value")
    n = each.join(pick, ["device", "axis", "value"]).groupBy("device", "axis", "value").agg(F.count(F.lit(1)).alias("agreeing")).where("agreeing >= 2")
    return n.select("device", F.col("value").alias("batch"), "axis", "agreeing")


def eager_drafts(rows: DataFrame, forwards: int = 2, agree: int = 2, least: float = 0.5, spread: float = 0.05) -> DataFrame:
    """device, step, draft_start, agreeing, offset: where the second forward of each step begins.

    Kernels launched `forwards` times in every step tell: those whose second launch lies, on the mean, past `least` of the
    step. At least `agree` of them have to, at means no more than spread apart; the earliest of them opens the draft.
    Devices of fewer than two steps, and those where kernels do not agree, have no rows.
    """
    steps = rows.select(*STEP).distinct().groupBy("device").agg(F.count(F.lit(1)).alias("steps")).where("steps >= 2")
    start = F.max("s") if forwards == 2 else F.get(F.sort_array(F.collect_list("s")), F.lit(1))  # a list of each kernel's starts is only made where it has to be
    second = rows.groupBy(*STEP, "name", "a", "b").agg(F.count(F.lit(1)).alias("n"), start.alias("second")).where(f"n = {forwards}")
    second = second.withColumn("x", (F.col("second") - F.col("a")) / (F.col("b") - F.col("a")))
    whole = second.groupBy("device", "name").agg(F.count(F.lit(1)).alias("seen"), F.avg("x").alias("offset")).join(F.broadcast(steps), "device").where(f"seen = steps and offset > {least}")
    fit = whole.groupBy("device").agg(F.count(F.lit(1)).alias("agreeing"), F.avg("offset").alias("mean"), (F.max("offset") - F.min("offset")).alias("apart")).where(f"agreeing >= {agree} and apart <= {spread}")
    # Devices and their kernels' names are few. Dealt by them, all steps of a device would be one task's.
    found = second.join(F.broadcast(whole.select("device", "name").join(F.broadcast(fit), "device")), ["device", "name"])
    return found.groupBy(*STEP).agg(F.min("second").alias("draft_start"), F.first("agreeing").alias("agreeing"), F.first("mean").alias("offset"))


def tail_drafts(rows: DataFrame, boundary: Column, layers: int) -> DataFrame:
    """device, step, draft_start: the last `layers` boundaries of each step begin its draft. A device with a step of no more boundaries has no rows."""
    back = F.row_number().over(Window.partitionBy(*STEP).orderBy(F.desc("s"), F.desc("id")))
    own = rows.where(boundary).withColumn("back", back)
    enough = rows.groupBy(*STEP).agg(F.count_if(boundary).alias("n")).groupBy("device").agg(F.min("n").alias("least")).where(F.col("least") > layers).select("device")
    return own.where(F.col("back") == layers).join(enough, "device").select(*STEP, F.col("s").alias("draft_start"))


def blocks(rows: DataFrame, boundary: Column, variants: dict[str, list[str]], lo: str = "a", gap: int | None = None) -> DataFrame:
    """device, step, block, lo, hi, rank: the stretches between layer boundaries, with the end of their busy time and the first variant found in them.

    What stands before the first boundary is a block from the column lo on, if it holds a variant's core. A block's time
    ends before its first hole wider than gap.
    """
    w = Window.partitionBy(*STEP).orderBy(*ORDER)
    x = rows.withColumns({"block": F.sum(boundary.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)), "rank": variant_rank(variants)})
    x = x.withColumn("marks", F.max("block").over(Window.partitionBy(*STEP))).where("marks > 0")
    in_block = Window.partitionBy(*STEP, "block").orderBy(*ORDER)
    if gap is not None:
        reach = F.max("e").over(in_block.rowsBetween(Window.unboundedPreceding, -1))
        wide = F.coalesce((F.col("s") - reach > gap).cast("int"), F.lit(0))
        x = x.withColumn("wide", wide).withColumn("after", F.sum("wide").over(in_block.rowsBetween(Window.unboundedPreceding, 0)))
    end = F.max(F.when(F.col("after") == 0, F.col("e"))) if gap is not None else F.max("e")
    out = x.groupBy(*STEP, "block").agg(F.min(F.when(F.col("block") > 0, F.col("s")).otherwise(F.col(lo))).alias("lo"), end.alias("hi"), F.min("rank").alias("rank"))
    return out.where("block > 0 or rank is not null")


def layers(rows: DataFrame, boundary: Column, variants: dict[str, list[str]], lo: str = "a", gap: int | None = None, most: int | None = None) -> DataFrame:
    """device, step, layer, variant, lo, hi: the layers of a phase.

    A block without a core belongs to the layer whose core comes next, so a boundary may fire more than once a layer; blocks
    after the last core belong to none. Of more layers than `most` the last ones stay.
    """
    w = Window.partitionBy(*STEP).orderBy("block")
    b = blocks(rows, boundary, variants, lo, gap).withColumn("layer", F.coalesce(F.sum(F.col("rank").isNotNull().cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = b.groupBy(*STEP, "layer").agg(F.min("lo").alias("lo"), F.max(F.when(F.col("rank").isNotNull(), F.col("hi"))).alias("hi"), F.max("rank").alias("rank")).where("rank is not null")
    if most is not None:
        n = F.count(F.lit(1)).over(Window.partitionBy(*STEP))
        out = out.withColumn("n", n).where(F.col("layer") >= F.col("n") - most).withColumn("layer", F.row_number().over(Window.partitionBy(*STEP).orderBy("layer")) - 1)
    return out.select(*STEP, F.col("layer").cast("long").alias("layer"), variant_at(variants, F.col("rank")).alias("variant"), "lo", "hi")


def last_layer_ends(rows: DataFrame, boundary: Column, variants: dict[str, list[str]]) -> DataFrame:
    """device, step, end: where the last block with a core ends, which is where a forward ends that no graph delimits."""
    b = blocks(rows, boundary, variants).where("rank is not null and block > 0")
    return b.groupBy(*STEP).agg(F.max_by("hi", "block").alias("end"))


def repeated_cores(rows: DataFrame, end: str = "b") -> DataFrame:
    """device, step, core, layers, last, stride, forward_end: the kernel that repeats and takes most time, and the end of the forward it belongs to, one median distance after its last start."""
    w = Window.partitionBy(*STEP, "name").orderBy(*ORDER)
    x = rows.withColumn("stride", F.col("s") - F.lag("s").over(w))
    n = x.groupBy(*STEP, "name").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("e") - F.col("s")).alias("time"), F.max("s").alias("last"), F.median("stride").alias("stride"), F.min("s").alias("first"), F.max(end).alias("end")).where("n > 1")
    best = n.groupBy(*STEP).agg(F.max(F.struct("time", (-F.col("first")).alias("early"), "name", "n", "last", "stride", "end")).alias("x"))
    return best.select(*STEP, F.col("x.name").alias("core"), F.col("x.n").alias("layers"), F.col("x.last").alias("last"), F.col("x.stride").alias("stride"), F.least(F.col("x.last") + F.col("x.stride"), F.col("x.end")).alias("forward_end"))


def phases(steps: DataFrame) -> DataFrame:
    """device, step, period, target, prep_draft, draft, prep_verify out of steps (device, step, a, b, target_end, draft_start, draft_end).

    Without a draft all after the target is prep_draft. Steps whose target end is unknown, and those whose bounds are out
    of order, are left out.
    """
    spec = F.col("draft_start").isNotNull() & F.col("draft_end").isNotNull()
    good = F.when(spec, (F.col("a") <= F.col("target_end")) & (F.col("target_end") <= F.col("draft_start")) & (F.col("draft_start") <= F.col("draft_end")) & (F.col("draft_end") <= F.col("b"))).otherwise(F.col("a") <= F.col("target_end"))
    x = steps.where(F.col("target_end").isNotNull() & good)
    return x.select(
        *STEP, (F.col("b") - F.col("a")).alias("period"), (F.col("target_end") - F.col("a")).alias("target"),
        F.when(spec, F.col("draft_start") - F.col("target_end")).otherwise(F.col("b") - F.col("target_end")).alias("prep_draft"),
        F.when(spec, F.col("draft_end") - F.col("draft_start")).alias("draft"), F.when(spec, F.col("b") - F.col("draft_end")).alias("prep_verify"),
    )


def graph_bounds(rows: DataFrame, split: DataFrame) -> DataFrame:
    """device, step, a, b, target_end, draft_start, draft_end by the graphs of marker_split; rows have graph."""
    x = rows.join(split.select("device", "speculative", "target_graph", "draft_graph"), "device")
    own, draft = F.col("graph") == F.col("target_graph"), F.col("speculative") & (F.col("graph") == F.col("draft_graph"))
    return x.groupBy(*STEP, "a", "b").agg(F.max(F.when(own, F.col("e"))).alias("target_end"), F.min(F.when(draft, F.col("s"))).alias("draft_start"), F.max(F.when(draft, F.col("e"))).alias("draft_end"))


def marker_counts(rows: DataFrame, markers: dict[str, list[str]]) -> DataFrame:
    """device, step, marker, n: launches of each marker in each step, none included."""
    one = F.explode(F.array(*[F.struct(F.lit(m).alias("marker"), F.col(f"__{i}").alias("n")) for i, m in enumerate(markers)]))
    n = rows.groupBy(*STEP).agg(*[F.count_if(any_of(v)).alias(f"__{i}") for i, v in enumerate(markers.values())])
    return n.select(*STEP, one.alias("x")).select(*STEP, "x.marker", "x.n")


def once_per_layer(rows: DataFrame, expected: int, most: int = 10) -> DataFrame:
    """device, names: the first kernels by name that are launched exactly `expected` times in every step. They are suggestions."""
    steps = rows.groupBy("device").agg(F.countDistinct("step").alias("steps"))
    n = rows.groupBy(*STEP, "name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == expected)
    good = n.groupBy("device", "name").agg(F.count(F.lit(1)).alias("seen")).join(steps, "device").where("seen = steps")
    good = good.withColumn("k", F.row_number().over(Window.partitionBy("device").orderBy("name"))).where(F.col("k") <= most)
    return good.groupBy("device").agg(F.sort_array(F.collect_list("name")).alias("names"))


def layer_marker_check(rows: DataFrame, marker: list[str], expected: int) -> DataFrame:
    """device, seen (distinct launches per step), ok, candidates: a layer boundary has to fire once per layer in every step; where it does not, other kernels are suggested."""
    n = marker_counts(rows, {"marker": marker}).groupBy("device").agg(F.sort_array(F.collect_set("n")).alias("seen"))
    out = n.withColumn("ok", F.col("seen") == F.array(F.lit(expected).cast("long")))
    return out.join(once_per_layer(rows, expected), "device", "left").select("device", "seen", "ok", F.when(~F.col("ok"), F.coalesce("names", F.array().cast("array<string>"))).alias("candidates"))


def variant_marker_check(rows: DataFrame, variants: dict[str, list[str]], expected: int) -> DataFrame:
    """device, marker, seen, universal: a variant's marker that fires in every layer of every step tells nothing but what is left over."""
    n = marker_counts(rows, variants)
    return n.groupBy("device", "marker").agg(F.sort_array(F.collect_set("n")).alias("seen"), (F.min("n") >= expected).alias("universal"))


def declared_layers(expected: Column, found: Column, gpus: Column) -> Column:
    """ok, a shard (1/k of the layers, as many devices as that may hold), or conflict; null where nothing is declared."""
    k = F.when(found > 0, expected / found)
    shard = (found > 0) & (expected % F.nullif(found, F.lit(0)) == 0) & (k > 1) & (k <= F.greatest(gpus, F.lit(1)))
    return F.when(expected == found, "ok").when(F.coalesce(shard, F.lit(False)), F.concat(F.lit("shard 1/"), k.cast("int").cast("string"))).when(expected.isNotNull(), "conflict")


def shard_notes(kernels: DataFrame, variants: dict[str, list[str]], gpus: int, handoff: str = "SendRecv") -> DataFrame:
    """device, handoffs, shard: hand-offs between devices tell of a split of layers unless they are as many as one variant's cores, which are exchanges within layers."""
    n = kernels.groupBy("device").agg(F.count_if(F.col("name").contains(handoff)).alias("handoffs"), *[sum((F.count_if(F.col("name").contains(x)) for x in v), F.lit(0).cast("long")).alias(f"__{i}") for i, v in enumerate(variants.values())])
    within = F.lit(False)
    for i in range(len(variants)):
        within = within | (F.col(f"__{i}") == F.col("handoffs"))
    return n.select("device", "handoffs", (F.lit(gpus > 1) & (F.col("handoffs") > 0) & ~within).alias("shard"))


def unit_check(found: DataFrame, ratio: dict[str, int], excluded: dict[str, int] | None = None) -> DataFrame:
    """device, repeats, remainder, ok: whether found layers (device, variant, n) are whole units of the ratio, a rotation of part of one, and the excluded layers.

    A remainder takes the variants in their order from any of them on.
    """
    excluded = excluded or {}
    names = list(dict.fromkeys([*ratio, *excluded]))
    unit, fixed, width = sum(ratio.values()) or 1, sum(excluded.values()), len(ratio)
    per = lambda m: F.array(*[F.lit(m.get(n, 0)) for n in names])
    n = found.where(F.col("n") > 0).groupBy("device").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("variant", "n"))).alias("m"))
    n = n.withColumn("rest", F.greatest(F.lit(0), F.col("total") - fixed)).withColumns({"repeats": F.expr(f"rest div {unit}"), "remainder": F.expr(f"rest % {unit}")})
    have = F.array(*[F.coalesce(F.try_element_at("m", F.lit(x)), F.lit(0)) for x in names])
    starts = F.when(F.col("remainder") == 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(width - 1)))
    # A variant at place p is met (remainder - first + width - 1) div width times, first being the steps from the start to it.
    place = F.array(*[F.lit(list(ratio).index(x) if x in ratio else -1) for x in names])
    own = F.arrays_zip(have.alias("have"), per(ratio).alias("unit"), per(excluded).alias("fixed"), place.alias("place"))
    extra = lambda p, s: F.when((p < 0) | (F.col("remainder") == 0), F.lit(0)).otherwise(F.floor((F.col("remainder") - F.pmod(p - s, F.lit(width)) + width - 1) / width))
    fits = lambda s: F.forall("own", lambda x: x["have"] == x["unit"] * F.col("repeats") + x["fixed"] + extra(x["place"], s))
    known = F.size(F.array_except(F.map_keys("m"), F.array(*[F.lit(x) for x in names]))) == 0
    return n.withColumn("own", own).select("device", "repeats", "remainder", (known & F.exists(starts, fits)).alias("ok"))


def walked(devices: DataFrame) -> DataFrame:
    """The first device by rank that segments without conflicts, else the first that segments: devices: device, rank, segments, conflicts."""
    best = devices.where("segments").groupBy().agg(F.min(F.struct((F.col("conflicts") > 0).alias("bad"), "rank", "device", "conflicts")).alias("x")).where("x is not null")
    return best.select("x.device", "x.rank", "x.conflicts")


def steady_pass(passes: Column) -> Column:
    """The last pass but one, the first being 0."""
    return F.greatest(F.lit(0), passes - 2)


def settled_pass(walls: DataFrame, least: int) -> DataFrame:
    """device, pass: the first pass after 0 whose first layer takes longer than least, else the third after it or the last there is. walls: device, pass, layer, wall."""
    n = walls.groupBy("device").agg((F.max("pass") + 1).alias("passes"), F.min(F.when((F.col("pass") > 0) & (F.col("layer") == 0) & (F.col("wall") > least), F.col("pass"))).alias("first"))
    return n.select("device", F.coalesce("first", F.least(F.lit(3), F.col("passes") - 1)).cast("long").alias("pass"))


#: What the rows of a tree are called that are no variant.
STEP_NAME, TARGET, DRAFT, PROLOGUE, OTHER, IDLE = "step", "target", "draft", "prologue", "other", "idle"


def slices(rows: DataFrame, drafts: DataFrame, layers_: DataFrame, gap: int) -> DataFrame:
    """device, step, a, b, phase, part, time: what each phase of a step spends before its first layer (prologue, of the target
    only), in the layers of each variant, and in none (other); wide idle time is the phase `idle`. The times of a step add up to b - a.

    rows: a step's kernels (device, step, a, b, s, e, id); drafts: device, step, draft_start; layers_: device, step, phase,
    variant, lo, hi. A kernel's time runs to the next one's start, less what is idle for longer than gap.
    """
    x = rows.join(drafts.select(*STEP, "draft_start"), STEP, "left")
    x = x.withColumn("phase", F.when(F.col("s") >= F.col("draft_start"), DRAFT).otherwise(TARGET))
    w = Window.partitionBy(*STEP).orderBy(*ORDER)
    reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.coalesce(F.lead("s").over(w), F.col("b"))
    x = x.withColumns({"next": ahead, "wait": F.greatest(F.lit(0), ahead - reach)})
    x = x.withColumn("idle", F.when(F.col("wait") > gap, F.col("wait")).otherwise(0)).withColumn("time", F.col("next") - F.col("s") - F.col("idle"))
    # Beginnings of layers are laid among the kernels; the last one before a kernel is its layer, if that has not ended.
    marks = layers_.select(*STEP, "phase", F.col("lo").alias("s"), F.lit(-1).alias("place"), F.struct("variant", "hi").alias("layer"))
    both = x.withColumn("place", F.lit(0)).unionByName(marks, allowMissingColumns=True)
    upto = Window.partitionBy(*STEP, "phase").orderBy("s", "place", "id").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("layer", F.last("layer", True).over(upto)).where("place = 0")
    early = F.col("layer").isNull() & (F.col("phase") == TARGET)
    part = F.when(F.col("s") < F.col("layer.hi"), F.col("layer.variant")).when(early, PROLOGUE).otherwise(OTHER)
    each = F.explode(F.array(F.struct("phase", part.alias("part"), "time"), F.struct(F.lit(IDLE).alias("phase"), F.lit(IDLE).alias("part"), F.col("idle").alias("time"))))
    return both.select(*STEP, "a", "b", each.alias("x")).groupBy(*STEP, "a", "b", "x.phase", "x.part").agg(F.sum("x.time").alias("time"))


def tree(parts: DataFrame, layers_: DataFrame, variants: list[str], unit: float = 1.0) -> DataFrame:
    """device, ord, parent, kind, name, layers, total_us, per_layer_us, pct_of_step, pct_of_parent, min_us, max_us, samples, note.

    The step is split into its phases and the idle time between kernels, each phase into the prologue, its variants' layers and
    what is left (other), so that the children of each row add up to it. Times are means over all steps of a device, a
    part that a step lacks being 0 there; layers are the most in a step. unit: how many units of time make a microsecond.
    """
    n = parts.select(*STEP, "a", "b").distinct().groupBy("device").agg(F.count(F.lit(1)).alias("samples"))
    own = parts.where(F.col("time") > 0)
    level = lambda x, parent, kind, name: x.groupBy(*STEP, parent.alias("parent"), kind.alias("kind"), name.alias("name")).agg(F.sum("time").alias("time"))
    idle, none = F.col("phase") == IDLE, F.lit(None).cast("string")
    kind = F.when(F.col("part") == PROLOGUE, "stage").when(F.col("part") == OTHER, "other").otherwise("variant")
    rows = level(parts, none, F.lit("total"), F.lit(STEP_NAME))
    rows = rows.unionByName(level(parts, F.lit(STEP_NAME), F.when(idle, "gap").otherwise("phase"), F.col("phase")))
    rows = rows.unionByName(level(own.where(~idle), F.col("phase"), kind, F.col("part")))
    g = rows.groupBy("device", "parent", "kind", "name").agg(F.sum("time").alias("sum"), F.min("time").alias("low"), F.max("time").alias("high"), F.count(F.lit(1)).alias("there")).join(n, "device")
    us = lambda c: c / unit
    g = g.select("device", "parent", "kind", "name", us(F.col("sum") / F.col("samples")).alias("total_us"), us(F.when(F.col("there") < F.col("samples"), 0).otherwise(F.col("low"))).alias("min_us"), us(F.col("high")).alias("max_us"), "samples")

    most = layers_.groupBy(*STEP, F.col("phase").alias("parent"), F.col("variant").alias("name")).agg(F.count(F.lit(1)).alias("n")).groupBy("device", "parent", "name").agg(F.max("n").alias("layers"))
    in_phase = most.groupBy("device", F.lit(STEP_NAME).alias("parent"), F.col("parent").alias("name")).agg(F.sum("layers").alias("layers"))
    g = g.join(most.unionByName(in_phase), ["device", "parent", "name"], "left")
    above = g.where("kind in ('total', 'phase')").select("device", F.col("name").alias("parent"), F.col("total_us").alias("above"))
    g = g.join(above, ["device", "parent"], "left").join(g.where("kind = 'total'").select("device", F.col("total_us").alias("step_us")), "device")
    order = F.when(F.col("kind") == "total", 0).when(F.col("kind") == "gap", 999)
    base = F.when(F.coalesce(F.when(F.col("kind") == "phase", F.col("name")), F.col("parent")) == TARGET, 1).otherwise(2) * 100
    within = F.when(F.col("kind") == "phase", 0).when(F.col("kind") == "stage", 1).when(F.col("kind") == "other", 99).otherwise(1 + F.array_position(F.array(*map(F.lit, variants)), F.col("name")))
    note = F.when(F.col("kind") == "gap", F.lit("idle for longer than the threshold, within steps")).otherwise(F.lit(""))
    pct = lambda c: F.when(c > 0, F.col("total_us") / c * 100)
    return g.select(
        "device", F.coalesce(order, base + within).cast("long").alias("ord"), "parent", "kind", "name", "layers", "total_us", F.when(F.col("layers") > 0, F.col("total_us") / F.col("layers")).alias("per_layer_us"),
        pct(F.col("step_us")).alias("pct_of_step"), pct(F.col("above")).alias("pct_of_parent"), "min_us", "max_us", "samples", note.alias("note"),
    )
