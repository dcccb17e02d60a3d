"""Segmentation of event sequences: anchors, blocks, passes, steps, periods and templates.

Order keys always end in a unique column, so results do not depend on how rows arrive. No lane is put in order as a whole:
rows are ordered within (lane, cell), a cell being a stretch of the first order key, and each cell hands on one row. A cell's
length comes from the rows, whatever their unit; where no lane is crowded, a lane is one cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanespan.operators.intervals import WHOLE, cell_of

ORDER = ["s", "id"]


def lane(keys: list[str], order: list[str] = ORDER):
    return Window.partitionBy(*keys).orderBy(*order)


def along(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, nexts: dict[str, Column] | None = None, befores: dict[str, Column] | None = None, cell: int | float | None = None) -> DataFrame:
    """df with running values along each lane: sums up to each row, the last value that is not null up to it (lasts) or
    before it (befores), and the first such value after it (nexts). The first order key has to be a number."""
    sums, lasts, nexts, befores = sums or {}, lasts or {}, nexts or {}, befores or {}
    at = F.struct(*order)
    cell = cell or cell_of(df, keys, order[0])
    rows = df.withColumn("__cell", F.floor(F.col(order[0]) / cell)).withColumns({f"__v_{n}": c for some in (sums, lasts, nexts, befores) for n, c in some.items()})
    w = Window.partitionBy(*keys, *(["__cell"] if cell != WHOLE else [])).orderBy(*order)
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    # What comes after is what came before in the other order: a frame that only grows is kept, one that only shrinks is made anew for each row.
    after = Window.partitionBy(*keys, *(["__cell"] if cell != WHOLE else [])).orderBy(*map(F.desc, order)).rowsBetween(Window.unboundedPreceding, -1)
    own = {f"__o_{n}": F.sum(f"__v_{n}").over(upto) for n in sums} | {f"__o_{n}": F.last(f"__v_{n}", True).over(upto) for n in lasts}
    own |= {f"__o_{n}": F.last(f"__v_{n}", True).over(after) for n in nexts} | {f"__o_{n}": F.last(f"__v_{n}", True).over(before) for n in befores}
    if cell == WHOLE:
        return rows.withColumns(own).select(*df.columns, *[F.col(f"__o_{n}").alias(n) for some in (sums, lasts, nexts, befores) for n in some])
    there = lambda n: F.when(F.col(f"__v_{n}").isNotNull(), at)
    aggs = [F.sum(f"__v_{n}").alias(n) for n in sums] + [F.max_by(f"__v_{n}", there(n)).alias(n) for n in (*lasts, *befores)] + [F.min_by(f"__v_{n}", there(n)).alias(n) for n in nexts]
    by = Window.partitionBy(*keys).orderBy("__cell")
    earlier = by.rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*keys).orderBy(F.desc("__cell")).rowsBetween(Window.unboundedPreceding, -1)
    far = [F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"__f_{n}") for n in sums] + [F.last(n, True).over(earlier).alias(f"__f_{n}") for n in (*lasts, *befores)] + [F.last(n, True).over(later).alias(f"__f_{n}") for n in nexts]
    cells = rows.groupBy(*keys, "__cell").agg(*aggs).select(*keys, "__cell", *far)
    null_keys = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in [*keys, "__cell"]]
    out = rows.withColumns(own).join(cells.withColumnsRenamed({k: f"__k_{k}" for k in [*keys, "__cell"]}), null_keys)
    given = {n: F.col(f"__o_{n}") + F.col(f"__f_{n}") for n in sums} | {n: F.coalesce(f"__o_{n}", f"__f_{n}") for n in (*lasts, *nexts, *befores)}
    return out.select(*df.columns, *[c.alias(n) for n, c in given.items()])


def numbered(df: DataFrame, keys: list[str], order: list[str] = ORDER, name: str = "idx", cell: int | float | None = None) -> DataFrame:
    """Index from 0 in order within the keys."""
    return along(df, keys, order, sums={name: F.lit(1).cast("long")}, cell=cell).withColumn(name, F.col(name) - 1)


def anchor_blocks(df: DataFrame, anchor: Column, keys: list[str], layers: int, per_layer: int, order: list[str] = ORDER) -> DataFrame:
    """block, pass, layer and half of each row; a block runs from an anchor to the next. Rows before the first anchor and of incomplete passes are dropped."""
    rows = along(df, keys, order, sums={"block": anchor.cast("long")}).withColumn("block", F.col("block") - 1)
    total = df.groupBy(*keys).agg(F.sum(anchor.cast("long")).alias("anchors"))
    per_pass = layers * per_layer
    rows = rows.join(total, keys).where(F.col("block") >= 0).where(F.col("block") < F.expr(f"((anchors - 1) div {per_pass}) * {per_pass}"))
    return rows.select(*df.columns, "block", F.expr(f"block div {per_pass}").alias("pass"), F.expr(f"(block % {per_pass}) div {per_layer}").alias("layer"), (F.col("block") % per_layer).alias("half"))


def steps(df: DataFrame, marker: Column, keys: list[str], order: list[str] = ORDER) -> DataFrame:
    """keys, step, a, b: the windows between consecutive markers."""
    marks = along(df.where(marker), keys, order, sums={"step": F.lit(1).cast("long")}, nexts={"b": F.col("s")})
    return marks.where("b is not null").select(*keys, F.col("s").alias("a"), "b", (F.col("step") - 1).alias("step"))


def in_steps(df: DataFrame, marker: Column, keys: list[str], order: list[str] = ORDER, cell: int | float | None = None) -> DataFrame:
    """The rows that start within a step, with step, a and b; the last marker opens no step. No join with the steps is needed."""
    start = F.when(marker, F.col("s"))
    rows = along(df, keys, order, sums={"step": marker.cast("long")}, lasts={"a": start}, nexts={"b": start}, cell=cell)
    return rows.where("a is not null and b is not null").withColumn("step", F.col("step") - 1)


def middle(df: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Of the steps of each lane the `most` that begin after the first quarter, or the last ones if fewer are left."""
    total = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    begin = F.greatest(F.lit(0), F.least(F.expr("total div 4"), F.col("total") - most))
    return df.withColumn("total", total).withColumn("begin", begin).where(f"step >= begin and step < begin + {most}").drop("total", "begin")


def gap_cv(df: DataFrame, keys: list[str], least: int = 3, most: int = 20_000, cell: int | float | None = None) -> DataFrame:
    """keys, launches, cv: names with that many rows and no gap of zero, and the variation of their gaps (population deviation by mean)."""
    gaps = along(df, keys, ORDER, befores={"__last": F.col("s")}, cell=cell).withColumn("gap", F.col("s") - F.col("__last"))
    out = gaps.groupBy(*keys).agg(F.count(F.lit(1)).alias("launches"), F.min("gap").alias("low"), (F.stddev_pop("gap") / F.avg("gap")).alias("cv"))
    return out.where(f"launches between {least} and {most} and low > 0").select(*keys, "launches", "cv")


def consensus(cv: DataFrame, keys: list[str], tiers: list[float], agree: int = 3) -> DataFrame:
    """keys, tier, launches, agreeing: the count that most names of the first good tier share (larger on ties); later tiers need `agree` names."""
    rows = cv.withColumn("t", F.explode(F.array(*[F.struct(F.lit(i).alias("n"), F.lit(t).alias("most")) for i, t in enumerate(tiers)]))).where("cv <= t.most")
    n = rows.groupBy(*keys, F.col("t.n").alias("tier"), "launches").agg(F.count(F.lit(1)).alias("agreeing"))
    best = n.groupBy(*keys, "tier").agg(F.max(F.struct("agreeing", "launches")).alias("m")).where(f"tier = 0 or m.agreeing >= {agree}")
    best = best.groupBy(*keys).agg(F.min(F.struct("tier", "m")).alias("x"))
    return best.select(*keys, F.col("x.tier").cast("long").alias("tier"), F.col("x.m.launches").alias("launches"), F.col("x.m.agreeing").alias("agreeing"))


def period_scores(df: DataFrame, value: str, keys: list[str], periods: range) -> DataFrame:
    """keys, period, score: mean likeness of values one period apart, for periods of which two fit."""
    rows = numbered(df, keys, ORDER, "__i").select(*keys, "__i", F.col(value).alias("__v"))
    total = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    ahead = rows.withColumn("period", F.explode(F.array(*[F.lit(p).cast("long") for p in periods]))).join(total, keys).where("2 * period <= n")
    then = rows.withColumnsRenamed({"__i": "__j", "__v": "__then"})
    rows = ahead.withColumn("__j", F.col("__i") + F.col("period")).join(then, [*keys, "__j"]).where("__then is not null")
    score = F.least("__v", "__then") / F.greatest("__v", "__then")
    return rows.groupBy(*keys, "period").agg(F.avg(score).alias("score"))


def layer_count(df: DataFrame, value: str, keys: list[str], per_layer: int, default: int = 1, first: int = 200, longest: int = 120, order: list[str] = ORDER) -> DataFrame:
    """keys, layers: how many layers a pass has, by the period at which the blocks' values come again.

    Of the first blocks of each lane (all but its last, `first` at most), those of the first period are held against the
    ones a period later; a period's score is the sum of their likenesses, and the first best one counts where it is more
    than 0.7 of the period. Lanes of fewer than 4 blocks, and those without such a period, have the default.
    """
    # The first rows are found without an order of all: each task keeps no more of a lane than are asked for.
    rows = df.select(*keys, F.col(value).alias("x"), F.row_number().over(lane(keys, order)).alias("i")).where(F.col("i") <= first)
    rows = rows.join(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total")), keys).withColumn("n", F.least(F.lit(first), F.col("total") - 1)).where("i <= n and n >= 4")
    one = rows.groupBy(*keys, "n").agg(F.array_sort(F.collect_list(F.struct("i", F.col("x").cast("double").alias("x")))).alias("a"))  # `first` values at most
    one = one.where(f"n div 2 >= {per_layer}").withColumn("period", F.explode(F.expr(f"sequence({per_layer}, least({longest - 1}, n div 2))")))

    def plus(total: Column, i: Column) -> Column:
        x, y = F.get("a.x", i), F.get("a.x", i + F.col("period"))
        return total + F.when((x > 0) & (y > 0), F.least(x, y) / F.greatest(x, y)).otherwise(0.0)

    score = F.aggregate(F.expr("sequence(0, least(period, n - period) - 1)"), F.lit(0.0), plus)
    best = one.withColumn("score", F.round(score, 6)).groupBy(*keys).agg(F.max(F.struct("score", (-F.col("period")).alias("neg"))).alias("b"))
    found = best.select(*keys, F.when(F.col("b.score") > -F.col("b.neg") * 0.7, F.expr(f"-b.neg div {per_layer}")).alias("layers"))
    return df.select(*keys).distinct().join(found, keys, "left").select(*keys, F.coalesce("layers", F.lit(default)).cast("long").alias("layers"))


def islands_of(df: DataFrame, value: str, keys: list[str], order: list[str] = ORDER) -> DataFrame:
    """Number of runs of each value in order: keys, value, islands."""
    rows = along(df, keys, order, befores={"__last": F.struct(F.col(value).alias("v"))})
    new = F.col("__last").isNull() | ~F.col(value).eqNullSafe(F.col("__last.v"))
    return rows.withColumn("new", new.cast("long")).groupBy(*keys, value).agg(F.sum("new").alias("islands"))


def sessions(df: DataFrame, keys: list[str], at: str, gap: int, order: list[str]) -> DataFrame:
    """keys, session_start, session_end, n: runs of rows with no more than gap between neighbours."""
    cell = cell_of(df, keys, order[0])
    rows = along(df, keys, order, befores={"__last": F.col(at)}, cell=cell).withColumn("__new", F.coalesce((F.col(at) - F.col("__last") > gap).cast("long"), F.lit(0)))
    rows = along(rows, keys, order, sums={"session": F.col("__new")}, cell=cell)
    return rows.groupBy(*keys, "session").agg(F.min(at).alias("session_start"), F.max(at).alias("session_end"), F.count(F.lit(1)).alias("n")).drop("session")


def middle_of(rows: DataFrame, key: str, most: int) -> DataFrame:
    """The rows of the steps that middle() would keep."""
    total = rows.groupBy(key).agg((F.max("step") + 1).alias("total"))
    kept = rows.join(F.broadcast(total), key).withColumn("begin", F.greatest(F.lit(0), F.least(F.expr("total div 4"), F.col("total") - most)))
    return kept.where(f"step >= begin and step < begin + {most}").drop("total", "begin")


def pivoted(rows: DataFrame, keys: list[str], column: str, names: list[str], value: Column) -> DataFrame:
    """keys and a column for each name with the sum of its values, 0 where there are none."""
    return rows.groupBy(*keys).pivot(column, names).agg(F.sum(value)).na.fill(0, names)


def growth(passes: DataFrame, keys: list[str], order: str, value: str, steady: float = 0.05) -> DataFrame:
    """passes with growth against the pass before, and label cold (the first), steady, growing or shrinking."""
    x = along(passes, keys, [order], befores={"__before": F.col(value)}).withColumn("growth", F.col(value) / F.col("__before") - 1)
    label = F.when(F.col("growth").isNull(), "cold").when(F.abs("growth") <= steady, "steady").when(F.col("growth") > 0, "growing").otherwise("shrinking")
    return x.withColumn("label", label).drop("__before")


def last_of_steps(rows: DataFrame, keys: list[str], k: int, order: list[str] = ORDER) -> DataFrame:
    """The last k rows of each step, with r from 1 backwards."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order])
    return rows.withColumn("r", F.row_number().over(w).cast("long")).where(F.col("r") <= k)


def owner_ahead(rows: DataFrame, keys: list[str], core: Column, owner: str, order: list[str] = ORDER) -> DataFrame:
    """rows with owner: the id of the next core at or after them in their lane; null behind the last one."""
    x = along(rows, keys, order, nexts={"__owner": F.when(core, F.col(owner))})
    return x.withColumn("owner", F.coalesce(F.when(core, F.col(owner)), F.col("__owner"))).drop("__owner")


def busy_until_gap(rows: DataFrame, keys: list[str], gap: int, order: list[str] = ORDER) -> DataFrame:
    """keys, busy_end, n: of each block (keys) what comes before its first hole wider than gap."""
    w = lane(keys, order)
    x = rows.withColumn("__reach", F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    x = x.withColumn("__after", F.sum(F.coalesce((F.col("s") - F.col("__reach") > gap).cast("long"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.where("__after = 0").groupBy(*keys).agg(F.max("e").alias("busy_end"), F.count(F.lit(1)).alias("n"))


def heaviest_repeated(rows: DataFrame, lanes: list[str], name: str) -> DataFrame:
    """lanes, name, total, stride: of the names with more than one row the one with most time (ties by name), and the median distance of its starts."""
    x = along(rows, [*lanes, name], ORDER, befores={"__last": F.col("s")}).withColumn("__gap", F.col("s") - F.col("__last"))
    a = x.groupBy(*lanes, name).agg(F.sum(F.col("e") - F.col("s")).alias("total"), F.median("__gap").alias("stride"), F.count(F.lit(1)).alias("n")).where("n > 1")
    best = a.groupBy(*lanes).agg(F.min(F.struct((-F.col("total")).alias("neg"), name, "stride")).alias("x"))
    return best.select(*lanes, f"x.{name}", (-F.col("x.neg")).alias("total"), "x.stride")


def pattern_holds(rows: DataFrame, keys: list[str], order: list[str], value: str, period: int) -> DataFrame:
    """keys, ok, n: whether each place of the period has one value throughout."""
    x = numbered(rows, keys, order, "__i").withColumn("__m", F.col("__i") % period)
    places = x.groupBy(*keys, "__m").agg(F.min(value).eqNullSafe(F.max(value)).alias("one"), (F.count(value) == F.count(F.lit(1))).alias("whole"), F.count(value).alias("there"), F.count(F.lit(1)).alias("n"))
    return places.groupBy(*keys).agg(F.bool_and(F.col("one") & (F.col("whole") | (F.col("there") == 0))).alias("ok"), F.sum("n").alias("n"))
