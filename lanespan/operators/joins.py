"""Joins on time, place, order and multiplicity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanespan.operators.intervals import cell_of, level, levels_to, own_nodes, point_nodes
from lanespan.sources.scratch import cut


def asof(probes: DataFrame, events: DataFrame, key: str, at: str, payload: list[str], cell: int | None = None) -> DataFrame:
    """probes with the payload of the last event of the same key at or before them (null if none), ties by payload.

    Both sides are ordered together within (key, cell of time); what a cell passes on to later ones is one row a cell, so
    no lane is ever ordered as a whole.
    """
    last = F.struct(F.col(at).alias("__t"), *payload)
    ev = events.select(key, at, last.alias("__ev"), F.lit(0).alias("__kind"))
    pr = probes.withColumn("__row", F.struct(*probes.columns)).select(key, at, F.col("__row"), F.lit(1).alias("__kind"))
    both = ev.unionByName(pr, allowMissingColumns=True)
    both = both.withColumn("__cell", F.floor(F.col(at) / (cell or cell_of(both, [key], at))))
    w = Window.partitionBy(key, "__cell").orderBy(at, "__kind", "__ev").rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("__near", F.last("__ev", True).over(w)).where("__kind = 1")
    ends = both.where("__kind = 0").groupBy(key, "__cell").agg(F.max("__ev").alias("__end"))
    cells = both.select(key, "__cell").distinct().join(ends, [key, "__cell"], "left")
    before = Window.partitionBy(key).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(key, "__cell", F.last("__end", True).over(before).alias("__far"))
    out = near.join(cells, [key, "__cell"], "left").withColumn("__got", F.coalesce("__near", "__far"))
    return out.select("__row.*", *[F.col(f"__got.{p}").alias(p) for p in payload])


def nearest(probes: DataFrame, events: DataFrame, key: str, at: str, payload: str, cell: int | None = None) -> DataFrame:
    """probes with nearest and distance: the event of the same key that is closest in time, of equally close ones the smallest payload; nulls if the key has none.

    One pass over both sides: within (key, cell of time) each probe sees the last event up to it and the first after it, and
    each cell hands its last and first event on to its neighbours.
    """
    ev = events.groupBy(key, at).agg(F.min(payload).alias("__p")).select(key, at, F.struct(F.col(at).alias("t"), F.col("__p").alias("p")).alias("__ev"), F.lit(0).alias("__kind"))
    pr = probes.withColumn("__row", F.struct(*probes.columns)).select(key, at, F.col("__row"), F.lit(1).alias("__kind"))
    both = ev.unionByName(pr, allowMissingColumns=True)
    both = both.withColumn("__cell", F.floor(F.col(at) / (cell or cell_of(both, [key], at))))
    w = Window.partitionBy(key, "__cell").orderBy(at, "__kind")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(key, "__cell").orderBy(F.desc(at), F.desc("__kind")).rowsBetween(Window.unboundedPreceding, -1)
    seen = both.withColumns({"__back": F.last("__ev", True).over(upto), "__ahead": F.last("__ev", True).over(after)})
    cells = both.groupBy(key, "__cell").agg(F.max("__ev").alias("__last"), F.min("__ev").alias("__first"))
    by, back = (Window.partitionBy(key).orderBy(x) for x in (F.asc("__cell"), F.desc("__cell")))
    cells = cells.select(key, "__cell", F.last("__last", True).over(by.rowsBetween(Window.unboundedPreceding, -1)).alias("__far_back"), F.last("__first", True).over(back.rowsBetween(Window.unboundedPreceding, -1)).alias("__far_ahead"))
    out = seen.where("__kind = 1").join(cells, [key, "__cell"], "left")
    near = [F.when(x.isNotNull(), F.struct(F.abs(x["t"] - F.col(at)).alias("d"), x["p"].alias("p"))) for x in (F.coalesce("__back", "__far_back"), F.coalesce("__ahead", "__far_ahead"))]
    return out.withColumn("__x", F.least(*near)).select("__row.*", F.col("__x.p").alias("nearest"), F.col("__x.d").alias("distance"))


def levels_of(frames: DataFrame, s: str, e: str) -> list[int]:
    """The levels at which frames [s, e) lie."""
    got = frames.agg(F.min(F.col(e) - F.col(s)).alias("least"), F.max(F.col(e) - F.col(s)).alias("most")).select(level(F.col("least")).alias("least"), "most").first()
    return [b for b in levels_to(got.most) if b >= got.least] if got.most is not None else []


def innermost(points: DataFrame, frames: DataFrame, keys: list[str], at: str, frame_id: str) -> DataFrame:
    """points with the smallest frame [s, e) of the same keys that holds them, ties by id; null if none does.

    A frame lies in the one or two nodes of its length, and a point looks at each level that frames have.
    """
    f = frames.where("e > s").select(*keys, F.col(frame_id).alias("__frame"), "s", "e")
    levels = levels_of(f, "s", "e") or [0]
    held = point_nodes(points, at, levels).join(own_nodes(f), [*keys, "__bits", "__node"]).where((F.col("s") <= F.col(at)) & (F.col(at) < F.col("e")))
    best = held.groupBy(*points.columns).agg(F.min(F.struct((F.col("e") - F.col("s")).alias("d"), "__frame")).alias("x"))
    out = points.join(best, points.columns, "left")
    return out.select(*points.columns, F.col("x.__frame").alias("frame"), F.col("x.d").alias("frame_len"))


def bag_match(rows: DataFrame, keys: list[str], bags: list[tuple[str, DataFrame]], other: str) -> DataFrame:
    """keys, n, class: rows of a key are consumed by the bags in turn, as often as each bag holds the key; the rest are `other`."""
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    upto = F.lit(0)
    cls = None
    for i, (name, bag) in enumerate(bags):
        out = out.join(bag.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"n{i}")), keys, "left").na.fill(0, [f"n{i}"])
        upto = upto + F.col(f"n{i}")
        cls = F.when(F.col("n") <= upto, name) if cls is None else cls.when(F.col("n") <= upto, name)
    # Rows of one key are alike, so a key's rows are made from its count and need no ordering.
    return out.withColumn("n", F.explode(F.expr("sequence(1L, rows)"))).select(*keys, "n", cls.otherwise(other).alias("class"))


def zipped(a: DataFrame, b: DataFrame, keys: list[str], order_a: list, order_b: list, how: str = "full") -> DataFrame:
    """Rows of both sides by place within the keys: strict with how="full", truncating with "inner"."""
    number = lambda df, order: df.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    return number(a, order_a).join(number(b, order_b), [*keys, "k"], how)


#: A dimension is sent to all executors up to so many rows; beyond that its join is shuffled.
SENT_ROWS = 200_000


def sent(df: DataFrame, most: int = SENT_ROWS) -> DataFrame:
    """df, marked to be sent to all executors if it has no more than `most` rows; it is counted no further than that."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def cascade(rows: DataFrame, column: str, steps: list[tuple[str, Column, DataFrame, str]], missing: str = "missing", most: int = SENT_ROWS) -> DataFrame:
    """rows with level and found: the first step whose dimension has the row's value. A step is (level, value, dimension, result column); a dimension's first column is its unique key."""
    out, level, found = rows, None, None
    for i, (name, value, dim, result) in enumerate(steps):
        d = dim.select(F.col(dim.columns[0]).alias(f"__k{i}"), F.col(result).alias(f"__r{i}"))
        out = out.join(sent(d, most), value == F.col(f"__k{i}"), "left")
        hit = F.col(f"__k{i}").isNotNull()
        level = F.when(hit, name) if level is None else level.when(hit, name)
        found = F.when(hit, F.col(f"__r{i}")) if found is None else found.when(hit, F.col(f"__r{i}"))
    return out.select(*rows.columns, level.otherwise(missing).alias("level"), found.alias("found"))


def ancestors(nodes: DataFrame, node: str, parent: str, most: int = 64) -> DataFrame:
    """node, depth, path: ancestors first, at most `most` of them; cycles end there.

    Paths double in each of log2(most) rounds. A round is written before the next, which reads it twice; the walk ends when
    no path has anything above it.
    """
    state = nodes.select(F.col(node).alias("node"), F.col(parent).alias("up"), F.array(F.col(node)).alias("path"))
    for _ in range(most.bit_length()):
        state = cut(state)
        if state.where("up is not null").limit(1).count() == 0:
            break
        p = state.select(F.col("node").alias("pn"), F.col("up").alias("pu"), F.col("path").alias("pp"))
        state = state.join(p, F.col("up") == F.col("pn"), "left").select("node", F.col("pu").alias("up"), F.when(F.col("pp").isNull(), F.col("path")).otherwise(F.concat("pp", "path")).alias("path"))
    path = F.expr(f"slice(path, greatest(1, size(path) - {most}), {most} + 1)")
    return state.select("node", (F.size(path) - 1).cast("long").alias("depth"), path.alias("path"))


def enclosing(points: DataFrame, frames: DataFrame, keys: list[str], frame_id: str, smallest: bool = True) -> DataFrame:
    """points (s, e and others) with frame: the smallest interval of the same keys that holds all of [s, e], else the smallest that holds s; ties by id, null if none does."""
    f = frames.select(*keys, F.col(frame_id).alias("__frame"), F.col("s").alias("__s"), F.col("e").alias("__e"), (F.col("e") + 1).alias("__end"))
    p = point_nodes(points.withColumn("__row", F.struct(*points.columns)), "s", levels_of(f, "__s", "__end") or [0])
    held = p.join(own_nodes(f, "__s", "__end"), [*keys, "__bits", "__node"]).where((F.col("__s") <= F.col("s")) & (F.col("s") <= F.col("__e")))
    length = (F.col("__e") - F.col("__s")) * (1 if smallest else -1)
    best = held.groupBy("__row").agg(F.min(F.struct((F.col("__e") < F.col("e")).alias("part"), length.alias("d"), "__frame")).alias("__x"))
    out = points.withColumn("__row", F.struct(*points.columns)).join(best, "__row", "left")
    return out.select(*points.columns, F.col("__x.__frame").alias("frame"), F.coalesce(~F.col("__x.part"), F.lit(False)).alias("whole"))


def operator_of(calls: DataFrame, operators: DataFrame, external: str, call_id: str, operator_id: str) -> DataFrame:
    """calls with operator: of the operators with the same external id the smallest that holds the call, else the smallest that holds its start, else the last; ties by id. Null where no operator has the id."""
    o = operators.select(external, F.col(operator_id).alias("__o"), F.col("s").alias("__s"), F.col("e").alias("__e"))
    x = calls.select(F.col(call_id).alias("__c"), external, "s", "e").where(F.col(external).isNotNull()).join(o, external)
    starts = (F.col("__s") <= F.col("s")) & (F.col("s") <= F.col("__e"))
    rank = F.when(starts & (F.col("__e") >= F.col("e")), 0).when(starts, 1).otherwise(2)
    order = F.struct(rank.alias("rank"), F.when(rank < 2, F.col("__e") - F.col("__s")).otherwise(-F.col("__s")).alias("d"), "__o")
    best = x.groupBy("__c").agg(F.min(order).alias("__x")).select(F.col("__c").alias(call_id), F.col("__x.__o").alias("operator"))
    return calls.join(best, call_id, "left")


def positioned(rows: DataFrame, positions: DataFrame, row_id: str) -> DataFrame:
    """rows with position: of positions (position, layer_id, pattern) that of the row's layer, where it has one, else one whose pattern its module holds.

    More than one match is an error, as positions have to be told apart. positions are a table of configuration and are sent to all executors.
    """
    p = F.broadcast(positions.select(F.col("position").alias("__p"), F.col("layer_id").alias("__l"), "pattern"))
    hit = F.when(F.col("__l").isNotNull(), F.col("__l") == F.col("layer_id")).otherwise(F.expr("module rlike concat('(?i)', pattern)"))
    n = rows.join(p, F.coalesce(hit, F.lit(False)), "left").groupBy(*rows.columns).agg(F.count("__p").alias("__n"), F.min("__p").alias("position"))
    wrong = F.raise_error(F.concat(F.lit("more than one position matches row "), F.col(row_id).cast("string"))).cast(positions.schema["position"].dataType)
    return n.select(*rows.columns, F.when(F.col("__n") > 1, wrong).otherwise(F.col("position")).alias("position"))
