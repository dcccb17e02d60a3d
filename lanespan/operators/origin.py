"""The origin table: a window of a kernel capture, with modules from maps, in the order of its groups, and its footer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanespan.operators import segments as S
from lanespan.operators.checks import all_of, check
from lanespan.operators.intervals import cell_of

FOOTER = "__layer_total__"


def map_frame(spark: SparkSession, entries: dict) -> DataFrame:
    """key, module, occurrence of a map whose values are a module, or an object with module and occurrence."""
    rows = [(str(k), v["module"], str(v.get("occurrence")) if v.get("occurrence") is not None else None) if isinstance(v, dict) else (str(k), v, None) for k, v in entries.items()]
    return spark.createDataFrame(rows, "key string, module string, occurrence string")


def lookup(values: dict[str, str], *keys: Column) -> Column:
    """The value of the first key that the map has, then that of *; null if neither is there."""
    if not values:
        return F.lit(None).cast("string")
    m = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(*[F.element_at(m, k.cast("string")) for k in keys], F.lit(values.get("*")))


def window(kernels: DataFrame, first: int, last: int, modules: dict, functions: dict | None = None, reasons: dict | None = None, strict: bool = False) -> DataFrame:
    """Kernels with index first to last of each device, with their module by index, else by place in the window, else unknown/<index>.

    group is the module with its occurrence, where the map tells one. Functions and reasons are looked up by index, place, module and *.
    strict: a device with fewer kernels than that is an error.
    """
    spark = kernels.sparkSession
    rows = S.numbered(kernels, ["device"], ["s", "e", "name"]).where(F.col("idx").between(first, last)).withColumn("place", F.col("idx") - first)
    if strict:
        n = kernels.groupBy("device").agg(F.count(F.lit(1)).alias("__n"))
        short = F.concat(F.lit(f"the window [{first}, {last}] was asked for, but device "), F.col("device").cast("string"), F.lit(" has only "), F.col("__n").cast("string"), F.lit(" kernels"))
        n = n.withColumn("__ok", F.when(F.col("__n") > last, True).otherwise(F.raise_error(short).cast("boolean")))
        rows = rows.join(n.where("__ok").select("device"), "device")
    m = map_frame(spark, modules)
    by = lambda n, c: rows_join(n, c, m)
    for n, c in (("i", "idx"), ("p", "place")):
        rows = by(rows, (n, c))
    # A map may hold numbers of both kinds; the index goes first.
    module = F.coalesce("i_module", "p_module", F.concat(F.lit("unknown/"), F.col("idx").cast("string")))
    occurrence = F.when(F.col("i_module").isNotNull(), F.col("i_occurrence")).otherwise(F.col("p_occurrence"))
    rows = rows.withColumns({"module": module, "occurrence": occurrence})
    rows = rows.withColumn("group", F.when(F.col("occurrence").isNull(), F.col("module")).otherwise(F.concat_ws("#", "module", "occurrence")))
    keys = (F.col("idx"), F.col("place"), F.col("module"))
    rows = rows.withColumns({"python_function": lookup(functions or {}, *keys), "mapping_reason": lookup(reasons or {}, *keys), "duration_us": (F.col("e") - F.col("s")) / 1000.0})
    return rows.drop("i_module", "i_occurrence", "p_module", "p_occurrence", "occurrence")


def rows_join(rows: DataFrame, named: tuple[str, str], m: DataFrame) -> DataFrame:
    n, c = named
    side = m.select(F.col("key").alias(f"__{n}"), F.col("module").alias(f"{n}_module"), F.col("occurrence").alias(f"{n}_occurrence"))
    return rows.join(side, F.col(c).cast("string") == F.col(f"__{n}"), "left").drop(f"__{n}")


def ordered(rows: DataFrame) -> DataFrame:
    """seq: rows of a group together, groups by their first start and index, rows by start and index."""
    g = Window.partitionBy("device", "group")
    x = rows.withColumns({"fs": F.min("s").over(g), "fi": F.min("idx").over(g)})
    return x.withColumn("seq", F.row_number().over(Window.partitionBy("device").orderBy("fs", "fi", "s", "idx")).cast("long")).drop("fs", "fi")


def with_footer(rows: DataFrame) -> DataFrame:
    """One row more for each device: the wall span of the window."""
    foot = rows.groupBy("device").agg(F.lit(FOOTER).alias("module"), F.min("s").alias("s"), F.max("e").alias("e"), ((F.max("e") - F.min("s")) / 1000.0).alias("duration_us"), (F.max("seq") + 1).alias("seq"))
    return rows.unionByName(foot, allowMissingColumns=True)


def checks(rows: DataFrame) -> DataFrame:
    """Groups are contiguous, each is on one stream, and every kernel has a module."""
    runs = S.islands_of(rows.withColumn("id", F.col("idx")), "group", ["device"])
    streams = rows.groupBy("device", "group").agg(F.countDistinct("stream").alias("n"))
    return all_of(check("contiguous_groups", runs, F.col("islands") > 1), check("single_stream_groups", streams, F.col("n") > 1), check("module_map_complete", rows, F.col("module").startswith("unknown/")))


def unit_windows(kernels: DataFrame, anchor: str, layers: int, confirm: str | None = None, within: int = 8) -> DataFrame:
    """device, unit, a, b: stretches from an anchor to the one `layers` later; with confirm only anchors that it follows within so many rows."""
    order = ["s", "e", "name"]
    cell = cell_of(kernels, ["device"], "s")
    rows = kernels.withColumn("hit", F.col("name").contains(anchor))
    if confirm:
        rows = S.along(rows, ["device"], order, sums={"__i": F.lit(1).cast("long")}, cell=cell)
        rows = S.along(rows, ["device"], order, nexts={"__near": F.when(F.col("name").contains(confirm), F.col("__i"))}, cell=cell)
        rows = rows.withColumn("hit", F.col("hit") & F.coalesce(F.col("__near") - F.col("__i") <= within + 1, F.lit(False)))
    marks = S.along(rows.where("hit").select("device", *order), ["device"], order, sums={"unit": F.lit(1).cast("long")}, cell=cell).withColumn("unit", F.col("unit") - 1)
    ends = marks.select("device", (F.col("unit") - layers).alias("unit"), F.col("s").alias("b"))
    return marks.select("device", "unit", F.col("s").alias("a")).join(ends, ["device", "unit"])


def representative(kernels: DataFrame, windows: DataFrame, skip: int = 0) -> DataFrame:
    """device, unit, a, b, n of the window nearest to the median span among those with the most common number of kernels."""
    from lanespan.operators.intervals import overlap_join

    w = windows.where(F.col("unit") >= skip).withColumnsRenamed({"a": "s", "b": "e"})
    pairs = overlap_join(w, kernels.select("device", "s", (F.col("s") + 1).alias("e")), ["device"])
    n = pairs.groupBy("device", "unit", F.col("s").alias("a"), F.col("e").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    modal = n.groupBy("device", "n").agg(F.count(F.lit(1)).alias("k")).groupBy("device").agg(F.max(F.struct("k", "n")).alias("m")).select("device", F.col("m.n").alias("n"))
    v = n.join(modal, ["device", "n"]).withColumn("span", F.col("b") - F.col("a"))
    mid = v.groupBy("device").agg(F.median("span").alias("mid"))
    best = v.join(mid, "device").groupBy("device").agg(F.min(F.struct(F.abs(F.col("span") - F.col("mid")).alias("off"), "span", "a", "unit", "b", "n")).alias("x"))
    return best.select("device", "x.unit", "x.a", "x.b", "x.n")


def skeleton(slots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols (symbol_id, name, short_name) and slots that refer to them. Names that share a short name have #2, #3, ... in order of appearance."""
    first = slots.groupBy("name", "short_name").agg(F.min(F.struct("s", "idx")).alias("at"))
    k = F.row_number().over(Window.partitionBy("short_name").orderBy("at"))
    named = first.withColumn("k", k).withColumn("label", F.when(F.col("k") == 1, F.col("short_name")).otherwise(F.concat_ws("#", "short_name", F.col("k").cast("string"))))
    named = named.withColumn("symbol_id", F.row_number().over(Window.orderBy("at")).cast("long"))  # a row for each symbol of a unit
    symbols = named.select("symbol_id", "name", F.col("label").alias("short_name"))
    return symbols, slots.drop("short_name").join(symbols.select("symbol_id", "name"), "name").select("idx", "s", "e", "symbol_id")


def templates(rows: DataFrame, unit: list[str], order: list[str], name: str) -> DataFrame:
    """template, pos, d: what each place of a unit takes, by the names of the unit in their order. A unit has to fit a task, the units of a template need not."""
    t = rows.groupBy(*unit).agg(F.sort_array(F.collect_list(F.struct(*order, name, (F.col("e") - F.col("s")).alias("d")))).alias("x"))
    return t.select(F.array_join(F.transform("x", lambda r: r[name]), ">").alias("template"), F.posexplode(F.transform("x", lambda r: r["d"])).alias("pos", "d"))


def position_stats(rows: DataFrame) -> DataFrame:
    """template, pos, n, low, high, mean, diff of each place of each template."""
    d = F.col("d")
    out = rows.groupBy("template", F.col("pos").cast("long").alias("pos"))
    return out.agg(F.count(F.lit(1)).alias("n"), F.min(d).alias("low"), F.max(d).alias("high"), F.avg(d).alias("mean"), (F.max(d) - F.min(d)).alias("diff"))


def stable_positions(samples: DataFrame) -> DataFrame:
    """position, name, n, min_us, max_us, diff_us, avg_us, avg_pct over the units whose names in order equal the most common template.

    samples: unit, position, name, duration_us, unit_us. Units are told apart by a digest of their names, not by collecting them.
    """
    t = samples.groupBy("unit").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "name"))), lambda x: x["name"]), "\n"), 256).alias("template"), F.max("unit_us").alias("u"))
    best = t.groupBy("template").agg(F.count(F.lit(1)).alias("k")).agg(F.max(F.struct("k", "template")).alias("m")).select(F.col("m.template").alias("template"))
    good = t.join(best, "template").select("unit")
    g = samples.join(good, "unit").groupBy("position", "name").agg(F.count(F.lit(1)).alias("n"), F.min("duration_us").alias("min_us"), F.max("duration_us").alias("max_us"), F.avg("duration_us").alias("avg_us"), F.avg("unit_us").alias("u"))
    return g.select("position", "name", "n", "min_us", "max_us", (F.col("max_us") - F.col("min_us")).alias("diff_us"), "avg_us", (F.col("avg_us") / F.col("u") * 100).alias("avg_pct"))
