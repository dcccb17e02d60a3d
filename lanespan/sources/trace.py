"""Trace-event JSON: kernels, launches, operators and frames, and the joins that lead from one to the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanespan.operators.joins import ancestors, innermost
from lanespan.sources.ranges import SPLIT, event_texts

EVENT = "struct<ph:string,cat:string,name:string,ts:double,dur:double,pid:string,tid:string,args:map<string,string>>"


def events(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """Events of files that hold a list of events, or an object with traceEvents, plain or gzip, cut into ranges of `split` bytes. file and idx (where the event begins) keep their order."""
    return event_texts(spark, path, split).select("file", "idx", F.from_json("value", EVENT).alias("e")).select("file", "idx", "e.*")


def args(*names: str):
    """The first of several argument names that is there."""
    return F.coalesce(*[F.element_at("args", n) for n in names])


def micro(c: str) -> F.Column:
    return F.round(F.col(c) * 1000).cast("long")


def classified(ev: DataFrame) -> dict[str, DataFrame]:
    """kernel, runtime, cpu and frame events with their ids, s and e in nanoseconds."""
    x = ev.where("ph = 'X'").withColumns({"s": micro("ts"), "e": F.round((F.col("ts") + F.col("dur")) * 1000).cast("long"), "low": F.lower("cat")})
    runtime = F.col("low").contains("cuda_runtime") | F.col("low").contains("cuda_driver") | F.col("name").startswith("cuda") | F.col("name").startswith("cuLaunch")
    cpu = F.col("low").contains("cpu_op") | F.col("low").contains("operator") | F.col("name").startswith("aten::") | F.col("name").startswith("torch::")
    frame = F.col("low").contains("python") | F.col("low").contains("user_annotation")
    return {
        "kernel": x.where("cat = 'kernel'").withColumn("correlation", args("correlation", "Correlation ID")),
        "runtime": x.where(runtime).withColumns({"correlation": args("correlation", "Correlation ID"), "external": args("External id", "external id")}),
        "cpu": x.where(cpu).withColumn("external", args("External id", "external id")),
        "frame": x.where(frame).withColumns({"frame": args("Python id").try_cast("long"), "parent": args("Python parent id").try_cast("long")}),
    }


def call_paths(ev: DataFrame) -> DataFrame:
    """file, kernel, s, dur_us, tid, op, path: each kernel with its launch by correlation (the last of equal ones), the operator by external id, and the frames open at the launch, outermost first.

    Ids hold within a file. A kernel without a launch keeps null op and an empty path. Frames nest, so the innermost is the shortest that holds the time.
    """
    c = classified(ev)
    last = lambda df, key: df.where(F.col(key).isNotNull()).groupBy("file", key).agg(F.max(F.struct("idx", "tid", "s", "e", "name", *(["external"] if "external" in df.columns else []))).alias("x"))
    launch = last(c["runtime"], "correlation").select("file", "correlation", F.col("x.tid").alias("l_tid"), F.col("x.s").alias("at"), F.col("x.external").alias("external"))
    op = last(c["cpu"], "external").select("file", "external", F.col("x.name").alias("op"))
    k = c["kernel"].select("file", F.col("idx").alias("kernel_idx"), F.col("name").alias("kernel"), "s", (F.col("e") - F.col("s")).alias("dur_ns"), "correlation")
    k = k.join(launch, ["file", "correlation"], "left").join(op, ["file", "external"], "left")
    frames = c["frame"].select("file", F.col("tid").alias("l_tid"), F.col("idx").alias("fid"), "s", "e")
    got = innermost(k.where("at is not null").select("kernel_idx", "file", "l_tid", "at"), frames, ["file", "l_tid"], "at", "fid")
    pyid = F.when(F.col("frame").isNotNull(), F.struct("file", F.col("frame").alias("id")))
    parent = F.when(F.col("parent").isNotNull(), F.struct("file", F.col("parent").alias("id")))
    own = c["frame"].select("file", F.col("idx").alias("frame"), pyid.alias("pyid"), parent.alias("parent"), F.col("name").alias("label"))
    # Only frames in which something is launched are walked, and their ancestors by id.
    ids = own.where("pyid is not null").groupBy("pyid").agg(F.min(F.struct("frame", "parent", "label")).alias("x")).select("pyid", "x.parent", "x.label")
    walk = ancestors(ids, "pyid", "parent")
    labelled = walk.select(F.col("node").alias("pyid"), F.posexplode("path").alias("p", "one")).join(ids.select(F.col("pyid").alias("one"), "label"), "one")
    paths = labelled.groupBy("pyid").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "label"))), lambda x: x["label"]).alias("path"))
    at = got.join(own.select("file", "frame", "pyid"), ["file", "frame"], "left").join(paths, "pyid", "left").select("file", "kernel_idx", "path")
    out = k.join(at, ["file", "kernel_idx"], "left")
    return out.select("file", "kernel_idx", "kernel", "s", (F.col("dur_ns") / 1000.0).alias("dur_us"), F.col("l_tid").alias("tid"), "op", F.coalesce("path", F.array().cast("array<string>")).alias("path"))


def call_tree(paths: DataFrame) -> DataFrame:
    """path, level, inclusive_us, self_us, launches of each prefix of the call paths; self is what no child has."""
    keys = F.transform(F.sequence(F.lit(1), F.size("path")), lambda i: F.slice("path", 1, i))
    x = paths.where("size(path) > 0").select("dur_us", F.col("path").alias("leaf"), F.explode(keys).alias("node"))
    own = F.when(F.size("node") == F.size("leaf"), F.col("dur_us")).otherwise(0.0)
    return x.groupBy("node").agg(F.sum("dur_us").alias("inclusive_us"), F.sum(own).alias("self_us"), F.count(F.lit(1)).alias("launches")).select(F.array_join("node", "/").alias("path"), F.size("node").alias("level"), "inclusive_us", "self_us", "launches")
