"""Fabricated captures with a known structure."""

import gzip
import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from lanespan.functions import kernels as K
from lanespan.operators import pipeline as P
from lanespan.operators import tables as T
from lanespan.sources import sqlite, trace

LAYER = [("boundary", 2), ("{}_core", 40), ("boundary", 2), ("experts", 30)]


def capture(path, steps=6, units=2, hole=80, devices=(0,)):
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE StringIds (id INTEGER PRIMARY KEY, value TEXT)")
    con.execute("CREATE TABLE CUPTI_ACTIVITY_KIND_KERNEL (start INTEGER, end INTEGER, deviceId INTEGER, shortName INTEGER, gridX INTEGER, graphId INTEGER, streamId INTEGER)")
    names: dict[str, int] = {}
    for dev in devices:
        t = 10
        for _ in range(steps):
            todo = [("marker", 5)]
            for _ in range(units):
                todo.append(("gate", 4))
                for v in ("kda", "kda", "kda", "mla"):
                    todo += [(n.format(v), d) for n, d in LAYER]
            for name, d in [*todo, ("lm_head", 12)]:
                i = names.setdefault(name, len(names) + 1)
                con.execute("INSERT INTO CUPTI_ACTIVITY_KIND_KERNEL VALUES (?, ?, ?, ?, 1, NULL, 7)", (t * 1000, (t + d) * 1000, dev, i))
                t += d
            t += hole
    con.executemany("INSERT INTO StringIds VALUES (?, ?)", [(i, n) for n, i in names.items()])
    con.commit()
    con.close()
    return str(path)


VARIANTS, RATIO = {"KDA": "kda_core", "MLA": "mla_core"}, {"KDA": 3, "MLA": 1}


def test_forward_pipeline_of_a_cyclic_capture(spark, tmp_path):
    k = sqlite.kernels(spark, capture(tmp_path / "a.sqlite", devices=(0, 1))).cache()
    assert k.count() == 2 * 6 * (2 + 2 * 17) and {r.device for r in k.select("device").distinct().collect()} == {0, 1}
    got = {(r.device, r.part): r for r in P.forward_pipeline(k, VARIANTS, RATIO).collect()}
    for d in (0, 1):
        assert got[d, "KDA"].layers == 6 and got[d, "MLA"].layers == 2 and got[d, "step"].samples == 5
        assert got[d, "gap"].mean_us == 80 and got[d, "step"].mean_us == 5 + 2 * (4 + 4 * 74) + 12 + 80
        assert sum(got[d, p].mean_us for p in ("KDA", "MLA", "other", "gap")) == pytest.approx(got[d, "step"].mean_us)
    at500 = {r.part: r for r in P.forward_pipeline(k.where("device = 0"), VARIANTS, RATIO, gap_ns=500_000).collect()}
    assert at500["gap"].mean_us == 0


def test_unit_markers_are_refused_with_a_ratio(spark, tmp_path):
    k = sqlite.kernels(spark, capture(tmp_path / "b.sqlite"), device=0).cache()
    cycles = P.unit_cycles(k, VARIANTS, RATIO)
    assert cycles.collect()[0].cycles == 12
    assert P.markers(k, cycles).collect()[0].launches == 6
    assert P.device_ranking(k, VARIANTS, RATIO).collect()[0].deviation == 0
    assert {r.hole_end - r.hole_start for r in P.wide_holes(k).collect()} == {80_000}
    assert P.degraded(k).collect()[0].steps is not None


def test_sqlite_without_tables_or_columns(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "c.sqlite")
    con.execute("CREATE TABLE StringIds (id INTEGER, value TEXT)")
    con.commit()
    with pytest.raises(ValueError, match="CUPTI"):
        sqlite.kernels(spark, str(tmp_path / "c.sqlite"))
    con.execute("CREATE TABLE CUPTI_ACTIVITY_KIND_KERNEL (start INTEGER, end INTEGER, deviceId INTEGER, shortName INTEGER)")
    con.execute("INSERT INTO CUPTI_ACTIVITY_KIND_KERNEL VALUES (1, 2, 0, 99)")
    con.commit()
    r = sqlite.kernels(spark, str(tmp_path / "c.sqlite")).collect()[0]
    assert (r.name, r.graph_id, r.gridX, r.stream) == (None, None, 1, 0)


# A golden table of two regions: seq, module, operator, us, start, end, layer.
GOLDEN = [
    (1, "layers.2/attn_core", "gemm_kernel", 10.0, 0, 10000, 2), (2, "layers.2/input_norm", "rmsnorm_kernel", 5.0, 10000, 15000, 2), (3, "layers.3/attn_core", "gemm_kernel", 10.0, 15000, 25000, 3), (4, "layers.3/input_norm", "rmsnorm_kernel", 5.0, 25000, 30000, 3),
    (5, "layers.20/attn_core", "gemm_kernel", 40.0, 100000, 140000, 20), (6, "layers.20/input_norm", "rmsnorm_kernel", 8.0, 140000, 148000, 20), (7, "layers.21/attn_core", "gemm_kernel", 40.0, 148000, 188000, 21), (8, "layers.21/input_norm", "rmsnorm_kernel", 8.0, 188000, 196000, 21),
]


def test_derived_tables_of_two_regions(spark):
    schema = "seq long, module string, operator_name string, duration_us double, start_ns long, end_ns long, layer_id int, region string, duration_avg_us double, stream int, unit_position string, unit_id string, unit_variant string, function_introduction string"
    origin = spark.createDataFrame([(*r, "", None, 7, "", "", "", "") for r in GOLDEN], schema)
    regions = spark.createDataFrame([(0, "encoder", 0, 9), (1, "decoder", 10, 99)], "ord int, region string, low int, high int")
    out = T.derived(origin, [], regions)
    classes = {(r.region, r.category): r for r in out["classes"].collect()}
    assert classes["encoder", "total"].duration == 30 and classes["decoder", "total"].duration == 96
    assert round(classes["encoder", "core"].duration_pct, 3) == 66.667 and round(classes["decoder", "core"].duration_pct, 3) == 83.333
    assert classes["encoder", "communication"].n == 0
    for name in ("overview", "core", "auxiliary", "stages"):
        assert out[name].where("kind = 'total'").count() == 2
    stage = {(r.region, r.kind, r.functional_module): r for r in out["stages"].collect()}
    assert stage["decoder", "pattern", "Attention 核心计算"].module_us == 80 and stage["decoder", "total", None].union_us == 96
    assert [r.duration for r in out["core"].where("region = 'decoder'").orderBy(F.asc_nulls_last("ord")).collect()] == [40, 40, 80]


def test_rules_and_categories(spark):
    rows = [("layers.1/comm", "ncclAllReduce"), ("m/attn_core", "flash_fwd_attn_kernel"), ("m/x", "flash_fwd_attn_kernel"), ("m/gate", "void ns::topk_kernel<int>(int)"), ("m/mlp", "nvjet_tst_TNT"), ("m/o_proj", "odd")]
    df = spark.createDataFrame(rows, "module string, op string").withColumn("leaf", F.substring_index(K.table_name(F.col("op")), "<", 1))
    none = F.lit(None).cast("string")
    got = [r.c for r in df.select(K.category(F.col("module"), F.col("op"), F.col("leaf"), none, none).alias("c")).collect()]
    assert got == ["communication", "core", "auxiliary", "auxiliary", "core", "auxiliary"]
    assert df.select(K.module_label(F.col("module")).alias("x")).collect()[-1].x == "Attention 输出投影"


def test_call_paths_and_tree(spark, tmp_path):
    ev = []
    frames = [(1, None, "main.py(1): main", 0, 1000), (2, 1, "model.py(5): forward", 10, 900), (3, 2, "attn.py(9): attn", 20, 300), (4, 2, "mlp.py(3): mlp", 400, 300)]
    for i, p, n, ts, d in frames:
        ev.append({"ph": "X", "cat": "python_function", "name": n, "ts": ts, "dur": d, "pid": "1", "tid": "5", "args": {"Python id": i, **({"Python parent id": p} if p else {})}})
    for c, ts, name in ((11, 30, "k1"), (12, 450, "k2"), (13, 60, "k1")):
        ev.append({"ph": "X", "cat": "cuda_runtime", "name": "cudaLaunchKernel", "ts": ts, "dur": 2, "pid": "1", "tid": "5", "args": {"correlation": c, "External id": c}})
        ev.append({"ph": "X", "cat": "cpu_op", "name": f"aten::{name}", "ts": ts, "dur": 3, "pid": "1", "tid": "5", "args": {"External id": c}})
        ev.append({"ph": "X", "cat": "kernel", "name": name, "ts": ts + 500, "dur": 10, "pid": "0", "tid": "7", "args": {"correlation": c}})
    ev.append({"ph": "X", "cat": "kernel", "name": "lost", "ts": 999, "dur": 1, "pid": "0", "tid": "7", "args": {}})
    with gzip.open(tmp_path / "t.json.gz", "wt") as f:
        json.dump({"traceEvents": ev}, f)
    paths = {(r.kernel, r.s): r for r in trace.call_paths(trace.events(spark, str(tmp_path / "t.json.gz"))).collect()}
    assert paths["k1", 530_000].path == ["main.py(1): main", "model.py(5): forward", "attn.py(9): attn"] and paths["k1", 530_000].op == "aten::k1"
    assert paths["k2", 950_000].path[-1] == "mlp.py(3): mlp" and paths["lost", 999_000].path == []
    (tmp_path / "bare.json").write_text(json.dumps(ev))
    tree = {r.path: r for r in trace.call_tree(trace.call_paths(trace.events(spark, str(tmp_path / "bare.json")))).collect()}
    top = tree["main.py(1): main"]
    assert (top.inclusive_us, top.self_us, top.launches) == (30, 0, 3) and tree["main.py(1): main/model.py(5): forward/attn.py(9): attn"].self_us == 20
