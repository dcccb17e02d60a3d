from lanespan.operators import pipeline as P
from lanespan.operators import tables as T
from lanespan.operators import validate as V
from lanespan.sources import config as C


def test_configurations():
    flat, deep = {"num_hidden_layers": 4, "num_nextn_predict_layers": 1}, {"text_config": {"num_hidden_layers": 6, "compress_ratios": [0, 4, 4, 0, 4, 4, 4]}}
    assert C.layer_counts(flat) == [4, 5] and C.layer_counts(deep) == [6] and C.layer_counts({}) == []
    assert C.compress_ratios(deep, 6) == [0, 4, 4, 0, 4, 4] and C.compress_ratios(deep, 9) is None
    assert C.first_present({"a": None, "b": 0}, "a", "b") == 0
    profiles = [{"name": "x", "conditions": [{"key": "compress_ratios", "non_empty": True}, {"key": "num_hidden_layers", "gt": 9}]}, {"name": "y", "conditions": [{"key": "num_hidden_layers", "gt": 3}]}]
    assert C.profile(deep, profiles) == "y" and C.profile({}, profiles) is None
    assert C.anchor({"a": 20, "b": 10, "c": 8, "d": 7}, [4, 5]) == ("b", 5) and C.anchor({"d": 7}, [4]) is None


def test_launch_scripts():
    script = "export TP=8\nDP=2  # replicas\npython serve.py --tp-size $TP --dp-size=$DP --chunked-prefill-size $((TP * 1024))\n"
    t = C.topology({"num_hidden_layers": 4}, script, {"dp_size": "4"})
    assert (t["layers"], t["tp"], t["dp"], t["pp"], t["chunk"]) == (4, 8, 4, None, 8192)
    assert C.cluster_batch(16, 16, 8, 2) == 64 and C.cluster_batch(16, 10, 8, 2) is None and C.cluster_batch(None, 8, 8, 1) is None
    assert C.kernel_words("The boundary is mla_core. Not used: bad_kernel. See ns::x_gemm") == ["mla_core", "ns::x_gemm"]


TAX = {"variants": [{"id": "KDA", "marker": "kda_core"}, {"id": "MLA"}], "repeating_unit": {"positions": [{"position": 1, "variant": "KDA", "layer_id": 4, "id": "L4"}, {"position": 2, "variant": "MLA", "layer_id": 7, "id": "L7"}]}, "regions": [{"id": "enc", "layers": [0, 5]}, {"id": "dec", "layers": [6, 9]}]}


def test_taxonomies(spark):
    assert C.taxonomy_errors(TAX) == [] and C.variant_ratio(TAX) == {"KDA": 1, "MLA": 1} and C.markers(TAX) == {"KDA": "kda_core"}
    bad = {**TAX, "variants": [], "regions": [{"id": "a", "layers": [0, 5]}, {"id": "b", "layers": [5, 9]}]}
    assert len(C.taxonomy_errors(bad)) == 3
    assert C.positions(spark, TAX).count() == 2 and C.regions(spark, TAX).count() == 2


def test_tables_by_position_validate(spark):
    schema = "seq long, module string, operator_name string, duration_us double, start_ns long, end_ns long, layer_id int, duration_avg_us double, stream int, unit_position string, unit_id string, unit_variant string, function_introduction string"
    rows = [(1, "embed", "copy_kernel", 10.0, 0, 10_000, 4), (2, "layers.4/attn_core", "flash_attn_fwd", 20.0, 10_000, 30_000, 4), (3, "embed", "copy_kernel", 30.0, 30_000, 60_000, 7), (4, "layers.7/attn_core", "flash_attn_fwd", 40.0, 60_000, 100_000, 7)]
    origin = spark.createDataFrame([(*r, None, 7, "", "", "", "") for r in rows], schema)
    rules = [{"match": {"module": "embed"}, "functional_module": "Input"}, {"match": {"module": "layers.4"}, "functional_module": "KDA core"}, {"match": {"module": "layers.7"}, "functional_module": "MLA core"}]
    out = T.derived(origin, rules, None, C.positions(spark, TAX))
    stage = {(r.kind, r.unit_variant, r.functional_module): r.module_us for r in out["stages"].collect()}
    assert stage["row", "KDA", "Input"] == 10 and stage["row", "MLA", "Input"] == 30
    assert (stage["pattern", None, "Input"], stage["pattern", None, "MLA core"], stage["pattern", None, "KDA core"], stage["total", None, None]) == (40, 40, 20, 100)
    checks = {r.check_id: r for r in V.derived_tables(out).collect()}
    assert len(checks) == 8 and all(r.n_violations == 0 and r.n_rows > 0 for r in checks.values())
    broken = {**out, "classes": out["classes"].withColumn("duration", out["classes"]["duration"] + 1)}
    assert {r.check_id: r.n_violations for r in V.derived_tables(broken).collect()}["classes_agree"] == 3
    unit = T.enriched(T.routed(origin, None), rules, C.positions(spark, TAX))
    assert all(r.n_violations == 0 for r in V.unit_attribution(unit).collect())


def test_pipeline_tables_validate(spark):
    rows = [(0, 1000 * (100 * i + d), 1000 * (100 * i + d + 9), n) for i in range(8) for d, n in ((0, "marker"), (10, "kda_core"), (20, "x"))]
    k = spark.createDataFrame(rows, "device int, s long, e long, name string")
    table = P.forward_pipeline(k, {"KDA": "kda_core"}, marker="marker")
    assert all(r.n_violations == 0 for r in V.pipeline_table(table).collect())
    second = P.second_forward(k, spark.createDataFrame([(0, "marker")], "device int, marker string"), times=1)
    assert second.count() == 0
