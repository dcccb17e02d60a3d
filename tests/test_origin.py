import zipfile

import pytest
from pyspark.sql import functions as F

from lanespan.operators import origin as O
from lanespan.sources import code as X
from lanespan.sources import packages as P


@pytest.fixture(scope="module")
def kernels(spark):
    rows = [(0, 7, 100 * i, 100 * i + 50, n, n[0]) for i, n in enumerate(["gate", "a_core", "b1", "gate", "a_core", "b2", "gate", "a_core", "b1", "gate"])]
    return spark.createDataFrame(rows, "device int, stream int, s long, e long, name string, short_name string")


def test_origin_window(kernels):
    w = O.window(kernels, 1, 4, {"1": "attn", "1x": "no", "2": {"module": "mlp", "occurrence": 2}, "3": "late"}, {"attn": "f.py(1): f", "*": "any"}, {"2": "by index"})
    got = {r.idx: r for r in O.ordered(w).collect()}
    assert [got[i].module for i in (1, 2, 3, 4)] == ["attn", "mlp", "late", "late"] and got[2].group == "mlp#2"
    assert (got[1].python_function, got[3].python_function, got[2].mapping_reason, got[3].mapping_reason) == ("f.py(1): f", "any", "by index", "by index")
    foot = O.with_footer(O.ordered(w)).where("module = '__layer_total__'").collect()
    assert len(foot) == 1 and foot[0].duration_us == 0.35 and foot[0].seq == 5
    bad = {r.check_id: r.n_violations for r in O.checks(O.window(kernels, 0, 5, {"0": "x", "1": "y", "2": "x"})).collect()}
    assert bad == {"contiguous_groups": 1, "single_stream_groups": 0, "module_map_complete": 3}


def test_units_and_skeleton(kernels):
    u = O.unit_windows(kernels, "gate", 1)
    assert [(r.unit, r.a, r.b) for r in u.orderBy("unit").collect()] == [(0, 0, 300), (1, 300, 600), (2, 600, 900)]
    assert O.unit_windows(kernels, "gate", 1, confirm="b2", within=2).count() == 0 and O.unit_windows(kernels, "gate", 2, confirm="core").count() == 1
    r = O.representative(kernels, u, skip=1).collect()[0]
    assert (r.unit, r.n) == (1, 3)
    symbols, slots = O.skeleton(kernels.withColumn("idx", kernels["s"]))
    assert sorted(x.short_name for x in symbols.collect()) == ["a", "b", "b#2", "g"] and slots.count() == 10


def test_stable_positions(spark):
    rows = [(u, p, n if (u, p) != (3, 1) else "odd", 10.0 + u, 100.0) for u in range(4) for p, n in enumerate(["x", "y"])]
    got = {r.position: r for r in O.stable_positions(spark.createDataFrame(rows, "unit int, position int, name string, duration_us double, unit_us double")).collect()}
    assert (got[0].n, got[0].min_us, got[0].max_us, got[0].avg_us, got[0].avg_pct) == (3, 10, 12, 11, 11)


def test_packages(spark, tmp_path):
    names = [f"run{s}" for s in P.SUFFIXES]
    assert P.prefixes(names) == ["run"] and P.prefixes(names[1:]) == []
    assert [tuple(r) for r in P.table_sets(spark.createDataFrame([(n,) for n in [*names, "b_stage_table.csv"]], "name string")).orderBy("prefix").collect()] == [("b", False), ("run", True)]
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for n in names:
            z.writestr(f"x/{n}", "h\n")
    root = P.unpack(str(tmp_path / "a.zip"), str(tmp_path / "out"))
    assert root.name == "x" and P.laid_out(str(root)) == P.laid_out(str(root)) and len(P.laid_out(str(root))["csv"]) == 6
    with pytest.raises(ValueError):
        P.unpack(str(tmp_path / "a.zip"), str(tmp_path / "out2"), largest=3)
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("../evil", "x")
    with pytest.raises(ValueError):
        P.unpack(str(tmp_path / "b.zip"), str(tmp_path / "out3"))
    files = P.fingerprints(spark, f"{tmp_path}/*.zip")
    one = P.fingerprint(str(tmp_path / "a.zip"))
    assert one["sha256_head"] in {r.sha256_head for r in files.collect()} and P.newest(files, [".none", ".zip"]).endswith(".zip") and P.newest(files, [".none"]) is None


SOURCE = '''import x


class A:
    def run(self,
            q):
        """Doc: mla_kernel(q)."""
        if self.fast:
            out = mla_kernel(
                q, 1)
        return out

    def other(self):
        pass
'''


def test_source_navigation(spark):
    code = X.index(spark.createDataFrame([("a.py", SOURCE), ("bad.py", "def broken(:"), ("empty.py", ""), ("null.py", None)], "path string, text string"))
    defs = {r.name: (r.def_line, r.begin, r.end) for r in code.where("kind = 'def'").collect()}
    assert defs == {"run": (5, 8, 11), "other": (13, 14, 14)}
    entries = spark.createDataFrame([(1, "a.py", "run", 5, ["kernel", "mla_kernel"]), (2, "a.py", "run", 50, ["none"]), (3, "a.py", "gone", 1, ["x"]), (4, "bad.py", "broken", 1, [])], "id int, path string, function string, hint int, tokens array<string>")
    got = {r.id: r for r in X.resolved(entries, code).collect()}
    assert (got[1].line, got[1].snippet, got[1].branch, got[1].drift, got[1].evidence) == (9, "            out = mla_kernel(\n                q, 1)", "if self.fast:", False, "statement")
    assert got[2].drift and got[2].body.startswith("        if self.fast:") and got[2].evidence == "body"
    assert got[3].evidence == "no function" and got[4].evidence == "no file"
    assert spark.range(1).select(X.call_tokens(F.array(F.lit("run")), F.lit("sgl::op"), F.lit("sm90_a_b_impl_kernel_v2"))).first()[0] == ["run", "sgl::op", "op", "sm90_a_b_impl_kernel_v2", "sm90_a_b_impl", "a_b_impl", "b_impl", "sm90_a_b"]
