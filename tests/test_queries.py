"""Every engine query against its SQL, and interval operators against a plain model."""

import random

import oracle
import pytest
from pyspark.sql import functions as F

from lanespan.functions import symbols
from lanespan.operators import intervals as I
from lanespan.operators import joins as J
from lanespan.operators import segments as S
from lanespan.plans.catalogue import ORACLE_SQL, QUERIES
from lanespan.sources import capture, sinks
from lanespan.streaming import events


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, sf, name):
    assert oracle.differences(spark, QUERIES[name], ORACLE_SQL[name], sf) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_has_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 15
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def model_union(iv):
    out, end = 0, None
    for s, e in sorted(iv):
        if e > s:
            out += max(0, e - (s if end is None else max(s, end)))
            end = e if end is None else max(e, end)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_intervals_match_a_plain_model(spark, seed):
    r = random.Random(seed)
    rows = [(r.randrange(3), r.choice("ab"), i, s := r.randrange(-50, 400), s + r.randrange(0, 60)) for i in range(120)]
    df = spark.createDataFrame(rows, "device int, stream string, id long, s long, e long")
    got = {x.device: x for x in I.union_length(df, ["device"], cell=37).collect()}
    for d in range(3):
        assert got[d].busy_union == model_union([(s, e) for k, _, _, s, e in rows if k == d])
    holes = I.holes(df, ["device"], cell=11).groupBy("device").agg(F.sum(F.col("hole_end") - F.col("hole_start")).alias("idle")).collect()
    for x in holes:
        assert x.idle == got[x.device].wall - got[x.device].busy_union
    ratio = {x.id: x.ratio for x in I.concurrency(df.where("e > s"), cell=23).collect()}
    for k, st, i, s, e in rows:
        if e > s:
            other = [(max(s, a), min(e, b)) for d, t, _, a, b in rows if d == k and t != st]
            assert ratio[i] == pytest.approx(model_union(other) / (e - s))


def test_asof_across_cells(spark):
    r = random.Random(2)
    ev = [(r.randrange(2), r.randrange(1000), i) for i in range(40)]
    pr = [(r.randrange(3), r.randrange(1200), i) for i in range(60)]
    got = J.asof(spark.createDataFrame(pr, "k int, t long, probe int"), spark.createDataFrame(ev, "k int, t long, ev int"), "k", "t", ["ev"], cell=50)
    want = {p: max(((t, e) for kk, t, e in ev if kk == k and t <= at), default=(0, None))[1] for k, at, p in pr}
    assert {x.probe: x.ev for x in got.collect()} == want


def test_ancestors_stop_at_cycles_and_depth(spark):
    rows = [(i, i - 1 if i else None) for i in range(100)] + [(200, 201), (201, 200)]
    got = {r.node: r for r in J.ancestors(spark.createDataFrame(rows, "n int, p int"), "n", "p").collect()}
    assert got[99].depth == 64 and got[10].path == list(range(11)) and got[200].depth == 64


def test_blocks_and_steps_agree(spark, sf):
    from lanespan.sources.tables import intervals

    iv = intervals(spark, sf)
    a = S.in_steps(iv, F.expr("stream = 'signup'"), ["device"]).groupBy("device", "a", "b").count()
    b = S.steps(iv, F.expr("stream = 'signup'"), ["device"]).select("device", "a", "b")
    assert b.join(a, ["device", "a", "b"], "left_anti").count() == 0


def test_symbols(spark):
    one = lambda f, x: spark.range(1).select(f(F.lit(x)).alias("x")).first().x
    assert one(symbols.symbol_leaf, "void at::native::(anonymous namespace)::f<a<b>, c>(int)") == "f"
    assert one(symbols.symbol_leaf, "a::foo<b>::run(int)") == "foo" and one(symbols.symbol_leaf, "(x)") == ""
    assert one(symbols.symbol_simplified, "void ns::g<" + "x" * 100 + ">(int)") == "g<…>" and one(symbols.symbol_simplified, "void ns::topk_kernel<int>(int)") == "topk_kernel<int>"
    assert tuple(one(symbols.template_arguments, "f<a<b,c>, (d,e), g>")) == ("f", ["a<b,c>", "(d,e)", "g"]) and one(symbols.template_arguments, "f(x)").args is None
    names = spark.createDataFrame([(x,) for x in ("k<1, 2, 3>", "k<1, 4, 3>", "p<" + "z" * 70 + ", 1>", "p<" + "z" * 70 + ", 2>", "p<…>", "n" * 90)], "name string")
    got = {r.name: r.label for r in symbols.kernel_labels(names).collect()}
    assert len(set(got.values())) == 6 and got["p<" + "z" * 70 + ", 2>"] == "p<2, …>" and got["k<1, 2, 3>"] == "k<1, 2, 3>"
    env = {"TP": "8", "N": "$((TP * 2 + 1))", "A": "$B", "B": "$A"}
    assert symbols.shell_int("$((N - 3) / 2))", env) is None and symbols.shell_int("$(((N - 3) / 2))", env) == 7 and symbols.shell_int("$A", env) is None


def test_capture_metadata(spark):
    rows = [("PROCESS_10:COMMAND", "run"), ("PROCESS_10:ARGUMENT_0", "a"), ("PROCESS_10:ARGUMENT_2", "lost"), ("PROCESS_2:ARGUMENT_1", "y"), ("PROCESS_2:ARGUMENT_0", "x y"), ("OTHER", "z")]
    got = {r.process: r.argv for r in capture.argv(spark.createDataFrame(rows, "name string, value string")).collect()}
    assert got == {10: ["run", "a"], 2: ["x y", "y"]}
    line = spark.createDataFrame([("server_args=ServerArgs(tp_size=8, model='m/x', dtype=None)",)], "t string")
    assert line.select(*capture.server_args(F.col("t"), ["tp_size", "model", "dtype", "none"])).first() == ("8", "m/x", None, None)


def test_sinks(spark, tmp_path):
    import io
    import zipfile

    df = spark.createDataFrame([(1, "a|b\nc"), (2, None), (3, "x" * 40_000)], "n int, t string").coalesce(1)
    data, rows = sinks.workbook(df, "s")
    sheet = zipfile.ZipFile(io.BytesIO(data)).read("xl/worksheets/sheet1.xml").decode()
    assert rows == 3 and "<v>2</v>" in sheet and "x" * 32_767 in sheet and "x" * 32_768 not in sheet and 'ref="A1:B4"' in sheet
    assert [r.text for r in sinks.markdown(df.limit(1)).orderBy("line").collect()] == ["| n | t |", "|---|---|", "| 1 | a\\|b c |"]
    sinks.write_csv(df.limit(2), f"{tmp_path}/csv", ["t", "n"], ["n"])
    assert spark.read.option("header", True).option("multiLine", True).csv(f"{tmp_path}/csv").columns == ["t", "n"]
    assert sinks.column_name(0) == "A" and sinks.column_name(27) == "AB"


def test_running_union_as_a_stream(spark, sf):
    from lanespan.sources.tables import intervals

    got = {r.lane: r.busy for r in events.running_union(spark, sf).groupBy("lane").agg(F.sum(F.col("e") - F.col("s")).alias("busy")).collect()}
    want = {r.device: r.busy_union for r in I.union_length(intervals(spark, sf), ["device"]).collect()}
    assert got == want
