"""Joins by level and cells from the data: the same in any unit, few rows for long intervals, no crowded lane in one window."""

import random

import pytest
from pyspark.sql import functions as F

from lanespan.operators import intervals as I
from lanespan.operators import joins as J
from lanespan.operators import origin as O
from lanespan.operators import segments as S

UNITS = (1, 1000)


def made(seed: int, unit: int, n: int = 150):
    r = random.Random(seed)
    out = []
    for i in range(n):
        s = r.randrange(-5_000, 90_000)
        out.append((r.randrange(3), r.choice("ab"), i, s * unit, (s + r.choice([0, 1, 3, 200, 9_000, 200_000]) + r.randrange(50)) * unit))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "device int, stream string, id long, s long, e long")


@pytest.mark.parametrize("unit", UNITS)
def test_overlaps_are_each_found_once(spark, unit):
    a, b = made(1, unit), made(2, unit)
    got = I.overlap_join(frame(spark, a), frame(spark, b), ["device"]).collect()
    want = [(x[2], y[2]) for x in a for y in b if x[0] == y[0] and x[4] > x[3] and y[4] > y[3] and x[3] < y[4] and y[3] < x[4]]
    assert sorted((g.id, g.id2) for g in got) == sorted(want) and len(want) > 100


def test_a_bound_that_does_not_hold_is_an_error(spark):
    with pytest.raises(Exception, match="longer than 10"):
        I.overlap_join(frame(spark, [(1, "a", 1, 0, 500)]), frame(spark, [(1, "a", 1, 0, 5)]), ["device"], 10).collect()


@pytest.mark.parametrize("unit", UNITS)
def test_innermost_and_enclosing_frames(spark, unit):
    frames, points = made(3, unit), made(4, unit, 80)
    p = frame(spark, points)
    got = {x.id: (x.frame, x.frame_len) for x in J.innermost(p.withColumn("t", F.col("s")).select("device", "id", "t"), frame(spark, frames), ["device"], "t", "id").collect()}
    for d, _, i, s, _ in points:
        assert got[i] == min(((f, e - a) for k, _, f, a, e in frames if k == d and a <= s < e), key=lambda x: (x[1], x[0]), default=(None, None))
    got = {x.id: (x.frame, x.whole) for x in J.enclosing(p, frame(spark, frames), ["device"], "id").collect()}
    for d, _, i, s, e in points:
        own = [(b < e, b - a, f) for k, _, f, a, b in frames if k == d and a <= s <= b]
        best = min(own, default=None)
        assert got[i] == ((best[2], not best[0]) if best else (None, False))


def test_a_long_interval_costs_a_few_rows(spark):
    df = frame(spark, [(1, "a", 1, -5, 1 << 50), (1, "a", 2, 0, 1)])
    assert {r.id: r.n for r in I.own_nodes(df).groupBy("id").agg(F.count(F.lit(1)).alias("n")).collect()} == {1: 2, 2: 1}
    assert len(I.levels_to(1 << 62)) <= 17


def test_cells_follow_the_data(spark, monkeypatch):
    rows = made(5, 1, 400)
    want = None
    for unit in UNITS:
        df = frame(spark, [(d, k, i, s * unit, e * unit) for d, k, i, s, e in rows])
        assert I.cell_of(df, ["device"], "s") == I.WHOLE
        whole = sorted(map(tuple, I.islands(df, ["device"]).collect()))
        monkeypatch.setattr(I, "ROWS", 20)
        cell = I.cell_of(df, ["device"], "s")
        assert 1 < cell < 95_000 * unit / 3
        assert sorted(map(tuple, I.islands(df, ["device"]).collect())) == whole
        numbers = sorted((r.device, r.idx, r.id) for r in S.numbered(df, ["device"], ["s", "id"]).collect())
        monkeypatch.setattr(I, "ROWS", 50_000)
        assert numbers == sorted((r.device, r.idx, r.id) for r in S.numbered(df, ["device"], ["s", "id"]).collect())
        scaled = [(d, s // unit, e // unit, n, b // unit) for d, s, e, n, b in whole]
        want = want or scaled
        assert scaled == want


def test_unit_windows_with_confirmed_anchors(spark, monkeypatch):
    r = random.Random(6)
    rows = [(r.randrange(2), i * 10, i * 10 + 5, r.choice(["head", "x", "y", "tail"])) for i in range(120)]
    df = spark.createDataFrame(rows, "device int, s long, e long, name string")
    want = []
    for d in (0, 1):
        own = [x for x in rows if x[0] == d]
        hits = [x[1] for k, x in enumerate(own) if x[3] == "head" and any(y[3] == "tail" for y in own[k + 1 : k + 4])]
        want += [(d, u, a, b) for u, (a, b) in enumerate(zip(hits, hits[3:], strict=False))]
    for n in (50_000, 10):
        monkeypatch.setattr(I, "ROWS", n)
        assert sorted(map(tuple, O.unit_windows(df, "head", 3, "tail", 2).collect())) == sorted(want)
