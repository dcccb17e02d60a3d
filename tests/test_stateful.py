"""Streams with state against the batch results of the same rows."""

import random

import pytest
from pyspark.sql import functions as F

from lanespan.operators import intervals as I
from lanespan.streaming import stateful as T


def polls(seed: int):
    """Three logs polled three times: one grows, one begins again and again, one is empty for a while."""
    r = random.Random(seed)
    out = []
    for log in "abc":
        lines: list[tuple[int, int, str]] = []
        for poll in range(3):
            if log == "b" and poll or log == "c" and poll == 1:
                lines = lines[: r.randrange(2)] if log == "b" else []
            for _ in range(0 if log == "c" and poll == 1 else r.randrange(1, 5)):
                at = sum(x[1] for x in lines)
                text = "t" * r.randrange(1, 9)
                lines.append((at, len(text) + 1, text))
            end = sum(x[1] for x in lines)
            out += [(log, poll, end, *x) for x in lines] or [(log, poll, 0, None, None, None)]
    return out


@pytest.mark.parametrize(("seed", "expiry"), [(1, 0), (2, 3_600_000)])
def test_tail_of_growing_and_shrinking_logs(spark, seed, expiry):
    df = spark.createDataFrame(polls(seed), "log string, poll long, end long, offset long, size long, text string")
    stream = T.arrivals(df.withColumn("batch", F.col("poll")), "batch", 3)
    got = sorted(map(tuple, T.drained(T.tail(stream, 30, expiry), by_clock=expiry > 0).collect()))
    assert got == sorted(map(tuple, T.tail_of(df, 30).collect())) and any(x[1] > 0 for x in got)


def test_shuffled_intervals_make_the_same_stretches(spark):
    r = random.Random(4)
    rows = [(r.randrange(3), s := r.randrange(0, 400_000_000), s + r.randrange(0, 6_000_000)) for _ in range(240)]
    late = 60_000_000
    df = spark.createDataFrame([(*x, (x[1] + r.randrange(late)) // 120_000_000) for x in rows], "lane long, s long, e long, batch long")
    all_, n = T.with_end(df, "batch", 4, "lane")
    got = T.drained(T.busy_stretches(T.arrivals(all_, "batch", n), "60 seconds"))
    want = I.islands(df, ["lane"]).select("lane", "s", "e", "n", "busy")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_units_by_template(spark):
    r = random.Random(5)
    rows, t = [], 0
    for i in range(200):
        t += r.randrange(1, 5)
        rows.append((i % 2, t, i, r.choice("ab") if i % 11 else "m", t + r.randrange(9), i % 11 in (0, 1), t // 170))
    df = spark.createDataFrame(rows, "lane long, s long, id long, name string, e long, marks boolean, batch long")
    got = T.accepted(T.arrivals(df, "batch", max(x[-1] for x in rows) + 1))
    import hashlib

    stats = {}
    for lane in (0, 1):
        own = [x for x in rows if x[0] == lane]
        marks = [k for k, x in enumerate(own) if x[5]]
        for a, b in zip(marks, marks[1:], strict=False):
            template = hashlib.sha256(">".join(x[3] for x in own[a:b]).encode()).hexdigest()
            for p, x in enumerate(own[a:b]):
                stats.setdefault((template, p), []).append(x[4] - x[1])
    want = sorted((*k, len(v), min(v), max(v), sum(v) / len(v)) for k, v in stats.items())
    assert sorted(map(tuple, got.collect())) == want
