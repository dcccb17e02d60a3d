import math
import random

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from lanespan.llm import hard_negatives as H

SF = "/root/testdata/sf0.001"


def plain(rows, asked, first=5, least=80, most=100):
    """rows: (id, vector, label)."""
    fine = [(i, [math.floor(256 * x) for x in v], c) for i, v, c in rows if c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, v, c) in enumerate(fine):
        if i is None or not asked(i):
            continue
        score = [(-sum(x * y for x, y in zip(v, w, strict=False)), j is None, j or 0, k, own) for k, (j, w, own) in enumerate(fine) if k != a]
        for p in sorted(s[:4] for s in score if s[4] == c)[:first]:
            ok = sorted(s[:4] for s in score if s[4] != c and least * -p[0] <= 100 * -s[0] <= most * -p[0])[:first]
            out += [(i, None if p[1] else p[2], r, None if s[1] else s[2], -p[0], -s[0]) for r, s in enumerate(ok, 1)]
    return sorted(out, key=repr)


def made(seed, n=120, size=7, labels=4):
    r = random.Random(seed)
    rows = [(i, [r.gauss(0.2, 1) for _ in range(size)], r.randrange(labels)) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [1.0] * 6 + [None], 1), (n + 2, [float("nan")] * size, 2), (n + 3, [float("inf")] * size, 2), (n + 4, [0.1] * size, None), (n + 5, [], 1), (n + 6, [1.0, 2.0], 2), (None, [0.5] * size, 1)]
    return rows + [rows[10], rows[10], rows[20], (3, rows[3][1], 3)]


@pytest.mark.parametrize(("seed", "anchors", "candidates"), [(1, 2048, 4096), (2, 5, 17), (3, 1, 1000)])
def test_mining_matches_brute_force(spark, seed, anchors, candidates):
    rows = made(seed)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, key string, score long").repartition(4)
    got = H.hard_negatives(df, F.col("vec_id") % 10 == 0, anchors=anchors, candidates=candidates).collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows, lambda i: i % 10 == 0) and len(got) > 50


def test_hot_label_and_ties(spark):
    r = random.Random(5)
    rows = [(i, [float(r.randrange(3)) for _ in range(4)], 0 if i % 3 else i % 7) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = H.hard_negatives(df, F.col("vec_id") % 25 == 0, candidates=64).collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows, lambda i: i % 25 == 0)


def test_query_matches_sql(spark):
    assert oracle.differences(spark, H.query, H.ORACLE, SF) == ""


def test_packed_scores_are_exact():
    r = np.random.default_rng(1)
    for size, far in ((1, 1), (5, 3), (64, 120), (3, 2**28)):
        v, a = r.integers(-far, far + 1, (1300, size)), r.integers(-far, far + 1, size)
        p = H.Packed(v, far, (size * (2 * far) ** 2).bit_length())
        assert np.array_equal(np.concatenate([p.scores(a, k) for k in range(len(p.cuts))]), v @ a)


def test_odd_tables(spark):
    df = spark.createDataFrame(made(4), "vec_id long, embedding array<double>, label int")
    yes = F.col("vec_id") % 10 == 0
    for odd in (df.limit(0), df.where("label = 1"), df.where("embedding is null"), df.where("vec_id % 10 <> 0")):
        assert H.hard_negatives(odd, yes).collect() == []
    with pytest.raises(ValueError, match="fit"):
        H.hard_negatives(spark.createDataFrame([(0, [1e12, 2.0], 1), (1, [1.0], 2)], df.schema), yes)
