import collections
import random

import corpus
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lanespan.llm.common import connected
from lanespan.llm.simhash import Forest, drop_near_copies, fingerprint, near, simhash, widths

FOLD = corpus.FOLD


def plain_fingerprint(t, k=3):
    w = (t or "").encode().translate(FOLD).split()
    grams = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def plain_components(fps, bits):
    fps = sorted(fps)
    head = list(range(len(fps)))

    def top(a):
        while head[a] != a:
            a = head[a]
        return a

    f = np.array(fps, np.uint64)
    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i] ^ f[i + 1 :]) <= bits) + i + 1:
            a, b = top(i), top(int(j))
            head[max(a, b)] = min(a, b)
    return {fps[i]: top(i) for i in range(len(fps))}


def groups(label):
    out = collections.defaultdict(set)
    for node, root in label.items():
        out[root].add(node)
    return {frozenset(x) for x in out.values() if len(x) > 1}


def clouds(seed, n=500):
    """Fingerprints around a few centres, many with one segment in common, and some apart."""
    r = random.Random(seed)
    centres = [r.getrandbits(64) for _ in range(6)]
    out = {0, (1 << 64) - 1}
    while len(out) < n:
        x = r.choice(centres)
        for _ in range(r.randrange(8)):
            x ^= 1 << r.randrange(64)
        out.add(x if r.random() < 0.8 else centres[0] & 0xFFFF << 48 | r.getrandbits(48))
    return out


@pytest.mark.parametrize(("bits", "crowd"), [(3, (128, 1024)), (3, (4, 4)), (3, (1, 1)), (1, (2, 2)), (2, (3, 3)), (5, (8, 8))])
def test_pairs_are_found_whatever_counts_as_a_crowd(spark, bits, crowd):
    fps = clouds(bits)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    label = {r.node % (1 << 64): r.label for r in connected(near(spark.createDataFrame(signed, "fp long"), bits, crowd, 40)).collect()}
    assert groups(label) == groups(plain_components(fps, bits))


def test_simhash_matches_brute_force(spark):
    rows = corpus.texts(3, 90)
    long_ = " ".join(f"w{i % 977}" for i in range(9000))
    rows += [(2000 + i, long_ + f" end{i}") for i in range(30)] + [(3000, long_.upper()), (3001, long_.upper())]
    got = simhash(corpus.frame(spark, rows)).collect()
    fp = [(i, plain_fingerprint(t)) for i, t in rows]
    assert all(fingerprint((t or "").encode()) == f for (_, t), (_, f) in zip(rows, fp, strict=True))
    label = plain_components({f for _, f in fp}, 3)
    low = collections.defaultdict(lambda: 1 << 62)
    for i, f in fp:
        low[label[f]] = min(low[label[f]], i)
    assert sorted(map(tuple, got)) == sorted((i, f"{f:016x}", low[label[f]]) for i, f in fp)
    kept = drop_near_copies(corpus.frame(spark, rows))
    assert sorted({r.doc_id for r in kept.collect()}) == sorted(set(low.values()))


def test_spark_has_the_same_hash(spark):
    text = "Été b c"
    mine = fingerprint(text.encode())
    assert spark.range(1).select(F.hex(F.xxhash64(F.lit("Été b c")))).first()[0].lower() == f"{mine:016x}"


def test_odd_tables(spark):
    assert simhash(corpus.frame(spark, [(1, "x")]).limit(0)).collect() == []
    docs = spark.createDataFrame([(None, "a b c d"), (1, "a b c d"), (None, "zz y"), (7, None), (8, "")], "doc_id long, text string")
    got = sorted(map(tuple, simhash(docs).collect()), key=repr)
    assert [r[2] for r in got if r[1] == "0" * 16] == [7, 7] and sum(r[2] == 1 for r in got) == 2 and sum(r[2] is None for r in got) == 1
    with pytest.raises(ValueError, match="bits"):
        simhash(docs, bits=9)
    assert [sum(widths(b)) for b in range(1, 8)] == [64] * 7


def test_a_forest_stays_small():
    f = Forest()
    f.MOST = 50
    r = np.random.default_rng(1)
    for _ in range(30):
        a = r.integers(0, 60, 40).astype(np.uint64)
        f.add(a, a // np.uint64(2))
    a, b = f.links()
    assert len(a) <= 60 and (b == 0).all()
