import collections
import hashlib

import corpus
import numpy as np
import public_tokenizers
import pytest

from lanespan.llm import token_alignment as T

ODD = [" ", "  ", "a", "a ", " a", "\n", "\na\n\nb \t c", "a▁b", "x\x00y", "<|endoftext|> hi <s> </s>", "été 日本語 🎉🎉", "a  b   c", "tab\tend \n x", "don't I'll we're", "a　b   c", "x" * 3000, "\x1c a \x1d b", "\x85 q ​ z", "12345 67 8.9e-3"]


@pytest.fixture(scope="module")
def pair():
    return T.Pair(*map(public_tokenizers.path, (T.LEFT, T.RIGHT)))


def plain(pair, t):
    """Ids on both sides, and the groups as pairs of id lists, by the libraries and a walk over byte offsets."""
    if not t:
        return [], [], []
    data = (" " + t).encode()
    ids = pair.left.encode(" " + t, add_special_tokens=False).ids, pair.right.encode(t)
    parts = [pair.left_bytes[i] for i in ids[0]], [pair.right_bytes[i] for i in ids[1]]
    if any(b"".join(p) != data for p in parts):
        return [], [], []
    ends = [np.cumsum([len(x) for x in p]).tolist() for p in parts]
    groups, at = [], [0, 0]
    for c in sorted(set(ends[0]) & set(ends[1])):
        to = [e.index(c) + 1 for e in ends]
        groups.append((ids[0][at[0] : to[0]], ids[1][at[1] : to[1]]))
        at = to
    return *ids, groups


def text_of(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def test_alignment_matches_the_libraries(spark, pair):
    rows = [*corpus.texts(2, 40), *((500 + k, t) for k, t in enumerate(ODD)), (None, "same same"), (None, "same same")]
    got = T.align(corpus.frame(spark, rows), with_groups=True).collect()
    aligned = [(i, plain(pair, t)) for i, t in rows]
    count = collections.Counter((a[-1], b[-1]) for _, (_, _, groups) in aligned for a, b in groups)
    best = collections.defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    want = []
    for i, (a, b, groups) in aligned:
        own = [count[x[-1], y[-1]] for x, y in groups]
        top = sum(count[x[-1], y[-1]] == best[y[-1]] for x, y in groups)
        text = text_of(groups)
        want.append((i, len(a), len(b), len(groups), len(groups), top, sum(own), hashlib.sha256(text.encode()).hexdigest() if text else "", text))
    assert sorted((tuple(r)[:9] for r in got), key=repr) == sorted(want, key=repr)
    for r in got:
        assert len(r.ends) == r.n_groups and r.ends == sorted(r.ends)
    assert sum(r.n_a > 0 for r in got) > 50 and sum(r.n_a == 0 for r in got) >= 4
    by_id = {r.doc_id: r for r in got}
    assert by_id[500 + ODD.index("a▁b")].n_a == 0 and by_id[500 + ODD.index("<|endoftext|> hi <s> </s>")].n_a > 5


def test_successors_end_at_the_last_token():
    a, b = T.terminals(np.array([3, 1, 2, 4]), np.array([1, 1, 3, 1, 4]))
    assert a.tolist() == [2, 2, 2, 3] and b.tolist() == [2, 2, 2, 2, 3]
    n = 40  # a chain in which each token overlaps the next of the other side
    a, b = T.terminals(np.array([1] + [2] * n + [1]), np.array([2] * n + [2]))
    assert set(a.tolist()) == {n + 1} == set(b.tolist())


def test_forgetting_changes_nothing(pair, monkeypatch):
    texts = [t for _, t in corpus.texts(4, 30) if t] + ODD
    want = pair.ids(texts)
    monkeypatch.setattr(T, "REMEMBERED", 50)
    few = T.Pair(*map(public_tokenizers.path, (T.LEFT, T.RIGHT)))
    assert [x for k in range(0, len(texts), 3) for x in few.ids(texts[k : k + 3])] == want


def test_totals_add_up(monkeypatch):
    monkeypatch.setattr(T, "MERGE_PAIRS", 10)
    t = T.Totals()
    for k in range(40):
        t.add(np.array([1, k % 3 + 5]), np.array([1, 2]))
    keys, n = t.merged()
    assert keys.tolist() == [1, 5, 6, 7] and n.sum() == 120


def test_empty_table(spark):
    assert T.align(corpus.frame(spark, [(1, "x")]).limit(0)).collect() == []
    assert T.pair_counts(T.cut(corpus.frame(spark, [(1, "a b"), (2, "a b")]))).count() == 2
