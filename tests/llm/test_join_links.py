import itertools

import corpus

from lanespan.llm import ngram_join


def linked(rows, k, percent):
    """Of each row, with how many others it is linked."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().translate(corpus.FOLD).split()
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    n = [0] * len(rows)
    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            n[a] += 1
            n[b] += 1
    return sorted((i, c) for (i, _), c in zip(rows, n, strict=True))


def test_query_counts_every_link(spark, tmp_path, monkeypatch):
    """Near copies of one text, of which some are linked with some only, with copies among them and in blocks of a few classes."""
    base = [f"b{i}" for i in range(120)]
    rows = [(i, " ".join([*base[: i % 118], f"x{i}", *base[i % 118 + 1 :]])) for i in range(130)]
    rows += [(200 + i, rows[i][1]) for i in range(0, 40, 3)]
    rows += [(300 + i, " ".join([*base[i:], *[f"y{j}" for j in range(i)]])) for i in range(0, 12)]
    rows += [(400 + i, t) for i, (_, t) in enumerate(corpus.texts(2, 40))]
    corpus.frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    got = ngram_join.query(spark, str(tmp_path)).collect()
    want = linked(rows, ngram_join.SHINGLE, ngram_join.PERCENT)
    assert sorted((r.doc_id, r.n_links) for r in got) == want and max(n for _, n in want) > 20
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == corpus.components(rows, ngram_join.SHINGLE, ngram_join.PERCENT)
