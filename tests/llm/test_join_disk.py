"""Disk of the n-gram join: packed tokens are not written besides their shuffle, sets go to pairs of blocks in bounded rounds, and shuffles end with their query."""

import corpus
from pyspark.sql import functions as F

from lanespan.llm import common, ngram_join


def texts():
    """One family of many sizes (each text begins like the next longer one), near copies of some, and others."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[: 12 + 2 * i])) for i in range(150)]
    rows += [(500 + i, " ".join([*words[: 12 + 2 * i], "x"])) for i in range(0, 150, 2)]
    return rows + [(900 + i, t) for i, (_, t) in enumerate(corpus.texts(3, 30))]


def test_rounds_find_what_one_pass_finds(spark, monkeypatch):
    rows, stashed, sent = texts(), [], []
    keep, verify = ngram_join.stash, ngram_join.verified_in_fragments
    monkeypatch.setattr(ngram_join, "stash", lambda df, *a: (stashed.extend(df.columns), keep(df, *a))[1])
    monkeypatch.setattr(ngram_join, "verified_in_fragments", lambda held, percent: (sent.append(held.agg(F.sum("n")).first()[0] or 0), verify(held, percent))[1])
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    monkeypatch.setattr(ngram_join, "LEAST_ROUND", 1 << 12)
    docs = corpus.frame(spark, rows)
    for percent in (80, 90):
        sent.clear()
        got = ngram_join.ngram_join(docs, 3, percent, with_links=True)
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == corpus.components(rows, 3, percent)
        assert len(sent) > 1
        plain = ngram_join.ngram_join(docs, 3, percent)
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in plain.collect()) == corpus.components(rows, 3, percent)
    assert "payload" not in stashed


def test_blocks_meet_those_of_fitting_sizes_only(spark, monkeypatch):
    """Without regard to size, a family of k blocks sends each of its sets k times."""
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    sent, verify = [], ngram_join.verified_in_fragments
    monkeypatch.setattr(ngram_join, "verified_in_fragments", lambda held, percent: (sent.append(held.count()), verify(held, percent))[1])
    family = [r for r in texts() if r[0] < 500]
    ngram_join.ngram_join(corpus.frame(spark, family), 3, 90, with_links=True).collect()
    assert sum(sent) < 150 * (150 / 16) * 0.6


def test_stash_leaves_no_shuffle(spark):
    def files():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}

    before = files()
    common.stash(spark.range(50_000).groupBy(F.col("id") % 9973).count())
    assert not files() - before
