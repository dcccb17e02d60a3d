import itertools

import corpus
import pytest
from pyspark.sql import functions as F

from lanespan.llm import substring_dedup as substring_dedup_module
from lanespan.llm.common import connected
from lanespan.llm.exact_dedup import drop_copies, exact_dedup
from lanespan.llm.ngram_join import block_links, drop_near_copies, ngram_join, similar, slack
from lanespan.llm.substring_dedup import substring_dedup, without_spans


@pytest.fixture(scope="module")
def rows():
    return corpus.texts()


def test_exact_dedup_matches_brute_force(spark, rows):
    got = exact_dedup(corpus.frame(spark, rows), hot_share=1 / 1024).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == corpus.exact_groups(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) and all(r.doc_id == r.keep_id for r in kept)


def test_exact_dedup_with_a_hot_group(spark):
    rows = [(i, "one text" + " " * (i % 3)) for i in range(400)] + [(1000 + i, f"t{i}") for i in range(300)]
    got = exact_dedup(corpus.frame(spark, rows, parts=5)).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == corpus.exact_groups(rows)
    assert sum(r.kept for r in got) == 301


def test_exact_dedup_compares_content_where_digests_clash(spark, rows):
    hot = [(5000 + i, "aa" if i % 3 else "bb") for i in range(300)]
    for some in (rows, rows + hot):
        got = exact_dedup(corpus.frame(spark, some, parts=5), key=F.length).collect()
        assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == corpus.exact_groups(some)


def test_drop_copies_keeps_one_of_repeated_rows_and_all_columns(spark, rows):
    docs = corpus.frame(spark, rows)
    out = drop_copies(docs)
    assert out.columns == docs.columns
    want = {(k, s) for _, k, _, s in corpus.exact_groups(rows)}
    assert sorted(r.doc_id for r in out.collect()) == sorted(k for k, _ in want)


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80), (2, 60)])
def test_ngram_join_matches_brute_force(spark, rows, k, percent):
    got = ngram_join(corpus.frame(spark, rows), k, percent).collect()
    assert sorted(tuple(r) for r in got) == corpus.components(rows, k, percent)


def test_ngram_join_in_a_large_group_of_near_copies(spark):
    base = [f"b{i}" for i in range(90)]
    rows = [(i, " ".join([*base[: i % 88], f"x{i}", *base[i % 88 + 1 :]])) for i in range(150)]
    rows += [(1000 + i, " ".join([*base[:60], *[f"y{i}.{j}" for j in range(30)]])) for i in range(60)]
    assert sorted(tuple(r) for r in ngram_join(corpus.frame(spark, rows), 3, 90).collect()) == corpus.components(rows, 3, 90)


def test_blocks_count_overlaps_by_slice():
    import numpy as np

    sets = [np.arange(0, 100, dtype=np.uint64), np.arange(3, 103, dtype=np.uint64), np.arange(500, 600, dtype=np.uint64)]
    groups, one = np.arange(3), np.zeros(3)
    assert block_links(sets, groups, one, 90) == [(0, 1)]
    assert block_links(sets, np.array([0, 0, 1]), one, 90) == []
    assert slack(100, 90) == 11 and similar(100, 100, 95, 90) and not similar(100, 100, 94, 90)


def test_drop_near_copies_keeps_the_smallest(spark, rows):
    docs = corpus.frame(spark, rows)
    out = drop_near_copies(docs, 5, 80)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(i for i, _, c in corpus.components(rows, 5, 80) if i == c)


@pytest.mark.parametrize("n", [20, 6])
def test_substring_dedup_matches_brute_force(spark, rows, n):
    got = substring_dedup(corpus.frame(spark, rows), n).collect()
    want = corpus.repeats(rows, n)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id]
    text = dict(rows)
    long = next(r for r in got if r.spans and r.n_removed < r.n_words)
    assert len(without_spans(text[long.doc_id], long.spans).split()) == long.n_words - long.n_removed


def test_substring_dedup_matches_brute_force_over_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = corpus.repeats([tuple(r) for r in docs.collect()], 20)
    got = substring_dedup(docs).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want and any(r.n_removed for r in got)


@pytest.mark.parametrize("limit", [500, 40, 2])
def test_groups_too_large_are_cut_by_longer_prefixes_and_then_merged_in_parts(spark, rows, monkeypatch, limit):
    """The least limit leaves groups that no prefix can cut, and blocks of few texts repeat the same windows."""
    monkeypatch.setattr(substring_dedup_module, "GROUP_SUFFIXES", limit)
    more = [(100 + i, f"a{i} " + " ".join(f"s{j}" for j in range(60)) + f" b{i}") for i in range(40)]
    got = substring_dedup(corpus.frame(spark, rows + more, parts=8), 20).collect()
    want = corpus.repeats(rows + more, 20)
    for r in got:
        assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id]


def test_substring_dedup_tells_texts_apart_whose_first_keys_clash(spark, rows):
    import zlib

    got = substring_dedup(corpus.frame(spark, rows, parts=5), 20, key=lambda joined: (len(joined) % 3, zlib.crc32(joined))).collect()
    want = corpus.repeats(rows, 20)
    for r in got:
        assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id]


def test_substring_dedup_of_long_rows_that_are_there_twice(spark):
    line = [f"w{i}" for i in range(50)]
    rows = [(3, " ".join(line)), (3, " ".join(line)), (5, " ".join(["x", *line, "y"])), (5, " ".join(["x", *line, "y"])), (7, " ".join(["z"] * 300))]
    want = corpus.repeats(rows, 20)
    for parts in (1, 4):
        got = substring_dedup(corpus.frame(spark, rows, parts=parts), 20).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id]


def test_subtrees_have_the_common_prefixes_of_neighbours():
    import numpy as np

    text = np.array([4, 1, 2, 3, 9, 1, 2, 3, 8, 1, 2, 7, 7, 7, 7, 7], np.uint16)
    words = np.array([[*text[i : i + 4], 5, 5] for i in range(13)], np.uint16)
    order, common = substring_dedup_module.ordered(words, np.zeros(13, np.uint64), np.arange(13, dtype=np.uint32), [np.zeros(13, np.int64)])
    got = [tuple(words[i]) for i in order]
    assert got == sorted(got)
    assert 4 in common.tolist()[1:] and common.tolist() == [0] + [next((j for j in range(4) if a[j] != b[j]), 4) for a, b in itertools.pairwise(got)]


def test_substring_dedup_needs_integer_ids(spark):
    with pytest.raises(ValueError, match="integer"):
        substring_dedup(spark.createDataFrame([("a", "x")], "doc_id string, text string"))


def test_empty_tables(spark):
    none = corpus.frame(spark, [(1, "x")]).limit(0)
    for f in (exact_dedup, ngram_join, substring_dedup, drop_copies, drop_near_copies):
        assert f(none).collect() == []


def test_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (1, "a b c d"), (None, None)], "doc_id long, text string")
    assert {(r.keep_id, r.group_size) for r in exact_dedup(docs).collect()} == {(1, 2), (None, 1)}
    assert len(ngram_join(docs).collect()) == 3 and len(substring_dedup(docs, 2).collect()) == 3


def test_connected_follows_long_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = dict(map(tuple, connected(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_sweep_spares_what_is_read(spark):
    from lanespan.llm import common

    a, b = (common.stash(spark.range(n)) for n in (3, 4))
    common.sweep(spark, b)
    assert b.count() == 4 and len(common._SCRATCH) == 1
    with pytest.raises(Exception, match="not exist|NOT_EXIST|FileNotFound"):
        spark.read.parquet(*a.inputFiles()).count()
    common.sweep(spark)
    assert common._SCRATCH == []
