import math
import random
import re
import zlib
from collections import Counter

import corpus
import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from lanespan.llm import token_counts as T
from lanespan.llm.decontam import Index, decontaminate, drop_contaminated
from lanespan.llm.common import alnum_words
from lanespan.llm.license_scan import BASE, MARKUP, TEMPLATES, Automaton, Scanner, license_scan
from lanespan.llm.lm_score import Totals, lm_scores
from lanespan.llm.mixing import mix, sampled

ODD = ["", "  a  b", "\n", "\n a", "a\n  \nb\t", "日本語 テスト😀 x", "   ", "<s> </s> <unk> <0x0A>", "▁▁x ▁", "a b", "a" * 300, "  \n\n  x", "\r\n);\r x", "é́", "Hello World's end!!", "▁ ", "▁ ia", "a▁ b", "▁", "\n▁\n ▁x", "▁\t▁▁"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(T.PIECES))


def test_counts_at_every_prefix_are_the_library_s(library):
    c = T.counter(T.PIECES)
    for t in ODD:
        assert T.last_of(c.steps(t)) == len(library.encode(t))
        assert c.counts(t).tolist() == [len(library.encode(t[:p])) for p in range(len(t) + 1)]


def test_counts_of_random_texts_are_the_library_s(library):
    """Blanks, their sign, line ends, letters of several alphabets, controls and special strings in all orders."""
    r, c = random.Random(5), T.counter(T.PIECES)
    bits = [" ", "  ", "▁", "▁ ", "\n", "\t", "\r", "\u00a0", "\u3000", "\u200b", "\x00", "a", "in", "the", "Th", "é", "e\u0301", "ß", "日", "😀", "<s>", "<0x41>", "</s>", "1", "99", ".", "!!", "İ", "\u2028"]
    for _ in range(400):
        t = "".join(r.choice(bits) for _ in range(r.randint(1, 25)))
        assert c.counts(t).tolist() == [len(library.encode(t[:p])) for p in range(len(t) + 1)], repr(t)


def test_counts_of_documents_are_the_library_s(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    for r in T.query(spark, sf).collect():
        n = len(library.encode(texts[r.doc_id]))
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(texts[r.doc_id].encode()), n > T.LIMIT)
        assert len(library.encode(texts[r.doc_id][: r.fits_chars])) <= T.LIMIT


def test_truncation_and_budgets_from_stored_counts(library):
    t = "Tokens are counted at each prefix, once and for all."
    data = T.pack(T.counter(T.PIECES).steps(t))
    for budget in (0, 1, 5, 100):
        cut = T.truncate_at(data, budget)
        assert len(library.encode(t[:cut])) <= budget
        assert all(len(library.encode(t[:p])) > budget for p in range(cut + 1, len(t) + 1))
    assert T.tokens_of(data, 10) == len(library.encode(t[:10])) and T.tokens_of(data, 999) == len(library.encode(t))


def test_token_counts_over_rows(spark, library):
    rows = [*enumerate(ODD), (90, None), (None, "x"), (91, "long " * 6000)]
    got = {r.doc_id: r for r in T.token_counts(corpus.frame(spark, rows), with_prefixes=True).collect()}
    for i, t in rows:
        n = len(library.encode(t or ""))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > T.LIMIT)
        assert T.tokens_of(got[i].prefixes, 10**9) == n
    assert T.token_counts(corpus.frame(spark, rows).limit(0)).collect() == []


def test_mixing_fills_targets_and_respects_caps(spark):
    rows = corpus.texts(3, 200)
    docs = corpus.frame(spark, rows)
    got = mix(docs, bucket=8).collect()
    again = mix(docs.repartition(7), bucket=8).collect()
    key = lambda r: (r.doc_id, r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
    total = sum(r.size for r in got)
    by = {r.source: r for r in got}
    assert math.isclose(sum(r.target for r in by.values()), total, rel_tol=1e-9)
    for s, r in by.items():
        assert r.target <= 3 * r.source_size + 1e-6
        assert abs(sum(x.taken for x in got if x.source == s) - r.target) <= 1
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    assert list(by) and mix(docs.limit(0)).collect() == []


def test_mixing_shares_excess_by_weight(spark):
    docs = spark.createDataFrame([(1, "a " * 10, "a"), (2, "b " * 1000, "b"), (3, "c " * 1000, "c"), (4, None, None)], "doc_id long, text string, source string")
    t = {r.source: r.target for r in mix(docs).collect()}
    assert t["a"] == 30 and math.isclose(t["b"] / t["c"], 2) and t[None] == 0 and math.isclose(sum(t.values()), 2010)


def test_the_mix_is_sampled_out(spark):
    rows = corpus.texts(3, 120)
    docs = corpus.frame(spark, rows)
    stated = {}
    for r in mix(docs, bucket=8).collect():
        stated[r.doc_id] = stated.get(r.doc_id, 0) + r.taken
    given, whole = Counter(), {}
    for i, t in rows:
        whole.setdefault(i, set()).add(t)
    for r in sampled(docs, bucket=8).collect():
        words = len(corpus.white_words(r.text))
        assert r.n_words == words > 0
        assert r.text in whole[r.doc_id] or any(corpus.white_words(t)[:words] == corpus.white_words(r.text) for t in whole[r.doc_id])
        given[r.doc_id] += words
    assert dict(given) == {i: n for i, n in stated.items() if n}
    assert sampled(docs.limit(0)).collect() == []


ITEMS = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"), (2, "short item here"), (3, None), (4, "..."), (5, "Été comme hiver le grand jardin reste ouvert pour tous les gens du village"), (2, "short item here")]


def decontamination_rows():
    a = ITEMS[0][1].split()
    rows = [(0, " ".join(a)), (1, "x y " + " ".join(a[2:]) + " z"), (2, " ".join(a[:12])), (3, "Short, ITEM: here! and short item here"), (4, None), (5, ""), (6, "été" + ITEMS[4][1][3:]), (7, ITEMS[4][1].upper().replace("ÉTÉ", "Été")), (8, "...a b")]
    rows += [(9, ("filler " * 500) + " ".join(a[:13])), (10, " ".join([*a[:5], "odd", *a[5:]])), (10, " ".join([*a[:5], "odd", *a[5:]])), (11, " ".join(a + a))]
    return rows + [(100 + i, t) for i, t in corpus.texts(5, 30)]


def test_decontamination_matches_brute_force(spark):
    rows = decontamination_rows()
    docs, items = corpus.frame(spark, rows), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert sorted(tuple(r) for r in decontaminate(docs, items).collect()) == corpus.contamination(rows, ITEMS)
    bad = {i for i, *_, c in corpus.contamination(rows, ITEMS) if c}
    left = drop_contaminated(docs, items)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == sorted(i for i, _ in rows if i not in bad)


def test_decontamination_without_items_or_rows(spark):
    docs, items = corpus.frame(spark, decontamination_rows()), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert all(r.n_hit == 0 and not r.contaminated for r in decontaminate(docs, items.limit(0)).collect())
    assert decontaminate(docs.limit(0), items).collect() == []


def nearly(rows, items, slack):
    """Ids of documents, with the items of which a window lies within the slack, one word of 13 left out."""
    out = set()
    for i, t in rows:
        w = corpus.alnum_words(t)
        for item, text in items:
            b = corpus.alnum_words(text)
            n = min(13, len(b))
            for k in range(len(b) - n + 1) if b else ():
                for s in range(-slack, len(w)):
                    if sum(b[k + o] in w[max(0, s + o - slack) : max(0, s + o + slack + 1)] for o in range(n)) >= n - n // 13:
                        out.add((i, item))
    return out


def test_proximity_matches_brute_force(spark):
    a = ITEMS[0][1].split()
    rows = [r for r in decontamination_rows()[:10] if r[0] != 9]
    rows += [(20, " ".join(a[:6] + ["other"] + a[7:])), (21, " ".join(a[:3] + a[5:])), (22, " ".join(reversed(a))), (23, "item short here"), (24, "item a b c d short here"), (25, " ".join([*a[:2], "p", "q", *a[2:]])), (26, " ".join(["the"] * 40 + a[:13]))]
    docs, items = corpus.frame(spark, rows), spark.createDataFrame(ITEMS, "item_id long, text string")
    for slack in (1, 2):
        search = Index(docs).search(items, slack=slack)
        got = {(r.doc_id, r.item_id) for r in search.owned(search.near()).collect()}
        assert got == nearly(rows, ITEMS, slack)
    found = {r.doc_id: r.n_near for r in decontaminate(docs, items, near=True).collect()}
    want = Counter(i for i, _ in nearly(rows, ITEMS, 2))
    assert found == {i: want[i] for i, _ in rows}


def test_a_saved_index_serves_other_test_sets(spark, tmp_path):
    docs, items = corpus.frame(spark, decontamination_rows()), spark.createDataFrame(ITEMS, "item_id long, text string")
    Index(docs).save(f"{tmp_path}/index")
    index = Index.load(spark, f"{tmp_path}/index", docs)
    for some in (items, items.where("item_id = 5"), items.limit(0)):
        got = sorted(tuple(r) for r in index.search(some).coverage().drop("mark").collect())
        assert got == corpus.contamination(decontamination_rows(), [tuple(r) for r in some.collect()])


def test_templates_match_mandatory_wording_only():
    a = Automaton("under the <<optional>>terms of the<</optional>> mit <<var:1-2>> text <<var:0-1|v version>> 2")
    m = lambda s: a.match_at(s.encode().split(), 0)
    assert m("under the mit license text 2") == 6 and m("under the terms of the mit big license text version 2 more") == 11
    assert m("under the terms of mit license text 2") == -1 and m("under the mit text 2") == -1 and m("under the mit a b c text 2") == -1
    with pytest.raises(ValueError):
        Automaton("a <<optional>>b")
    with pytest.raises(ValueError):
        Scanner({}, {"x": ["<<var:1-2>> a"]})


def regex_of(template):
    """A template as a regular expression over words that each end in a blank."""
    out = ""
    for k, part in enumerate(MARKUP.split(template)):
        if k % 2 == 0:
            out += "".join(re.escape(w.decode()) + " " for w in alnum_words(part.encode()))
        elif part == "optional":
            out += "(?:"
        elif part == "/optional":
            out += ")?"
        else:
            bounds, _, some = part[4:].partition("|")
            one = "|".join(map(re.escape, some.split())) or "[^ ]+"
            out += f"(?:(?:{one}) ){{{bounds.replace('-', ',')}}}"
    return re.compile(out)


def scanned(text, base, templates):
    """What a scan returns, by trying every template at every word, shortest match first."""
    w = corpus.alnum_words(text)
    places, base_labels, labels, covered = [], set(), set(), 0
    first = {t: regex_of(t) for ts in templates.values() for t in ts}
    for at in range(len(w)):
        for phrase, label in base.items():
            if w[at : at + len(phrase.split())] == phrase.split():
                places.append(at)
                base_labels.add(label)
                covered += len(phrase.split())
        for label, ts in templates.items():
            for t in ts:
                m = first[t].match("".join(x + " " for x in w[at : at + 300]))
                if m:
                    n = next(n for n in range(1, 301) if first[t].fullmatch("".join(x + " " for x in w[at : at + n])))
                    labels.add(label)
                    covered += n
    return (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels | base_labels)), covered / (covered + 4.0))


def test_license_scan_of_documents_matches_brute_force(spark, sf):
    """All documents of the smallest table, whole licenses with regions left out, replaced and altered, long, repeated and empty texts."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    mit = MARKUP.sub("", TEMPLATES["mit"][1]).replace("  ", " ")
    full = re.sub(r"<<var:1-\d+>>", "Software", TEMPLATES["mit"][1].replace("<<optional>>", "").replace("<</optional>>", ""))
    bsd = re.sub(r"<<var:1-\d+>>", "THE AUTHORS", TEMPLATES["bsd"][0].replace("<<optional>>", "").replace("<</optional>>", ""))
    own = [(10**6, full), (10**6 + 1, mit), (10**6 + 2, full.replace("LIABILITY", "RISK")), (10**6 + 3, bsd), (10**6 + 4, "x " * 30_000 + full + " y" * 1000), (10**6 + 4, "x " * 30_000 + full + " y" * 1000), (10**6 + 5, None), (10**6 + 6, "")]
    rows = docs.unionByName(spark.createDataFrame(own, docs.schema))
    got = sorted((tuple(r) for r in license_scan(rows).collect()), key=repr)
    want = sorted(((r.doc_id, *scanned(r.text, BASE, TEMPLATES)) for r in rows.collect()), key=repr)
    assert got == want
    by = {r[0]: r[6] for r in got}
    assert by[10**6] == by[10**6 + 4] == "mit" and by[10**6 + 1] == by[10**6 + 2] == "" and by[10**6 + 3] == "bsd"
    assert license_scan(docs.limit(0)).collect() == []


def test_license_scan(spark):
    rows = [(1, "Released under the MIT License."), (2, "Licensed under CC BY-NC 4.0, or: under the mit  license; CC-BY-NC"), (3, None), (4, ""), (5, "the mit licence"), (6, "GNU General Public License, version 3"), (7, "Apache License, Version 2.0. " * 2)]
    got = {r.doc_id: r for r in license_scan(corpus.frame(spark, rows)).collect()}
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels, got[1].labels) == (5, 1, 1, 1, "mit", "mit")
    assert (got[2].n_base, got[2].first_word, got[2].last_word, got[2].base_labels) == (3, 2, 12, "cc-by-nc,mit")
    for i in (3, 4, 5):
        assert (got[i].n_base, got[i].first_word, got[i].labels, got[i].score) == (0, None, "", 0.0)
    assert got[6].base_labels == "" and got[6].labels == "gpl-3" and 0 < got[6].score < 1
    assert got[7].n_base == 2


def test_language_model_scores(spark):
    rows = [(i, t) for i, t in corpus.texts(9, 80)] + [(None, "null id")]
    tokens = [(i, (t or "").encode().translate(corpus.FOLD).split() + [b" end"]) for i, t in rows]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(w for i, t in tokens if not held(i) for w in t)
    n, v = sum(c.values()), len(c)
    got = lm_scores(corpus.frame(spark, rows)).collect()
    key = lambda i, x: (i is None, i or 0, x)
    want = sorted((key(i, len(t)), sum(c[w] > 0 for w in t), sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)) for i, t in tokens)
    have = sorted((key(r.doc_id, r.n_tokens), r.n_known, r.base_score) for r in got)
    for a, b in zip(want, have, strict=True):
        assert a[:2] == b[:2] and math.isclose(a[2], b[2], rel_tol=1e-9)
    assert all(r.train_tokens == n and r.score < 0 for r in got)
    assert lm_scores(corpus.frame(spark, rows).limit(0)).collect() == []


def test_smoothed_probabilities_add_up():
    """Over all known words and one unknown, each context's probabilities sum to 1."""
    pairs = {(0, 5): 3, (0, 6): 1, (1, 5): 1, (1, 7): 2, (2, 8): 1, (2, 5): 4, (0, 9): 1}
    before = Counter(w for _, w in pairs)
    n, m = ([sum(x == k for x in d.values()) for k in range(1, 5)] for d in (pairs, before))
    classes = {c: tuple(sum(f(x) for (a, _), x in pairs.items() if a == c) for f in (lambda x: x, lambda x: x == 1, lambda x: x == 2, lambda x: x > 2)) for c in (0, 1, 2)}
    t = Totals(sum(pairs.values()), len(before), len(pairs), n, m, classes, {})
    words = [*before, None]
    lower = t.lower(np.array([before[w] if w else 0 for w in words]))
    assert math.isclose(lower.sum(), 1)
    for c in (0, 1, 2, 3):
        p = t.higher(np.array([pairs.get((c, w), 0) for w in words]), np.full(len(words), c), lower)
        assert math.isclose(p.sum(), 1) and (p > 0).all()
