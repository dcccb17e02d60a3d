import math
import random
import zlib
from collections import Counter, defaultdict

import corpus

from lanespan.llm.lm_score import discounts, lm_scores


def kneser_ney(rows):
    """Sums of log10 probabilities of a bigram model that knows every context by its word."""
    tokens = [(i, (t or "").encode().translate(corpus.FOLD).split() + [b" end"]) for i, t in rows]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    pairs = Counter(p for i, t in tokens if not held(i) for p in zip([b" start", *t], t))
    before = Counter(w for _, w in pairs)
    high, low = (discounts([sum(x == k for x in c.values()) for k in range(1, 5)]) for c in (pairs, before))
    after = defaultdict(list)
    for (c, _), n in pairs.items():
        after[c].append(n)
    spare = sum(low[min(n, 3)] for n in before.values()) / len(pairs)

    def p(c, w):
        b = before[w]
        lower = max(b - low[min(b, 3)], 0) / len(pairs) + spare / (len(before) + 1)
        if c not in after:
            return lower
        n, seen = pairs[c, w], sum(after[c])
        return max(n - high[min(n, 3)], 0) / seen + sum(high[min(x, 3)] for x in after[c]) / seen * lower

    return {i: sum(math.log10(p(c, w)) for c, w in zip([b" start", *t], t)) for i, t in tokens}


def test_scores_are_those_of_every_context_apart(spark):
    """6,000 words: any 65,536 classes of contexts would mix some hundreds of them."""
    r = random.Random(3)
    rows = [(i, " ".join(f"V{r.randrange(6000)}" if r.random() < 0.7 else f"c{r.randrange(20)}" for _ in range(r.randint(1, 150)))) for i in range(300)]
    rows += [(300, None), (301, ""), (302, "never met before")]
    want = kneser_ney(rows)
    rows_ = lm_scores(corpus.frame(spark, rows)).collect()
    got = {x.doc_id: x.score for x in rows_}
    assert all(math.isclose(x.perplexity, 10 ** (-x.score / x.n_tokens)) for x in rows_)
    assert got.keys() == want.keys()
    for i, s in want.items():
        assert math.isclose(got[i], s, rel_tol=1e-9), i
