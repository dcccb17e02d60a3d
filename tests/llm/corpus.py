"""Small corpora with the awkward cases, and brute-force versions of the operators."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re

FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: Names that operators use inside; as extra columns they must do no harm.
CLASHES = "n long, k1 long, k2 long, shard int, key string, size long, row_key long, norm string, window long, part long, mark long, low long, label long"


def texts(seed: int = 1, n: int = 60) -> list[tuple]:
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    line = lambda k: [r.choice(vocabulary) for _ in range(k)]
    shared = line(30)
    rows: list[tuple] = []
    for i in range(n):
        w = line(r.randint(1, 120))
        if i % 5 == 0:
            w += shared
        if i % 7 == 0 and rows:
            w = list((rows[r.randrange(len(rows))][1] or "x").split())
            if w and i % 2:
                w[r.randrange(len(w))] = "CHANGED"
        rows.append((i, (" " if i % 3 else "\n\t").join(w)))
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\r\n"), (n + 3, None), (n + 4, "Été É"), (n + 5, "a b"), (n + 6, "A  b"), (n + 7, " ".join(line(12_000))), (n + 8, "same"), (n + 8, "same"), (n + 9, "x " * 300)]
    return rows


def frame(spark, rows: list[tuple], extra: str = CLASHES, parts: int = 3):
    names = [c.split()[0] for c in extra.split(", ")]
    data = [(i, t, None if i is None else f"src{i % 4}" if i % 9 else None, *[7 if " string" not in c else "s" for c in extra.split(", ")]) for i, t in rows]
    return spark.createDataFrame(data, f"doc_id long, text string, source string, {extra}").repartition(parts) if names else None


def white_words(t) -> list[bytes]:
    return (t or "").encode().split()


def alnum_words(t) -> list[str]:
    low = (t or "").encode().translate(FOLD).decode()
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def exact_groups(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        norm = re.sub(r"[\x20\x09-\x0d]", "", t or "")
        groups[norm].append((-len(t or ""), i))
    out = []
    for norm, members in groups.items():
        keep = min(members)[1]
        out += [(i, keep, len(members), hashlib.sha256(norm.encode()).hexdigest()) for _, i in members]
    return sorted(out)


def repeats(rows, n):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        if i in out:
            continue
        w = white_words(t)
        gone = [False] * len(w)
        for s in range(len(w) - n + 1):
            g = tuple(w[s : s + n])
            if g in seen:
                gone[s : s + n] = [True] * n
            seen.add(g)
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, y in zip(w, gone, strict=True) if not y)).hexdigest())
    return out


def components(rows, k, percent):
    sets = []
    for i, t in rows:
        w = (t or "").encode().translate(FOLD).split()
        sets.append((i, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()))
    head = list(range(len(sets)))

    def top(a):
        while head[a] != a:
            a = head[a]
        return a

    where = collections.defaultdict(list)
    for j, (_, s) in enumerate(sets):
        for g in s:
            where[g].append(j)
    both = collections.Counter(p for v in where.values() for p in itertools.combinations(v, 2))
    for (a, b), n in both.items():
        if 100 * n >= percent * (len(sets[a][1]) + len(sets[b][1]) - n):
            head[max(top(a), top(b))] = min(top(a), top(b))
    low = collections.defaultdict(list)
    for j, (i, _) in enumerate(sets):
        low[top(j)].append(i)
    return sorted((i, len(s), min(low[top(j)])) for j, (i, s) in enumerate(sets))


def contamination(rows, items, size=13):
    windows = collections.defaultdict(set)
    for item, t in items:
        w = alnum_words(t)
        n = min(size, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[s : s + n])].add(item)
    lengths = {len(w) for w in windows}
    out = []
    for i, t in rows:
        w, hit, found = alnum_words(t), set(), set()
        for n in lengths:
            for s in range(len(w) - n + 1):
                if items_ := windows.get(tuple(w[s : s + n])):
                    hit.update(range(s, s + n))
                    found |= items_
        names = ",".join(sorted(map(str, found)))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out)
