"""Labels of identifiers against a plain search over all ways of a family."""

import random
import re

import pytest

from lanespan.functions import labels as L


def clip(t, budget):
    if len(t) <= budget:
        return t
    kept = ""
    for w in re.findall(L.WORDS, t):
        if len(kept + w) > budget:
            break
        kept += w
    return (kept or t[:budget]) + L.CUT


def made(parts, own, budget, keep, stem, count):
    if keep:
        head, rest = parts[:keep], parts[keep:]
    else:
        head = parts[:stem] + [p for p in parts[stem:-1] if p in own][:count]
        rest = [p for p in parts[1:] if p not in head]
    out = [clip(p, budget) for p in head]
    if rest and (len(rest) > 1 or rest[0] != parts[-1]):
        out.append(L.CUT)
    if rest and parts[-1] not in head:
        out.append(clip(parts[-1], budget))
    return "_".join(out)


def plain(names, limit):
    out = {}
    for family in {n.split("_")[0] for n in names}:
        members = {n: n.split("_") for n in names if n.split("_")[0] == family}
        label = {n: n for n in members}
        if max(map(len, members)) > limit:
            own = {n: [p for p in parts if sum(p in q for q in members.values()) == 1] for n, parts in members.items()}
            widest = max(map(len, members.values()))
            ways = [w for b in L.BUDGETS for w in [*((b, k, 0, 0) for k in range(2, widest + 1)), *((b, 0, s, c) for s in L.STEMS for c in L.OWN)]]
            good = []
            for i, w in enumerate(ways):
                got = {n: made(parts, own[n], *w) for n, parts in members.items()}
                if len(set(got.values())) == len(got):
                    size = max(map(len, got.values()))
                    good.append(((0, -size, i) if size <= limit else (1, size, i), got))
            if good:
                label = min(good, key=lambda x: x[0])[1]
        out |= label
    return out


@pytest.mark.parametrize(("seed", "limit"), [(1, 60), (2, 30), (3, 12)])
def test_labels_match_a_plain_search(spark, seed, limit):
    r = random.Random(seed)
    words = ["Fp32", "MxE4m3", "kernelCutlassGemmExtKernel", "t128x16", "cta64x16x128", "sm100f", "a", "b", "qkvBfloat16OBfloat16HQk192HV128PersistentContext", "x" * 50, "", "view"]
    names = {"_".join([f"fam{r.randrange(4)}", *(r.choice(words) for _ in range(r.randrange(12))), str(r.randrange(30))]) for _ in range(70)} | {"single", "Z" * 90, "é_ü"}
    df = spark.createDataFrame([(n,) for n in names] + [(None,), ("single",)], "name string")
    assert {x.name: x.label for x in L.identifier_labels(df, limit=limit).collect()} == plain(names, limit)


def test_large_family(spark):
    df = spark.range(10_000).selectExpr("concat_ws('_', 'gemm', 'a common part that is rather long', 'with more of it', id, 'sm100') AS name")
    got = L.identifier_labels(df)
    assert got.count() == 10_000 == got.select("label").distinct().count() and got.selectExpr("max(length(label))").first()[0] <= 60


def test_no_names(spark):
    assert L.identifier_labels(spark.createDataFrame([(None,)], "name string")).collect() == []


def test_budgets_beyond_a_familys_longest_token_are_not_tried(spark):
    """They give the same labels; with four budgets for each name, most of the work was for nothing."""
    from lanespan.functions import labels

    names = spark.createDataFrame([(f"fam_{'word_' * 12}{i}_end",) for i in range(20)], "name string")
    plan = labels.identifier_labels(names)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("posexplode") <= 1
    assert len({r.label for r in labels.identifier_labels(names).collect()}) == 20
