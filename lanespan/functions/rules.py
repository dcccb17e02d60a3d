"""Ordered rules, first match wins: one chain of when(), evaluated within the scan's stage and without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def matches(patterns: dict[str, str | None]) -> Column:
    """True if every pattern given for a column is found in it, whatever the case; absent patterns do not count."""
    found = [F.coalesce(F.col(c).rlike(f"(?i){p}"), F.lit(False)) for c, p in patterns.items() if p]
    if not found:
        raise ValueError("a rule needs a pattern")
    out = found[0]
    for f in found[1:]:
        out = out & f
    return out


def first_match(rules: list[dict], value: str, default=None) -> Column:
    """`value` of the first rule whose patterns all match, or default. value "ord" is the rule's position."""
    chain = None
    for i, r in enumerate(rules):
        give = F.lit(i if value == "ord" else r[value])
        chain = F.when(matches(r["match"]), give) if chain is None else chain.when(matches(r["match"]), give)
    return chain.otherwise(F.lit(default))


def like_any_case(c: str, needle: str) -> Column:
    """SQLite's LIKE '%needle%': ASCII case does not count, and _ in the needle stands for any character."""
    return F.col(c).ilike(f"%{needle}%")


def contains_any(c: str, needles: list[str], lower: bool = False) -> Column:
    x = F.lower(F.col(c)) if lower else F.col(c)
    return F.exists(F.array(*[F.lit(n) for n in needles]), lambda n: x.contains(n))
