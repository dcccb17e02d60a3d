"""Short labels for long identifiers: as much as fits, and no two of a family alike.

A family is what has the same first token. Every way to shorten it is tried on all its names at once, as rows of (name,
way), and judged by sums over the family: how many labels differ, and how long the longest is. The tokens that set a name
apart are those that one name of the family alone has, which counting finds. So a family of any size is a shuffle of
its rows, and the choice is one row a family.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanespan.sources.scratch import cut

# The longest label, letters that a token may keep, how many tokens lead, and how many of a name's own follow.
LIMIT = 60
BUDGETS = (24, 40, 64, 1024)
STEMS, OWN = (1, 2, 3), (1, 2, 3)
CUT = "…"
#: Words of a token in mixed case, at whose ends it may be cut.
WORDS = r"[A-Z]?[a-z]+\d*|[A-Z]+\d*|\d+"


def clipped(token: Column, budget: Column) -> Column:
    """The token, or as many of its first words as the budget has room for, and a sign of the cut."""
    start = F.struct(F.lit("").alias("kept"), F.lit(False).alias("full"))

    def more(x: Column, word: Column) -> Column:
        full = x["full"] | (F.length(x["kept"]) + F.length(word) > budget)
        return F.struct(F.when(full, x["kept"]).otherwise(F.concat(x["kept"], word)).alias("kept"), full.alias("full"))

    kept = F.aggregate(F.regexp_extract_all(token, F.lit(WORDS), F.lit(0)), start, more)["kept"]
    cut = F.concat(F.when(kept == "", F.left(token, budget)).otherwise(kept), F.lit(CUT))
    return F.when(F.length(token) <= budget, token).otherwise(cut)


def shortened(tokens: Column, own: Column, budget: Column, keep: Column, stem: Column, count: Column) -> Column:
    """The label of a way: the first `keep` tokens, or where that is null the first `stem` and then `count` of the name's own tokens; then a sign for what is left out, and the last token."""
    n = F.size(tokens)
    last = F.element_at(tokens, -1)
    inner = F.when(n > stem + 1, F.slice(tokens, stem + 1, F.greatest(n - stem - 1, F.lit(0)))).otherwise(F.slice(tokens, 1, 0))
    apart = F.slice(F.filter(inner, lambda t: F.array_contains(own, t)), F.lit(1), count)
    head = F.when(keep.isNotNull(), F.slice(tokens, F.lit(1), F.coalesce(keep, F.lit(0)))).otherwise(F.concat(F.slice(tokens, F.lit(1), stem), apart))
    rest = F.when(keep.isNotNull(), F.slice(tokens, F.coalesce(keep, F.lit(0)) + 1, F.greatest(n - F.coalesce(keep, F.lit(0)), F.lit(0))))
    rest = rest.otherwise(F.filter(F.slice(tokens, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda t: ~F.array_contains(head, t)))
    some = F.size(rest) > 0
    gap = some & ((F.size(rest) > 1) | (F.get(rest, F.lit(0)) != last))
    pieces = [F.transform(head, lambda t: clipped(t, budget)), F.when(gap, F.array(F.lit(CUT))).otherwise(F.array().cast("array<string>"))]
    pieces.append(F.when(some & ~F.array_contains(head, last), F.array(clipped(last, budget))).otherwise(F.array().cast("array<string>")))
    return F.array_join(F.concat(*pieces), "_")


def identifier_labels(names: DataFrame, name: str = "name", limit: int = LIMIT) -> DataFrame:
    """name, label of each distinct name that is not null.

    Names of a family in which none is longer than limit stay as they are. Of the ways that give all names of a family
    different labels, that with the longest label within the limit is taken, the first of equal ones; if none keeps within it, that
    with the shortest longest label; and where no way tells them apart, names stay whole.
    """
    x = names.select(F.col(name).alias("name")).where("name is not null").distinct().withColumn("tokens", F.split("name", "_")).withColumn("family", F.get("tokens", F.lit(0)))
    long_ = x.groupBy("family").agg(F.max(F.length("name")).alias("longest"), F.max(F.size("tokens")).alias("widest"), F.max(F.array_max(F.transform("tokens", F.length))).alias("token")).where(F.col("longest") > limit).drop("longest")
    part = x.join(long_, "family")
    token = part.select("family", "name", F.explode(F.array_distinct("tokens")).alias("token"))
    alone = token.groupBy("family", "token").agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("n")).where("n = 1")
    own = alone.groupBy("family", "name").agg(F.collect_list("token").alias("own"))  # of one name's tokens
    part = part.join(own, ["family", "name"], "left").withColumn("own", F.coalesce("own", F.array().cast("array<string>")))
    # Few bytes and much work: a number that is given is not made fewer by what the rows take.
    part = part.repartition(int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")), "name")

    none = F.lit(None).cast("int")
    way = lambda budget, keep, stem, count: F.struct(F.lit(budget).alias("budget"), keep.alias("keep"), stem.alias("stem"), count.alias("count"))

    def ways(budget: int) -> Column:
        leading = F.transform(F.sequence(F.lit(2), F.greatest(F.col("widest"), F.lit(2))), lambda k: way(budget, k, none, none))
        leading = F.filter(leading, lambda x: x["keep"] <= F.col("widest"))
        return F.concat(leading, F.array(*[way(budget, none, F.lit(s), F.lit(c)) for s in STEMS for c in OWN]))

    # A budget beyond one that has room for every token of the family gives the same labels, and of equal ways the first is taken.
    each = [F.when(F.lit(k == 0) | (F.col("token") > BUDGETS[k - 1]), ways(b)).otherwise(F.slice(ways(b), 1, 0)) for k, b in enumerate(BUDGETS)]
    label = shortened(F.col("tokens"), F.col("own"), F.col("w.budget"), F.col("w.keep"), F.coalesce("w.stem", F.lit(1)), F.coalesce("w.count", F.lit(0)))
    tried = part.select("family", "tokens", "own", F.posexplode(F.concat(*each)).alias("way", "w")).select("family", "way", label.alias("label"))
    one = tried.groupBy("family", "way", "label").agg(F.count(F.lit(1)).alias("n"))
    judged = one.groupBy("family", "way").agg(F.max("n").alias("most"), F.max(F.length("label")).alias("size")).where("most = 1")
    fits = F.col("size") <= limit
    best = judged.groupBy("family").agg(F.min(F.struct((~fits).alias("over"), F.when(fits, -F.col("size")).otherwise(F.col("size")).alias("by"), "way")).alias("x")).select("family", F.col("x.way").alias("way"))
    best = cut(best)  # a row for each family
    chosen = part.join(best, "family").withColumn("w", F.get(F.concat(*each), F.col("way"))).select("name", label.alias("label"))  # only labels of the way that was chosen
    rest = x.join(best.select("family"), "family", "left_anti").select("name", F.col("name").alias("label"))
    return chosen.unionByName(rest)
