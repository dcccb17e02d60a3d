"""Published documents out of derived tables: the analysis document, its manifest, and the report's tables as lines of text.

Documents are rows of one JSON text for each package; what they gather is one unit's operators, a bounded table of results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanespan.operators import document as D
from lanespan.sources.scratch import cut

VERSION = "1.0"


def gathered(rows: DataFrame, key: str, order: list[str], fields: dict[str, Column], name: str) -> DataFrame:
    """key, name: an array of the rows' fields, in order."""
    x = rows.select(key, F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)]).alias("o"), F.struct(*[c.alias(n) for n, c in fields.items()]).alias("x"))
    return x.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "x"))), lambda r: r["x"]).alias(name))


def analysis(rows: DataFrame, unit: DataFrame, key: str = "package") -> DataFrame:
    """key, document of operators (key, seq, name, category, module, stage, position, unit, variant, start, duration, mfu, mbu) and units (key, unit_us, samples, devices).

    A document has its version, a summary, the three classes, stages by key in order of appearance, structural units by
    position, and the operators in order.
    """
    rows = cut(rows.withColumn("stage_key", D.stage_key(F.col("position"), F.col("unit"), F.col("variant"), F.col("stage"))))  # read by every part
    ops = gathered(rows, key, ["seq"], {"index": F.col("seq"), "name": F.col("name"), "category": F.col("category"), "module": F.col("module"), "stageKey": F.col("stage_key"), "unitVariant": D.filled(F.col("variant")), "startNs": F.col("start"), "durationUs": F.col("duration"), "mfu": F.col("mfu"), "mbu": F.col("mbu")}, "operators")
    shares = D.class_shares(rows.join(unit.select(key, "unit_us"), key), F.lit(1.0), [key]).join(unit.select(key, "unit_us"), key)
    classes = gathered(shares, key, ["ord"], {"name": F.col("name"), "count": F.col("count"), "durationUs": F.round("duration", 3), "durationPct": F.round(F.col("duration") / F.col("unit_us") * 100, 4), "sharePct": F.round("share_pct", 4)}, "classifications")
    stage = rows.groupBy(key, "stage_key", "stage").agg(F.min("seq").alias("first"), F.sum("duration").alias("d"))
    stages = gathered(stage, key, ["first"], {"key": F.col("stage_key"), "name": F.col("stage"), "durationUs": F.round("d", 3)}, "stages")
    place = rows.where("position is not null").groupBy(key, "position", "unit", "variant").agg(F.min("seq").alias("first"), F.round(F.sum("duration"), 3).alias("d"))
    units = gathered(place, key, ["position", "first"], {"position": F.col("position"), "id": F.col("unit"), "variant": F.col("variant"), "durationUs": F.col("d")}, "units")
    best = D.best_shares(rows, [key]).join(rows.groupBy(key).agg(F.array_sort(F.collect_set(D.filled(F.col("variant")))).alias("variants")), key).join(unit, key)
    summary = F.struct(
        F.col("operators").alias("operatorCount"), F.col("unit_us").alias("durationUs"), F.col("samples").alias("stableSamples"), "devices", F.col("variants").alias("distinctUnitVariants"),
        (F.size("variants") > 1).alias("heterogeneous"), F.col("max_mfu").alias("maxMfu"), F.col("max_mbu").alias("maxMbu"),
    )
    out = best.select(key, summary.alias("summary"))
    for part in (classes, stages, units, ops):
        out = out.join(part, key, "left")
    return out.select(key, F.to_json(F.struct(F.lit(VERSION).alias("schemaVersion"), "summary", "classifications", "stages", "units", "operators")).alias("document"))


def manifest(tables: dict[str, DataFrame], formulas: dict[str, str], evidence: DataFrame | None = None) -> DataFrame:
    """manifest: one JSON text with the rows of each table, the formulas, and the evidence's rows, if there are some (few)."""
    counts = None
    for name, t in tables.items():
        n = t.agg(F.struct(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows")).alias("x"))
        counts = n if counts is None else counts.unionByName(n)
    told = F.create_map(*[F.lit(x) for kv in sorted(formulas.items()) for x in kv])
    out = counts.agg(F.array_sort(F.collect_list("x")).alias("tables")).withColumn("formulas", told)
    if evidence is not None:
        given = evidence.select(F.struct(*evidence.columns).alias("x")).agg(F.array_sort(F.collect_list("x")).alias("evidence"))
        out = out.crossJoin(F.broadcast(given))  # one row each
    return out.select(F.to_json(F.struct(*out.columns)).alias("manifest"))


def lines(sections: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """section, line, text of a report: for each (title, table, order) a heading, the table's head and its rows in the order of that column, which is left out."""
    out = None
    for i, (title, t, order) in enumerate(sections):
        shown = [c for c in t.columns if c != order]
        safe = [F.regexp_replace(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\|", r"\\|"), r"\s*\n\s*", " ") for c in shown]
        body = t.select((F.row_number().over(Window.orderBy(order)) + 3).cast("long").alias("line"), F.concat(F.lit("| "), F.concat_ws(" | ", *safe), F.lit(" |")).alias("text"))  # a table of a report
        head = t.sparkSession.createDataFrame([(1, f"## {title}"), (2, "| " + " | ".join(shown) + " |"), (3, "|" + "---|" * len(shown))], "line long, text string")
        part = head.unionByName(body).select(F.lit(i).alias("section"), "line", "text")
        out = part if out is None else out.unionByName(part)
    return out


# What a rule may ask for.
ASKED, KINDS = ("core", "communication", "auxiliary"), ("gemm", "attention")


def rules_of(data: object) -> list[dict]:
    """Rules of a semantic map as the engine takes them: each with a pattern for the module or the operator, and allowed classes and kinds only."""
    if not isinstance(data, dict) or not isinstance(data.get("rules", []), list):
        raise ValueError("a semantic map is an object with a list of rules")
    out = []
    for i, r in enumerate(data.get("rules", [])):
        match = {c: r[k] for c, k in (("module", "module_regex"), ("operator_name", "operator_regex")) if isinstance(r, dict) and k in r}
        if not match:
            raise ValueError(f"rule {i} has no pattern")
        if r.get("category") not in (None, *ASKED) or r.get("core_kind") not in (None, *KINDS):
            raise ValueError(f"rule {i} asks for what there is not")
        out.append({**{k: v for k, v in r.items() if not k.endswith("_regex")}, "match": match})
    return out
