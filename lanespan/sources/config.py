"""Model configurations, launch scripts, taxonomies and profiles: one small document each, read on the driver.

What rows need of them is made into small frames (positions, regions, rules) that are joined or folded into expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from lanespan.functions.symbols import shell_int

#: Sections of a configuration that may hold the language model's keys.
SECTIONS = ("text_config", "language_config", "llm_config")


def nested(config: dict, *path, default=None):
    for p in path:
        if not isinstance(config, dict) or p not in config:
            return default
        config = config[p]
    return config


def first_present(config: dict, *keys):
    """The first key that is there and not null; 0 and False count."""
    return next((config[k] for k in keys if config.get(k) is not None), None)


def language(config: dict, key: str):
    """A key at the root, else in one of the language sections."""
    return next((v for c in (config, *(nested(config, s, default={}) for s in SECTIONS)) if (v := nested(c, key)) is not None), None)


def layer_counts(config: dict) -> list[int]:
    """Candidate numbers of layers, each once: as declared, and with the speculative layers."""
    out: list[int] = []
    for c in (config, *(nested(config, s, default={}) for s in SECTIONS)):
        n = nested(c, "num_hidden_layers")
        if isinstance(n, int) and n > 0:
            for x in (n, n + int(nested(c, "num_nextn_predict_layers", default=0) or 0)):
                if x not in out:
                    out.append(x)
    return out


def compress_ratios(config: dict, layers: int) -> list[int] | None:
    """Ratios by layer, cut to the number of layers; None if there are too few."""
    r = language(config, "compress_ratios")
    return None if not isinstance(r, list) or len(r) < layers else [int(x) for x in r[:layers]]


def holds(config: dict, condition: dict) -> bool:
    """non_empty, exists, gt, eq and contains on a key; all that are given must hold."""
    v = language(config, condition["key"])
    tests = {
        "exists": lambda want: (v is not None) == bool(want),
        "non_empty": lambda want: bool(v) == bool(want),
        "gt": lambda want: isinstance(v, int | float) and v > want,
        "eq": lambda want: v == want,
        "contains": lambda want: v is not None and str(want) in (v if isinstance(v, list) else str(v)),
    }
    return all(test(condition[name]) for name, test in tests.items() if name in condition)


def profile(config: dict, profiles: list[dict]) -> str | None:
    """Name of the first profile whose conditions all hold."""
    return next((p["name"] for p in profiles if p.get("conditions") and all(holds(config, c) for c in p["conditions"])), None)


def anchor(counts: dict[str, int], layers: list[int]) -> tuple[str, int] | None:
    """The kernel that divides a capture into layers: at least twice a candidate number, and a multiple of it; the largest number first, then the rarest kernel, then the first."""
    fit = [(-n, c, i, name) for i, (name, c) in enumerate(counts.items()) for n in layers if c >= 2 * n and c % n == 0]
    return (min(fit)[3], -min(fit)[0]) if fit else None


def assignments(script: str) -> dict[str, str]:
    return {m[1]: m[2].strip().strip("\"'") for m in re.finditer(r"^\s*(?:export\s+)?([A-Za-z_]\w*)=(.*?)\s*(?:#.*)?$", script, re.M)}


def flag(script: str, name: str) -> str | None:
    m = re.search(rf"(?:^|\s)--{re.escape(name)}(?:\s+|=)(\$\(\(.*?\)\)|\"[^\"]*\"|'[^']*'|\S+)", script)
    return m[1].strip("\"'") if m else None


def int_flag(script: str, name: str) -> int | None:
    text = flag(script, name)
    return None if text is None else shell_int(text, assignments(script))


def topology(config: dict, script: str = "", captured: dict[str, str] | None = None) -> dict:
    """Layers, speculative layers and parallel sizes; what was captured at run time goes before the script."""
    captured = captured or {}

    def size(*names: str) -> int | None:
        for n in names:
            if str(captured.get(n, "")).lstrip("-").isdigit():
                return int(captured[n])
        return next((v for n in names if (v := int_flag(script, n.replace("_", "-"))) is not None), None)

    n = language(config, "num_hidden_layers")
    return {"layers": n, "draft_layers": language(config, "num_nextn_predict_layers") or 0, "tp": size("tp_size", "tp", "tensor_parallel_size"), "dp": size("dp_size", "dp"), "pp": size("pp_size", "pp"), "chunk": size("chunked_prefill_size")}


def cluster_batch(batch: int | None, gpus: int | None, tp: int | None, dp: int | None) -> int | None:
    """Batch of all replicas: None unless everything is known and the GPUs divide."""
    if not batch or not gpus or not tp:
        return None
    group = tp // max(1, dp or 1)
    return batch * (gpus // group) if group and gpus % group == 0 else None


def taxonomy_errors(tax: dict) -> list[str]:
    """What is wrong with a taxonomy: positions in order without holes, variants declared, regions that do not overlap."""
    out = []
    variants = {v.get("id") for v in tax.get("variants", [])}
    positions = nested(tax, "repeating_unit", "positions", default=[])
    places = [p.get("position") for p in positions]
    if places != list(range(1, len(places) + 1)):
        out.append("positions are not 1, 2, ...")
    for p in positions:
        if p.get("variant") not in variants:
            out.append(f"position {p.get('position')} has an undeclared variant")
        if "layer_id" not in p and not p.get("module_regex"):
            out.append(f"position {p.get('position')} cannot be told from others")
    spans = sorted((r["layers"][0], r["layers"][1], r["id"]) for r in tax.get("regions", []) if r.get("layers"))
    out += [f"regions {a[2]} and {b[2]} overlap" for a, b in zip(spans, spans[1:], strict=False) if b[0] <= a[1]]
    return out


def positions(spark: SparkSession, tax: dict) -> DataFrame:
    """layer_id, p_position, p_id, p_variant of positions that name a layer."""
    rows = [(int(p["layer_id"]), str(p["position"]), str(p.get("id", "")), str(p["variant"])) for p in nested(tax, "repeating_unit", "positions", default=[]) if "layer_id" in p]
    return spark.createDataFrame(rows, "layer_id int, p_position string, p_id string, p_variant string")


def regions(spark: SparkSession, tax: dict) -> DataFrame:
    rows = [(i, str(r["id"]), int(r["layers"][0]), int(r["layers"][1])) for i, r in enumerate(tax.get("regions", []))]
    return spark.createDataFrame(rows, "ord int, region string, low int, high int")


def variant_ratio(tax: dict) -> dict[str, int]:
    """How often each variant occurs in the repeating unit, in order of appearance."""
    out: dict[str, int] = {}
    for p in nested(tax, "repeating_unit", "positions", default=[]):
        out[p["variant"]] = out.get(p["variant"], 0) + 1
    return out


def markers(tax: dict) -> dict[str, str]:
    """Needles by variant, for those that declare one."""
    return {v["id"]: v["marker"] for v in tax.get("variants", []) if v.get("marker")}


NEGATIONS = ("not ", "no ", "without", "never", "absent", "n't")
PROSE = re.compile(r"[A-Za-z_][A-Za-z0-9_:]*(?:kernel|gemm|attn|core|_[a-z0-9]+)[A-Za-z0-9_:]*")


def kernel_words(text: str) -> list[str]:
    """Words of prose that look like kernel names, from sentences that do not negate; each once."""
    out: list[str] = []
    for s in re.split(r"[.;。;]\s*|\n", text):
        if not any(n in s.lower() for n in NEGATIONS):
            out += [w for w in PROSE.findall(s) if w not in out]
    return out
