"""Peaks of hardware, widths of operands, and how much of both a matrix product reaches. Registries are bounded tables of names, so look-ups are literal maps."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanespan.functions.scalars import normalized_hardware

# Dense peaks per device in TFLOPS, and bandwidths in GB/s.
REGISTRY = {
    "source": {"url": "https://www.nvidia.com/en-eu/data-center/hgx/"},
    "profiles": {
        "nvidia-b200": {
            "display_name": "NVIDIA B200",
            "aliases": ["Nvidia B200", "NVIDIA B200", "B200"],
            "dense_tflops_per_gpu": {"fp4": 9000.0, "fp8": 4500.0, "fp6": 4500.0, "fp16": 2250.0, "bf16": 2250.0, "tf32": 1125.0},
            "hbm_bandwidth_gb_per_s": 8000.0,
        },
        "nvidia-b300": {
            "display_name": "NVIDIA B300 Blackwell Ultra",
            "aliases": ["Nvidia B300", "NVIDIA B300", "B300", "Blackwell Ultra B300"],
            "dense_tflops_per_gpu": {"fp4": 13500.0, "fp8": 4500.0, "fp6": 4500.0, "fp16": 2250.0, "bf16": 2250.0, "tf32": 1125.0},
            "hbm_bandwidth_gb_per_s": 8000.0,
        },
    },
}

# Bytes of an element as stored; formats that exist within a product only have none.
DTYPE_BYTES = {"fp32": 4, "float32": 4, "bf16": 2, "bfloat16": 2, "fp16": 2, "float16": 2, "fp8": 1, "fp8_e4m3": 1, "fp8_e5m2": 1, "mxfp8": 1, "fp6": 1, "mxfp4": 1, "fp4": 1, "int8": 1}
ACCUMULATORS = ["fp32_accum", "fp32-accum", "accum_fp32"]


def checked_registry(registry: dict) -> dict:
    """A registry, or an error where its profiles are no table of tables."""
    profiles = registry.get("profiles", {})
    if not isinstance(profiles, dict) or not all(isinstance(p, dict) for p in profiles.values()):
        raise ValueError("profiles of a hardware registry are objects by name")
    return registry


def entries(registry: dict) -> Iterator[tuple[str, str, dict]]:
    """hardware, source and profile for each normalised alias; of profiles that share an alias the first counts."""
    met: set[str] = set()
    source = (registry.get("source") or {}).get("url") or "hardware profile registry"
    for p in checked_registry(registry).get("profiles", {}).values():
        for alias in filter(None, [p.get("display_name"), *(p.get("aliases") or [])]):
            key = "".join(c for c in str(alias).lower() if c.isascii() and c.isalnum())
            if key not in met:
                met.add(key)
                yield key, str(source), p


def registry_frame(spark: SparkSession, registry: dict = REGISTRY) -> DataFrame:
    """hardware, dtype, tflops, gb_per_s, source: a row for each alias and type with a positive peak."""
    rows = [(h, d, float(x), float(p.get("hbm_bandwidth_gb_per_s") or 0) or None, s) for h, s, p in entries(registry) for d, x in (p.get("dense_tflops_per_gpu") or {}).items() if x and x > 0]
    return spark.createDataFrame(rows, "hardware string, dtype string, tflops double, gb_per_s double, source string")


def _map(values: dict) -> Column | None:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv]) if values else None


def _look(values: dict, key: Column) -> Column:
    m = _map(values)
    return F.try_element_at(m, key) if m is not None else F.lit(None).cast("double")


def compute_dtype(told: Column, dtypes: Column) -> Column:
    """The type a product is computed in: what a rule tells, else its operands' if they share one, accumulators left out; null if unknown."""
    own = F.array_distinct(F.filter(F.transform(dtypes, F.lower), lambda x: ~x.isin(*ACCUMULATORS)))
    return F.coalesce(F.nullif(F.lower(told), F.lit("")), F.when(F.size(own) == 1, F.get(own, F.lit(0))))


def peak(explicit: Column, told: Column, dtypes: Column, hardware: Column, registry: dict = REGISTRY, legacy: dict[str, dict[str, float]] | None = None) -> Column:
    """struct(tflops, dtype, source): a rule's own peak, else that of its map of hardware, else the registry's; nulls where none is positive."""
    dtype = compute_dtype(told, dtypes)
    at = lambda h: F.concat_ws("|", h, dtype)
    old = _look({f"{h}|{d}": float(x) for h, m in (legacy or {}).items() for d, x in m.items() if x and x > 0}, at(hardware))
    known = {f"{h}|{d}": (float(x), s) for h, s, p in entries(registry) for d, x in (p.get("dense_tflops_per_gpu") or {}).items() if x and x > 0}
    own = _look({k: x for k, (x, _) in known.items()}, at(normalized_hardware(hardware)))
    where = F.lit(next((s for _, s in known.values()), None)).cast("string")
    row = lambda x, d, s: F.struct(x.cast("double").alias("tflops"), d.alias("dtype"), s.alias("source"))
    none = F.lit(None).cast("string")
    out = F.when(F.coalesce(explicit, F.lit(0.0)) > 0, row(explicit, F.coalesce(F.nullif(told, F.lit("")), F.lit("explicit")), F.lit("semantic rule")))
    out = out.when(F.coalesce(F.nullif(hardware, F.lit("")), dtype).isNull() | hardware.isNull() | (hardware == "") | dtype.isNull(), row(F.lit(None), none, none))
    return out.when(old.isNotNull(), row(old, dtype, F.lit("semantic-map hardware_tflops"))).when(own.isNotNull(), row(own, dtype, where)).otherwise(row(F.lit(None), dtype, none))


def bandwidth(hardware: Column, registry: dict = REGISTRY, legacy: dict[str, float] | None = None) -> Column:
    """Bandwidth in GB/s; null if unknown."""
    old = _look({h: float(x) for h, x in (legacy or {}).items() if x and x > 0}, hardware)
    own = {h: float(p["hbm_bandwidth_gb_per_s"]) for h, _, p in entries(registry) if (p.get("hbm_bandwidth_gb_per_s") or 0) > 0}
    return F.coalesce(old, _look(own, normalized_hardware(hardware)))


def dtype_bytes(c: Column) -> Column:
    """Bytes of a stored element; null for formats that are none."""
    return _look({k: float(v) for k, v in DTYPE_BYTES.items()}, F.lower(c))


def operand_bytes(storage: Column, shared: Column, dtypes: Column, computed: Column) -> Column:
    """struct(a, b, c, source): widths of both operands and the result.

    storage (array of three types) counts where all three have a width, then one type for all, then the first of dtypes
    with a width, then the computed type; null where nothing tells.
    """
    three = F.transform(storage, dtype_bytes)
    whole = F.coalesce((F.size(storage) == 3) & ~F.exists(three, lambda x: x.isNull()), F.lit(False))
    of = lambda a, b, c, s: F.struct(a.alias("a"), b.alias("b"), c.alias("c"), F.lit(s).alias("source"))
    out = F.when(whole, of(*(F.get(three, F.lit(i)) for i in range(3)), "rule.storage_dtypes"))
    first = F.get(F.filter(F.transform(dtypes, dtype_bytes), lambda x: x.isNotNull()), F.lit(0))
    for one, s in ((dtype_bytes(shared), "rule.storage_dtypes"), (first, "rule.dtypes"), (dtype_bytes(computed), "compute_dtype")):
        out = out.when(one.isNotNull(), of(one, one, one, s))
    return out


def checked_mfu(m: Column, n: Column, k: Column, us: Column, tflops: Column) -> Column:
    """Percent of the peak; null where something is missing, an error above 100, where shape, time, types or peak are wrong."""
    x = 2.0 * m * n * k / (us * tflops * 1e6) * 100
    wrong = F.raise_error(F.concat(F.lit("a share of the peak of "), F.format_number(x, 2), F.lit(" % exceeds 100 %: verify shape, time, types and peak"))).cast("double")
    known = m.isNotNull() & n.isNotNull() & k.isNotNull() & (us > 0) & (tflops > 0)
    return F.when(known & (x > 100), wrong).when(known, x)


def judged_mbu(m: Column, n: Column, k: Column, us: Column, widths: Column, gb_per_s: Column) -> Column:
    """struct(mbu, implied, rejected, reason): percent of the bandwidth that bytes counted once take.

    Above 100 the value is blank and stands in rejected: such bytes are a lower bound, so an input is wrong. Unknown widths
    are a reason too; without shape, time or bandwidth there is nothing to say.
    """
    gb = (m * k * widths["a"] + k * n * widths["b"] + m * n * widths["c"]) / (us / 1e6) / 1e9
    pct = gb / gb_per_s * 100
    none = F.lit(None)
    row = lambda a, b, c, r: F.struct(a.cast("double").alias("mbu"), b.cast("double").alias("implied"), c.cast("double").alias("rejected"), r.cast("string").alias("reason"))
    known = m.isNotNull() & n.isNotNull() & k.isNotNull() & (us > 0) & (gb_per_s > 0)
    return (
        F.when(~F.coalesce(known, F.lit(False)), row(none, none, none, none))
        .when(widths.isNull(), row(none, none, none, F.lit("no width of storage is known")))
        .when(pct > 100, row(none, F.round(gb, 3), F.round(pct, 2), F.lit("more than the bandwidth")))
        .otherwise(row(pct, gb, none, none))
    )
