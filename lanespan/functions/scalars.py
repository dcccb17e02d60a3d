"""Scalar functions as column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(c) -> Column:
    """A number out of text, percent signs at the end left out; null if it is none."""
    x = F.regexp_replace(F.trim(c), "%+$", "")
    return F.when(x.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), x.try_cast("double"))


def truthy(c, zero=0) -> Column:
    """Null where the value is zero or empty, as `a or b` has it."""
    return F.nullif(c, F.lit(zero))


def shape(c) -> Column:
    """M, N and K of text like (M=1,N=2,K=3), each null if absent."""
    return F.struct(*[F.nullif(F.regexp_extract(c, rf"{x}\s*=\s*(\d+)", 1), F.lit("")).cast("long").alias(x) for x in "MNK"])


def flops(s: Column) -> Column:
    return 2.0 * s["M"] * s["N"] * s["K"]


def mfu(s: Column, us: Column, tflops: Column) -> Column:
    """Percent of the peak that a matrix product of this shape reaches in us microseconds; may exceed 100."""
    return flops(s) / (us * tflops * 1e6) * 100


def mbu(s: Column, us: Column, gb_per_s: Column, a=2.0, b=2.0, c=2.0) -> Column:
    """Percent of the peak bandwidth, from bytes of both operands and the result by their widths."""
    size = s["M"] * s["K"] * a + s["K"] * s["N"] * b + s["M"] * s["N"] * c
    return size / (us / 1e6) / (gb_per_s * 1e9) * 100


def bounded(value: Column, hi: float = 100.0) -> Column:
    """Blank beyond hi, as nothing measured can be there."""
    return F.when(value <= hi, value)


def normalized_hardware(c) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def env_map(c, item: str = ";") -> Column:
    """A map out of k=v items; the first = splits, items without one are left out, the last of equal keys stays."""
    items = F.filter(F.split(c, item), lambda x: x.contains("="))
    pairs = F.transform(items, lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.regexp_replace(x, "^[^=]*=", "").alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.lit(0), F.size(pairs) - i - 1)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def frame_parts(c) -> Column:
    """file, line and func of a frame like file.py(12): name; null if it is none."""
    pattern = r"^(.*\.py)\((\d+)\): (.*)$"
    return F.when(c.rlike(pattern), F.struct(F.regexp_extract(c, pattern, 1).alias("file"), F.regexp_extract(c, pattern, 2).cast("int").alias("line"), F.regexp_extract(c, pattern, 3).alias("func")))


def layer_type(ratio: Column, layer: Column, layers: Column, hashed: Column, order: list[str] = ["FIRST", "HASH", "FINAL"]) -> Column:
    """Label of a layer by the first rule of `order` that holds (FIRST, HASH, FINAL), else by its compress ratio; a layer without one has -1."""
    holds = {"FIRST": layer == 0, "HASH": layer >= layers - hashed, "FINAL": layer == layers - 1}
    chain = None
    for name in order:
        chain = F.when(holds[name], name) if chain is None else chain.when(holds[name], name)
    own = F.coalesce(ratio, F.lit(-1))
    return chain.when(own == 0, "FULL_ATTN").when(own == 4, "C4_LIGHT").when(own == 128, "C128_HEAVY").otherwise(F.concat(F.lit("CR"), own.cast("string")))


# Arguments of a trace event that name a source line, and those that hold a stack.
LINE_KEYS = ["File", "file", "Source Location", "source", "callsite", "Call site"]
STACK_KEYS = ["Call stack", "Python stack", "Stack", "stack"]


def source_line(args: Column) -> Column:
    """Where an event's arguments say it comes from: the first key that names it, else file.py:line of the first stack that has one; empty if none does."""
    told = [F.nullif(F.try_element_at(args, F.lit(k)), F.lit("")) for k in LINE_KEYS]
    pattern = r"([^\s()]+\.py):(\d+)"

    def of_stack(k: str) -> Column:
        v = F.try_element_at(args, F.lit(k))
        file = F.regexp_extract(F.regexp_extract(v, pattern, 1), "[^/]*$", 0)
        return F.when(v.rlike(pattern), F.concat(file, F.lit(":"), F.regexp_extract(v, pattern, 2)))

    return F.coalesce(*told, *map(of_stack, STACK_KEYS), F.lit(""))


def device_id(c, strict: bool = False) -> Column:
    """The first whole number in a device column; where there is none, null, or an error if strict."""
    found = F.regexp_extract(c.cast("string"), r"-?\d+", 0)
    none = F.raise_error(F.concat(F.lit("no device number in "), F.coalesce(c.cast("string"), F.lit("null")))).cast("int") if strict else F.lit(None).cast("int")
    return F.when(F.coalesce(found, F.lit("")) != "", found.try_cast("int")).otherwise(none)


# Where a model's name ends.
NAME_ENDS = [" / ", " (", ", architectures=", ", model_type="]


def model_label(model: Column, architecture: Column, longest: int = 80) -> Column:
    """A model's name, or its architecture, up to the first separator; null if there is neither."""
    x = F.trim(F.coalesce(F.nullif(model, F.lit("")), architecture, F.lit("")))
    for end in NAME_ENDS:
        x = F.trim(F.substring_index(x, end, 1))
    return F.nullif(F.substring(x, 1, longest), F.lit(""))


def redacted(c: Column, secrets: list[str], instead: str = "***") -> Column:
    """Text without the secrets, the longest first."""
    for s in sorted({s for s in secrets if s}, key=lambda s: (-len(s), s)):
        c = F.replace(c, F.lit(s), F.lit(instead))
    return c


def clipped(c: Column, limit: int, marker: str = "[cut: {} bytes]") -> Column:
    """Text of no more than limit bytes; what is longer ends in a line that tells its size. A character that the cut falls into is left out."""
    size = F.octet_length(c)
    before, _, after = marker.partition("{}")
    end = F.concat(F.lit("\n" + before), size.cast("string"), F.lit(after + "\n"))
    room = F.greatest(F.lit(0), F.lit(limit) - F.octet_length(end))
    head = F.substring(F.encode(c, "utf-8"), F.lit(1), room)
    whole = F.regexp_replace(F.decode(head, "iso-8859-1"), r"[\u00C0-\u00FF][\u0080-\u00BF]{0,3}$", "")
    cut = F.coalesce(F.try_validate_utf8(head.cast("string")), F.encode(whole, "iso-8859-1").cast("string"))
    return F.when(size > limit, F.concat(cut, end)).otherwise(c)


def stack_frames(c) -> Column:
    """Frames of a call stack whose arrows are -> or →."""
    return F.filter(F.split(c, r"\s*(?:->|→)\s*"), lambda x: x != "")
