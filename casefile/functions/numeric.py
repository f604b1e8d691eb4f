"""Numbers, vectors, hashes and geometry as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from casefile.functions.lexicon import CHI_STEPS, MEMORY_TIERS


def hamming(a: Column, b: Column, bits: int = 64) -> Column:
    """Differing bits of two hashes; a missing hash differs in all."""
    return F.coalesce(F.bit_count(a.bitwiseXOR(b)), F.lit(bits))


def hash_similarity(distance: Column, known: Column, bits: int = 64) -> Column:
    return F.when(known, 1 - distance / F.lit(float(bits))).otherwise(F.lit(0.0))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y).cast("double") * (x - y).cast("double")), F.lit(0.0), lambda s, x: s + x)


def quality_score(blur: Column, brightness: Column, contrast: Column, sharpness: Column) -> Column:
    """0 to 100: blur up to 40, sharpness 25, brightness 15, contrast 20."""
    part = lambda c, most: F.least(F.lit(float(most)), F.greatest(F.lit(0.0), c))
    light = F.greatest(F.lit(0.0), 1 - F.abs(brightness - 0.5) * 2) * 15
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), part(blur / 300 * 40, 40) + part(sharpness * 10 * 25, 25) + light + part(contrast * 20, 20)))


def decimal_degrees(deg: Column, minute: Column, sec: Column, ref: Column) -> Column:
    """From degrees, minutes and seconds; south and west are negative, a missing part gives null."""
    value = deg + minute / 60 + sec / 3600
    return F.when(ref.isin("S", "W"), -value).otherwise(value)


def bit_entropy(ones: Column, total: Column) -> Column:
    """Shannon entropy of a bit sequence; 0 for an empty or constant one."""
    p = F.try_divide(ones.cast("double"), total.cast("double"))
    term = lambda q: F.when(q > 0, -q * F.log2(q)).otherwise(F.lit(0.0))
    return F.coalesce(term(p) + term(1 - p), F.lit(0.0))


def chi_square(counts: list[Column]) -> Column:
    """Of counts against equal shares; 0 where nothing was counted."""
    each = sum(counts, F.lit(0)) / F.lit(float(len(counts)))
    return F.coalesce(F.try_divide(sum(((c - each) * (c - each) for c in counts), F.lit(0.0)), each), F.lit(0.0))


def chi_p_value(chi: Column) -> Column:
    out = F.lit(0.50)
    for limit, p in reversed(CHI_STEPS):
        out = F.when(chi > limit, p).otherwise(out)
    return out


def angle_gap(a: Column, b: Column) -> Column:
    return F.least(F.abs(a - b), 360 - F.abs(a - b))


def backoff_delay(attempt: Column, initial: float, base: float, most: float, jitter: Column | None = None) -> Column:
    delay = F.least(F.lit(initial) * F.pow(F.lit(base), attempt), F.lit(most))
    return delay if jitter is None else delay * (0.5 + jitter)


def memory_tier(gb: Column) -> Column:
    out = F.lit("")
    for least, name in MEMORY_TIERS:
        out = F.when(gb >= least, name).otherwise(out)
    return out


def box_center(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(((x1 + x2) / 2).cast("int").alias("x"), ((y1 + y2) / 2).cast("int").alias("y"))


def padded_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, pad: int = 10) -> Column:
    return F.struct(
        F.greatest(F.lit(0), x1 - pad).alias("x1"), F.greatest(F.lit(0), y1 - pad).alias("y1"),
        F.least(width, x2 + pad).alias("x2"), F.least(height, y2 + pad).alias("y2"),
    )


def frame_stamp(frame: Column, fps: Column) -> Column:
    """``MMmSSs`` of a frame; a frame rate of 0 counts as second 0."""
    at = F.when(fps > 0, F.floor(frame / fps)).otherwise(0)
    return F.format_string("%02dm%02ds", F.floor(at / 60), at % 60)
