"""Vector and score functions as columns. Elements are cast to double before any arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BINS = 200_000


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalised(v: Column, policy: str = "raw", eps: float = 1e-10) -> Column:
    """policy: raw (divide by the norm), eps (by the norm but at least eps; a zero vector stays zero), unit (only if off by 1e-3)."""
    n = norm(v)
    by = {"raw": n, "eps": F.greatest(n, F.lit(eps)), "unit": F.when(F.abs(n - 1) > 1e-3, n).otherwise(1.0)}[policy]
    return F.transform(v, lambda x: x.cast("double") / by)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def clamped(sim: Column) -> Column:
    """Into [-1, 1]. NaN would become 1, so vectors are validated before scores are made."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sim))


def bin_of(sim: Column, bins: int = BINS, policy: str = "floor") -> Column:
    """floor: equal bins, the last one closed; nearest: bins + 1 slots, halves to even; wide: floor on a grid of bins - 1."""
    if policy == "nearest":
        return F.rint((sim + 1) * (bins / 2)).cast("long")
    if policy == "wide":
        return F.floor((sim + 1) / 2 * (bins - 1)).cast("long")
    return F.least(F.lit(bins - 1), F.floor((sim + 1) * (bins / 2)).cast("long"))


def fixed_point(sim: Column, scale: int = 1_000_000) -> Column:
    return F.rint(sim * scale).cast("long")


def edge(k: Column, bins: int = BINS) -> Column:
    """The left edge of a bin."""
    return k * (2.0 / bins) - 1.0


def centre(k: Column, bins: int = BINS) -> Column:
    return (k + 0.5) * (2.0 / bins) - 1.0


def beyond(sim: Column, op: str, threshold: float | Column) -> Column:
    t = F.lit(threshold) if isinstance(threshold, float) else threshold
    return {">": sim > t, ">=": sim >= t, "<": sim < t, "<=": sim <= t}[op]


def pair_type(is_pos: Column, sim: Column, threshold: float) -> Column:
    return (
        F.when(is_pos & (sim > threshold), "true_accept").when(~is_pos & (sim > threshold), "false_accept").when(is_pos, "false_reject").otherwise("true_reject")
    )


def checked_fpirs(values, closed: bool = False) -> list[float]:
    """Sorted, without repeats; each inside (0, 1), or [0, 1] if closed."""
    out = sorted({float(v) for v in values})
    if not out or any(not (0 <= v <= 1 if closed else 0 < v < 1) for v in out):
        raise ValueError(f"false positive rates must lie between 0 and 1: {out}")
    return out
