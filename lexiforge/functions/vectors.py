"""Vector and scalar column functions (array higher-order functions, no UDFs)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def asum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return asum(F.zip_with(a, b, lambda x, y: x * y))


def rms_norm(a: Column, eps: float = 1e-6, weight: Column | None = None) -> Column:
    """x / sqrt(mean(x^2) + eps), optionally times a weight vector."""
    d = a.cast("array<double>")
    r = F.sqrt(asum(F.transform(d, lambda x: x * x)) / F.size(d) + F.lit(eps))
    out = F.transform(d, lambda x: x / r)
    return F.zip_with(out, weight, lambda x, w: x * w) if weight is not None else out


def group_norm(a: Column, groups: int, eps: float = 1e-5) -> Column:
    """Layer norm without affine parameters inside each of ``groups`` equal slices."""
    d = a.cast("array<double>")
    g = F.size(d) / groups

    def slice_of(i):
        return F.slice(d, (i * g).cast("int") + 1, g.cast("int"))

    parts = []
    for h in range(groups):
        s = slice_of(F.lit(h))
        mean = asum(s) / F.size(s)
        var = asum(F.transform(s, lambda x: (x - mean) * (x - mean))) / F.size(s)
        parts.append(F.transform(s, lambda x: (x - mean) / F.sqrt(var + F.lit(eps))))
    return F.flatten(F.array(*parts))


def l2_normalize(a: Column, eps: float = 1e-4) -> Column:
    d = a.cast("array<double>")
    n = F.greatest(F.sqrt(asum(F.transform(d, lambda x: x * x))), F.lit(eps))
    return F.transform(d, lambda x: x / n)


def one_hot(idx: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i == idx).cast("int"))


def pad_to_multiple(n: Column, m: int) -> Column:
    """Padding needed to reach the next multiple of m (0 if already a multiple)."""
    return F.pmod(-n, F.lit(m))


def bucket_starts(buckets: int, max_distance: int) -> list[int]:
    """Least distance of each bucket from 1 on: one distance a bucket up to half of them, then geometric steps.

    With ``half`` exact buckets and ``rest`` others, bucket ``half + j`` starts at the least whole
    ``d`` with ``d >= half * (max_distance / half) ** (j / rest)``, found in whole numbers.
    """
    half = buckets // 2
    rest = buckets - half
    starts, d = list(range(1, half + 1)), half
    for j in range(1, rest):
        while d ** rest < half ** (rest - j) * max_distance ** j:
            d += 1
        starts.append(d)
    return starts


def log_bucket(rel: Column, bidirectional: bool = True, num_buckets: int = 32,
               max_distance: int = 128) -> Column:
    """Bucket of a relative distance: how many bucket starts the distance has reached.

    Two-sided: positions ahead (``rel > 0``) use the upper half of the buckets.
    One-sided: positions ahead count as distance 0.
    """
    side = num_buckets // 2 if bidirectional else num_buckets
    distance = F.abs(rel) if bidirectional else F.greatest(-rel, F.lit(0))
    starts = F.array(*[F.lit(d) for d in bucket_starts(side, max_distance)])
    reached = F.size(F.filter(starts, lambda d: d <= distance))
    return F.when(rel > 0, reached + side).otherwise(reached).cast("int") if bidirectional else reached.cast("int")


def sincos_angles(dim: int, heads: int = 1) -> list[float]:
    """Geometric frequencies 1 / 10000^linspace(0, 1, k), each repeated twice."""
    k = dim // heads // 2
    lin = [i / (k - 1) if k > 1 else 0.0 for i in range(k)]
    out = []
    for t in lin:
        a = 1.0 / (10000.0 ** t)
        out += [a, a]
    return out


def sincos(pos: Column, angles: list[float]) -> tuple[Column, Column]:
    arr = F.array(*[F.lit(a) for a in angles])
    return (F.transform(arr, lambda a: F.sin(pos.cast("double") * a)),
            F.transform(arr, lambda a: F.cos(pos.cast("double") * a)))


def nan_clamp(x: Column, lo: float, hi: float, nan_value: float = 0.0) -> Column:
    """NaN -> nan_value, +-inf and everything else clamped into [lo, hi]."""
    return F.greatest(F.lit(lo), F.least(F.lit(hi), F.nanvl(x, F.lit(nan_value))))


def parse_int_list(s: Column) -> Column:
    """'[2048, 4096]' -> array<bigint> (JSON parse, never eval)."""
    return F.from_json(s, "array<bigint>")


def stringify_map(m: Column) -> Column:
    return F.transform_values(m, lambda k, v: v.cast("string"))


def format_ts(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
