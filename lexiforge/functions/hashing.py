"""Keyed deterministic uniforms: the same value in Spark and in DuckDB.

A uniform in [0, 1) is the first 32 bits of ``md5('<seed>:<key>')`` divided by
2^32. It depends only on the row key, never on partitioning, so splits and
samples are stable under retries and re-partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def keyed_uniform(seed, *keys: Column) -> Column:
    s = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("bigint") / F.lit(TWO_32)


def open_uniform(seed, *keys: Column) -> Column:
    """Uniform clipped into the open interval (0, 1) (safe for logarithms)."""
    return (keyed_uniform(seed, *keys) * F.lit(TWO_32) + F.lit(0.5)) / F.lit(TWO_32)


def gumbel(seed, *keys: Column) -> Column:
    """Standard Gumbel sample -ln(-ln(u))."""
    return -F.log(-F.log(open_uniform(seed, *keys)))
