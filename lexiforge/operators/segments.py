"""Segment / dilation sampling over long series and log-sum-exp merging.

Positions come from the skew-safe global index, then each row is tested with
pure column arithmetic: no window, no join.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def head_offset(head: Column, heads: int, ratio: int) -> Column:
    """Offset of a head: heads are padded to a multiple of ratio and split in ratio groups."""
    per_group = math.ceil(heads / ratio)
    return F.floor(head / F.lit(per_group))


def dilate(df: DataFrame, pos: str, segment_len: int, ratio: int, heads: int) -> DataFrame:
    """Rows kept per head: ((pos mod segment) mod ratio) == offset(head); adds head, seg."""
    h = df.withColumn("head", F.explode(F.sequence(F.lit(0), F.lit(heads - 1))))
    inseg = F.pmod(F.col(pos), F.lit(segment_len))
    keep = F.pmod(inseg, F.lit(ratio)) == head_offset(F.col("head"), heads, ratio)
    return (h.withColumn("seg", F.floor(F.col(pos) / segment_len)).withColumn("sampled", keep))


def densify(sampled: DataFrame, length: int, heads: int, pos: str, value: str) -> DataFrame:
    """Sampled rows (pos, head, value) back on the dense grid of ``length`` positions and ``heads``.

    The grid is generated; a place that no row has carries value 0 and weight exp(-1e8) = 0.
    """
    grid = sampled.sparkSession.range(length).select(
        F.col("id").alias("_p"), F.explode(F.sequence(F.lit(0), F.lit(heads - 1))).alias("_h"))
    rows = sampled.select(F.col(pos).cast("long").alias("_rp"), F.col("head").cast("int").alias("_rh"), F.col(value).alias("_v"))
    out = grid.join(rows, (F.col("_p") == F.col("_rp")) & (F.col("_h") == F.col("_rh")), "left")
    there = F.col("_rp").isNotNull()
    return out.select(F.col("_p").alias(pos), F.col("_h").alias("head"), F.when(there, F.col("_v")).otherwise(F.lit(0.0)).alias(value),
                      F.when(there, F.lit(1.0)).otherwise(F.exp(F.lit(-1e8))).alias("weight"))


#: Width of the exponent ranges of ``lse_merge``: exp of it, times any count of rows, is a finite double.
RANGE = 300.0


def lse_merge(df: DataFrame, keys: Sequence[str], out: str, lse: str) -> DataFrame:
    """sum_i exp(lse_i) out_i / sum_i exp(lse_i) per key, without overflow.

    Rows are summed by ranges of their exponent, each relative to the start of
    its range, so a hot key is combined map-side and its rows are never joined
    back; the few ranges of a key are then put on the scale of the highest one.
    """
    keys = list(keys)
    low = F.floor(F.col(lse) / RANGE)
    x = F.exp(F.col(lse) - F.col("_r") * RANGE)
    part = (df.withColumn("_r", low).groupBy(*keys, "_r")
            .agg(F.sum(x).alias("_w"), F.sum(x * F.col(out)).alias("_s")))
    top = F.max("_r").over(Window.partitionBy(*keys))  # as many rows as a key has ranges
    scale = F.exp((F.col("_r") - F.col("_top")) * RANGE)
    return (part.withColumn("_top", top).groupBy(*keys)
            .agg((F.sum(scale * F.col("_s")) / F.sum(scale * F.col("_w"))).alias("merged")))
