"""Experiment book-keeping as DataFrame operators.

Checkpoint selection, early stopping, names,
grids of hyper-parameters, latency and emissions roll-ups. Per-run operators
use the skew-safe index and two-level windows (chunk, then per-chunk table),
so one run holding most of the rows is still spread over many tasks.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiforge.operators.decay import prefix_max_before, prefix_min_before
from lexiforge.operators.ordering import ordered_index

CHUNK = 4096


def tail_ids(ids: Column, length: int) -> Column:
    """Last ``length`` ids (trailing context crop)."""
    start = F.greatest(F.lit(1), F.size(ids) - length + 1)
    return F.slice(ids, start, length)


def early_stop(df: DataFrame, keys: Sequence[str], pos: str, value: str, patience: int) -> DataFrame:
    """First position where ``patience`` validations in a row brought no new minimum.

    ``patience <= 0`` disables stopping (stop_pos is NULL).
    """
    keys = list(keys)
    d = prefix_min_before(df, keys, pos, value, "_prev_min", CHUNK)
    d = d.withColumn("_best_here", F.when(F.col("_prev_min").isNull() | (F.col(value) < F.col("_prev_min")),
                                          F.col(pos)))
    d = prefix_max_before(d, keys, pos, "_best_here", "_last_best", CHUNK)
    stop = (F.min(F.when(F.col(pos) - F.col("_last_best") >= patience, F.col(pos)))
            if patience > 0 else F.lit(None).cast("bigint"))
    return d.groupBy(*keys).agg(stop.alias("stop_pos"), F.count(F.lit(1)).alias("n_validations"))


def checkpoint_topk(df: DataFrame, keys: Sequence[str], pos: str, value: str, k: int) -> DataFrame:
    """Rows kept by a top-k-by-minimum checkpoint policy, plus the last row.

    Ties: the earlier position wins. ``k = -1`` keeps every row.
    Two levels: top-k inside chunks of a run, then top-k of the candidates.
    """
    keys = list(keys)
    last = df.groupBy(*keys).agg(F.max(pos).alias(pos)).withColumn("is_last", F.lit(True))
    if k < 0:
        top = ordered_index(df.select(*keys, pos, value), keys, [value, pos], "_r").select(
            *keys, pos, (F.col("_r") + 1).cast("int").alias("topk_rank"))
    else:
        # top-k per chunk, then per chunk of chunks, then per run: each window
        # holds at most CHUNK rows or k * CHUNK candidates
        cand = df.select(*keys, pos, value)
        for level, width in enumerate((CHUNK, CHUNK * CHUNK)):
            w = Window.partitionBy(*keys, F.floor(F.col(pos) / width)).orderBy(value, pos)
            cand = cand.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")
        w_run = Window.partitionBy(*keys).orderBy(value, pos)
        top = (cand.withColumn("topk_rank", F.row_number().over(w_run)).filter(F.col("topk_rank") <= k)
               .select(*keys, pos, F.col("topk_rank").cast("int")))
    res = top.join(last, [*keys, pos], "full_outer")
    return res.select(*keys, pos, "topk_rank", F.coalesce(F.col("is_last"), F.lit(False)).alias("is_last"))


def best_checkpoint(df: DataFrame, keys: Sequence[str], pos: str, value: str) -> DataFrame:
    """(keys, best_pos, best_value): one partial/final aggregate, ties -> earlier."""
    best = F.min(F.struct(F.col(value), F.col(pos)))
    return df.groupBy(*keys).agg(best.alias("_b")).select(
        *keys, F.col(f"_b.{pos}").alias("best_pos"), F.col(f"_b.{value}").alias("best_value"))


def ckpt_name(counter: Column, epoch: Column, val_loss: Column) -> Column:
    """ckpt_<counter:03d>_epoch=<epoch>_val_loss=<loss:.2f>."""
    return F.format_string("ckpt_%03d_epoch=%d_val_loss=%.2f", counter.cast("int"), epoch.cast("bigint"), val_loss)


def run_label(given: Column, model_type: Column, n_params: Column, lr: Column, grad_clip: Column) -> Column:
    """Given label, else <type>_<params>_LR<lr>_GC<clip>."""
    return F.coalesce(given, F.concat(model_type, F.lit("_"), n_params.cast("string"), F.lit("_LR"),
                                      lr.cast("string"), F.lit("_GC"), grad_clip.cast("string")))


def latency_summary(trials: DataFrame) -> DataFrame:
    """(seq_len, kind) -> n_trials, mean, min, max, median seconds.

    The median is read off the rows in the middle of a skew-safe index, so no
    task holds a group's values.
    """
    keys = ["seq_len", "kind"]
    stats = trials.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_trials"), F.avg("seconds").alias("mean_s"), F.min("seconds").alias("min_s"),
        F.max("seconds").alias("max_s"))
    placed = ordered_index(trials.filter(F.col("seconds").isNotNull()).select(*keys, "seconds", "trial"), keys, ["seconds", "trial"], "_at")
    size = placed.groupBy(*keys).agg(F.max("_at").alias("_last"))
    middle = (placed.join(size, keys).filter((F.col("_at") == F.floor(F.col("_last") / 2)) | (F.col("_at") == F.ceil(F.col("_last") / 2)))
              .groupBy(*keys).agg(F.avg("seconds").alias("median_s")))
    return stats.join(middle, keys, "left")


def emissions_rollup(runs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sum duration / emissions / energy per group and the emission rate per hour."""
    return runs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_runs"), F.sum("duration").alias("duration_s"),
        F.sum("emissions").alias("emissions_kg"), F.sum("energy_consumed").alias("energy"),
        (F.sum("emissions") / (F.sum("duration") / 3600.0)).alias("kg_per_hour"))


def default_if_falsy(col: Column, default) -> Column:
    """Python-style default: NULL, 0 or an empty string/array take ``default``."""
    falsy = col.isNull() | col.cast("string").isin("0", "0.0", "", "[]")
    return F.when(falsy, F.lit(default)).otherwise(col)
