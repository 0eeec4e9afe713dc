"""Exponentially decayed running aggregates, skew-safe.

``o_n = sum_{m <= n} gamma^(n-m) v_m`` per key in a given order (retention-style
decay). Two forms:

* ``decayed_sum``: chunk form. Positions come from the skew-safe ordered index;
  inside a chunk of C rows the closed form ``gamma^j * cumsum(gamma^-j v)`` is
  exact and cannot overflow (C * ln(1/gamma) <= 600); chunk totals are carried
  to the next chunks by the *same* operator one level up (factor gamma^C).
  Windows only ever span one chunk, so a key holding a third of the data is
  spread over many tasks.
* ``decayed_norm``: the recurrent form's output ``S / sqrt(scale)`` with
  ``scale_n = sum_{k<=n} gamma^k`` (closed form).
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiforge.operators.ordering import ordered_index

MAX_EXP = 600.0        # keep gamma^-j below e^600
UNDERFLOW = 746.0      # e^-746 is 0 in doubles
MAX_CHUNK = 1 << 20
MAX_REACH = 64         # earlier chunks that a rate looks back to in one pass


def head_gammas(heads: int) -> list[float]:
    """Multi-rate decay: gamma_h = 1 - 2^(-5-h)."""
    return [1.0 - 2.0 ** (-5 - h) for h in range(heads)]


def chunk_size(gamma: float) -> int:
    lg = -math.log(gamma)
    return int(max(2, min(MAX_CHUNK, math.floor(MAX_EXP / lg)))) if lg > 0 else MAX_CHUNK


def _decay_dense(df: DataFrame, keys: list, idx: str, v: str, gamma: float, out: str,
                 chunk: int | None) -> DataFrame:
    """Decayed sum over a dense 0-based ``idx`` per key."""
    if gamma <= 0.0:
        return df.withColumn(out, F.col(v))
    lg = -math.log(gamma)
    C = min(chunk or MAX_CHUNK, chunk_size(gamma))  # beyond that gamma^-j would overflow
    c = F.floor(F.col(idx) / C)
    d = df.withColumn("_c", c).withColumn("_j", F.col(idx) - F.col("_c") * C)
    w = (Window.partitionBy(*keys, "_c").orderBy("_j")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    g = F.lit(gamma)
    d = d.withColumn("_loc", F.pow(g, F.col("_j")) * F.sum(F.col(v) * F.pow(g, -F.col("_j"))).over(w))
    # chunk totals at the end of each full chunk
    tot = d.groupBy(*keys, "_c").agg(F.sum(F.col(v) * F.pow(g, F.lit(C - 1) - F.col("_j"))).alias("_T"))
    big_gamma = gamma ** C
    if 2 * C * lg >= UNDERFLOW:
        # E_{c-1} = T_{c-1} + Gamma T_{c-2}; the factor of older chunks, Gamma^2, is 0 in doubles
        t1 = tot.select(*keys, (F.col("_c") + 1).alias("_c"), F.col("_T").alias("_t1"))
        t2 = tot.select(*keys, (F.col("_c") + 2).alias("_c"), F.col("_T").alias("_t2"))
        carry = (t1.join(t2, [*keys, "_c"], "left")
                 .select(*keys, "_c", (F.col("_t1") + F.lit(big_gamma) * F.coalesce(F.col("_t2"), F.lit(0.0)))
                         .alias("_carry")))
    else:
        # carried state is itself a decayed sum over chunks with factor gamma^C
        e = _decay_dense(tot.withColumnRenamed("_c", "_ci"), keys, "_ci", "_T", big_gamma, "_E", None)
        carry = e.select(*keys, (F.col("_ci") + 1).alias("_c"), F.col("_E").alias("_carry"))
    res = d.join(carry, [*keys, "_c"], "left").withColumn(
        out, F.col("_loc") + F.pow(g, F.col("_j") + 1) * F.coalesce(F.col("_carry"), F.lit(0.0)))
    return res.drop("_c", "_j", "_loc", "_carry")


def decayed_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, gamma: float,
                out: str = "decayed", chunk: int | None = None, pos: str = "pos") -> DataFrame:
    """Chunk form: adds ``pos`` (0-based order in key) and ``out``."""
    idx = ordered_index(df, list(keys), list(order), pos)
    return _decay_dense(idx, list(keys), pos, value, gamma, out, chunk)


def decayed_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, rates: dict[str, float],
                 pos: str = "pos") -> DataFrame:
    """Several rates in one pass: adds ``pos`` and a column of each of ``rates`` (name -> gamma, 0 < gamma < 1).

    Chunks are as long as the fastest rate allows; one window gives the sums of all
    rates inside a chunk, and a chunk's total goes straight to the later chunks in
    which it is not yet 0 in doubles. Rates that look back further than MAX_REACH
    chunks are carried level by level instead.
    """
    keys = list(keys)
    d = ordered_index(df, keys, list(order), pos)
    C = min(chunk_size(g) for g in rates.values())
    reach = {c: math.ceil(UNDERFLOW / (C * -math.log(g))) for c, g in rates.items()}
    fast = [c for c in rates if reach[c] <= MAX_REACH]
    d = d.withColumn("_c", F.floor(F.col(pos) / C)).withColumn("_j", F.col(pos) - F.col("_c") * C)
    w = (Window.partitionBy(*keys, "_c").orderBy("_j")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    v, j = F.col(value), F.col("_j")
    d = d.withColumns({f"_l_{c}": F.pow(F.lit(rates[c]), j) * F.sum(v * F.pow(F.lit(rates[c]), -j)).over(w) for c in fast})
    totals = d.groupBy(*keys, "_c").agg(*[F.sum(v * F.pow(F.lit(rates[c]), F.lit(C - 1) - j)).alias(f"_t_{c}") for c in fast])
    later = totals.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(max(reach[c] for c in fast)))))
    carry = (later.withColumn("_c", F.col("_c") + F.col("_k")).groupBy(*keys, "_c")
             .agg(*[F.sum(F.col(f"_t_{c}") * F.pow(F.lit(rates[c]), (F.col("_k") - 1) * C)).alias(f"_e_{c}") for c in fast]))
    d = d.join(carry, [*keys, "_c"], "left").withColumns(
        {c: F.col(f"_l_{c}") + F.pow(F.lit(rates[c]), j + 1) * F.coalesce(F.col(f"_e_{c}"), F.lit(0.0)) for c in fast})
    d = d.drop("_c", "_j", *[f"_{k}_{c}" for k in "le" for c in fast])
    for c in rates:
        if c not in fast:
            d = _decay_dense(d, keys, pos, value, rates[c], c, None)
    return d


def decayed_norm(decayed: str, pos: str, gamma: float):
    """Recurrent form output: S / sqrt(sum_{k<=pos} gamma^k)."""
    if gamma == 1.0:
        scale = F.col(pos) + 1
    else:
        scale = (F.lit(1.0) - F.pow(F.lit(gamma), F.col(pos) + 1)) / F.lit(1.0 - gamma)
    return F.col(decayed) / F.sqrt(scale)


def _prefix(df: DataFrame, keys: list, idx: str, value: str, out: str, agg, inclusive: bool,
            chunk: int, levels: int) -> DataFrame:
    """agg of ``value`` over earlier (or earlier-or-equal) rows of the key.

    Running aggregate inside chunks of ``chunk`` rows; the aggregate of all
    earlier chunks comes from the per-chunk table, itself handled the same way
    for ``levels`` more levels, so the top window holds n / chunk^(levels+1)
    rows of a key.
    """
    c, tin, tm, tb = f"_c{levels}", f"_in{levels}", f"_m{levels}", f"_before{levels}"
    d = df.withColumn(c, F.floor(F.col(idx) / chunk))
    w_in = Window.partitionBy(*keys, c).orderBy(idx).rowsBetween(
        Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    d = d.withColumn(tin, agg(value).over(w_in))
    per = d.groupBy(*keys, c).agg(agg(value).alias(tm))
    if levels > 0:
        per = _prefix(per, keys, c, tm, tb, agg, False, chunk, levels - 1).drop(tm)
    else:
        w_ch = Window.partitionBy(*keys).orderBy(c).rowsBetween(Window.unboundedPreceding, -1)
        per = per.withColumn(tb, agg(tm).over(w_ch)).drop(tm)
    combine = F.least if agg is F.min else F.greatest
    res = d.join(per, [*keys, c], "left").withColumn(out, combine(F.col(tin), F.col(tb)))
    return res.drop(c, tin, tb)


def prefix_min_before(df: DataFrame, keys: Sequence[str], idx: str, value: str, out: str,
                      chunk: int = 4096, levels: int = 1) -> DataFrame:
    """Minimum of ``value`` over earlier rows of the key (NULL for the first)."""
    return _prefix(df, list(keys), idx, value, out, F.min, False, chunk, levels)


def prefix_max_before(df: DataFrame, keys: Sequence[str], idx: str, value: str, out: str,
                      chunk: int = 4096, levels: int = 1) -> DataFrame:
    """Maximum over earlier-or-equal rows (inclusive running max)."""
    return _prefix(df, list(keys), idx, value, out, F.max, True, chunk, levels)
