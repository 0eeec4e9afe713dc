"""Capacity-limited routing of rows to buckets (mixture-of-experts gate, re-aimed).

Input: ``(row_id, logits array<double>, is_padding)``. Vector maths are array
higher-order functions (JVM, codegen). The slot of a row inside its bucket is
the running count of earlier rows routed there; it comes from the skew-safe
ordered index, so one bucket receiving most rows is still cut into balanced
ranges. Only E-sized tables (per-bucket counts) are broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.functions.hashing import gumbel, keyed_uniform
from lexiforge.operators.ordering import ordered_index
from lexiforge.session import stored

# ---- fixed values ----------------------------------------------------------
EVAL_CAPACITY_TOKEN_FRACTION = 0.25
SAMPLE_FRACTION = 0.2
FLOAT64_EPS = 2.220446049250313e-16
# ----------------------------------------------------------------------------


def _given(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once; what a lambda captures is evaluated for each element instead."""
    return F.element_at(F.transform(F.array(value), use), 1)


def softmax(a: Column) -> Column:
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x)
    return _given(a, lambda v: _given(F.array_max(v), lambda m: _given(
        F.transform(v, lambda x: F.exp(x - m)), lambda e: _given(total(e), lambda s: F.transform(e, lambda x: x / s)))))


def argmax(a: Column) -> Column:
    """0-based index of the maximum; the first one on ties."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def entropy(p: Column) -> Column:
    """-sum p ln p with 0 ln 0 = 0."""
    return -F.aggregate(p, F.lit(0.0), lambda acc, x: acc + F.when(x > 0, x * F.log(x)).otherwise(F.lit(0.0)))


def mask_index(a: Column, idx: Column, fill: float = float("-inf")) -> Column:
    return F.transform(a, lambda x, i: F.when(i == idx, F.lit(fill)).otherwise(x))


def capacity(num_rows: int, num_experts: int, top: int = 1, capacity_factor: float = 1.0,
             eval_mode: bool = False, eval_fraction: float = EVAL_CAPACITY_TOKEN_FRACTION) -> int:
    """Bucket capacity rule (train: cf * ceil(S/E) for top-1, 2 * ceil(S/E) for top-2)."""
    if eval_mode and eval_fraction > 0.0:
        return math.ceil(eval_fraction * num_rows)
    if top == 1:
        return int(capacity_factor * math.ceil(num_rows / num_experts))
    return 2 * math.ceil(num_rows / num_experts)


def make_finite(df: DataFrame, col: str = "logits") -> DataFrame:
    """Replace NaN / +-inf entries by the minimum finite entry of the whole table."""
    finite = lambda x: ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    lo = df.select(F.array_min(F.filter(F.col(col), finite)).alias("m")).agg(F.coalesce(F.min("m"), F.lit(0.0)).alias("m")).scalar()
    return df.withColumn("_lo", lo).withColumn(
        col, F.transform(F.col(col), lambda x: F.when(finite(x), x).otherwise(F.col("_lo")))).drop("_lo")


def _slots(rows: DataFrame, expert: str, out: str, order: list) -> DataFrame:
    """Running count (0-based) of routed rows per bucket in ``order``."""
    return ordered_index(rows, [expert], order, out)


def route_top1(df: DataFrame, num_experts: int, capacity_factor: float = 1.0,
               prioritized: bool = False, eval_mode: bool = False) -> tuple[DataFrame, int]:
    """(row_id, expert, slot, kept, gate, is_padding) and the capacity used."""
    n = df.count()
    cap = capacity(n, num_experts, 1, capacity_factor, eval_mode)
    # numbered and joined below: gates are computed once
    g = stored(df.select("row_id", "is_padding", softmax(F.col("logits")).alias("gates")), "gates")
    g = g.withColumn("expert", argmax(F.col("gates")))
    g = g.withColumn("max_gate", F.array_max("gates")).withColumn("gate_raw", F.element_at("gates", F.col("expert") + 1))
    routed = g.filter(~F.col("is_padding"))
    if prioritized:
        routed = routed.withColumn("_neg_gate", -F.col("max_gate"))
        slotted = _slots(routed.select("row_id", "expert", "_neg_gate"), "expert", "slot", ["_neg_gate", "row_id"])
    else:
        slotted = _slots(routed.select("row_id", "expert"), "expert", "slot", ["row_id"])
    out = g.join(slotted.select("row_id", "slot"), "row_id", "left")
    kept = F.coalesce(F.col("slot") < cap, F.lit(False))
    return (out.select("row_id", "expert", "slot", kept.alias("kept"),
                       F.when(kept, F.col("gate_raw")).otherwise(F.lit(0.0)).alias("gate"), "is_padding",
                       "gates"), cap)


def route_top2(df: DataFrame, num_experts: int, policy: str = "sampling", seed: int = 42,
               normalize_before_dropping: bool = False, prioritized: bool = False,
               eval_mode: bool = False) -> tuple[DataFrame, int]:
    """Top-2 routing; second-slot numbering starts after all first choices of the bucket.

    ``prioritized``: rows of greater best gate take slots first. ``eval_mode``: the
    evaluation capacity. Both choices are rows of one long table, so one
    index numbers the slots of first and second choices.
    """
    cap = capacity(df.count(), num_experts, 2, eval_mode=eval_mode)
    g = stored(df.select("row_id", "is_padding", "logits", softmax(F.col("logits")).alias("gates")), "gates")
    g = g.withColumn("expert1", argmax(F.col("gates")))
    if policy == "sampling":
        noisy = F.transform(F.col("logits"), lambda x, i: x + gumbel(seed, F.col("row_id"), i))
    else:
        noisy = F.col("logits")
    g = g.withColumn("expert2", argmax(mask_index(noisy, F.col("expert1"))))
    g1 = F.element_at("gates", F.col("expert1") + 1)
    g2 = F.element_at("gates", F.col("expert2") + 1)
    g = g.withColumn("g1", g1).withColumn("g2", g2)
    if normalize_before_dropping:
        den = F.greatest(F.col("g1") + F.col("g2"), F.lit(FLOAT64_EPS))
        g = g.withColumns({"g1": F.col("g1") / den, "g2": F.col("g2") / den})
    m2 = ~F.col("is_padding")
    if policy == "random":
        m2 = m2 & (F.lit(2.0) * F.col("g2") > keyed_uniform(seed, F.col("row_id")))
    g = g.withColumn("m1", ~F.col("is_padding")).withColumn("m2", m2).drop("logits")
    first = -F.array_max("gates") if prioritized else F.lit(0.0)
    long = g.select("row_id", first.alias("first"), F.explode(F.array(
        F.struct(F.lit(1).alias("choice"), F.col("expert1").alias("expert"), F.col("m1").alias("m")),
        F.struct(F.lit(2).alias("choice"), F.col("expert2").alias("expert"), F.col("m2").alias("m")))).alias("c"))
    long = long.select("row_id", "first", "c.choice", "c.expert", "c.m").filter("m").drop("m")
    slots = _slots(long, "expert", "slot", ["choice", "first", "row_id"])
    slots = slots.groupBy("row_id").agg(F.max(F.when(F.col("choice") == 1, F.col("slot"))).alias("slot1"),
                                        F.max(F.when(F.col("choice") == 2, F.col("slot"))).alias("slot2"))
    out = g.join(slots, "row_id", "left")
    k1 = F.coalesce(F.col("slot1") < cap, F.lit(False))
    k2 = F.coalesce(F.col("slot2") < cap, F.lit(False))
    out = out.withColumn("kept1", k1).withColumn("kept2", k2)
    a = F.when(F.col("kept1"), F.col("g1")).otherwise(F.lit(0.0))
    b = F.when(F.col("kept2"), F.col("g2")).otherwise(F.lit(0.0))
    if not normalize_before_dropping:
        den = F.greatest(a + b, F.lit(FLOAT64_EPS))
        a, b = a / den, b / den
    return (out.select("row_id", "expert1", "slot1", "kept1", a.alias("gate1"), "expert2", "slot2", "kept2",
                       b.alias("gate2"), "is_padding", "gates", "m1", "m2"), cap)


def report(routed: DataFrame, cap: int, num_experts: int) -> DataFrame:
    """One row: mean gate entropy and, for first and second choices, unused buckets, balance and overflow (%)."""
    long = routed.select(F.explode(F.array(F.struct(F.lit(1).alias("choice"), F.col("expert1").alias("expert")),
                                           F.struct(F.lit(2).alias("choice"), F.col("expert2").alias("expert")))).alias("c")).select("c.*")
    counts = long.groupBy("choice", "expert").agg(F.count(F.lit(1)).alias("n"))
    spine = routed.sparkSession.range(2 * num_experts).select(
        (F.floor(F.col("id") / num_experts) + 1).cast("int").alias("choice"), F.pmod("id", F.lit(num_experts)).cast("int").alias("expert"))
    k = max(math.ceil(num_experts * SAMPLE_FRACTION), 1)
    full = (spine.join(counts, ["choice", "expert"], "left").groupBy("choice")  # num_experts numbers in each
            .agg(F.array_sort(F.collect_list(F.coalesce("n", F.lit(0)))).alias("n")))
    total = F.aggregate("n", F.lit(0).cast("bigint"), lambda s, x: s + x)

    def share(part):
        return F.lit(100.0) * F.aggregate(part, F.lit(0).cast("bigint"), lambda s, x: s + x) / total

    per = full.select("choice", F.size(F.filter("n", lambda x: x == 0)).alias("unused"),
                      share(F.slice("n", num_experts - k + 1, k)).alias("top"), share(F.slice("n", 1, k)).alias("bottom"))
    per = per.agg(*[F.max(F.when(F.col("choice") == c, F.col(x))).alias(f"{name}{c}") for c in (1, 2)
                    for x, name in (("unused", "unused_expert"), ("top", "balance_top"), ("bottom", "balance_bottom"))])
    over = routed.agg(F.avg(entropy(F.col("gates"))).alias("entropy_gating"), *[
        (F.lit(100.0) * F.sum(F.when(F.col(f"m{c}") & (F.col(f"slot{c}") >= cap), 1).otherwise(0))
         / F.sum(F.when(F.col(f"m{c}"), 1).otherwise(0))).alias(f"overflow{c}") for c in (1, 2)])
    return over.select("*", *[per.select(c).scalar().alias(c) for c in per.columns])


def expert_histogram(assign: DataFrame, expert: str, num_experts: int, num_rows: int) -> DataFrame:
    """(expert, pct): share of all rows (padding included) whose argmax is the bucket."""
    spine = assign.sparkSession.range(num_experts).select(F.col("id").cast("int").alias(expert))
    counts = assign.groupBy(expert).agg(F.count(F.lit(1)).alias("n"))
    return spine.join(F.broadcast(counts), expert, "left").select(
        expert, (F.lit(100.0) * F.coalesce(F.col("n"), F.lit(0)) / F.lit(num_rows)).alias("pct"))


def balance(hist: DataFrame, num_experts: int) -> DataFrame:
    """Sum of the largest / smallest SAMPLE_FRACTION of bins, and unused bins (E rows)."""
    k = max(math.ceil(num_experts * SAMPLE_FRACTION), 1)
    from pyspark.sql.window import Window
    w_desc = Window.orderBy(F.desc("pct"), "expert")   # E rows: bounded single-partition window
    w_asc = Window.orderBy("pct", F.desc("expert"))
    h = hist.withColumn("_rd", F.row_number().over(w_desc)).withColumn("_ra", F.row_number().over(w_asc))
    return h.agg(F.sum(F.when(F.col("_rd") <= k, F.col("pct"))).alias("balance_top"),
                 F.sum(F.when(F.col("_ra") <= k, F.col("pct"))).alias("balance_bottom"),
                 F.sum(F.when(F.col("pct") == 0, 1).otherwise(0)).cast("int").alias("unused"))


def balance_loss(gated: DataFrame, mask_expert: str, mask_col: str, num_experts: int,
                 num_rows: int) -> DataFrame:
    """E^2 * mean_e(mean gate_e * mean mask_e); means over all rows incl. padding."""
    sums = [F.sum(F.get("gates", F.lit(i))).alias(f"p{i}") for i in range(num_experts)]
    per = gated.groupBy(F.col(mask_expert).alias("g")).agg(F.count(F.when(F.col(mask_col), 1)).alias("nm"), *sums)   # <= E rows and one
    each = per.select("g", "nm", F.posexplode(F.array(*[f"p{i}" for i in range(num_experts)])).alias("e", "p"))
    j = each.groupBy("e").agg(F.sum("p").alias("sp"), F.sum(F.when(F.col("g") == F.col("e"), F.col("nm"))).alias("nm"))
    s = float(num_rows)
    return j.agg((F.sum(F.col("sp") / s * F.coalesce(F.col("nm"), F.lit(0)) / s)
                  / F.lit(num_experts) * F.lit(num_experts * num_experts)).alias("l_aux"))
