"""Routing queries (X1-X8, A6-A8, W1, W2, J4, P8, K3, F7, F8, F11) on ``embeddings``.

There is a bucket for each label: its centroid is the mean embedding of that
label. Gate logits = dot product with the L2-normalised centroids (rows
themselves are not normalised). Rows without a label play the padding rows.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from lexiforge.operators import routing
from lexiforge.plans.params import SEED, sql_uniform
from lexiforge.plans.registry import register, table

E = 10
NUDGE = 3.1e-10


def r6(c):
    return F.round(c + NUDGE, 6)


def centroids(spark, sf_dir):
    """One row: the E x D matrix of normalised centroids; labels of E and more, and those without rows, have no bucket."""
    emb = table(spark, sf_dir, "embeddings").filter(F.col("label") < E)
    m = (emb.select("label", F.posexplode("embedding").alias("d", "v")).groupBy("label", "d").agg(F.avg("v").alias("m"))
         .groupBy("label").agg(F.array_sort(F.collect_list(F.struct("d", "m"))).alias("c")))
    norm = F.greatest(F.sqrt(F.aggregate("c", F.lit(0.0), lambda s, x: s + x["m"] * x["m"])), F.lit(1e-4))
    m = m.withColumn("n", norm).select("label", F.transform("c", lambda x: x["m"] / F.col("n")).alias("c"))
    return m.agg(F.array_sort(F.collect_list(F.struct("label", "c"))).alias("rows")).select(
        F.transform("rows", lambda r: r["c"]).alias("matrix"))


def gate_rows(spark, sf_dir):
    """(row_id, logits, is_padding, embedding)."""
    emb = table(spark, sf_dir, "embeddings").withColumn("_matrix", centroids(spark, sf_dir).scalar())
    x = F.col("embedding")
    logits = F.transform("_matrix", lambda c: F.aggregate(F.zip_with(x, c, lambda a, b: a.cast("double") * b),
                                                          F.lit(0.0), lambda s, v: s + v))
    return emb.select(F.col("vec_id").alias("row_id"), logits.alias("logits"),
                      F.col("label").isNull().alias("is_padding"), "embedding")


# SQL twin of gate_rows -------------------------------------------------------------
SQL_GATES = f"""
cen AS (SELECT label AS e, d, avg(v) AS m FROM (SELECT label, unnest(embedding) AS v, unnest(range(0, len(embedding))) AS d
        FROM embeddings WHERE label < {E}) GROUP BY label, d),
nrm AS (SELECT e, greatest(sqrt(sum(m * m)), 1e-4) AS n FROM cen GROUP BY e),
cw AS (SELECT c.e, c.d, c.m / n.n AS w FROM cen c JOIN nrm n USING (e)),
xv AS (SELECT vec_id, unnest(embedding) AS v, unnest(range(0, len(embedding))) AS d FROM embeddings),
lg AS (SELECT x.vec_id, c.e, sum(CAST(x.v AS DOUBLE) * c.w) AS logit FROM xv x JOIN cw c USING (d) GROUP BY x.vec_id, c.e),
gr AS (SELECT l.vec_id, list(logit ORDER BY e) AS logits, any_value(m.label) IS NULL AS is_padding
       FROM lg l JOIN embeddings m USING (vec_id) GROUP BY l.vec_id),
sm AS (SELECT *, list_transform(logits, lambda x: exp(x - list_max(logits))) AS ex FROM gr),
gt AS (SELECT vec_id, logits, is_padding, list_transform(ex, lambda x: x / list_sum(ex)) AS gates FROM sm),
a1 AS (SELECT *, CAST(list_position(gates, list_max(gates)) - 1 AS INTEGER) AS expert1 FROM gt),
sz AS (SELECT count(*) AS S FROM embeddings)"""

SQL_TOP1 = SQL_GATES + """,
sl AS (SELECT vec_id, row_number() OVER (PARTITION BY expert1 ORDER BY vec_id) - 1 AS slot FROM a1 WHERE NOT is_padding),
t1 AS (SELECT a1.vec_id, expert1 AS expert, slot, coalesce(slot < CAST(ceil(S / {E}) AS BIGINT), false) AS kept,
              CASE WHEN coalesce(slot < CAST(ceil(S / {E}) AS BIGINT), false) THEN gates[expert1 + 1] ELSE 0.0 END AS gate,
              gates, is_padding
       FROM a1 LEFT JOIN sl USING (vec_id), sz)""".replace("{E}", str(E))


def sql_top2(policy: str, prioritized: bool = False, eval_mode: bool = False, before: bool = False) -> str:
    if policy == "sampling":
        noisy = ("list_transform(logits, lambda x, i: x - ln(-ln(((('0x' || substr(md5('" + str(SEED) +
                 ":' || CAST(vec_id AS VARCHAR) || ':' || CAST(i - 1 AS VARCHAR)), 1, 8))::BIGINT) + 0.5) / 4294967296.0)))")
        m2 = "NOT is_padding"
    else:
        noisy = "logits"
        m2 = f"NOT is_padding AND 2.0 * g2 > {sql_uniform('vec_id')}"
    first = "list_max(gates) DESC, vec_id" if prioritized else "vec_id"
    cap = f"CAST(ceil({routing.EVAL_CAPACITY_TOKEN_FRACTION} * S) AS BIGINT)" if eval_mode else f"2 * CAST(ceil(S / {E}) AS BIGINT)"
    raw = "gates[expert{0} + 1]"
    both = f"greatest({raw.format(1)} + {raw.format(2)}, {routing.FLOAT64_EPS!r})"
    g1, g2 = (f"{raw.format(c)} / {both}" if before else raw.format(c) for c in (1, 2))
    k1, k2 = ("CASE WHEN kept%d THEN g%d ELSE 0.0 END" % (c, c) for c in (1, 2))
    den = "1.0" if before else f"greatest(({k1}) + ({k2}), {routing.FLOAT64_EPS!r})"
    return SQL_GATES + f""",
n2 AS (SELECT *, {noisy} AS noisy FROM a1),
a2 AS (SELECT *, CAST(list_position(list_transform(noisy, lambda x, i: CASE WHEN i - 1 = expert1 THEN '-inf'::DOUBLE ELSE x END),
                  list_max(list_transform(noisy, lambda x, i: CASE WHEN i - 1 = expert1 THEN '-inf'::DOUBLE ELSE x END))) - 1 AS INTEGER) AS expert2 FROM n2),
g AS (SELECT *, {g1} AS g1, {g2} AS g2 FROM a2),
m AS (SELECT *, NOT is_padding AS m1, {m2} AS m2 FROM g),
s1 AS (SELECT vec_id, row_number() OVER (PARTITION BY expert1 ORDER BY {first}) - 1 AS slot1 FROM m WHERE m1),
c1 AS (SELECT expert1 AS expert2, count(*) AS n1 FROM m WHERE m1 GROUP BY expert1),
s2 AS (SELECT vec_id, row_number() OVER (PARTITION BY m.expert2 ORDER BY {first}) - 1 + coalesce(any_value(n1) OVER (PARTITION BY m.expert2), 0) AS slot2
       FROM m LEFT JOIN c1 ON c1.expert2 = m.expert2 WHERE m2),
k AS (SELECT m.*, slot1, slot2, coalesce(slot1 < {cap}, false) AS kept1, coalesce(slot2 < {cap}, false) AS kept2, {cap} AS cap
      FROM m LEFT JOIN s1 USING (vec_id) LEFT JOIN s2 USING (vec_id), sz),
t2 AS (SELECT *, ({k1}) / {den} AS gate1, ({k2}) / {den} AS gate2 FROM k)"""


def top1(spark, sf_dir, prioritized=False):
    return routing.route_top1(gate_rows(spark, sf_dir), E, prioritized=prioritized)


def top2(spark, sf_dir, policy="sampling", **kw):
    return routing.route_top2(gate_rows(spark, sf_dir), E, policy=policy, seed=SEED, **kw)


@register("route_capacity", sql=f"""
SELECT count(*) AS num_rows, {E} AS num_experts, CAST(ceil(count(*) / {E}) AS BIGINT) AS cap_top1,
       2 * CAST(ceil(count(*) / {E}) AS BIGINT) AS cap_top2, CAST(ceil({routing.EVAL_CAPACITY_TOKEN_FRACTION} * count(*)) AS BIGINT) AS cap_eval
FROM embeddings""")
def route_capacity(spark, sf_dir):
    n = F.col("num_rows")
    per = F.ceil(n / E)
    return table(spark, sf_dir, "embeddings").agg(F.count(F.lit(1)).alias("num_rows")).select(
        "num_rows", F.lit(E).alias("num_experts"), per.cast("bigint").alias("cap_top1"), (2 * per).cast("bigint").alias("cap_top2"),
        F.ceil(n * routing.EVAL_CAPACITY_TOKEN_FRACTION).cast("bigint").alias("cap_eval"))


@register("route_top1", sql=f"""WITH {SQL_TOP1}
SELECT vec_id, expert, slot, kept, round(gate + 3.1e-10, 6) AS gate FROM t1""")
def route_top1(spark, sf_dir):
    r, _ = top1(spark, sf_dir)
    return r.select(F.col("row_id").alias("vec_id"), "expert", "slot", "kept", r6(F.col("gate")).alias("gate"))


def _top2_select(r):
    return r.select(F.col("row_id").alias("vec_id"), "expert1", "slot1", "kept1", r6(F.col("gate1")).alias("gate1"),
                    "expert2", "slot2", "kept2", r6(F.col("gate2")).alias("gate2"))


_T2_SQL_OUT = "SELECT vec_id, expert1, slot1, kept1, round(gate1 + 3.1e-10, 6) AS gate1, expert2, slot2, kept2, round(gate2 + 3.1e-10, 6) AS gate2 FROM t2"


@register("route_top2", sql=f"WITH {sql_top2('sampling')} {_T2_SQL_OUT}")
def route_top2(spark, sf_dir):
    r, _ = top2(spark, sf_dir, "sampling")
    return _top2_select(r)


@register("route_top2_random", sql=f"WITH {sql_top2('random')} {_T2_SQL_OUT}")
def route_top2_random(spark, sf_dir):
    r, _ = top2(spark, sf_dir, "random")
    return _top2_select(r)


@register("route_top2_priority", sql=f"WITH {sql_top2('sampling', prioritized=True)} {_T2_SQL_OUT}")
def route_top2_priority(spark, sf_dir):
    """Rows of greater best gate take the slots of first and second choices first."""
    return _top2_select(top2(spark, sf_dir, prioritized=True)[0])


@register("route_top2_eval", sql=f"WITH {sql_top2('sampling', eval_mode=True, before=True)} {_T2_SQL_OUT}")
def route_top2_eval(spark, sf_dir):
    """Evaluation capacity; gates are normalised before rows are dropped."""
    return _top2_select(top2(spark, sf_dir, eval_mode=True, normalize_before_dropping=True)[0])


@register("route_overflow", sql=f"""WITH {sql_top2('sampling')}
SELECT round(100.0 * count(*) FILTER (WHERE m1 AND slot1 >= cap) / count(*) FILTER (WHERE m1) + 3.1e-10, 6) AS overflow1,
       round(100.0 * count(*) FILTER (WHERE m2 AND slot2 >= cap) / count(*) FILTER (WHERE m2) + 3.1e-10, 6) AS overflow2 FROM t2""")
def route_overflow(spark, sf_dir):
    r, cap = top2(spark, sf_dir, "sampling")
    return routing_overflow(r, cap)


def routing_overflow(r, cap):
    o1 = F.sum(F.when(F.col("m1") & (F.col("slot1") >= cap), 1).otherwise(0)) / F.sum(F.when(F.col("m1"), 1).otherwise(0))
    o2 = F.sum(F.when(F.col("m2") & (F.col("slot2") >= cap), 1).otherwise(0)) / F.sum(F.when(F.col("m2"), 1).otherwise(0))
    return r.agg(r6(F.lit(100.0) * o1).alias("overflow1"), r6(F.lit(100.0) * o2).alias("overflow2"))


@register("route_balance_loss", sql=f"""WITH {SQL_GATES},
me AS (SELECT i AS e, sum(p) AS sp FROM (SELECT unnest(gates) AS p, unnest(range(0, {E})) AS i FROM gt) GROUP BY i),
ce AS (SELECT expert1 AS e, count(*) AS nm FROM a1 WHERE NOT is_padding GROUP BY expert1)
SELECT round(sum(sp / S * coalesce(nm, 0) / S) / {E} * {E * E} + 3.1e-10, 6) AS l_aux FROM me LEFT JOIN ce USING (e), sz""")
def route_balance_loss(spark, sf_dir):
    r, _ = top1(spark, sf_dir)
    n = table(spark, sf_dir, "embeddings").count()
    gated = r.withColumn("m", ~F.col("is_padding"))
    return routing.balance_loss(gated, "expert", "m", E, n).select(r6(F.col("l_aux")).alias("l_aux"))


@register("gate_entropy", sql=f"""WITH {SQL_GATES}
SELECT vec_id, round(-list_sum(list_transform(gates, lambda p: CASE WHEN p > 0 THEN p * ln(p) ELSE 0.0 END)) + 3.1e-10, 6) AS entropy FROM gt""")
def gate_entropy(spark, sf_dir):
    g = gate_rows(spark, sf_dir)
    return g.select(F.col("row_id").alias("vec_id"), r6(routing.entropy(routing.softmax(F.col("logits")))).alias("entropy"))


_SQL_HIST = f""",
sp AS (SELECT unnest(range(0, {E})) AS expert),
hc AS (SELECT expert1 AS expert, count(*) AS n FROM a1 GROUP BY expert1),
hist AS (SELECT CAST(expert AS INTEGER) AS expert, 100.0 * coalesce(n, 0) / S AS pct FROM sp LEFT JOIN hc USING (expert), sz)"""


@register("expert_histogram", sql=f"""WITH {SQL_GATES}{_SQL_HIST}
SELECT expert, round(pct + 3.1e-10, 6) AS pct FROM hist""")
def expert_histogram(spark, sf_dir):
    r, _ = top1(spark, sf_dir)
    n = table(spark, sf_dir, "embeddings").count()
    h = routing.expert_histogram(r, "expert", E, n)
    return h.select("expert", r6(F.col("pct")).alias("pct"))


_K = max(math.ceil(E * routing.SAMPLE_FRACTION), 1)


@register("expert_balance", sql=f"""WITH {SQL_GATES}{_SQL_HIST},
rk AS (SELECT *, row_number() OVER (ORDER BY pct DESC, expert) AS rd, row_number() OVER (ORDER BY pct, expert DESC) AS ra FROM hist)
SELECT round(sum(pct) FILTER (WHERE rd <= {_K}) + 3.1e-10, 6) AS balance_top, round(sum(pct) FILTER (WHERE ra <= {_K}) + 3.1e-10, 6) AS balance_bottom,
       CAST(count(*) FILTER (WHERE pct = 0) AS INTEGER) AS unused FROM rk""")
def expert_balance(spark, sf_dir):
    r, _ = top1(spark, sf_dir)
    n = table(spark, sf_dir, "embeddings").count()
    b = routing.balance(routing.expert_histogram(r, "expert", E, n), E)
    return b.select(r6(F.col("balance_top")).alias("balance_top"), r6(F.col("balance_bottom")).alias("balance_bottom"),
                    "unused")


def _sql_balance(c: int) -> str:
    return f"""h{c} AS (SELECT 100.0 * coalesce(n, 0) / S AS pct FROM (SELECT unnest(range(0, {E})) AS e) x
      LEFT JOIN (SELECT expert{c} AS e, count(*) AS n FROM t2 GROUP BY expert{c}) y USING (e), sz),
r{c} AS (SELECT pct, row_number() OVER (ORDER BY pct DESC) AS rd, row_number() OVER (ORDER BY pct) AS ra FROM h{c}),
bal{c} AS (SELECT CAST(count(*) FILTER (WHERE pct = 0) AS INTEGER) AS unused_expert{c}, round(sum(pct) FILTER (WHERE rd <= {_K}) + 3.1e-10, 6) AS balance_top{c},
      round(sum(pct) FILTER (WHERE ra <= {_K}) + 3.1e-10, 6) AS balance_bottom{c} FROM r{c})"""


@register("route_report", sql=f"""WITH {sql_top2('sampling')}, {_sql_balance(1)}, {_sql_balance(2)},
ov AS (SELECT round(100.0 * count(*) FILTER (WHERE m1 AND slot1 >= cap) / count(*) FILTER (WHERE m1) + 3.1e-10, 6) AS overflow1,
              round(100.0 * count(*) FILTER (WHERE m2 AND slot2 >= cap) / count(*) FILTER (WHERE m2) + 3.1e-10, 6) AS overflow2,
              round(avg(-list_sum(list_transform(gates, lambda p: CASE WHEN p > 0 THEN p * ln(p) ELSE 0.0 END))) + 3.1e-10, 6) AS entropy_gating FROM t2)
SELECT * FROM ov, bal1, bal2""")
def route_report(spark, sf_dir):
    """One row: entropy; unused buckets, balance and overflow of first and second choices."""
    r, cap = top2(spark, sf_dir, "sampling")
    out = routing.report(r, cap, E)
    return out.select(*[F.col(c) if c.startswith("unused") else r6(F.col(c)).alias(c) for c in out.columns])


@register("slot_index", sql=f"""WITH {SQL_GATES}
SELECT vec_id, expert1 AS expert, row_number() OVER (PARTITION BY expert1 ORDER BY vec_id) - 1 AS slot FROM a1 WHERE NOT is_padding""")
def slot_index(spark, sf_dir):
    r, _ = top1(spark, sf_dir)
    return r.filter(~F.col("is_padding")).select(F.col("row_id").alias("vec_id"), "expert", "slot")


@register("slot_index_priority", sql=f"""WITH {SQL_GATES}
SELECT vec_id, expert1 AS expert, row_number() OVER (PARTITION BY expert1 ORDER BY list_max(gates) DESC, vec_id) - 1 AS slot
FROM a1 WHERE NOT is_padding""")
def slot_index_priority(spark, sf_dir):
    r, _ = top1(spark, sf_dir, prioritized=True)
    return r.filter(~F.col("is_padding")).select(F.col("row_id").alias("vec_id"), "expert", "slot")


@register("route_combine", sql=f"""WITH {sql_top2('sampling')},
bv AS (SELECT expert1 AS e, d, avg(CAST(v AS DOUBLE)) AS bval FROM t2 JOIN xv USING (vec_id) WHERE kept1 GROUP BY expert1, d),
ds AS (SELECT DISTINCT vec_id, d FROM xv)
SELECT vec_id, CAST(ds.d AS INTEGER) AS d, round(coalesce(gate1 * b1.bval, 0.0) + coalesce(gate2 * b2.bval, 0.0) + 3.1e-10, 6) AS combined
FROM t2 JOIN ds USING (vec_id) LEFT JOIN bv b1 ON b1.e = t2.expert1 AND t2.kept1 AND b1.d = ds.d
LEFT JOIN bv b2 ON b2.e = t2.expert2 AND t2.kept2 AND b2.d = ds.d""")
def route_combine(spark, sf_dir):
    """Dispatch whole vectors to buckets, mean vector of a bucket, combine back weighted; dropped rows give 0."""
    r, _ = top2(spark, sf_dir, "sampling")
    emb = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), "embedding")
    rv = r.join(emb, "row_id")
    means = (rv.filter("kept1").select(F.col("expert1").alias("e"), F.posexplode("embedding").alias("d", "v")).groupBy("e", "d")
             .agg(F.avg(F.col("v").cast("double")).alias("m")).groupBy("e")
             .agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda x: x["m"]).alias("mean")))  # E rows
    j = rv
    for c in (1, 2):
        own = means.select(F.col("e").alias(f"expert{c}"), F.col("mean").alias(f"mean{c}"))
        gate, zero = F.col(f"gate{c}"), F.transform("embedding", lambda v: F.lit(0.0))
        weighted = F.transform(f"mean{c}", lambda m: m * gate)  # noqa: B023 - evaluated here
        j = j.join(own, f"expert{c}", "left").withColumn(f"part{c}", F.coalesce(F.when(F.col(f"kept{c}"), weighted), zero))
    both = F.zip_with("part1", "part2", lambda a, b: a + b)
    return j.select(F.col("row_id").alias("vec_id"), F.posexplode(both).alias("d", "v")).select(
        "vec_id", F.col("d").cast("int").alias("d"), r6(F.col("v")).alias("combined"))


@register("make_finite", sql=r"""
WITH a AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0.25 THEN 'inf'::DOUBLE WHEN x < -0.25 THEN 'nan'::DOUBLE ELSE CAST(x AS DOUBLE) END) AS s FROM embeddings),
lo AS (SELECT min(v) AS lo FROM (SELECT unnest(s) AS v FROM a) WHERE NOT isnan(v) AND NOT isinf(v))
SELECT vec_id, CAST(unnest(range(0, len(s))) AS INTEGER) AS i,
       round(unnest(list_transform(s, lambda x: CASE WHEN isnan(x) OR isinf(x) THEN lo ELSE x END)) + 3.1e-10, 6) AS v FROM a, lo""")
def make_finite_q(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    s = F.transform("embedding", lambda x: F.when(x > 0.25, F.lit(float("inf")))
                    .when(x < -0.25, F.lit(float("nan"))).otherwise(x.cast("double")))
    fixed = routing.make_finite(emb.select("vec_id", s.alias("s")), "s")
    return fixed.select("vec_id", F.posexplode("s").alias("i", "v")).select(
        "vec_id", F.col("i").cast("int"), r6(F.col("v")).alias("v"))


@register("gumbel_sample", sql=f"""
SELECT vec_id, CAST(e AS INTEGER) AS e,
       round(-ln(-ln(((('0x' || substr(md5('{SEED}:' || CAST(vec_id AS VARCHAR) || ':' || CAST(e AS VARCHAR)), 1, 8))::BIGINT) + 0.5) / 4294967296.0)) + 3.1e-10, 6) AS g
FROM embeddings, (SELECT unnest(range(0, {E})) AS e)""")
def gumbel_sample(spark, sf_dir):
    """Gumbel(0, 1) noise per row and bucket, keyed by (seed, row, bucket)."""
    from lexiforge.functions.hashing import gumbel
    emb = table(spark, sf_dir, "embeddings").select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(E - 1))).alias("e"))
    return emb.select("vec_id", F.col("e").cast("int"), r6(gumbel(SEED, F.col("vec_id"), F.col("e"))).alias("g"))
