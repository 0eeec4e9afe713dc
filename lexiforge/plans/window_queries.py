"""Window-style queries on event series.

``events`` stands in for a metric series: a run = ``user_id``, the order is
``(ts, event_id)``, the monitored value (e.g. validation loss) = ``value``.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiforge.operators import decay, experiments
from lexiforge.operators.ordering import ordered_index
from lexiforge.plans.example_queries import L, sql_with
from lexiforge.plans.registry import register, table
from lexiforge.plans.token_queries import byte_tokens

GAMMA = 1.0 - 2.0 ** -5
HEADS = 3
CHUNK = 16
PATIENCE = 3
TOP_K = 3
# gamma = 31/32 times 2-decimal values gives exact decimal ties at the 6th
# digit; both engines round value + NUDGE so a 1-ulp difference cannot split a tie.
NUDGE = 3.1e-10

SQL_EV = ("ev AS (SELECT user_id, event_id, ts, value, event_type, "
          "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events)")


def ev(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value", "event_type")


def _decay_sql(gamma_expr: str, extra_sel: str = "", extra_from: str = "", extra_on: str = "", extra_grp: str = "") -> str:
    return (f"WITH {SQL_EV} SELECT a.user_id, a.event_id, a.pos{extra_sel}, "
            f"round(sum(b.value * pow({gamma_expr}, a.pos - b.pos)) + 3.1e-10, 6) AS decayed "
            f"FROM ev a{extra_from} JOIN ev b ON a.user_id = b.user_id AND b.pos <= a.pos{extra_on} "
            f"GROUP BY a.user_id, a.event_id, a.pos{extra_grp}")


@register("decayed_sum", sql=_decay_sql(repr(GAMMA)))
def decayed_sum(spark, sf_dir):
    """Every earlier event of a run, whatever its age, in chunks as large as doubles allow."""
    d = decay.decayed_sum(ev(spark, sf_dir), ["user_id"], ["ts", "event_id"], "value", GAMMA)
    return d.select("user_id", "event_id", "pos", F.round(F.col("decayed") + NUDGE, 6).alias("decayed"))


@register("decayed_sum_chunked", sql=_decay_sql(repr(GAMMA)))
def decayed_sum_chunked(spark, sf_dir):
    """Chunk form with 16-row chunks: windows never span a whole run."""
    d = decay.decayed_sum(ev(spark, sf_dir), ["user_id"], ["ts", "event_id"], "value", GAMMA, chunk=CHUNK)
    return d.select("user_id", "event_id", "pos", F.round(F.col("decayed") + NUDGE, 6).alias("decayed"))


@register("decayed_sum_recurrent", sql=f"""
WITH {SQL_EV}, s AS (SELECT a.user_id, a.event_id, a.pos, sum(b.value * pow({GAMMA!r}, a.pos - b.pos)) AS d
     FROM ev a JOIN ev b ON a.user_id = b.user_id AND b.pos <= a.pos GROUP BY a.user_id, a.event_id, a.pos)
SELECT user_id, event_id, pos, round(d / sqrt((1 - pow({GAMMA!r}, pos + 1)) / (1 - {GAMMA!r})) + 3.1e-10, 6) AS decayed_norm FROM s""")
def decayed_sum_recurrent(spark, sf_dir):
    """Recurrent form's output S / sqrt(scale) (state carried as in the layer)."""
    d = decay.decayed_sum(ev(spark, sf_dir), ["user_id"], ["ts", "event_id"], "value", GAMMA)
    return d.select("user_id", "event_id", "pos",
                    F.round(decay.decayed_norm("decayed", "pos", GAMMA) + NUDGE, 6).alias("decayed_norm"))


@register("decayed_sum_multi", sql=(
    f"WITH {SQL_EV}, h AS (SELECT unnest(range(0, {HEADS})) AS head) "
    "SELECT a.user_id, a.event_id, a.pos, CAST(h.head AS INTEGER) AS head, "
    "round(sum(b.value * pow(1 - pow(2, -5 - h.head), a.pos - b.pos)) + 3.1e-10, 6) AS decayed "
    "FROM ev a JOIN ev b ON a.user_id = b.user_id AND b.pos <= a.pos, h "
    "GROUP BY a.user_id, a.event_id, a.pos, h.head"))
def decayed_sum_multi(spark, sf_dir):
    """One decay rate per head, gamma_h = 1 - 2^(-5-h), all in one pass."""
    rates = {f"head{h}": g for h, g in enumerate(decay.head_gammas(HEADS))}
    d = decay.decayed_sums(ev(spark, sf_dir), ["user_id"], ["ts", "event_id"], "value", rates)
    heads = F.explode(F.array(*[F.struct(F.lit(h).alias("head"), F.col(c).alias("decayed")) for h, c in enumerate(rates)]))
    return d.select("user_id", "event_id", "pos", heads.alias("h")).select(
        "user_id", "event_id", "pos", "h.head", F.round(F.col("h.decayed") + NUDGE, 6).alias("decayed"))


@register("tail_context", sql=f"""{sql_with()}
SELECT doc_id, array_to_string(list_slice(ids, greatest(1, len(ids) - {L} + 1), greatest(1, len(ids) - {L} + 1) + {L} - 1), ',') AS ctx_csv
FROM toks""")
def tail_context(spark, sf_dir):
    """Last seq_len ids of each document (context crop before generation)."""
    t = byte_tokens(spark, sf_dir, last=L)
    return t.select("doc_id", F.array_join(experiments.tail_ids(F.col("ids"), L), ",").alias("ctx_csv"))


@register("early_stop", sql=f"""
WITH {SQL_EV},
b AS (SELECT *, min(value) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_min FROM ev),
n AS (SELECT *, CASE WHEN prev_min IS NULL OR value < prev_min THEN pos END AS best_here FROM b),
l AS (SELECT *, max(best_here) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_best FROM n)
SELECT user_id, min(CASE WHEN pos - last_best >= {PATIENCE} THEN pos END) AS stop_pos, count(*) AS n_validations
FROM l GROUP BY user_id""")
def early_stop(spark, sf_dir):
    e = ordered_index(ev(spark, sf_dir), ["user_id"], ["ts", "event_id"], "pos")
    return experiments.early_stop(e, ["user_id"], "pos", "value", PATIENCE)


@register("checkpoint_topk", sql=f"""
WITH {SQL_EV},
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value, pos) AS topk_rank,
             pos = max(pos) OVER (PARTITION BY user_id) AS is_last FROM ev)
SELECT user_id, pos, CASE WHEN topk_rank <= {TOP_K} THEN CAST(topk_rank AS INTEGER) END AS topk_rank, is_last
FROM r WHERE topk_rank <= {TOP_K} OR is_last""")
def checkpoint_topk(spark, sf_dir):
    e = ordered_index(ev(spark, sf_dir), ["user_id"], ["ts", "event_id"], "pos")
    return experiments.checkpoint_topk(e, ["user_id"], "pos", "value", TOP_K)


@register("best_checkpoint", sql=f"""
WITH {SQL_EV}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value, pos) AS rn FROM ev)
SELECT user_id, pos AS best_pos, value AS best_value FROM r WHERE rn = 1""")
def best_checkpoint(spark, sf_dir):
    e = ordered_index(ev(spark, sf_dir), ["user_id"], ["ts", "event_id"], "pos")
    return experiments.best_checkpoint(e, ["user_id"], "pos", "value")


@register("ckpt_name", sql=f"""
WITH {SQL_EV},
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value, pos) AS topk_rank FROM ev),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pos) - 1 AS n_saved FROM r WHERE topk_rank <= {TOP_K})
SELECT user_id, pos, printf('ckpt_%03d_epoch=%d_val_loss=%.2f', n_saved, pos // 10, value) AS name FROM k""")
def ckpt_name(spark, sf_dir):
    """Names of the kept checkpoints: zero-filled save counter, epoch, loss with 2 decimals."""
    e = ordered_index(ev(spark, sf_dir), ["user_id"], ["ts", "event_id"], "pos")
    k = experiments.checkpoint_topk(e, ["user_id"], "pos", "value", TOP_K).filter(F.col("topk_rank").isNotNull())
    k = k.join(e.select("user_id", "pos", "value"), ["user_id", "pos"])
    # at most TOP_K rows per run: a per-run window is bounded
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("pos")) - 1
    return k.select("user_id", "pos", experiments.ckpt_name(n, F.floor(F.col("pos") / 10), F.col("value")).alias("name"))
