"""Experiment tables.

Every table is derived from the given data: the n-gram grid is fitted on the
document splits, trials and runs come from ``events``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiforge.operators import experiments, ngram
from lexiforge.plans.example_queries import sql_with
from lexiforge.plans.model_queries import SQL_MODEL, Model
from lexiforge.plans.params import NGRAM_ALPHA
from lexiforge.plans.registry import register, table
from lexiforge.plans.routing_queries import r6
from lexiforge.session import stored

# ---- fixed grid values ----------------------------------------------------
ORDERS = [1, 2]
ALPHAS = [0.1, 1.0]
PICK_ID = 2
# ---------------------------------------------------------------------------


def grid_counts(pairs, order):
    """(split, ctx, next_id, n) of an order: the previous id as context, or none."""
    ctx = F.col("prev_id") if order == 2 else F.lit(-1).cast("bigint")
    return pairs.groupBy("split", ctx.alias("ctx"), "next_id").agg(F.sum("n").alias("n"))


def grid_results(spark, sf_dir, points=None):
    """(grid_id, order, alpha, split, loss) of all grid points, or of those asked for; only their orders are fitted."""
    m = Model(spark, sf_dir)
    out = None
    for i, order in enumerate(ORDERS):
        alphas = [(i * len(ALPHAS) + j, a) for j, a in enumerate(ALPHAS) if points is None or i * len(ALPHAS) + j in points]
        if not alphas:
            continue
        c = grid_counts(m.pairs, order)
        fit = c.filter(F.col("split") == "train").select("ctx", "next_id", F.col("n").alias("cnt"))
        ev = (c.filter(F.col("split").isin("validation", "test")).join(fit, ["ctx", "next_id"], "left")
              .join(ngram.context_totals(fit, ("ctx",)), "ctx", "left"))
        al = ev.withColumn("p", F.explode(F.array(*[F.struct(F.lit(g).alias("grid_id"), F.lit(a).alias("alpha")) for g, a in alphas])))
        logp = F.log((F.coalesce("cnt", F.lit(0)) + F.col("p.alpha")) /
                     (F.coalesce("ctx_cnt", F.lit(0)) + F.col("p.alpha") * m.vocab_size))
        part = al.groupBy(F.col("p.grid_id").alias("grid_id"), F.lit(order).alias("order"), F.col("p.alpha").alias("alpha"), "split").agg(
            (F.sum(-logp * F.col("n")) / F.sum("n")).alias("loss"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "grid_id int, order int, alpha double, split string, loss double")
    return out


_SQL_GRID_POS = [
    f"gpos AS (SELECT split, o AS ord, CASE WHEN o = 1 THEN -1 ELSE prev_id END AS ctx, next_id FROM pos, (SELECT unnest({ORDERS!r}) AS o))",
    "gcnt AS (SELECT ord, ctx, next_id, count(*) AS cnt FROM gpos WHERE split = 'train' GROUP BY ALL)",
    "gtot AS (SELECT ord, ctx, sum(cnt) AS ctx_cnt FROM gcnt GROUP BY ALL)",
    f"gal AS (SELECT unnest(range(0, {len(ALPHAS)})) AS i_alpha, unnest({ALPHAS!r}) AS alpha)",
    "gres AS (SELECT CAST((ord - 1) * " + str(len(ALPHAS)) + " + i_alpha AS INTEGER) AS grid_id, ord, alpha, split, "
    "avg(-ln((coalesce(cnt, 0) + alpha) / (coalesce(ctx_cnt, 0) + alpha * vocab_size))) AS loss "
    "FROM gpos LEFT JOIN gcnt USING (ord, ctx, next_id) LEFT JOIN gtot USING (ord, ctx), gal, alpha_map "
    "WHERE split IN ('validation', 'test') GROUP BY ALL)",
]
SQL_GRID = sql_with(*SQL_MODEL[:1], *_SQL_GRID_POS)


@register("grid_run", sql=f"""{SQL_GRID}
SELECT grid_id, CAST(ord AS INTEGER) AS "order", alpha, split, round(loss + 3.1e-10, 6) AS loss FROM gres""")
def grid_run(spark, sf_dir):
    return _grid_rows(grid_results(spark, sf_dir))


def _grid_rows(g):
    return g.select("grid_id", F.col("order").cast("int"), "alpha", "split", r6(F.col("loss")).alias("loss"))


@register("grid_pick", sql=f"""{SQL_GRID}
SELECT grid_id, CAST(ord AS INTEGER) AS "order", alpha, split, round(loss + 3.1e-10, 6) AS loss FROM gres WHERE grid_id = {PICK_ID}""")
def grid_pick(spark, sf_dir):
    """One grid point by id, fitted alone; an id outside the grid gives an empty result."""
    return _grid_rows(grid_results(spark, sf_dir, {PICK_ID}))


SQL_SIM = (f"{SQL_GRID}, sim AS (SELECT a.alpha, CAST(a.ord AS INTEGER) AS order_a, CAST(b.ord AS INTEGER) AS order_b, "
           "a.loss - b.loss AS similarity FROM gres a JOIN gres b ON a.alpha = b.alpha AND a.split = b.split "
           "AND a.ord < b.ord WHERE a.split = 'validation')")


def similarity(spark, sf_dir):
    g = stored(grid_results(spark, sf_dir).filter(F.col("split") == "validation"), "grid")
    a = g.select(F.col("alpha"), F.col("order").alias("order_a"), F.col("loss").alias("loss_a"))
    b = g.select(F.col("alpha").alias("alpha_b"), F.col("order").alias("order_b"), F.col("loss").alias("loss_b"))
    # theta join on the tiny grid result (|grid|^2 rows at most)
    j = a.join(b, (a.alpha == b.alpha_b) & (a.order_a < b.order_b))
    return j.select("alpha", F.col("order_a").cast("int"), F.col("order_b").cast("int"),
                    (F.col("loss_a") - F.col("loss_b")).alias("similarity"))


@register("model_similarity", sql=f"{SQL_SIM} SELECT alpha, order_a, order_b, round(similarity + 3.1e-10, 6) AS similarity FROM sim")
def model_similarity(spark, sf_dir):
    """Positive = the second model (higher order) has the lower loss."""
    s = similarity(spark, sf_dir)
    return s.select("alpha", "order_a", "order_b", r6(F.col("similarity")).alias("similarity"))


@register("similarity_extremes", sql=f"""{SQL_SIM}
SELECT arg_min(alpha, similarity) AS most_similar_alpha, arg_max(alpha, similarity) AS most_different_alpha,
       round(min(similarity) + 3.1e-10, 6) AS min_similarity, round(max(similarity) + 3.1e-10, 6) AS max_similarity FROM sim""")
def similarity_extremes(spark, sf_dir):
    s = similarity(spark, sf_dir)
    return s.agg(F.min_by("alpha", "similarity").alias("most_similar_alpha"),
                 F.max_by("alpha", "similarity").alias("most_different_alpha"),
                 r6(F.min("similarity")).alias("min_similarity"), r6(F.max("similarity")).alias("max_similarity"))


@register("run_label", sql=f"""{SQL_GRID}
SELECT CAST((ord - 1) * {len(ALPHAS)} + i_alpha AS INTEGER) AS grid_id,
       'ngram' || CAST(ord AS VARCHAR) || '_' || CAST(n_params AS VARCHAR) || '_LR' || CAST(alpha AS VARCHAR) || '_GC0.0' AS label
FROM (SELECT ord, count(*) AS n_params FROM gcnt GROUP BY ord), gal""")
def run_label(spark, sf_dir):
    """Default run labels from the model type, its parameter count (count rows) and settings."""
    train = Model(spark, sf_dir).pairs.filter(F.col("split") == "train")
    parts = [grid_counts(train, o).agg(F.lit(o).alias("order"), F.count(F.lit(1)).alias("n_params")) for o in ORDERS]
    n = parts[0].unionByName(parts[1])
    al = n.select("*", F.posexplode(F.array(*[F.lit(a) for a in ALPHAS])).alias("i_alpha", "alpha"))
    label = experiments.run_label(F.lit(None).cast("string"), F.concat(F.lit("ngram"), F.col("order").cast("string")),
                                  F.col("n_params"), F.col("alpha"), F.lit(0.0))
    return al.select(((F.col("order") - 1) * len(ALPHAS) + F.col("i_alpha")).cast("int").alias("grid_id"),
                     label.alias("label"))


def trials(spark, sf_dir):
    """Latency trial rows (seq_len, kind, trial, seconds): events stand in for trials, which the given tables do not have."""
    ev = table(spark, sf_dir, "events")
    return ev.select(F.pow(F.lit(2), F.lit(6) + F.pmod(F.col("user_id"), F.lit(4))).cast("int").alias("seq_len"),
                     F.when(F.col("event_type").isin("view", "click"), "single_token").otherwise("n_token").alias("kind"),
                     F.col("event_id").alias("trial"), (F.col("value") / 1000.0).alias("seconds"))


SQL_TRIALS = ("tr AS (SELECT CAST(pow(2, 6 + user_id % 4) AS INTEGER) AS seq_len, CASE WHEN event_type IN ('view', 'click') "
              "THEN 'single_token' ELSE 'n_token' END AS kind, event_id AS trial, value / 1000.0 AS seconds FROM events)")
SQL_LAT = (f"WITH {SQL_TRIALS} SELECT seq_len, kind, count(*) AS n_trials, round(avg(seconds) + 3.1e-10, 6) AS mean_s, "
           "min(seconds) AS min_s, max(seconds) AS max_s, round(quantile_cont(seconds, 0.5) + 3.1e-10, 6) AS median_s FROM tr GROUP BY ALL")


def latency(spark, sf_dir):
    s = experiments.latency_summary(trials(spark, sf_dir))
    return s.select("seq_len", "kind", "n_trials", r6(F.col("mean_s")).alias("mean_s"), "min_s", "max_s",
                    r6(F.col("median_s")).alias("median_s"))


@register("latency_summary", sql=SQL_LAT)
def latency_summary(spark, sf_dir):
    return latency(spark, sf_dir)


def emission_runs(spark, sf_dir):
    """Per-run emission rows: the events of a user stand in for a run's measurements, which the given tables do not have."""
    ev = table(spark, sf_dir, "events")
    dur = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6
    return ev.groupBy("user_id").agg(
        F.max("ts").alias("timestamp"), dur.alias("duration"), (F.sum("value") * 1e-3).alias("emissions"),
        (F.sum("value") * 1e-2).alias("energy_consumed")).select(
        "timestamp", F.concat(F.lit("proj_"), F.pmod(F.col("user_id"), F.lit(3)).cast("string")).alias("project_name"),
        F.col("user_id").cast("string").alias("run_id"), "duration", "emissions",
        (F.col("emissions") / F.col("duration")).alias("emissions_rate"), "energy_consumed")


SQL_RUNS = ("runs AS (SELECT max(ts) AS timestamp, 'proj_' || CAST(user_id % 3 AS VARCHAR) AS project_name, CAST(user_id AS VARCHAR) AS run_id, "
            "epoch(max(ts) - min(ts)) AS duration, sum(value) * 1e-3 AS emissions, sum(value) * 1e-2 AS energy_consumed FROM events GROUP BY user_id)")


@register("emissions_rollup", sql=f"""WITH {SQL_RUNS}
SELECT project_name, count(*) AS n_runs, round(sum(duration) + 3.1e-10, 3) AS duration_s, round(sum(emissions) + 3.1e-10, 6) AS emissions_kg,
       round(sum(energy_consumed) + 3.1e-10, 6) AS energy, round(sum(emissions) / (sum(duration) / 3600.0) + 3.1e-10, 9) AS kg_per_hour
FROM runs GROUP BY project_name""")
def emissions_rollup(spark, sf_dir):
    r = experiments.emissions_rollup(emission_runs(spark, sf_dir), ["project_name"])
    return r.select("project_name", "n_runs", F.round(F.col("duration_s") + 3.1e-10, 3).alias("duration_s"),
                    r6(F.col("emissions_kg")).alias("emissions_kg"), r6(F.col("energy")).alias("energy"),
                    F.round(F.col("kg_per_hour") + 3.1e-10, 9).alias("kg_per_hour"))


@register("union_runs", sql=f"""{SQL_GRID}
SELECT 'ngram' || CAST(ord AS VARCHAR) AS run_id, split, round(loss + 3.1e-10, 6) AS loss FROM gres WHERE alpha = {NGRAM_ALPHA}""")
def union_runs(spark, sf_dir):
    """Result tables of two runs appended by column name."""
    g = stored(grid_results(spark, sf_dir).filter(F.col("alpha") == NGRAM_ALPHA), "grid")
    runs = [g.filter(F.col("order") == o).select(F.lit(f"ngram{o}").alias("run_id"), "split",
                                                  r6(F.col("loss")).alias("loss")) for o in ORDERS]
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    return out


@register("task_filter", sql="""
WITH req AS (SELECT ['click', 'purchase', 'latency'] AS tasks),
av AS (SELECT DISTINCT event_type AS task FROM events)
SELECT task, list_contains(tasks, task) OR list_contains(tasks, '*') AS selected,
       list_contains(list_filter(tasks, lambda t: t <> 'latency'), task) AS selected_without_latency FROM av, req""")
def task_filter(spark, sf_dir):
    """Task list membership ('*' = all) and removal of the latency task, over the tasks found in the data."""
    tasks = F.array(*[F.lit(t) for t in ["click", "purchase", "latency"]])
    av = table(spark, sf_dir, "events").select(F.col("event_type").alias("task")).distinct()
    sel = F.array_contains(tasks, F.col("task")) | F.array_contains(tasks, F.lit("*"))
    return av.select("task", sel.alias("selected"),
                     F.array_contains(F.array_remove(tasks, "latency"), F.col("task")).alias("selected_without_latency"))
