import math

import pytest
from pyspark.sql import functions as F

from lexiforge.operators import decay
from lexiforge.streaming.pipelines import _decay_block

GAMMA = 1 - 2 ** -5


def brute(vals, g):
    out, s = [], 0.0
    for v in vals:
        s = s * g + v
        out.append(s)
    return out


@pytest.mark.parametrize("n", [1, 16, 17, 40])
def test_chunk_form_matches_recurrence(spark, n):
    vals = [float((i * 7) % 11) for i in range(n)]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(vals)], "k long, t long, v double")
    got = [r["decayed"] for r in decay.decayed_sum(df, ["k"], ["t"], "v", GAMMA, chunk=16).orderBy("pos").collect()]
    assert got == pytest.approx(brute(vals, GAMMA), rel=1e-12, abs=1e-9)


def parallel_reference(df, keys, order, value, gamma, out):
    """Brute force: the definition over the whole causal frame (tests only)."""
    from pyspark.sql.window import Window
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.aggregate(F.collect_list(F.col(value)).over(w), F.lit(0.0),
                                          lambda acc, x: acc * F.lit(gamma) + x))


def test_forms_agree_on_events(spark):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", "event_id", "ts", "value")
    c = decay.decayed_sum(ev, ["user_id"], ["ts", "event_id"], "value", GAMMA, out="c")
    h = decay.decayed_sum(ev, ["user_id"], ["ts", "event_id"], "value", GAMMA, out="h", chunk=3).select("event_id", "h")
    p = parallel_reference(c, ["user_id"], ["pos"], "value", GAMMA, "p").select("event_id", "p")
    j = c.join(h, "event_id").join(p, "event_id")
    assert j.count() == 1000 and j.filter("abs(c - p) > 1e-6 or abs(h - p) > 1e-6").count() == 0


@pytest.mark.parametrize("gamma,chunk", [(0.5, 2), (0.5, None), (1e-100, 2), (0.99, 5)])
def test_old_values_are_never_cut_off(spark, gamma, chunk):
    vals = [1e300] + [1.0] * 39
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(vals)], "k long, t long, v double")
    got = [r["decayed"] for r in decay.decayed_sum(df, ["k"], ["t"], "v", gamma, chunk=chunk).orderBy("pos").collect()]
    assert got == pytest.approx(brute(vals, gamma), rel=1e-9)


def test_prefix_levels(spark):
    vals = [5.0, 4.0, 6.0, 3.0, 7.0, 2.0, 8.0, 1.0, 9.0]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(vals)], "k long, i long, v double")
    got = decay.prefix_min_before(df, ["k"], "i", "v", "m", chunk=2, levels=2).orderBy("i").collect()
    want = [None] + [min(vals[:i]) for i in range(1, len(vals))]
    assert [r["m"] for r in got] == want
    got = decay.prefix_max_before(df, ["k"], "i", "v", "m", chunk=2, levels=1).orderBy("i").collect()
    assert [r["m"] for r in got] == [max(vals[:i + 1]) for i in range(len(vals))]


def test_small_gamma_and_block_fold():
    v = [1.0, 2.0, 3.0, 4.0]
    assert list(_decay_block(__import__("numpy").array(v), 0.5, 0.0)) == pytest.approx(brute(v, 0.5))
    assert decay.chunk_size(GAMMA) == math.floor(600 / -math.log(GAMMA))
    assert decay.head_gammas(2) == [1 - 2 ** -5, 1 - 2 ** -6]


def test_lse_merge_over_a_wide_range_and_sparse_gap_fill(spark):
    from lexiforge.operators import segments
    rows = [(1, 0.0, 2.0), (1, 1.0, 4.0), (2, 5000.0, 1.0), (2, 5001.0, 3.0), (2, -4000.0, 100.0), (3, -900.0, 7.0)]
    df = spark.createDataFrame(rows, "k long, lse double, o double")
    got = {r["k"]: r["merged"] for r in segments.lse_merge(df, ["k"], "o", "lse").collect()}
    e = math.e
    assert got == pytest.approx({1: (2 + 4 * e) / (1 + e), 2: (1 + 3 * e) / (1 + e), 3: 7.0})
    sparse = spark.createDataFrame([(1, 0, 5.0), (3, 1, 6.0)], "pos long, head int, v double")
    out = {(r["pos"], r["head"]): (r["v"], r["weight"]) for r in segments.densify(sparse, 5, 2, "pos", "v").collect()}
    assert len(out) == 10 and out[1, 0] == (5.0, 1.0) and out[3, 1] == (6.0, 1.0) and out[3, 0] == (0.0, 0.0)


def test_several_rates_in_one_pass_and_a_long_chunk(spark, monkeypatch):
    """Chunks of a few rows, so that totals go on to many later chunks; a rate that looks back too far; a chunk that would overflow."""
    monkeypatch.setattr(decay, "MAX_EXP", 60.0)
    rates = {"a": 0.5, "b": 0.9, "c": 0.999}
    rows = [(k % 3 if k % 7 else None, k, float(k % 5) - 1.5) for k in range(2000)]
    df = spark.createDataFrame(rows, "u long, i long, v double")
    got = {r["i"]: r for r in decay.decayed_sums(df, ["u"], ["i"], "v", rates).collect()}
    state = {}
    for u, i, v in rows:
        if u is None:
            continue
        for c, g in rates.items():
            state[u, c] = state.get((u, c), 0.0) * g + v
            assert abs(got[i][c] - state[u, c]) < 1e-9
    monkeypatch.undo()
    long = spark.range(3000).selectExpr("1 AS u", "id AS i", "1.0D AS v")
    d = decay.decayed_sum(long, ["u"], ["i"], "v", 0.5, chunk=2048).collect()
    assert all(r["decayed"] <= 2 for r in d) and len(d) == 3000
