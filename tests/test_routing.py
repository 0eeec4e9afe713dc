import math

from pyspark.sql import functions as F

from lexiforge.operators import routing


def rows(spark, logits, padding=None):
    padding = padding or [False] * len(logits)
    return spark.createDataFrame([(i, [float(x) for x in l], p) for i, (l, p) in enumerate(zip(logits, padding))],
                                 "row_id long, logits array<double>, is_padding boolean")


def test_ties_take_first_bucket_and_overflow(spark):
    df = rows(spark, [[1, 1, 0]] * 6)            # ties between buckets 0 and 1; all go to 0
    r, cap = routing.route_top1(df, 3)
    out = r.orderBy("row_id").collect()
    assert cap == 2 and {x["expert"] for x in out} == {0}
    assert [x["kept"] for x in out] == [True, True, False, False, False, False]
    h = {x["expert"]: x["pct"] for x in routing.expert_histogram(r, "expert", 3, 6).collect()}
    assert h == {0: 100.0, 1: 0.0, 2: 0.0}
    b = routing.balance(routing.expert_histogram(r, "expert", 3, 6), 3).first()
    assert b["unused"] == 2 and b["balance_top"] == 100.0


def test_padding_rows_are_not_routed(spark):
    df = rows(spark, [[0, 2], [2, 0], [0, 2]], [False, True, False])
    r, _ = routing.route_top1(df, 2)
    out = {x["row_id"]: x for x in r.collect()}
    assert out[1]["slot"] is None and not out[1]["kept"] and out[1]["gate"] == 0.0
    assert out[2]["slot"] == 1


def test_top2_second_slots_follow_first_choices(spark):
    df = rows(spark, [[3, 2, 0], [3, 2, 0], [2, 3, 0]])
    r, cap = routing.route_top2(df, 3, policy="none")
    out = {x["row_id"]: x for x in r.collect()}
    assert out[0]["expert2"] == 1 and out[2]["expert2"] == 0
    assert out[2]["slot2"] == 2  # after the two first choices of bucket 0
    assert abs(out[0]["gate1"] + out[0]["gate2"] - 1.0) < 1e-12


def test_make_finite(spark):
    df = spark.createDataFrame([([1.0, float("nan")],), ([float("inf"), -2.0],)], "logits array<double>")
    vals = sorted(v for r in routing.make_finite(df).collect() for v in r["logits"])
    assert vals == [-2.0, -2.0, -2.0, 1.0]


def test_capacity_rules():
    assert routing.capacity(10, 4, 1) == 3 and routing.capacity(10, 4, 2) == 6
    assert routing.capacity(10, 4, eval_mode=True) == math.ceil(2.5)


def test_entropy_zero_prob(spark):
    e = spark.range(1).select(routing.entropy(F.array(F.lit(1.0), F.lit(0.0))).alias("e")).first()["e"]
    assert e == 0.0


def test_balance_loss_computes_gates_once_and_reads_them_once(spark):
    rows = [(1, [1.0, 2.0, 0.5], False), (2, [3.0, 1.0, 0.0], True), (3, [0.0, 0.0, 4.0], False), (4, None, True), (5, [2.0, 5.0, 1.0], False)]
    df = spark.createDataFrame(rows, "row_id long, logits array<double>, is_padding boolean")
    routed, _ = routing.route_top1(df, 3)
    loss = routing.balance_loss(routed.withColumn("m", ~F.col("is_padding")), "expert", "m", 3, len(rows))
    plan = loss._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "exp(" not in plan.replace("explode(", "") and plan.count("leftouter") == 2     # the slots' offsets, the slots: joined once each
    sums, hits = [0.0] * 3, [0] * 3
    for _, logits, pad in rows:
        if logits:
            e = [math.exp(x - max(logits)) for x in logits]
            sums = [s + x / sum(e) for s, x in zip(sums, e)]
            hits[logits.index(max(logits))] += not pad
    want = sum(s / 5 * h / 5 for s, h in zip(sums, hits)) / 3 * 9
    assert abs(loss.first()["l_aux"] - want) < 1e-12
