from pyspark.sql import functions as F

from lexiforge.operators import experiments


def series(spark, losses, run=1):
    return spark.createDataFrame([(run, i, float(v)) for i, v in enumerate(losses)], "run long, pos long, value double")


def test_early_stopping(spark):
    df = series(spark, [5, 4, 4, 4, 4, 3])
    r = experiments.early_stop(df, ["run"], "pos", "value", 3).first()
    assert r["stop_pos"] == 4  # the fifth validation
    assert experiments.early_stop(df, ["run"], "pos", "value", 0).first()["stop_pos"] is None


def test_checkpoint_topk(spark):
    df = series(spark, [3, 1, 1, 2, 1, 5])
    rows = {r["pos"]: (r["topk_rank"], r["is_last"]) for r in experiments.checkpoint_topk(df, ["run"], "pos", "value", 3).collect()}
    assert rows == {1: (1, False), 2: (2, False), 4: (3, False), 5: (None, True)}
    allk = experiments.checkpoint_topk(df, ["run"], "pos", "value", -1).collect()
    assert len(allk) == 6
    b = experiments.best_checkpoint(df, ["run"], "pos", "value").first()
    assert (b["best_pos"], b["best_value"]) == (1, 1.0)


def test_ckpt_name(spark):
    r = spark.range(1).select(experiments.ckpt_name(F.lit(2), F.lit(0), F.lit(1.234)).alias("n")).first()["n"]
    assert r == "ckpt_002_epoch=0_val_loss=1.23"


def test_latency_single_and_unsorted(spark):
    t = spark.createDataFrame([(512, "n_token", 0, 2.0), (128, "n_token", 0, 1.0), (128, "n_token", 1, 3.0)],
                              "seq_len int, kind string, trial long, seconds double")
    rows = {r["seq_len"]: r for r in experiments.latency_summary(t).collect()}
    assert rows[512]["n_trials"] == 1 and rows[128]["median_s"] == 2.0


def test_default_if_falsy_and_scorer_registry(spark):
    import pytest
    from lexiforge.operators import ngram
    df = spark.createDataFrame([(None,), (0,), (7,)], "n int")
    got = [r["d"] for r in df.select(experiments.default_if_falsy(F.col("n"), 5).alias("d")).collect()]
    assert got == [5, 5, 7]
    assert ngram.get_scorer("NGRAM", alpha=0.5) is not None
    with pytest.raises(ValueError):
        ngram.get_scorer("transformer")
