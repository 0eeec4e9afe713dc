import random
from collections import Counter

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiforge.operators import examples, ngram
from lexiforge.operators.ordering import file_order_index, ordered_index


def test_causal_pairs_seq_len_4(spark):
    lists = {1: [1], 3: [1, 5, 6], 4: [1, 5, 6, 7], 5: [1, 5, 6, 7, 8], 9: list(range(1, 10))}
    df = spark.createDataFrame([(k, v) for k, v in lists.items()], "doc_id long, ids array<bigint>")
    out = {r["doc_id"]: (r["x"], r["y"]) for r in examples.causal_pairs(df, 4).collect()}
    assert out[1] == ([1], [0])
    assert out[3] == ([1, 5, 6], [5, 6, 0])
    assert out[4] == ([1, 5, 6, 7], [5, 6, 7, 0])
    assert out[5] == ([1, 5, 6, 7], [5, 6, 7, 8])
    assert out[9] == ([1, 2, 3, 4], [2, 3, 4, 5])
    padded = {r["doc_id"]: r["x"] for r in examples.padded_pairs(examples.causal_pairs(df, 4), 4).collect()}
    assert padded[1] == [1, 0, 0, 0]


def test_shards_and_lengths(spark):
    df = spark.range(10).withColumnRenamed("id", "doc_id")
    s = examples.with_shards(df, "doc_id", world_size=2, num_workers=2, batch_size=2)
    per = {(r["rank"], r["worker"]): (r["actual_len"], r["advertised_len"])
           for r in examples.shard_lengths(s, 2, 2).collect()}
    assert sorted(v[0] for v in per.values()) == [2, 2, 3, 3]
    assert {v[1] for v in per.values()} == {2}
    sizes = (s.filter((F.col("rank") == 0) & (F.col("worker") == 0)).groupBy("batch_id").count()
             .orderBy("batch_id").collect())
    assert [r["count"] for r in sizes] == [2, 1]


def test_pad_batches_marks_padding(spark):
    rows = spark.createDataFrame([(0, 0, 0, 0, 10), (0, 0, 0, 1, 11), (0, 0, 1, 0, 12)],
                                 "rank int, worker int, batch_id long, slot long, doc_id long")
    out = examples.pad_batches(rows, 2, by=("rank", "worker")).collect()
    assert len(out) == 4 and sum(r["is_padding"] for r in out) == 1


def test_ordered_index_is_skew_safe_and_exact(spark):
    ev = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    ev = ev.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, F.lit(7)).otherwise(F.col("user_id")))
    a = ordered_index(ev, ["user_id"], ["ts", "event_id"], "idx")
    b = ev.withColumn("idx2", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1)
    j = a.join(b.select("event_id", "idx2"), "event_id")
    assert j.count() == 10000 and j.filter("idx != idx2").count() == 0


def test_windows_hold_every_id(spark):
    lists = {1: [1], 2: [1, 5, 6], 3: [1, 5, 6, 7], 4: list(range(1, 11)), 5: []}
    df = spark.createDataFrame([(k, "a", v) for k, v in lists.items()], "doc_id long, split string, ids array<bigint>")
    rows = sorted(tuple(r) for r in ngram.window_positions(df, ("doc_id",), 4).collect())
    want = []
    for k, ids in lists.items():
        x = ids + [0] * (-len(ids) % 4)
        y = ids[1:] + [0] * (len(x) - len(ids) + 1) if ids else []
        want += [(k, i // 4, i % 4, a, b) for i, (a, b) in enumerate(zip(x, y))]
    assert rows == sorted(want)
    assert ngram.window_positions(df, ("doc_id",), 4, include_pad=False).count() == 18
    counts = {(r["prev_id"], r["next_id"]): r["n"] for r in ngram.pair_counts(df, 4).collect()}
    assert sum(counts.values()) == len(want) and counts[0, 0] == sum(1 for w in want if w[3:] == (0, 0))


def test_chains_by_doubling_and_total_length(spark):
    best = spark.createDataFrame([(0, 0), (1, 2), (2, 3), (3, 1), (4, 0)], "prev_id long, best_id long")
    chains = ngram.greedy_chains(best, 5)
    p = spark.createDataFrame([(1, [9, 1]), (2, [4]), (3, [1] * 7), (4, [8])], "k long, ids array<bigint>")
    got = {r["k"]: list(r["gen"]) for r in ngram.generate(p, "ids", chains, 7).collect()}
    assert got == {1: [2, 3, 1, 2, 3], 2: [0], 3: [], 4: []}
    assert {r["k"]: len(r["gen"]) for r in ngram.generate(p, "ids", chains, 7, stop_id=None).collect()}[2] == 6


def test_ordered_index_takes_null_and_nan_keys(spark):
    import datetime as dt
    nan = float("nan")
    kinds = {"long": [None, 1, 2], "double": [None, nan, 1.5, -0.0, 0.0], "timestamp": [None, dt.datetime(2024, 1, 1)], "string": [None, "", "a"]}
    for kind, values in kinds.items():
        rows = [(values[k % len(values)], k) for k in range(300)]
        df = spark.createDataFrame(rows, f"k {kind}, o long")
        got = ordered_index(df, ["k"], ["o"], "idx", n_parts=7)
        want = df.withColumn("idx2", F.row_number().over(Window.partitionBy("k").orderBy("o")) - 1)
        assert got.join(want.drop("k"), "o").filter("idx = idx2").count() == 300, kind


def test_generation_over_contexts(spark):
    """Orders 1 to 4 against a plain loop; prompts empty, null, unseen, too long and one hot prompt many times."""
    rnd = random.Random(5)
    texts = [[1] + [rnd.choice([3, 4, 4, 5, 6]) for _ in range(rnd.randint(0, 30))] for _ in range(25)]
    tokens = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, ids array<long>")
    asked = [[1], [1, 9, 9], [1, 3, 4], [9], [1, 4, 4, 5, 6], [], None, [3] * 20, [4] * 12] + [[1, 5]] * 30
    prompts = spark.createDataFrame([(i, p) for i, p in enumerate(asked)], "item_id long, ids array<long>")
    for order in (1, 2, 3, 4):
        grams = {}
        for t in texts:
            t = t + [0]
            for i in range(1, len(t)):
                for k in range(order):
                    if k <= i:
                        grams.setdefault(tuple(t[i - k:i]), Counter())[t[i]] += 1
        counts = ngram.context_counts(ngram.ended(tokens), order, by=())
        for stop in (True, False):
            got = {r["item_id"]: r["gen"] for r in ngram.generate_contexts(prompts, "ids", counts, order, 20, stop).collect()}
            for i, p in enumerate(asked):
                want, seq = [], list(p or [])
                while p and len(p) + len(want) < 20:
                    if want and want[-1] == 0:
                        if stop:
                            break
                        w = 0
                    else:
                        known = next(c for k in range(order - 1, -1, -1) if k <= len(seq) and (c := tuple(seq[len(seq) - k:])) in grams)
                        w = min(grams[known], key=lambda x: (-grams[known][x], x))
                    want.append(w)
                    seq.append(w)
                assert got[i] == want, (order, stop, p)


def test_generation_without_a_model(spark):
    none = spark.createDataFrame([], "ctx array<long>, next_id long, n long")
    prompts = spark.createDataFrame([(1, [1, 2])], "item_id long, ids array<long>")
    assert ngram.generate_contexts(prompts, "ids", none, 3, 5).first()["gen"] == [0]
    assert ngram.generate_contexts(prompts.limit(0), "ids", none, 3, 5).count() == 0


def test_file_order_and_shard_store(spark, tmp_path):
    """Index in file order against a two-pass count; a reader opens its shard only and keeps order and batches."""
    import os
    import pyarrow as pa
    import pyarrow.parquet as pq
    from lexiforge.sources import io
    rnd, want, root = random.Random(3), [], tmp_path / "t"
    root.mkdir()
    for k, n in enumerate([5, 0, 700, 1, 64]):
        ids = [rnd.randint(0, 9) if rnd.random() < 0.9 else None for _ in range(n)]
        pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "row_idx": pa.array(range(n), pa.int64())}),
                       root / f"part-{k}.parquet", row_group_size=50)
        want += ids
    df = spark.read.parquet(str(root)).drop("row_idx")
    for limit in (100, 0):   # broadcast offsets, and joined ones
        got = file_order_index(df, "row_idx", max_broadcast=limit)
        rows = sorted(((r["row_idx"], r["doc_id"]) for r in got.collect()), key=lambda r: r[0])
        assert rows == list(enumerate(want))
    plan = file_order_index(df, "row_idx")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "SortMergeJoin" not in plan
    store = io.write_shards(examples.shard_columns(file_order_index(df, "row_idx"), 3, 2, 4), str(tmp_path / "s"), 7)
    for rank in range(3):
        for worker in range(2):
            shard = io.read_shard(spark, store, rank, worker)
            kept = want[rank * 2 + worker::6]
            got = sorted((r["idx_in_shard"], r["doc_id"], r["batch_id"]) for r in shard.select(
                "idx_in_shard", F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), "batch_id").collect())
            assert got == [(k, -1 if d is None else d, k // 4) for k, d in enumerate(kept)]
            read = shard.select("_metadata.file_path").distinct().collect()
            assert all(f"rank={rank}/worker={worker}/" in r["file_path"] for r in read)
            for f in read:   # inside a file rows follow the shard's order
                name = os.path.join(store, f"rank={rank}", f"worker={worker}", os.path.basename(f["file_path"]))
                at = pq.read_table(name, columns=["idx_in_shard"], partitioning=None)["idx_in_shard"].to_pylist()
                assert at == sorted(at)
            scan = shard._jdf.queryExecution().executedPlan().toString()
            assert "(rank#" in scan and "PartitionFilters: [" in scan and "PartitionFilters: []" not in scan
    empty = spark.read.parquet(str(root / "part-1.parquet"))
    assert file_order_index(empty.drop("row_idx"), "row_idx").count() == 0
