import hashlib
import math


from lexiforge.operators import fewshot, ngram


def test_contexts_against_a_plain_loop(spark):
    rows = [("hot", k, f"q{k} ", f"a{k}") for k in range(200)] + [("few", 1, None, "x"), ("few", 2, "y", None), ("one", 5, "p", "a")]
    items = spark.createDataFrame(rows, "task string, item_id long, prompt string, answer string").repartition(5)
    for n in (0, 1, 3):
        got = {(r["task"], r["item_id"]): r["context"] for r in fewshot.few_shot_contexts(items, n, 7).collect()}
        assert len(got) == len(rows)
        for task in ("hot", "few", "one"):
            ring = sorted((r for r in rows if r[0] == task), key=lambda r: (hashlib.md5(f"7:{task}:{r[1]}".encode()).hexdigest(), r[1]))
            for k, r in enumerate(ring):
                others = [ring[(k + j) % len(ring)] for j in range(1, min(n, len(ring) - 1) + 1)]
                assert r not in others
                assert got[task, r[1]] == "".join((o[2] or "") + (o[3] or "") + "\n" for o in others)
    assert fewshot.few_shot_contexts(items.limit(0), 3, 7).count() == 0


def test_no_pairs_of_items_in_the_plan(spark):
    items = spark.createDataFrame([("a", k, "p", "x") for k in range(9)], "task string, item_id long, prompt string, answer string")
    plan = fewshot.few_shot_contexts(items, 3, 1)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_loglik_of_a_continuation(spark):
    texts = [[1, 3, 4, 5], [1, 3, 4, 4], [1, 5, 3]]
    train = ngram.context_counts(spark.createDataFrame([(t,) for t in texts], "ids array<long>"), 3, by=())
    rows = [(0, [1], [3, 4]), (1, [1, 3], [4, 9]), (2, [7, 1, 3, 4], [5]), (3, [1], [])]
    got = {r["k"]: r["loglik"] for r in ngram.continuation_loglik(
        spark.createDataFrame(rows, "k long, before array<long>, ids array<long>"), ("k",), "before", "ids", train, 3, 10, 2.0).collect()}
    for k, before, ids in rows:
        seq, want = before[-2:] + ids, 0.0
        for i in range(len(before[-2:]), len(seq)):
            p = 1 / 10
            for level in range(3):
                if level > i:
                    break
                c = seq[i - level:i]
                follows = [t[j] for t in texts for j in range(max(level, 1), len(t)) if t[j - level:j] == c]
                if follows:
                    p = (follows.count(seq[i]) + 2.0 * p) / (len(follows) + 2.0)
            want += math.log(p)
        assert abs(got[k] - want) < 1e-9, k
