"""Counting of pairs and contexts by task: no row for each position, same counts as position by position."""

from collections import Counter

import pyarrow as pa
import pytest

from lexiforge.operators import bpe, encode, ngram

ROWS = [("a", [1, 5, 6, 5, 6]), ("a", [1]), (None, [1, 5, 5, 5]), ("b", []), ("b", None), ("a", [1, 5, 6, 5, 6]), (None, [7, 1])]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def tokens(spark):
    return spark.createDataFrame(ROWS, "split string, ids array<long>")


def test_pair_counts_make_no_row_for_a_position(spark, tokens):
    got = ngram.pair_counts(tokens, 4)
    assert "Generate" not in plan(got)
    want = Counter()
    for split, ids in ROWS:
        if ids:
            want.update((split, p, n) for p, n in zip(ids, ids[1:] + [0]))
            if -len(ids) % 4:
                want[split, 0, 0] += -len(ids) % 4
    assert {tuple(r)[:3]: r["n"] for r in got.collect()} == dict(want)
    whole = ngram.pair_counts(tokens.select("ids"), 4, by=())
    assert sum(r["n"] for r in whole.collect()) == sum(want.values())


def test_pair_counts_of_large_ids(spark):
    ids = [1, 2 ** 20, 2 ** 20 + 1, 1, 2 ** 20]
    got = ngram.pair_counts(spark.createDataFrame([("a", ids)], "split string, ids array<long>"), 5).collect()
    assert {(r["prev_id"], r["next_id"]): r["n"] for r in got} == {
        (1, 2 ** 20): 2, (2 ** 20, 2 ** 20 + 1): 1, (2 ** 20 + 1, 1): 1, (2 ** 20, 0): 1}


@pytest.mark.parametrize("scale", [1, 2 ** 30])     # small ids share a number, large ones do not
@pytest.mark.parametrize("by", [("split",), ()])
@pytest.mark.parametrize("order", [1, 2, 4])
def test_context_counts_make_no_row_for_a_position(spark, scale, by, order):
    rows = [(s, ids and [i * scale for i in ids]) for s, ids in ROWS]
    got = ngram.context_counts(spark.createDataFrame(rows, "split string, ids array<long>"), order, by=by)
    assert "Generate" not in plan(got)
    want = Counter()
    for split, ids in rows:
        for i in range(1, len(ids or [])):
            want[(split,) * len(by) + (tuple(ids[max(0, i - order + 1):i]), ids[i])] += 1
    assert {(*(r[c] for c in by), tuple(r["ctx"]), r["next_id"]): r["n"] for r in got.collect()} == dict(want)


def test_contexts_of_many_batches_leave_a_task_once(monkeypatch):
    monkeypatch.setattr(ngram, "CHUNK", 8)
    batch = pa.RecordBatch.from_pydict({"ids": pa.array([[1, 5, 6, 5, 6], [1, 5, 6, 5]], pa.list_(pa.int64()))})
    out = list(ngram._context_counter(2, "ids", ())([batch] * 3))
    rows = [r for o in out for r in zip(o.column("ctx").to_pylist(), o.column("next_id").to_pylist(), o.column("n").to_pylist())]
    assert sorted(rows) == [([1], 5, 6), ([5], 6, 9), ([6], 5, 6)]


def test_whole_texts_as_byte_ids_equal_the_column_expression(spark, monkeypatch):
    monkeypatch.setattr(encode, "CHUNK_IDS", 3)
    lut = [2] * 256
    for i, b in enumerate("ab é日".encode()):
        lut[b] = 3 + i
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["ab", "", None, "é日 zb", "a" * 50, "b"])], "doc_id long, text string").coalesce(1)
    for bos in (True, False):
        want = {r[0]: r[1] for r in df.select("doc_id", encode.byte_level_ids(df["text"], lut, add_bos=bos).alias("ids")).collect()}
        whole = encode.encode_bytes(df, lut, keep=("doc_id",), add_bos=bos)
        assert "transform(" not in plan(whole)
        assert {r[0]: r[1] for r in whole.collect()} == want


def test_alphabet_makes_no_row_for_a_byte(spark):
    got = bpe.text_alphabet(spark.createDataFrame([("ba é",), (None,), ("",)], "text string"))
    assert "explode" not in plan(got)
    assert sorted((r["byte"], r["id"], r["token"]) for r in got.collect()) == [
        (32, 7, "Ġ"), (97, 3, "a"), (98, 4, "b"), (169, 5, "©"), (195, 6, "Ã")]
