"""Registered queries against their SQL oracles (quick subset by default)."""
import math
import os

import duckdb
import pytest

import __spark_entry__ as E

QUICK = ["filter_blank", "split_report", "pretokenize", "bpe_alphabet", "causal_pairs", "shard_lengths",
         "mean_loss", "ngram_orders", "few_shot_accuracy", "greedy_generate_contexts", "tail_context", "padded_pairs", "decayed_sum_multi", "decayed_sum_chunked", "early_stop", "route_top1", "segment_dilate", "choice_accuracy",
         "stream_decayed_sum", "bpe_merge_once", "detokenize", "perplexity", "generation_log", "route_report",
         "route_top2_eval", "write_splits", "dataset_length", "stage_rows", "log_bucket", "segment_densify", "lse_merge"]
KEYS = sorted(E.oracle_sql()) if os.environ.get("LEXIFORGE_FULL") else QUICK
SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def norm(v):
    if v is None:
        return "NULL"
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return str(v)


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_has_a_callable():
    q = E.queries()
    assert len(q) >= 100 and set(E.oracle_sql()) <= set(q)


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    df = E.queries()[key](spark, SF)
    r = con.sql(E.oracle_sql()[key])
    assert sorted(df.columns) == sorted(r.columns)
    assert canon(df.columns, [tuple(x) for x in df.collect()]) == canon(r.columns, r.fetchall())


def test_entry_smoke(spark):
    rows = E.entry(spark).collect()
    assert len(rows) == 1 and rows[0]["perplexity"] > 1.0
