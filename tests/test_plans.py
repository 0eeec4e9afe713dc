"""Physical-plan properties of registered queries: pruned scans, no cartesian joins."""
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
KEYS = ["scan_feature", "filter_blank", "split_invariants", "causal_pairs", "mean_loss", "perplexity",
        "early_stop", "checkpoint_topk", "route_top2", "route_combine", "model_similarity",
        "segment_dilate", "token_lookup", "choice_accuracy", "stage_rows"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", KEYS)
def test_no_cartesian_or_nested_loop_join(spark, key):
    p = plan_of(E.queries()[key](spark, SF))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_feature_scan_is_pruned(spark):
    p = plan_of(E.queries()["scan_feature"](spark, SF))
    assert "ReadSchema: struct<text:string>" in p
    p = plan_of(E.queries()["causal_pairs"](spark, SF))
    assert "struct<doc_id:bigint,text:string>" in p and "lang" not in p
