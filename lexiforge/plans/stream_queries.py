"""Streaming queries (Z1, Z2): results must equal the batch operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiforge.plans.example_queries import sql_with
from lexiforge.plans.params import RATIOS, SEED, SEQ_LEN
from lexiforge.plans.registry import register
from lexiforge.plans.routing_queries import r6
from lexiforge.plans.token_queries import byte_vocab, saved_tokenizer
from lexiforge.plans.window_queries import GAMMA, _decay_sql
from lexiforge.sources import io
from lexiforge.streaming import pipelines


@register("stream_causal_pairs", sql=f"""{sql_with()}
SELECT doc_id, split, array_to_string(x, ',') AS x_csv, array_to_string(y, ',') AS y_csv FROM pairs""")
def stream_causal_pairs(spark, sf_dir):
    """File stream of documents to next-token pairs (Parquet sink, availableNow)."""
    lut, _, _ = byte_vocab(spark, sf_dir)
    out = pipelines.run_to_table(pipelines.causal_pairs_stream(spark, sf_dir, lut, SEQ_LEN, RATIOS, SEED), "pairs-stream")
    return out.select("doc_id", "split", F.array_join("x", ",").alias("x_csv"), F.array_join("y", ",").alias("y_csv"))


@register("stream_learned_pairs")
def stream_learned_pairs(spark, sf_dir):
    """File stream of documents through the saved tokenizer to padded pairs (Parquet sink, availableNow)."""
    tok = io.load_tokenizer(spark, saved_tokenizer(spark, sf_dir))
    docs = pipelines.file_stream(spark, sf_dir, "documents")
    out = pipelines.run_to_table(pipelines.learned_pairs_stream(docs, tok, SEQ_LEN, RATIOS, SEED), "learned-pairs-stream")
    return out.select("doc_id", "split", F.array_join("x", ",").alias("x_csv"), F.array_join("y", ",").alias("y_csv"), "n_real")


@register("stream_decayed_sum", sql=_decay_sql(repr(GAMMA)))
def stream_decayed_sum(spark, sf_dir):
    """Event stream with per-user carried state (decayed sum and position)."""
    ev = pipelines.file_stream(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value")
    out = pipelines.run_to_table(pipelines.decayed_sum_stream(ev, GAMMA), "decay-stream")
    return out.select("user_id", "event_id", "pos", r6(F.col("decayed")).alias("decayed"))
