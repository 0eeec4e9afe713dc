"""Source/sink round trips (S3-S6, S8-S13): write to shared storage, read back."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiforge.functions.vectors import format_ts
from lexiforge.operators.encode import decode_corpus
from lexiforge.plans.corpus_queries import split_docs
from lexiforge.plans.experiment_queries import SQL_GRID, SQL_LAT, SQL_RUNS, emission_runs, grid_results, latency
from lexiforge.plans.example_queries import sql_with
from lexiforge.plans.generation_queries import SQL_GEN_TEXT, SQL_GENERATED, generated
from lexiforge.plans.model_queries import SQL_MODEL, batch_losses
from lexiforge.plans.params import SQL_NONBLANK, sql_split_docs
from lexiforge.plans.registry import register, table
from lexiforge.plans.routing_queries import r6
from lexiforge.plans.token_queries import saved_tokenizer
from lexiforge.session import scratch_path, stored
from lexiforge.sources import io


@register("ingest_corpus", sql="SELECT doc_id, lang, n_chars FROM documents WHERE lang IN ('en', 'de')")
def ingest_corpus(spark, sf_dir):
    """Raw corpus as gzipped JSON lines, a folder for each language; a partial fetch reads two of them by pattern."""
    raw = scratch_path(spark, "raw-json")
    d = table(spark, sf_dir, "documents")
    io.write_table(d.withColumn("folder", F.col("lang")), raw, fmt="json", partition_by=["folder"], compression="gzip")
    df = io.read_corpus(spark, raw + "/folder={en,de}", fmt="json", glob="*.json.gz",
                        schema="doc_id bigint, text string, lang string, source string, n_chars bigint")
    return df.select("doc_id", "lang", "n_chars")


@register("roundtrip_parquet", sql=f"SELECT doc_id, n_chars FROM documents WHERE regexp_matches(text, '{SQL_NONBLANK}')")
def roundtrip_parquet(spark, sf_dir):
    from lexiforge.operators.splits import filter_blank
    path = io.write_table(filter_blank(table(spark, sf_dir, "documents")), scratch_path(spark, "corpus"))
    return io.read_corpus(spark, path, columns=["doc_id", "n_chars"])


@register("write_splits", sql=f"WITH s AS ({sql_split_docs()}) SELECT doc_id, split, n_chars FROM s")
def write_splits(spark, sf_dir):
    """All splits in one write (split=... directories), all read back; reading one prunes the others."""
    path = io.write_splits(split_docs(spark, sf_dir), scratch_path(spark, "splits"))
    return io.read_split(spark, path, ["train", "validation", "test"]).select("doc_id", "split", "n_chars")


@register("tokenizer_roundtrip")
def tokenizer_roundtrip(spark, sf_dir):
    """Save vocabulary, merges and settings as tables; load them back."""
    tok = io.load_tokenizer(spark, saved_tokenizer(spark, sf_dir))
    return tok.merge_table.join(tok.vocab.select(F.col("id").alias("new_id"), "token"), "new_id").select(
        "rank", "left_id", "right_id", "new_id", "token", F.lit(tok.meta["template"]).alias("template"))


GRID_SCHEMA = T.StructType([T.StructField("grid_id", T.IntegerType()), T.StructField("order", T.IntegerType()),
                            T.StructField("alpha", T.DoubleType()), T.StructField("split", T.StringType()),
                            T.StructField("loss", T.DoubleType())])


@register("grid_results", sql=f"""{SQL_GRID}
SELECT grid_id, CAST(ord AS INTEGER) AS "order", alpha, split, round(loss + 3.1e-10, 6) AS loss FROM gres""")
def grid_results_csv(spark, sf_dir):
    """Grid results appended to a CSV with header; read back with a typed schema."""
    path = scratch_path(spark, "grid-csv")
    g = stored(grid_results(spark, sf_dir).select("grid_id", F.col("order").cast("int"), "alpha", "split",
                                                  r6(F.col("loss")).alias("loss")), "grid")
    io.append_csv(g.filter(F.col("split") == "validation"), path)
    io.append_csv(g.filter(F.col("split") == "test"), path)
    return io.read_csv(spark, path, GRID_SCHEMA)


STAMP = dt.datetime(2024, 1, 1, 12, 30)


@register("generation_log", sql=f"""{SQL_GENERATED}
SELECT '2024-01-01 12:30:00' AS ts, 'ngram2' AS model_type, item_id AS prompt_id, {SQL_GEN_TEXT} AS text FROM generated, vhex""")
def generation_log(spark, sf_dir, now=STAMP):
    """Generated texts appended as quoted CSV rows: (ts, model_type, prompt_id, text); ``now`` is the time to stamp."""
    path = scratch_path(spark, "generations")
    g, vocab_hex = generated(spark, sf_dir, stop=True)
    g = decode_corpus(g, vocab_hex, ids="gen", out="text").select(
        format_ts(F.lit(now)).alias("ts"), F.lit("ngram2").alias("model_type"), F.col("item_id").alias("prompt_id"), "text")
    io.append_csv(g, path, quote_all=True)
    return io.read_csv(spark, path, "ts string, model_type string, prompt_id bigint, text string")


@register("latency_json", sql=SQL_LAT)
def latency_json(spark, sf_dir):
    """Latency summary written as JSON and read back."""
    path = io.write_table(latency(spark, sf_dir), scratch_path(spark, "latency-json"), fmt="json")
    return spark.read.schema("seq_len int, kind string, n_trials bigint, mean_s double, min_s double, "
                             "max_s double, median_s double").json(path)


@register("metrics_log", sql=f"""{sql_with(*SQL_MODEL)},
st AS (SELECT split, batch_id AS step, sum(loss * n) / sum(n) AS loss FROM bl GROUP BY split, batch_id)
SELECT 'ngram2' AS run_id, split, 0 AS epoch, step, name, round(value + 3.1e-10, 6) AS value
FROM (SELECT split, step, 'loss' AS name, loss AS value FROM st UNION ALL SELECT split, step, 'perplexity', exp(loss) FROM st)""")
def metrics_log(spark, sf_dir):
    """Append-only metric table (validation, then test), read back."""
    path = scratch_path(spark, "metrics")
    st = batch_losses(spark, sf_dir).groupBy("split", F.col("batch_id").alias("step")).agg(
        (F.sum(F.col("loss") * F.col("n")) / F.sum("n")).alias("loss"))
    rows = st.select("split", "step", F.array(F.struct(F.lit("loss").alias("name"), F.col("loss").alias("value")),
                                              F.struct(F.lit("perplexity").alias("name"), F.exp("loss").alias("value"))).alias("m"))
    m = rows.select(F.lit("ngram2").alias("run_id"), "split", F.lit(0).alias("epoch"), "step",
                    F.explode("m").alias("x")).select("run_id", "split", "epoch", "step", "x.name",
                                                      r6(F.col("x.value")).alias("value"))
    m = stored(m, "metrics-all")  # written by split, computed once
    for sp in ("validation", "test"):
        io.write_table(m.filter(F.col("split") == sp), path, mode="append")
    return spark.read.parquet(path)


@register("emissions_scan", sql=f"""WITH {SQL_RUNS}
SELECT run_id, project_name, round(duration + 3.1e-10, 3) AS duration, round(emissions + 3.1e-10, 6) AS emissions,
       round(energy_consumed + 3.1e-10, 6) AS energy_consumed, CAST(NULL AS DOUBLE) AS longitude FROM runs""")
def emissions_scan(spark, sf_dir):
    """Per-run emission rows written with the 31-column layout and read with its schema."""
    path = scratch_path(spark, "emissions")
    rows = io.to_emissions_schema(emission_runs(spark, sf_dir).withColumn("country_iso_code", F.lit("USA"))
                                  .withColumn("cloud_provider", F.lit("gcp")))
    io.append_csv(rows, path)
    e = io.read_emissions(spark, path)
    return e.select("run_id", "project_name", F.round(F.col("duration") + 3.1e-10, 3).alias("duration"),
                    r6(F.col("emissions")).alias("emissions"), r6(F.col("energy_consumed")).alias("energy_consumed"),
                    "longitude")
