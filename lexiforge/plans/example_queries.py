"""Training-example queries (E1-E9, P4, P5): pairs, padding, shards, batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiforge.operators import examples
from lexiforge.operators.ordering import file_order_index
from lexiforge.plans.corpus_queries import split_docs
from lexiforge.plans.params import BATCH_SIZE, NUM_WORKERS, SEQ_LEN, WORLD_SIZE, sql_token_ctes
from lexiforge.plans.registry import register, table
from lexiforge.plans.token_queries import byte_tokens
from lexiforge.session import scratch_path
from lexiforge.sources import io

L = SEQ_LEN
TOTAL = WORLD_SIZE * NUM_WORKERS


def pairs(spark, sf_dir):
    # one id more than x has: the last target, and whether the row is a short one
    return examples.causal_pairs(byte_tokens(spark, sf_dir, first=SEQ_LEN + 1), SEQ_LEN)


def shards(spark, sf_dir, *extra):
    """(doc_id, split, extra..., row_idx, rank, worker, idx_in_shard, batch_id).

    The skew-safe index carries only the key columns (and what is asked for),
    never the token arrays.
    """
    docs = split_docs(spark, sf_dir).select("doc_id", "split", *extra)
    return examples.with_shards(docs, "doc_id", WORLD_SIZE, NUM_WORKERS, BATCH_SIZE, by=("split",))


# SQL twins ------------------------------------------------------------------
SQL_PAIRS = (f"pairs AS (SELECT doc_id, split, list_slice(ids, 1, {L}) AS x, "
             f"list_concat(list_slice(ids, 2, {L + 1}), CASE WHEN len(ids) <= {L} THEN [0::BIGINT] ELSE [] END) AS y FROM toks)")
SQL_SHARDS = (f"shards AS (SELECT *, CAST((row_idx % {TOTAL}) // {NUM_WORKERS} AS INTEGER) AS rank, "
              f"CAST(row_idx % {NUM_WORKERS} AS INTEGER) AS worker, row_idx // {TOTAL} AS idx_in_shard, "
              f"(row_idx // {TOTAL}) // {BATCH_SIZE} AS batch_id FROM "
              f"(SELECT *, row_number() OVER (PARTITION BY split ORDER BY doc_id) - 1 AS row_idx FROM pairs))")
SQL_PADDED = (f"padded AS (SELECT *, list_concat(x, list_transform(range(0, greatest(0, {L} - len(x))), lambda i: 0::BIGINT)) AS px, "
              f"list_concat(y, list_transform(range(0, greatest(0, {L} - len(y))), lambda i: 0::BIGINT)) AS py FROM shards)")


def sql_with(*extra: str) -> str:
    return "WITH " + ", ".join([sql_token_ctes(), SQL_PAIRS, SQL_SHARDS, SQL_PADDED, *extra])


def stored_keys(spark, sf_dir) -> str:
    """Keys of the split corpus, a directory a split: what has to be stored to count rows, without the texts."""
    return io.write_splits(split_docs(spark, sf_dir).select("doc_id", "split"), scratch_path(spark, "split-keys"))


@register("dataset_length", sql=f"{sql_with()} SELECT split, count(*) AS n_rows FROM splitdocs GROUP BY split")
def dataset_length(spark, sf_dir):
    """Rows of the stored splits: counts from the files' footers, no column is read."""
    path = stored_keys(spark, sf_dir)
    return spark.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))


@register("causal_pairs", sql=f"""{sql_with()}
SELECT doc_id, split, array_to_string(x, ',') AS x_csv, array_to_string(y, ',') AS y_csv FROM pairs""")
def causal_pairs(spark, sf_dir):
    p = pairs(spark, sf_dir)
    return p.select("doc_id", "split", F.array_join("x", ",").alias("x_csv"), F.array_join("y", ",").alias("y_csv"))


@register("padded_pairs", sql=f"""{sql_with()}
SELECT doc_id, split, array_to_string(px, ',') AS x_csv, array_to_string(py, ',') AS y_csv FROM padded""")
def padded_pairs(spark, sf_dir):
    p = examples.padded_pairs(pairs(spark, sf_dir), SEQ_LEN)
    return p.select("doc_id", "split", F.array_join("x", ",").alias("x_csv"), F.array_join("y", ",").alias("y_csv"))


@register("shard_rows", sql=f"""{sql_with()}
SELECT doc_id, split, row_idx, rank, worker FROM shards""")
def shard_rows(spark, sf_dir):
    return shards(spark, sf_dir).select("doc_id", "split", "row_idx", "rank", "worker")


@register("shard_lengths", sql=f"""{sql_with()}
SELECT split, rank, worker, count(*) AS actual_len,
       CAST(floor(sum(count(*)) OVER (PARTITION BY split) / {TOTAL}) AS BIGINT) AS advertised_len
FROM shards GROUP BY split, rank, worker""")
def shard_lengths(spark, sf_dir):
    s = shards(spark, sf_dir)
    return examples.shard_lengths(s, WORLD_SIZE, NUM_WORKERS, by=("split",)).withColumn(
        "advertised_len", F.col("advertised_len").cast("bigint"))


@register("batches", sql=f"""{sql_with()}
SELECT split, rank, worker, batch_id, count(*) AS n_rows FROM shards GROUP BY ALL""")
def batches(spark, sf_dir):
    s = shards(spark, sf_dir)
    return s.groupBy("split", "rank", "worker", "batch_id").agg(F.count(F.lit(1)).alias("n_rows"))


@register("stage_rows", sql=f"""{sql_with()},
st AS (SELECT * FROM (VALUES ('fit', 'train'), ('fit', 'validation'), ('validate', 'validation'), ('test', 'test')) v(stage, split))
SELECT stage, split, count(doc_id) AS n_rows FROM st LEFT JOIN toks USING (split) GROUP BY stage, split""")
def stage_rows(spark, sf_dir):
    """Rows that each stage reads: only its splits' directories of the stored keys."""
    path = stored_keys(spark, sf_dir)
    out = None
    for stage in ("fit", "validate", "test"):
        own = examples.stage_splits(stage)
        n = io.read_split(spark, path, own).groupBy("split").agg(F.count(F.lit(1)).alias("n"))
        names = spark.createDataFrame([(stage, x) for x in own], "stage string, split string")
        part = names.join(n, "split", "left").select("stage", "split", F.coalesce("n", F.lit(0)).alias("n_rows"))
        out = part if out is None else out.unionByName(part)
    return out


@register("position_rows", sql=f"""{sql_with()}
SELECT doc_id, CAST(unnest(range(0, {L})) AS INTEGER) AS pos, unnest(px) AS x_id, unnest(py) AS y_id
FROM padded""")
def position_rows(spark, sf_dir):
    return examples.position_rows(examples.padded_pairs(pairs(spark, sf_dir), SEQ_LEN))


@register("pad_batches", sql=f"""{sql_with()},
b AS (SELECT DISTINCT split, rank, worker, batch_id FROM shards),
spine AS (SELECT split, rank, worker, batch_id, CAST(unnest(range(0, {BATCH_SIZE})) AS BIGINT) AS slot FROM b),
r AS (SELECT split, rank, worker, batch_id, idx_in_shard % {BATCH_SIZE} AS slot, doc_id FROM shards)
SELECT split, rank, worker, batch_id, slot, doc_id, doc_id IS NULL AS is_padding FROM spine LEFT JOIN r USING (split, rank, worker, batch_id, slot)""")
def pad_batches(spark, sf_dir):
    rows = shards(spark, sf_dir).select("split", "rank", "worker", "batch_id",
                                        F.pmod(F.col("idx_in_shard"), F.lit(BATCH_SIZE)).alias("slot"), "doc_id")
    out = examples.pad_batches(rows, BATCH_SIZE, by=("split", "rank", "worker"))
    return out.select("split", "rank", "worker", "batch_id", F.col("slot").cast("bigint"), "doc_id", "is_padding")


@register("token_lookup", sql=f"""{sql_with()},
x AS (SELECT doc_id, CAST(unnest(range(0, {L})) AS INTEGER) AS pos, unnest(px) AS x_id FROM padded),
emb AS (SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * v))) AS norm FROM embeddings, alpha_map WHERE vec_id < vocab_size)
SELECT doc_id, pos, x_id, round(CASE WHEN x_id = 0 THEN 0.0 ELSE coalesce(norm, 0.0) END + 3.1e-10, 6) AS vec_norm
FROM x LEFT JOIN emb ON emb.vec_id = x.x_id""")
def token_lookup(spark, sf_dir):
    """Id -> vector lookup (the embeddings table as an embedding matrix indexed by
    token id); the pad id gives the zero vector. The query shows the vector's norm."""
    from lexiforge.functions.vectors import asum
    from lexiforge.plans.token_queries import byte_vocab
    _, _, vsize = byte_vocab(spark, sf_dir)
    x = examples.position_rows(examples.padded_pairs(pairs(spark, sf_dir), SEQ_LEN)).select("doc_id", "pos", "x_id")
    emb = table(spark, sf_dir, "embeddings").filter(F.col("vec_id") < vsize).select(F.col("vec_id").alias("x_id"), "embedding")
    found = examples.embedding_lookup(x, "x_id", emb, "embedding")
    norm = F.sqrt(asum(F.transform("vector", lambda v: v.cast("double") * v)))
    return found.select("doc_id", "pos", "x_id", F.round(F.coalesce(norm, F.lit(0.0)) + 3.1e-10, 6).alias("vec_norm"))


SHARD = (1, 0)   # rank and worker whose rows ``shard_store`` reads
_SQL_FILE_ORDER = (f"f AS (SELECT doc_id, text, row_number() OVER () - 1 AS row_idx FROM documents), "
                   f"fs AS (SELECT *, CAST((row_idx % {TOTAL}) // {NUM_WORKERS} AS INTEGER) AS rank, CAST(row_idx % {NUM_WORKERS} AS INTEGER) AS worker, "
                   f"row_idx // {TOTAL} AS idx_in_shard, (row_idx // {TOTAL}) // {BATCH_SIZE} AS batch_id FROM f)")


def file_shards(spark, sf_dir, *columns):
    """Documents as they are stored: (columns..., row_idx, rank, worker, idx_in_shard, batch_id)."""
    rows = file_order_index(table(spark, sf_dir, "documents"), "row_idx").select(*columns, "row_idx")
    return examples.shard_columns(rows, WORLD_SIZE, NUM_WORKERS, BATCH_SIZE)


@register("file_order_rows", sql=f"WITH {_SQL_FILE_ORDER} SELECT doc_id, row_idx, rank, worker, idx_in_shard, batch_id FROM fs")
def file_order_rows(spark, sf_dir):
    """Row index, shard and batch of every document in the order of its file; no row is exchanged."""
    return file_shards(spark, sf_dir, "doc_id")


@register("shard_store", sql=f"""WITH {_SQL_FILE_ORDER}
SELECT doc_id, idx_in_shard, batch_id, length(text) AS n_text FROM fs WHERE rank = {SHARD[0]} AND worker = {SHARD[1]}""")
def shard_store(spark, sf_dir):
    """Documents written by shard; the rows of one worker, read from its directory alone."""
    path = io.write_shards(file_shards(spark, sf_dir, "doc_id", "text"), scratch_path(spark, "shards"))
    return io.read_shard(spark, path, *SHARD).select("doc_id", "idx_in_shard", "batch_id", F.length("text").cast("long").alias("n_text"))
