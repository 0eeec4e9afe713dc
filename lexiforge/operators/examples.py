"""Training-example construction: next-token pairs, padding, shards, batches.

Everything is a column expression or the skew-safe ordered index; the shard of
a row is a column, so a writer can ``partitionBy("rank", "worker")`` once
instead of every worker scanning the whole corpus and keeping its residue class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiforge.functions.text import PAD_ID
from lexiforge.operators.ordering import ordered_index


def causal_x(ids: Column, seq_len: int) -> Column:
    """Input side: the first ``seq_len`` ids (all of them for short rows)."""
    return F.slice(ids, 1, seq_len)


def causal_y(ids: Column, seq_len: int, pad_id: int = PAD_ID) -> Column:
    """Target side: ids shifted by one; a short row ends with the pad id."""
    short = F.concat(F.slice(ids, 2, seq_len), F.array(F.lit(pad_id).cast("bigint")))
    return F.when(F.size(ids) <= seq_len, short).otherwise(F.slice(ids, 2, seq_len))


def causal_pairs(df: DataFrame, seq_len: int, ids: str = "ids", pad_id: int = PAD_ID) -> DataFrame:
    """Add x and y; rows longer than ``seq_len`` are truncated (rest dropped)."""
    return df.withColumn("x", causal_x(F.col(ids), seq_len)).withColumn(
        "y", causal_y(F.col(ids), seq_len, pad_id))


def pad_to(col: Column, seq_len: int, pad_id: int = PAD_ID) -> Column:
    return F.concat(col, F.array_repeat(F.lit(pad_id).cast("bigint"),
                                        F.greatest(F.lit(0), F.lit(seq_len) - F.size(col))))


def padded_pairs(df: DataFrame, seq_len: int, pad_id: int = PAD_ID) -> DataFrame:
    """Right-pad x and y to seq_len; ``n_real`` keeps the unpadded length."""
    return (df.withColumn("n_real", F.size("x")).withColumn("x", pad_to(F.col("x"), seq_len, pad_id))
            .withColumn("y", pad_to(F.col("y"), seq_len, pad_id)))


def embedding_lookup(df: DataFrame, id_col: str, matrix: DataFrame, vector: str, pad_id: int = PAD_ID) -> DataFrame:
    """Adds ``vector``: the matrix row of ``id_col``; zeros for the pad id, null for an id it does not have."""
    m = matrix.select(F.col(id_col).alias("_mid"), F.col(vector).alias("vector"))
    out = df.join(m, F.col(id_col) == F.col("_mid"), "left").drop("_mid")
    return out.withColumn("vector", F.when(F.col(id_col) == pad_id, F.transform("vector", lambda v: v * 0)).otherwise(F.col("vector")))


def with_shards(df: DataFrame, order: str | list, world_size: int, num_workers: int,
                batch_size: int | None = None, by: tuple = ()) -> DataFrame:
    """Global row index (per ``by`` group) in ``order``, round-robin shard.

    shard = idx mod (world x workers); rank = shard div workers;
    worker = shard mod workers; idx_in_shard = idx div total; batch_id.
    """
    out = ordered_index(df, list(by), [order] if isinstance(order, str) else order, "row_idx")
    return shard_columns(out, world_size, num_workers, batch_size)


def shard_columns(df: DataFrame, world_size: int, num_workers: int, batch_size: int | None = None) -> DataFrame:
    """The shard of each ``row_idx``: rank, worker, idx_in_shard and, with a batch size, batch_id."""
    total = world_size * num_workers
    shard = F.pmod(F.col("row_idx"), F.lit(total))
    out = (df.withColumn("rank", (shard / num_workers).cast("int"))
           .withColumn("worker", F.pmod(shard, F.lit(num_workers)).cast("int"))
           .withColumn("idx_in_shard", F.floor(F.col("row_idx") / total)))
    if batch_size:
        out = out.withColumn("batch_id", F.floor(F.col("idx_in_shard") / batch_size))
    return out


def shard_lengths(df: DataFrame, world_size: int, num_workers: int, by: tuple = ()) -> DataFrame:
    """Advertised length floor(n / total) next to the actual rows per shard.

    ``df`` already has rank/worker columns; n comes from the same aggregate.
    """
    total = world_size * num_workers
    per = df.groupBy(*by, "rank", "worker").agg(F.count(F.lit(1)).alias("actual_len"))
    n = F.sum("actual_len").over(Window.partitionBy(*by))  # total * groups rows
    return per.withColumn("advertised_len", F.floor(n / total))


def position_rows(df: DataFrame, keep: tuple = ("doc_id",)) -> DataFrame:
    """One row per position: (keep..., pos, x_id, y_id)."""
    z = F.posexplode(F.arrays_zip(F.col("x").alias("x"), F.col("y").alias("y")))
    return (df.select(*keep, z.alias("pos", "z"))
            .select(*keep, F.col("pos").cast("int").alias("pos"),
                    F.col("z.x").alias("x_id"), F.col("z.y").alias("y_id")))


def stage_splits(stage: str) -> list[str]:
    """Which splits a stage reads: fit -> train + validation, validate, test."""
    return {"fit": ["train", "validation"], "validate": ["validation"],
            "validation": ["validation"], "test": ["test"]}[stage]


def pad_batches(df: DataFrame, batch_size: int, by: tuple) -> DataFrame:
    """Fill every batch to ``batch_size`` slots; missing slots are padding rows.

    ``df`` has ``by`` + ``batch_id`` + ``slot`` (position inside the batch).
    The spine is generated per existing batch (no cross join of whole tables).
    """
    batches = df.select(*by, "batch_id").distinct()
    spine = batches.select(*by, "batch_id",
                           F.explode(F.sequence(F.lit(0), F.lit(batch_size - 1))).alias("slot"))
    return (spine.join(df, [*by, "batch_id", "slot"], "left")
            .withColumn("is_padding", F.col("doc_id").isNull()))
