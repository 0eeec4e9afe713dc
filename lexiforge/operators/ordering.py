"""Dense, ordered, per-key row index that survives skew.

``row_number().over(Window.partitionBy(key).orderBy(...))`` puts every row of
a key into one task; with one key holding a third of the data that task is the
whole job. Instead:

1. ``repartitionByRange(n, key, order...)`` + ``sortWithinPartitions``: a hot
   key is cut into several contiguous, balanced ranges.
2. One vectorised Arrow pass per partition numbers the rows of each key run
   inside the partition (no per-row Python, no shuffle).
3. The numbered rows are checkpointed once (shared storage), because range
   bounds are sampled per exchange and every later step must see the same
   partitions.
4. Only the first and the last run of a partition can continue a key from a
   neighbour partition, so a table of at most 2 x n_partitions runs gets the
   carried offsets (window per key over that tiny table).
5. That table (size bounded by the partition count, not by the data) is
   broadcast and added to the local index.
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lexiforge.session import cut_lineage

_CONST = "_ord_all"


def _codes(col: pa.Array) -> np.ndarray:
    """One number per distinct value of a batch; nulls are one value, NaNs another, and -0.0 is 0.0."""
    if pa.types.is_floating(col.type):
        col = pc.add(col, 0.0)
    return col.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)


def _same(a, b) -> bool:
    """Equal as a grouping key: nulls equal nulls, NaN equals NaN."""
    return a == b or (a != a and b != b)


def _local_runs(key_names: Sequence[str]):
    """Arrow batch iterator -> same batches + _run (run number) + _lidx."""

    def fn(batches):
        last = None       # key tuple of the previous row in this partition
        run = -1          # current run number in this partition
        count = 0         # rows seen so far in the current run
        for b in batches:
            n = b.num_rows
            if n == 0:
                yield pa.RecordBatch.from_arrays(
                    list(b.columns) + [pa.array([], pa.int64()), pa.array([], pa.int64())],
                    names=list(b.schema.names) + ["_run", "_lidx"])
                continue
            keys = [b.column(k) for k in key_names]
            change = np.zeros(n, dtype=bool)
            for k in keys:
                code = _codes(k)
                change[1:] |= code[1:] != code[:-1]
            same_as_last = last is not None and all(_same(k[0].as_py(), v) for k, v in zip(keys, last))
            change[0] = not same_as_last
            idx = np.arange(n, dtype=np.int64)
            starts = np.maximum.accumulate(np.where(change, idx, -1))
            lidx = np.where(starts < 0, idx + count, idx - starts)
            runs = run + np.cumsum(change)
            run = int(runs[-1])
            count = int(lidx[-1]) + 1
            last = tuple(k[-1].as_py() for k in keys)
            yield pa.RecordBatch.from_arrays(
                list(b.columns) + [pa.array(runs, pa.int64()), pa.array(lidx, pa.int64())],
                names=list(b.schema.names) + ["_run", "_lidx"])

    return fn


def ordered_index(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                  out: str = "idx", n_parts: int | None = None) -> DataFrame:
    """Add ``out`` = 0-based position of each row inside its key, by ``order``.

    ``order`` must make rows unique inside a key (deterministic under retries).
    With ``keys=[]`` the index is global. Null keys form one key, NaN keys another.
    """
    spark = df.sparkSession
    n = n_parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    keys = list(keys)
    work = df
    if not keys:
        work = work.withColumn(_CONST, F.lit(0))
        keys = [_CONST]
    r = (work.repartitionByRange(n, *[F.col(k) for k in keys], *[F.col(o) for o in order])
         .sortWithinPartitions(*keys, *order)
         .withColumn("_pid", F.spark_partition_id()))
    schema = T.StructType(r.schema.fields + [T.StructField("_run", T.LongType()),
                                             T.StructField("_lidx", T.LongType())])
    # Range bounds are sampled per exchange, so every later use must read the
    # *same* partitioned rows: materialise them once in the shared checkpoint
    # folder (this also cuts the lineage for executor-loss recovery).
    local = cut_lineage(r.mapInArrow(_local_runs(keys), schema))

    # Rows of one key inside one partition form one run.
    per_run = local.groupBy("_pid", *keys).agg(F.count(F.lit(1)).alias("_len"))
    key_struct = F.struct(*[F.col(k) for k in keys])
    bounds = per_run.groupBy("_pid").agg(F.min(key_struct).alias("_first"),
                                         F.max(key_struct).alias("_last"))
    edges = (per_run.join(F.broadcast(bounds), "_pid")  # one row per partition
             .filter((key_struct == F.col("_first")) | (key_struct == F.col("_last")))
             .withColumn("_is_first", key_struct == F.col("_first"))
             .drop("_first", "_last"))
    carry_w = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (edges.withColumn("_off", F.coalesce(F.sum("_len").over(carry_w), F.lit(0)))
               .filter(F.col("_is_first") & (F.col("_off") > 0))
               .select("_pid", *keys, "_off"))
    # offsets has at most n_parts rows: safe to broadcast. Null keys are a key of their own.
    off = offsets.select(F.col("_pid").alias("_opid"), *[F.col(k).alias(f"_o{i}") for i, k in enumerate(keys)], "_off")
    same_key = F.col("_pid") == F.col("_opid")
    for i, k in enumerate(keys):
        same_key = same_key & F.col(k).eqNullSafe(F.col(f"_o{i}"))
    res = (local.join(F.broadcast(off), same_key, "left")
           .withColumn(out, F.col("_lidx") + F.coalesce(F.col("_off"), F.lit(0)))
           .drop("_pid", "_run", "_lidx", "_off", "_opid", *[f"_o{i}" for i in range(len(keys))]))
    if keys == [_CONST]:
        res = res.drop(_CONST)
    return res


def file_order_index(df: DataFrame, out: str = "idx", max_broadcast: int = 100_000) -> DataFrame:
    """Add ``out`` = 0-based position of each row in the order of the files it is stored in (by path, then place).

    ``df`` is a Parquet table as read. A row's place in its file comes from the hidden metadata column, so no row is
    moved or sorted: only the row count of each file is aggregated. The offsets have one row for each file, as the
    driver's file listing does; up to ``max_broadcast`` files they are broadcast, beyond that they are joined by path.
    """
    placed = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_place"))
    per_file = df.groupBy(F.col("_metadata.file_path").alias("_of")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)   # a row a file
    offsets = per_file.select("_of", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    if len(df.inputFiles()) <= max_broadcast:
        offsets = F.broadcast(offsets)
    return (placed.join(offsets, F.col("_file") == F.col("_of"))
            .withColumn(out, F.col("_off") + F.col("_place")).drop("_file", "_place", "_of", "_off"))
