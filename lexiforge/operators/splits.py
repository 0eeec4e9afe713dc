"""Blank filtering and reproducible train/validation/test splits.

The split is a *narrow* projection: each row's split comes from a keyed hash of
``seed:key``, so it needs no shuffle, does not depend on partitioning, and the
input is scanned once for all three splits (the per-split writers share it).
"""

from __future__ import annotations

import math
from typing import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiforge.functions.hashing import keyed_uniform
from lexiforge.functions.text import is_not_blank

SPLITS = ("train", "validation", "test")


def filter_blank(df: DataFrame, feature: str = "text", keep_null: bool = False) -> DataFrame:
    """Drop rows whose feature is empty after Unicode strip (and NULL unless kept)."""
    cond = is_not_blank(F.col(feature))
    if keep_null:
        cond = cond | F.col(feature).isNull()
    return df.filter(cond)


def split_column(key: Column, ratios: Sequence[float] = (0.7, 0.2, 0.1), seed: int = 42,
                 reference_order: bool = False) -> Column:
    """Split name per row from one keyed uniform and two thresholds.

    ``reference_order=True`` reproduces the original pipeline, where the second
    share goes to *test* and the third to *validation*.
    """
    r0, r1, _ = (float(r) for r in ratios)
    total = math.fsum(float(r) for r in ratios)
    u = keyed_uniform(seed, key)
    second, third = ("test", "validation") if reference_order else ("validation", "test")
    return F.when(u < F.lit(r0 / total), "train").when(u < F.lit((r0 + r1) / total), second).otherwise(third)


def split_corpus(df: DataFrame, key: str = "doc_id", feature: str = "text",
                 ratios: Sequence[float] = (0.7, 0.2, 0.1), seed: int = 42,
                 reference_order: bool = False, keep_null: bool = False,
                 preprocess: Iterable[Callable[[DataFrame], DataFrame]] = ()) -> DataFrame:
    """filter blank -> optional user preprocessing -> ``split`` column."""
    out = filter_blank(df, feature, keep_null)
    for fn in preprocess:
        out = out.transform(fn)
    return out.withColumn("split", split_column(F.col(key), ratios, seed, reference_order))


def split_report(split_df: DataFrame, ratios: Sequence[float] = (0.7, 0.2, 0.1)) -> DataFrame:
    """Rows and share per split next to the target share."""
    target = F.create_map(*[x for name, r in zip(SPLITS, ratios)
                            for x in (F.lit(name), F.lit(float(r) / float(sum(ratios))))])
    counts = split_df.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))
    total = F.sum("n_rows").over(Window.partitionBy())  # three rows
    return (counts.withColumn("share", F.round(F.col("n_rows") / total, 6))
            .withColumn("target", F.round(F.element_at(target, F.col("split")), 6)))


def shuffle_within_split(split_df: DataFrame, key: str = "doc_id", seed: int = 42) -> DataFrame:
    """Deterministic shuffle: a keyed hash gives each row its rank in its split.

    The rank is computed as a sort key only; a writer can use
    ``repartitionByRange(split, shuffle_key)`` + ``sortWithinPartitions`` so
    no single task holds a whole split.
    """
    return split_df.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))))


def split_invariants(source: DataFrame, split_df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Disjoint and complete: keys in two splits, keys missing, keys extra.

    One full outer join on the key (co-partitioned shuffle) and one global
    aggregate; no row is collected.
    """
    per_key = split_df.groupBy(key).agg(F.countDistinct("split").alias("n_splits"))
    src = source.select(key).distinct().withColumn("_in_source", F.lit(1))
    j = src.join(per_key, key, "full_outer")
    return j.agg(
        F.coalesce(F.sum(F.when(F.col("n_splits") > 1, 1)), F.lit(0)).cast("bigint").alias("keys_in_two_splits"),
        F.coalesce(F.sum(F.when(F.col("n_splits").isNull(), 1)), F.lit(0)).cast("bigint").alias("missing_keys"),
        F.coalesce(F.sum(F.when(F.col("_in_source").isNull(), 1)), F.lit(0)).cast("bigint").alias("extra_keys"))
