"""Few-shot contexts for multiple-choice items: solved examples of other items before the question."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.operators.ordering import ordered_index


def few_shot_contexts(items: DataFrame, n_shots: int, seed: int, separator: str = "\n", task: str = "task",
                      item: str = "item_id", prompt: str = "prompt", answer: str = "answer") -> DataFrame:
    """(task, item_id, context): ``n_shots`` other items of the same task, each ``prompt``, ``answer`` and ``separator``.

    Sampled without replacement: a keyed hash puts a task's items in a seeded order, and each item takes those that
    follow it, around the end; a task with fewer others gives them all. Every item is joined to ``n_shots`` places, so
    no two items are compared and no task sorts in one window (``ordered_index`` cuts a hot one). ``items`` has one row
    for each (task, item_id); a null prompt or answer is empty, and no shots give an empty context.
    """
    if n_shots < 1:
        return items.select(task, item, F.lit("").alias("context"))
    shot = F.concat(F.coalesce(F.col(prompt), F.lit("")), F.coalesce(F.col(answer), F.lit("")), F.lit(separator))
    at = items.select(task, item, F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(task), F.col(item).cast("string"))).alias("_h"))
    ring = ordered_index(at, [task], ["_h", item], "_idx").drop("_h")
    sizes = ring.groupBy(task).agg(F.count(F.lit(1)).alias("_size"))
    wants = (ring.join(sizes, task).withColumn("_k", F.explode(F.sequence(F.lit(0), F.least(F.lit(n_shots), F.col("_size") - 1).cast("int"))))
             .filter("_k > 0").select(task, item, "_k", F.pmod(F.col("_idx") + F.col("_k"), F.col("_size")).alias("_idx")))
    texts = ring.join(items.select(task, item, shot.alias("_shot")), [task, item]).select(task, "_idx", "_shot")
    given = (wants.join(texts, [task, "_idx"]).groupBy(task, item)
             .agg(F.array_sort(F.collect_list(F.struct("_k", "_shot"))).alias("_s")))   # at most n_shots
    return items.select(task, item).join(given, [task, item], "left").select(
        task, item, F.coalesce(F.array_join(F.col("_s._shot"), ""), F.lit("")).alias("context"))
