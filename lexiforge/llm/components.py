"""Connected components by contraction: every round, vertices hook to their least neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.common import Scratch


def _after(df: DataFrame, col: str, parent: DataFrame) -> DataFrame:
    """``col`` replaced by its parent, if it has one."""
    p = parent.select(F.col("v").alias("pv"), F.col("p").alias("pp"))
    return df.join(p, F.col(col) == F.col("pv"), "left").withColumn(col, F.coalesce("pp", col)).drop("pv", "pp")


def connected_components(links: DataFrame, keep: Scratch) -> DataFrame:
    """``v, root`` for every vertex of ``links`` (a, b: long, no nulls): the least vertex it is connected with.

    Parents are minima, so a common vertex is combined before the shuffle; each
    round at least halves the vertices that still have links, and jumps twice
    along the parents. Loops and repeated links do no harm.
    """
    edges = keep(links.filter("a <> b").select("a", "b").distinct())
    roots = keep(edges.select(F.col("a").alias("v")).union(edges.select("b")).distinct().withColumn("root", F.col("v")))
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        parent = keep(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("p")).filter("p < v"))
        for _ in range(2):
            parent = _after(parent, "p", parent)
        parent = keep(parent)
        roots = keep(_after(roots, "root", parent))
        edges = keep(_after(_after(edges, "a", parent), "b", parent).filter("a <> b").distinct())
    return roots
