"""Exact top-k search by inner product: columnar branch and bound.

Candidates lie in blocks, each block in vertical layout: one row per dimension.
For a query, the partial products of a block grow by a few dimensions at a
time. What the other dimensions can still add is at most the product of the
remaining norms (Cauchy-Schwarz), so a candidate whose bound is below the k-th
best score found so far can be left out; the survivors are compacted. Blocks of
queries meet blocks of candidates, each pair once, and the best of all blocks
are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Beyond this sum of |a||b| in double arithmetic, products are summed as Python integers.
EXACT = 2.0 ** 52
LONG = (-(2 ** 63), 2 ** 63 - 1)


def scaled_floor(vector: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x), in doubles (whole, so exact as integers)."""
    return np.floor(np.asarray(vector, np.float64) * scale)


def _tails(v: np.ndarray, step: int) -> np.ndarray:
    """Norms of what follows each run of ``step`` dimensions; ``v`` has a row per dimension."""
    squares = np.add.reduceat(v * v, np.arange(0, len(v), step), axis=0)
    after = np.cumsum(squares[::-1], axis=0)[::-1]
    return np.sqrt(np.vstack([after[1:], np.zeros((1, v.shape[1]))])) * (1 + 1e-9)


def search_block(ids: np.ndarray, vertical: np.ndarray, qid: int, q: np.ndarray, k: int, step: int,
                 tails: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """The ``k`` best of a block for one query (its own id apart), by score and then smaller id."""
    dims = len(q)
    if vertical.shape[1] == 0:
        return np.zeros(0, np.int64), []
    if np.sqrt((vertical ** 2).sum(0).max()) * np.sqrt((q * q).sum()) >= EXACT:
        whole = [int(x) for x in q]
        scores = [min(max(sum(a * int(b) for a, b in zip(whole, col)), LONG[0]), LONG[1]) for col in vertical.T]
        best = sorted((-s, i) for s, i in zip(scores, ids.tolist()) if i != qid)[:k]
        return np.array([i for _, i in best], np.int64), [-s for s, _ in best]
    q_tail = _tails(q[:, None], step)[:, 0]
    alive = np.flatnonzero(ids != qid)
    # a floor for the k-th best score: exact scores of the candidates of greatest first partial products
    part = q[:step] @ vertical[:step][:, alive]
    floor = -math.inf
    if len(alive) > 4 * k:
        seed = alive[np.argpartition(-part, 2 * k)[:2 * k]]
        floor = np.partition(q @ vertical[:, seed], k)[k]
    for b, lo in enumerate(range(0, dims, step)):
        if lo:
            part = part + q[lo:lo + step] @ vertical[lo:lo + step][:, alive]
        keep = part + q_tail[b] * tails[b, alive] >= floor - 0.5  # scores are whole: half a unit covers rounding
        if not keep.all():
            alive, part = alive[keep], part[keep]
        if len(part) > 4 * k and lo + step < dims:  # lower bounds may lift the floor
            floor = max(floor, -np.partition(-(part - q_tail[b] * tails[b, alive]), k - 1)[k - 1])
    scores = np.rint(part).astype(np.int64)
    if len(scores) > k:  # all ties of the k-th stay for the choice by id
        kth = -np.partition(-scores, k - 1)[k - 1]
        alive, scores = alive[scores >= kth], scores[scores >= kth]
    order = np.lexsort((ids[alive], -scores))[:k]
    return ids[alive[order]], scores[order].tolist()


def _taking_part(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(f"`{vector_col}`").cast("array<double>")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    d = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v"))
    return d.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.coalesce(whole, F.lit(False)))


def exact_topk(vectors: DataFrame, queries: Column, k: int = 10, scale: float = 1024.0, step: int = 8,
               id_col: str = "vec_id", vector_col: str = "embedding", block: int = 4096,
               query_block: int = 1024) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` best partners of each row that fulfils ``queries``.

    ``queries`` is a condition on ``vec_id``. Components become
    ``floor(scale * x)``; scores are whole inner products, ties go to the
    smaller id; a score outside 64 bits counts as the nearest one inside. Rows with a null id,
    a null vector or a null or non-finite component take no part. Vectors of
    another length than the query's are not compared with it. An id that occurs
    several times stands once, with its greatest vector. No rows, no result.
    """
    d = _taking_part(vectors, id_col, vector_col)
    n = d.count()
    blocks, query_blocks = max(1, -(-n // block)), max(1, -(-n // (100 * query_block)))
    d = d.withColumn("b", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    q = d.filter(queries).withColumn("g", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(query_blocks)).cast("int"))
    # every block of candidates once for each block of queries, and the other way round
    left = d.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    right = q.drop("b").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def distinct(p: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """By length of vector: ids and the vectors' whole numbers, a row per dimension."""
        sizes = p["v"].map(len).to_numpy() if len(p) else np.zeros(0, int)
        ids = p["vec_id"].to_numpy()
        if len(np.unique(ids)) < len(ids):
            order = sorted(range(len(p)), key=lambda i: (ids[i], list(p["v"].iloc[i])))
            last = [j for a, j in enumerate(order) if a + 1 == len(order) or ids[order[a + 1]] != ids[j]]
            p, sizes, ids = p.iloc[last], sizes[last], ids[last]
        for s in np.unique(sizes):
            own = sizes == s
            yield ids[own], (scaled_floor(np.stack(p["v"].to_numpy()[own]), scale).T if s else np.zeros((0, int(own.sum()))))

    def search(c: pa.Table, q: pa.Table) -> pa.Table:
        cands = {len(v): (ids, np.ascontiguousarray(v)) for ids, v in distinct(c.select(["vec_id", "v"]).to_pandas())}
        out: list[tuple] = []
        for qids, qv in distinct(q.select(["vec_id", "v"]).to_pandas()):
            if len(qv) not in cands:
                continue
            ids, v = cands[len(qv)]
            # dimensions of great spread first: bounds get tight early
            order = np.argsort(-(v * v).sum(1), kind="stable")
            v, qv = v[order], qv[order]
            tails = _tails(v, step) if len(v) else np.zeros((0, v.shape[1]))
            for qid, one in zip(qids.tolist(), qv.T):
                if len(one):
                    best, scores = search_block(ids, v, qid, one, k, step, tails)
                else:
                    best = np.sort(ids[ids != qid])[:k]
                    scores = [0] * len(best)
                out += [(qid, i, s) for i, s in zip(best.tolist(), scores)]
        cols = list(zip(*out)) or [[], [], []]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()),
                         "score": pa.array(cols[2], pa.int64())})

    found = (left.groupBy("b", "g").cogroup(right.groupBy("b", "g"))
             .applyInArrow(search, "query_id long, vec_id long, score long"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
