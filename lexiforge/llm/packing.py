"""Vector best-fit packing of token pieces into sequences.

A bin (sequence) has three capacities: tokens, documents and attention cost
(the sum of squared lengths). Pieces of one length have one and the same
vector, so the best-fit plan depends on how many pieces of each length there
are, and on nothing else: the driver plans on that histogram (at most
``tokens`` rows, whatever the corpus holds), longest first, with bins of the
same residual handled together. Spark numbers the pieces of each length and
every piece looks up its place in the plan.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.llm.common import cut_lineage, id_text, partitions, real_id
from lexiforge.llm.words import ChunkTable, library


#: Shares of residual tokens, documents and attention cost in the choice of a bin.
WEIGHTS = (1.0, 0.25, 0.25)


def plan_bins(hist: dict[int, int], tokens: int, documents: int | None = None, attention: int | None = None,
              rule: str = "norm", weights: tuple[float, float, float] = WEIGHTS) -> dict[str, np.ndarray]:
    """Best-fit placements: ``length, first, count, each, bin, offset``.

    Pieces ``first .. first + count - 1`` of that length go, ``each`` to a bin,
    to bins from ``bin`` on, at ``offset`` and behind. Among the residual
    states in which a piece fits under every capacity, ``rule`` picks the one
    of least weighted residual norm afterwards ("norm") or of greatest weighted
    dot product of piece and residual ("dot"); both measure in shares of the
    capacities. A piece that exceeds a capacity by itself gets a bin of its own.
    """
    documents = documents or tokens
    attention = attention or tokens * tokens
    cap = np.array([tokens, documents, attention], float)
    w = np.array(weights)
    state = np.zeros((0, 3))  # residual tokens, documents and attention cost
    used = np.zeros(0, np.int64)  # tokens used; also where the next piece starts
    count = np.zeros(0, np.int64)
    first_bin = np.zeros(0, np.int64)
    bins, out = 0, []
    smallest = min(hist, default=0)
    for length in sorted(hist, reverse=True):
        left, rank = hist[length], 0
        item = np.array([length, 1, float(length) ** 2])
        most = np.array([length, 1, length ** 2])
        while left:
            fits = np.flatnonzero((state >= item).all(1))
            if fits.size:
                after = (state[fits] - item) / cap
                score = (w * after ** 2).sum(1) if rule == "norm" else -(w * (item / cap) * (state[fits] / cap)).sum(1)
                s = int(fits[score.argmin()])
                # a bin that is best now stays best for the same length under "norm": fill it up at once
                each = int((state[s] // most).min()) if rule == "norm" else 1
            else:
                each = max(1, int((cap // most).min())) if rule == "norm" else 1
                new = -(-left // each)
                state, used = np.vstack([state, cap]), np.append(used, 0)
                count, first_bin = np.append(count, new), np.append(first_bin, bins)
                bins, s = bins + new, len(count) - 1
            full = min(int(count[s]), left // each)
            rest = left % each if full < count[s] else 0
            if full:
                out.append((length, rank, full * each, each, first_bin[s], used[s]))
            if rest:
                out.append((length, rank + full * each, rest, rest, first_bin[s] + full, used[s]))
            # the touched bins become states of their own
            parts = [(state[s] - each * item, used[s] + each * length, full, first_bin[s]),
                     (state[s] - rest * item, used[s] + rest * length, 1 if rest else 0, first_bin[s] + full),
                     (state[s], used[s], count[s] - full - (1 if rest else 0), first_bin[s] + full + (1 if rest else 0))]
            rank, left = rank + full * each + rest, left - full * each - rest
            keep = np.ones(len(count), bool)
            keep[s] = False
            parts = [p for p in parts if p[2] and p[0][0] >= smallest and p[0][1] >= 1]
            state = np.vstack([state[keep], *[p[0][None] for p in parts]])
            used = np.append(used[keep], [p[1] for p in parts]).astype(np.int64)
            count = np.append(count[keep], [p[2] for p in parts]).astype(np.int64)
            first_bin = np.append(first_bin[keep], [p[3] for p in parts]).astype(np.int64)
    cols = np.array(out, np.int64).reshape(-1, 6)
    order = np.lexsort((cols[:, 1], cols[:, 0]))
    return dict(zip(("length", "first", "count", "each", "bin", "offset"), cols[order].T))


def best_fit_pack(pieces: DataFrame, tokens: int, documents: int | None = None, attention: int | None = None,
                  rule: str = "norm", weights: tuple[float, float, float] = WEIGHTS,
                  length_col: str = "length", key: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` (the place in the sequence, without gaps from 0).

    ``length_col`` must be at least 1 (null or smaller: the row gets nulls).
    ``key`` orders the pieces of a length; repeated keys are separate pieces.
    The result does not depend on how the input is partitioned, up to the order of
    rows that are equal in ``key`` and length. An empty input gives no rows. Columns
    ``sequence_id`` and ``offset`` of the input are replaced.
    """
    names = [f"c{k}" for k in range(len(pieces.columns))]
    at = {c: names[k] for k, c in enumerate(pieces.columns)}
    n = partitions(pieces.sparkSession)
    rows = pieces.toDF(*names).withColumn("n_len", F.col(at[length_col]).cast("long"))
    # spread the pieces of one length over as many parts as there are tasks
    rows = rows.withColumn("salt", F.pmod(F.xxhash64(*[at[k] for k in key]), F.lit(n)).cast("int"))
    rows = cut_lineage(rows)
    fits = rows.filter(F.col("n_len") >= 1)
    parts = fits.groupBy("n_len", "salt").agg(F.count(F.lit(1)).alias("n"))
    hist = {r[0]: r[1] for r in parts.groupBy("n_len").agg(F.sum("n")).collect()}  # one row per length
    plan = plan_bins(hist, tokens, documents, attention, rule, weights)
    before = Window.partitionBy("n_len").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("n_len", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("n_len", "salt").orderBy(*[at[k] for k in key])
    ranked = (fits.withColumn("rank", F.row_number().over(within) - 1).join(starts, ["n_len", "salt"])
              .withColumn("rank", F.col("rank") + F.col("start"))
              .select(*names, "n_len", "rank"))
    shared = pieces.sparkSession.sparkContext.broadcast(plan)  # rows: bounded by the lengths, not by the corpus

    def place(batches):
        p = shared.value
        key_of = (p["length"] << 40) + p["first"]
        for b in batches:
            length, rank = (b.column(c).to_numpy() for c in ("n_len", "rank"))
            e = np.searchsorted(key_of, (length << 40) + rank, "right") - 1
            d = rank - p["first"][e]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:len(names)], pa.array(p["bin"][e] + d // p["each"][e]),
                 pa.array(p["offset"][e] + d % p["each"][e] * length)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema.fields[:len(names)])
    placed = ranked.mapInArrow(place, schema + ", sequence_id long, offset long")
    none = (rows.filter(~F.coalesce(F.col("n_len") >= 1, F.lit(False)))
            .select(*names, F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("long").alias("offset")))
    stay = [F.col(n).alias(c) for n, c in zip(names, pieces.columns) if c not in ("sequence_id", "offset")]
    return placed.unionByName(none).select(*stay, "sequence_id", "offset")


@functools.cache
def _chunks(path: str) -> ChunkTable:
    """Ids by the library: distinct words go through it together and are told apart by their last tokens."""
    lib = library(path)
    ends = np.zeros(lib.get_vocab_size(), bool)
    for t, i in lib.get_vocab().items():
        ends[i] = t.endswith("</w>")

    def encode(words: list[bytes]) -> list[bytes]:
        if not words:
            return []
        texts = [w.decode() for w in words]
        out = []
        for lo in range(0, len(texts), 20_000):
            part = texts[lo:lo + 20_000]
            ids = np.array(lib.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(ends[ids]) + 1
            if len(cuts) != len(part):  # a word that the library splits further
                out += [np.array(e.ids, "<u4").tobytes() for e in lib.encode_batch(part, add_special_tokens=False)]
                continue
            data, a = ids.tobytes(), 0
            for b in (cuts * 4).tolist():
                out.append(data[a:b])
                a = b
        return out

    table = ChunkTable(path, encode)
    table.other = lambda text: np.array(lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    return table


def token_pieces(docs: DataFrame, path: str, tokens: int, end_id: int | None = 1, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids``: each document's ids, then ``end_id``, cut every ``tokens`` ids.

    ``ids`` is binary, little-endian uint32. A null or empty text is ``end_id``
    alone; without an ``end_id`` it has no piece. Repeated rows are packed each.
    """
    end = b"" if end_id is None else np.uint32(end_id).astype("<u4").tobytes()
    step = 4 * tokens

    def run(batches):
        table = _chunks(path)
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            size = 0
            for d, ids in zip(b.column("doc_id").to_pylist(), table.ids(b.column("text").to_pylist())):
                ids += end
                size += len(ids)
                for k, lo in enumerate(range(0, len(ids), step)):
                    part = ids[lo:lo + step]
                    for c, v in zip(cols, (d, k, lo // 4, len(part) // 4, part)):
                        c.append(v)
                if size > 8_000_000:
                    yield batch_of(cols)
                    cols, size = [[], [], [], [], []], 0
            yield batch_of(cols)

    def batch_of(cols):
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                          ["doc_id", "piece", "start", "length", "ids"])

    out = id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")
    return out.withColumn("doc_id", real_id())
