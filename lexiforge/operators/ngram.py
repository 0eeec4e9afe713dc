"""Count-based next-token model: fit, score, loss, perplexity, greedy generation.

Stands in for the trainable model. Documents are cut into consecutive windows
of ``seq_len`` ids, so every id of every document counts. A model is a table of
counts (prev_id, next_id, n); scoring is additive smoothing
``(c + alpha) / (C + alpha * V)``. Losses are sums over *distinct* pairs
weighted by how often they occur: positions are aggregated (map-side first)
before anything is joined, and the join is between two count tables of at most
V * V rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiforge.operators.encode import row_chunks
from lexiforge.session import stored


#: Positions that one pass of an Arrow function works on, at most (a longer row is a pass of its own).
CHUNK = 2_000_000


def _lists(batch: pa.RecordBatch, ids: str, limit: int = CHUNK):
    """(rows, flat ids, ids of each row) in stretches of at most ``limit`` ids; rows without ids are left out."""
    col = batch.column(ids)
    some = pc.greater(pc.fill_null(pc.list_value_length(col), 0), 0)
    batch = batch.filter(some)
    size = pc.list_value_length(batch.column(ids)).to_numpy(zero_copy_only=False).astype(np.int64)
    for lo, hi in row_chunks(size, limit):
        rows = batch.slice(lo, hi - lo)
        yield rows, rows.column(ids).flatten().to_numpy(), size[lo:hi]


def _followed(flat: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The id after each; the pad id 0 after a row's last."""
    nxt = np.zeros(len(flat), np.int64)
    nxt[:-1] = flat[1:]
    nxt[np.cumsum(size) - 1] = 0
    return nxt


def _positions(keep: tuple, seq_len: int, ids: str, include_pad: bool):
    def fn(batches):
        for b in batches:
            for rows, flat, size in _lists(b, ids, CHUNK // 4):
                pad = (-size) % seq_len if include_pad else np.zeros(len(size), np.int64)
                n = size + pad
                ends = np.cumsum(n)
                row = np.repeat(np.arange(len(n)), n)
                i = np.arange(int(n.sum())) - (ends - n)[row]
                real = i < size[row]
                prev, nxt = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
                prev[real], nxt[real] = flat, _followed(flat, size)
                at = pa.array(row)
                cols = [rows.column(c).take(at) for c in keep]
                cols += [pa.array(i // seq_len), pa.array((i % seq_len).astype(np.int32)), pa.array(prev), pa.array(nxt)]
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, "win", "pos", "prev_id", "next_id"])
    return fn


def _kept(df: DataFrame, keep: tuple, more: list) -> T.StructType:
    """Schema of the columns ``keep`` of ``df`` and of ``more`` (name, type)."""
    return T.StructType([*df.select(*keep).schema.fields, *(T.StructField(n, t) for n, t in more)])


def window_positions(tokens: DataFrame, keep: tuple, seq_len: int, ids: str = "ids", include_pad: bool = True) -> DataFrame:
    """(keep..., win, pos, prev_id, next_id): every position of every window of ``seq_len`` ids.

    The target of a document's last id is the pad id 0. The last window is
    padded (0 -> 0); those positions count in a loss unless ``include_pad`` is false.
    """
    long = T.LongType()
    schema = _kept(tokens, keep, [("win", long), ("pos", T.IntegerType()), ("prev_id", long), ("next_id", long)])
    return tokens.select(*keep, ids).mapInArrow(_positions(keep, seq_len, ids, include_pad), schema)


def _groups(rows: pa.RecordBatch, by: tuple):
    """Number of each row's group by the columns ``by``, and a row of each group."""
    code = np.zeros(rows.num_rows, np.int64)
    for c in by:
        values = rows.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        code = np.unique(code * (int(values.max(initial=0)) + 1) + values, return_inverse=True)[1]
    return code, np.unique(code, return_index=True)[1]


def _pair_counter(by: tuple, seq_len: int):
    def fn(batches):
        for b in batches:
            for rows, flat, size in _lists(b, "ids"):
                group, example = _groups(rows, by)
                base = int(flat.max()) + 1
                key = (np.repeat(group, size) * base + flat) * base + _followed(flat, size)
                n_keys = len(example) * base * base
                if n_keys <= CHUNK:
                    n = np.bincount(key, minlength=n_keys)
                    key = np.flatnonzero(n)
                    n = n[key]
                else:
                    key, n = np.unique(key, return_counts=True)
                pads = np.bincount(group, weights=(-size) % seq_len, minlength=len(example)).astype(np.int64)
                padded = np.flatnonzero(pads)
                none = np.zeros(len(padded), np.int64)
                at = pa.array(example[np.concatenate([key // (base * base), padded])])
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(c).take(at) for c in by), pa.array(np.concatenate([key // base % base, none])),
                     pa.array(np.concatenate([key % base, none])), pa.array(np.concatenate([n, pads[padded]]))],
                    names=[*by, "prev_id", "next_id", "n"])
    return fn


def pair_counts(tokens: DataFrame, seq_len: int, by: tuple = ("split",)) -> DataFrame:
    """(by..., prev_id, next_id, n) over all window positions, pads included; counted by batch before they are rows."""
    long = T.LongType()
    some = tokens.select(*by, "ids").mapInArrow(_pair_counter(by, seq_len), _kept(tokens, by, [
        ("prev_id", long), ("next_id", long), ("n", long)]))
    return some.groupBy(*by, "prev_id", "next_id").agg(F.sum("n").alias("n"))


def context_totals(counts: DataFrame, ctx: tuple = ("prev_id",)) -> DataFrame:
    return counts.groupBy(*ctx).agg(F.sum("cnt").alias("ctx_cnt"))


def score_pairs(pairs: DataFrame, counts: DataFrame, vocab_size: int, alpha: float) -> DataFrame:
    """Adds ``logp`` = ln((c + alpha) / (C + alpha V)) to rows with (prev_id, next_id); counts: (prev_id, next_id, cnt)."""
    out = pairs.join(counts, ["prev_id", "next_id"], "left").join(context_totals(counts), "prev_id", "left")
    return out.withColumn("logp", F.log((F.coalesce(F.col("cnt"), F.lit(0)) + F.lit(alpha))
                                        / (F.coalesce(F.col("ctx_cnt"), F.lit(0)) + F.lit(alpha * vocab_size)))
                          ).drop("cnt", "ctx_cnt")


def guess_loss(vocab_size: int) -> float:
    """Loss of a model that knows nothing: -ln(1/V)."""
    return math.log(vocab_size)


def best_next_table(counts: DataFrame, vocab_size: int) -> DataFrame:
    """(prev_id, best_id) for every id: most frequent continuation, ties -> lowest id; an unseen id predicts 0 (all ties)."""
    ids = counts.sparkSession.range(vocab_size).select(F.col("id").alias("prev_id"))
    b = counts.groupBy("prev_id").agg(F.min_by("next_id", F.struct(-F.col("cnt"), F.col("next_id"))).alias("best_id"))
    return ids.join(b, "prev_id", "left").select("prev_id", F.coalesce("best_id", F.lit(0).cast("bigint")).alias("best_id"))


def greedy_chains(best: DataFrame, steps: int) -> DataFrame:
    """(start_id, gen): the greedy continuation of every id, at least ``steps`` ids long.

    Built over the vocabulary, not over the prompts, by doubling: a chain of 2k
    ids is a chain of k and the chain of its last id, so ``steps`` ids take
    log2(steps) joins of V-row tables.
    """
    chains = stored(best.select(F.col("prev_id").alias("start_id"), F.array("best_id").alias("gen")), "chains")
    length = 1
    while length < steps:
        more = chains.select(F.col("start_id").alias("s2"), F.col("gen").alias("g2"))
        chains = stored(chains.join(more, F.element_at("gen", -1) == F.col("s2"))
                        .select("start_id", F.concat("gen", "g2").alias("gen")), "chains")
        length *= 2
    return chains


def generate(prompts: DataFrame, ids: str, chains: DataFrame, total_length: int, stop_id: int | None = 0) -> DataFrame:
    """Adds ``gen``: the greedy continuation of each prompt up to ``total_length`` ids with the prompt,
    or up to and with the first ``stop_id``. A prompt of that length or more gets none."""
    j = prompts.join(chains, F.element_at(F.col(ids), -1) == F.col("start_id"), "left")
    return j.withColumn("gen", _cut(F.col("gen"), _room(ids, total_length), stop_id)).drop("start_id")


def _room(ids: str, total_length: int) -> Column:
    return F.greatest(F.lit(total_length) - F.size(ids), F.lit(0))


def _cut(gen: Column, room: Column, stop_id: int | None) -> Column:
    """The first ``room`` ids of ``gen``, up to and with the first ``stop_id``; none for a null."""
    gen = F.slice(gen, F.lit(1), room)
    if stop_id is not None:
        at = F.array_position(gen, F.lit(stop_id).cast("bigint"))
        gen = F.when(at > 0, F.slice(gen, F.lit(1), at.cast("int"))).otherwise(gen)
    return F.coalesce(gen, F.array().cast("array<bigint>"))


def sequence_loglik(df: DataFrame, keys: tuple, ids: str, counts: DataFrame, vocab_size: int,
                    alpha: float) -> DataFrame:
    """Sum of ln p(ids[i] | ids[i-1]) over a whole sequence; 0 for one without a second id."""
    z = F.explode(F.arrays_zip(F.slice(ids, F.lit(1), F.size(ids) - 1).alias("p"), F.slice(ids, F.lit(2), F.size(ids)).alias("q")))
    p = df.filter(F.size(ids) >= 2).select(*keys, z.alias("z")).select(
        *keys, F.col("z.p").alias("prev_id"), F.col("z.q").alias("next_id"))
    s = score_pairs(p, counts, vocab_size, alpha).groupBy(*keys).agg(F.sum("logp").alias("loglik"))
    return df.select(*keys).join(s, list(keys), "left").withColumn("loglik", F.coalesce("loglik", F.lit(0.0)))


# ---- scorer registry: model name -> factory (only the count model is built) ----
SCORERS: dict = {}


def register_scorer(name: str):
    def deco(factory):
        SCORERS[name.lower()] = factory
        return factory
    return deco


@register_scorer("ngram")
def ngram_scorer(alpha: float = 0.1):
    """fit(pair counts) -> counts; score(pairs, counts, V) -> pairs with logp."""
    class _Scorer:
        def fit(self, pairs):
            return pairs.groupBy("prev_id", "next_id").agg(F.sum("n").alias("cnt"))

        def score(self, pairs, counts, vocab_size):
            return score_pairs(pairs, counts, vocab_size, alpha)
    return _Scorer()


def get_scorer(name: str, **kw):
    try:
        return SCORERS[name.lower()](**kw)
    except KeyError:
        raise ValueError(f"model type '{name}' not supported") from None


# ---- orders above two: contexts of several ids -------------------------------------------------------------------
class _Contexts:
    """Counts of (context, next id) of one group, summed within the task; ids packed into one number."""

    def __init__(self):
        self.keys, self.counts, self.held = [], [], 0

    def add(self, key: np.ndarray, n: np.ndarray) -> None:
        self.keys.append(key)
        self.counts.append(n)
        self.held += len(key)

    def sum(self):
        key, n = np.concatenate(self.keys), np.concatenate(self.counts)
        order = np.argsort(key)
        key, n = key[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        self.keys, self.counts, self.held = [key[first]], [np.add.reduceat(n, first)], len(first)
        return self.keys[0], self.counts[0]


def _context_batch(group: tuple, types: list, names: tuple, back: np.ndarray, next_id: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Rows of one group; ``back``: the ids before the next one, oldest first, -1 where there is none."""
    has = back >= 0
    ends = np.concatenate([[0], np.cumsum(has.sum(axis=1))])
    ctx = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(back[has], pa.int64()))
    cols = [pa.array([v] * len(n), t) for v, t in zip(group, types)]
    return pa.RecordBatch.from_arrays([*cols, ctx, pa.array(next_id, pa.int64()), pa.array(n, pa.int64())], names=[*names, "ctx", "next_id", "n"])


def _context_counter(order: int, ids: str, by: tuple):
    bits = 62 // order
    mask = (1 << bits) - 1

    def fn(batches):
        held, types = {}, []

        def rows_of(group):
            key, n = held.pop(group).sum()
            for lo in range(0, len(key), CHUNK // 4):
                k = key[lo:lo + CHUNK // 4]
                back = np.empty((len(k), order - 1), np.int64)
                for j in range(1, order):
                    back[:, order - 1 - j] = (k >> bits * j & mask) - 1
                yield _context_batch(group, types, by, back, k & mask, n[lo:lo + CHUNK // 4])

        for b in batches:
            types = [b.schema.field(c).type for c in by]
            for rows, flat, size in _lists(b, ids):
                group, example = _groups(rows, by)
                row = np.repeat(np.arange(len(size)), size)
                within = np.arange(len(flat)) - (np.cumsum(size) - size)[row]
                packed = int(flat.max()) < mask
                back = []
                for j in range(1, order):
                    q = np.full(len(flat), -1, np.int64)
                    q[j:] = flat[:-j] if j < len(flat) else q[j:]
                    q[within < j] = -1
                    back.append(q)
                of = group[row]
                for g, e in enumerate(example.tolist()):
                    at = np.flatnonzero((within > 0) & (of == g))
                    if not len(at):
                        continue
                    name = tuple(rows.column(c)[e].as_py() for c in by)
                    if not packed:       # ids too large to share a number: counted by batch only
                        seen = np.stack([*(q[at] for q in reversed(back)), flat[at]], axis=1)
                        seen, n = np.unique(seen, axis=0, return_counts=True)
                        yield _context_batch(name, types, by, seen[:, :-1], seen[:, -1], n)
                        continue
                    key = flat[at]
                    for j, q in enumerate(back, 1):
                        key = key | (q[at] + 1) << bits * j
                    held.setdefault(name, _Contexts()).add(*np.unique(key, return_counts=True))
                if sum(c.held for c in held.values()) > 2 * CHUNK:
                    for name in list(held):
                        held[name].sum()
                    if sum(c.held for c in held.values()) > CHUNK:
                        for name in list(held):
                            yield from rows_of(name)
        for name in list(held):
            yield from rows_of(name)
    return fn


def context_counts(tokens: DataFrame, order: int, ids: str = "ids", by: tuple = ("split",), first: str | None = None) -> DataFrame:
    """(by..., ctx, next_id, n): how often an id follows its last ``order - 1`` ids (fewer at the start of a row).

    What stands before the second id of a row, or before the place in column ``first``, is context only. Whole texts are
    counted by task before they are rows: rows grow with distinct contexts.
    """
    if first is None:
        schema = _kept(tokens, by, [("ctx", T.ArrayType(T.LongType())), ("next_id", T.LongType()), ("n", T.LongType())])
        some = tokens.select(*by, ids).mapInArrow(_context_counter(order, ids, by), schema)
        return some.groupBy(*by, "ctx", "next_id").agg(F.sum("n").alias("n"))
    start = F.col(first)
    grams = F.transform(F.sequence(start, F.size(ids)), lambda i: F.struct(
        F.slice(F.col(ids), F.greatest(F.lit(1), i - (order - 1)), F.least(F.lit(order - 1), i - 1)).alias("ctx"),
        F.element_at(F.col(ids), i).alias("next_id")))
    rows = tokens.filter(F.size(ids) >= start).select(*by, F.explode(grams).alias("g"))
    return rows.groupBy(*by, "g.ctx", "g.next_id").agg(F.count(F.lit(1)).alias("n"))


def _suffix(k: int) -> Column:
    """The last ``k`` ids of ``ctx``; null where it has fewer."""
    return F.when(F.size("ctx") >= k, F.slice("ctx", F.size("ctx") - k + 1, k)) if k else F.array().cast("array<bigint>")


def score_orders(evaluated: DataFrame, train: DataFrame, order: int, vocab_size: int, prior: float) -> DataFrame:
    """``evaluated`` (ctx, next_id, ...) with p1 ... p<order>: the probability by models of every order up to ``order``.

    Each order shrinks its counts to the order below: (count + prior * p) / (total + prior), from 1 / vocab_size; a
    context that training has not seen leaves p as it is, so the longest known context decides. Both tables are
    aggregated already, so every level is one join of distinct contexts, not of positions.
    """
    out = evaluated.withColumn("p0", F.lit(1.0 / vocab_size))
    for k in range(order):
        seen = train.withColumn("c", _suffix(k)).filter("c IS NOT NULL")
        counts = seen.groupBy("c", F.col("next_id").alias("w")).agg(F.sum("n").alias("cnt"))
        out = out.withColumn("_s", _suffix(k))
        if k == 0:
            # one row of totals, and a count for each id of the vocabulary
            total = counts.agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("tot")).scalar()
            out = out.join(F.broadcast(counts.drop("c")), F.col("next_id") == F.col("w"), "left").withColumn("tot", total)
        else:
            totals = counts.groupBy(F.col("c").alias("tc")).agg(F.sum("cnt").alias("tot"))
            if k == 1:
                totals = F.broadcast(totals)     # at most a row for each id of the vocabulary
            out = (out.join(counts, (F.col("_s") == F.col("c")) & (F.col("next_id") == F.col("w")), "left").drop("c")
                   .join(totals, F.col("_s") == F.col("tc"), "left").drop("tc"))
        p = (F.coalesce("cnt", F.lit(0)) + F.lit(prior) * F.col(f"p{k}")) / (F.col("tot") + F.lit(prior))
        out = out.withColumn(f"p{k + 1}", F.coalesce(p, F.col(f"p{k}"))).drop("w", "cnt", "tot", "_s")
    return out.drop("p0")


def continuation_loglik(rows: DataFrame, keys: tuple, context: str, ids: str, train: DataFrame, order: int,
                        vocab_size: int, prior: float) -> DataFrame:
    """(keys..., loglik): ln p of the ids of ``ids`` after those of ``context``, by ``score_orders``; 0 for no ids.

    ``context`` needs at least one id (``<bos>``); of its ids the model sees the last ``order - 1``.
    """
    tail = _last_ids(F.col(context), max(order - 1, 1))
    seq = rows.select(*keys, F.concat(tail, ids).alias("ids"), (F.size(tail) + 1).alias("first"))
    scored = score_orders(context_counts(seq, order, by=keys, first="first"), train, order, vocab_size, prior)
    sums = scored.groupBy(*keys).agg(F.sum(F.col("n") * F.log(f"p{order}")).alias("loglik"))
    return rows.select(*keys).join(sums, list(keys), "left").withColumn("loglik", F.coalesce("loglik", F.lit(0.0)))


# ---- generation over contexts of several ids ---------------------------------------------------------------------
END = 0   # the pad id: what a text is counted to end with


def ended(tokens: DataFrame, ids: str = "ids") -> DataFrame:
    """Token rows with the end id appended, so that a model learns where texts end."""
    return tokens.withColumn(ids, F.concat(F.col(ids), F.array(F.lit(END).cast("bigint"))))


def best_next_contexts(counts: DataFrame, order: int) -> DataFrame:
    """(ctx, best_id) for every context of 0 to ``order - 1`` ids: most frequent continuation, ties -> lowest id.

    ``counts``: (ctx, next_id, n) of ``context_counts``, which hold the longest contexts; the shorter ones are their
    ends. Sums are made map-side first, and no context is a row more than once for each continuation.
    """
    suffixes = F.explode(F.transform(F.sequence(F.lit(0), F.least(F.lit(order - 1), F.size("ctx"))),
                                     lambda k: F.slice("ctx", F.size("ctx") - k + 1, k)))
    cnt = counts.select(suffixes.alias("c"), "next_id", "n").groupBy("c", "next_id").agg(F.sum("n").alias("n"))
    return cnt.groupBy(F.col("c").alias("ctx")).agg(
        F.min_by("next_id", F.struct(-F.col("n"), F.col("next_id"))).alias("best_id"))


def _last_ids(ids: Column, n: int) -> Column:
    return F.slice(ids, F.greatest(F.size(ids) - n + 1, F.lit(1)), n) if n else F.array().cast("array<bigint>")


def _follow(frontier: DataFrame, best: DataFrame, order: int) -> DataFrame:
    """(ctx, next_id, to): what the longest known end of each context predicts, and the context after it (null after END).

    One join looks up all ends of a context; a model without any row predicts END.
    """
    ends = F.transform(F.sequence(F.lit(0), F.size("ctx")), lambda k: F.slice("ctx", F.size("ctx") - k + 1, k))
    known = best.select(F.col("ctx").alias("_end"), "best_id")
    found = (frontier.select("ctx", F.explode(ends).alias("_end")).join(known, "_end", "left")
             .groupBy("ctx").agg(F.max_by("best_id", F.when(F.col("best_id").isNotNull(), F.size("_end"))).alias("w")))
    w = F.coalesce("w", F.lit(END).cast("bigint"))
    return found.select("ctx", w.alias("next_id"),
                        F.when(w != END, _last_ids(F.concat("ctx", F.array(w)), order - 1)).alias("to"))


def context_edges(starts: DataFrame, best: DataFrame, order: int, steps: int) -> DataFrame:
    """(ctx, next_id, to) for every context that greedy generation meets within ``steps`` ids from ``starts`` (ctx).

    The frontier holds contexts, not prompts: each one is looked up once, however many prompts reach it, and it is
    finished when all its successors have been met (a chain that ends or runs into a known one). Every step's edges are
    written to shared storage, so a lost executor costs one step.
    """
    frontier, parts = starts.select("ctx").filter("ctx IS NOT NULL").distinct(), []
    for _ in range(max(steps, 1)):
        edges = stored(_follow(frontier, best, order), "edges")
        if edges.isEmpty():
            break
        parts.append(edges)
        met = edges
        for p in parts[:-1]:
            met = met.unionByName(p)
        frontier = edges.select(F.col("to").alias("ctx")).filter("ctx IS NOT NULL").distinct().join(met, "ctx", "left_anti")
        if len(parts) % 8 == 0:      # few tables to read, whatever the number of steps
            parts = [stored(met, "edges")]
    out = parts[0] if parts else edges
    for p in parts[1:]:
        out = out.unionByName(p)
    return stored(out, "edges")


def context_chains(edges: DataFrame, starts: DataFrame, steps: int) -> DataFrame:
    """(ctx, gen): the greedy continuation of each of ``starts``, ``steps`` ids long or up to and with END.

    By doubling over the contexts met: a chain of 2k ids is one of k and the chain of the context it leads to. The last
    doubling is made for the starts alone.
    """
    chains, length = edges.select("ctx", F.array("next_id").alias("gen"), "to"), 1
    wanted = starts.select("ctx").distinct()
    while length < steps:
        left = chains if 2 * length < steps else chains.join(wanted, "ctx", "left_semi")
        more = chains.select(F.col("ctx").alias("_c"), F.col("gen").alias("_g"), F.col("to").alias("_t"))
        chains = stored(left.join(more, F.col("to") == F.col("_c"), "left").select(
            "ctx", F.when(F.col("_c").isNull(), F.col("gen")).otherwise(F.concat("gen", "_g")).alias("gen"),
            F.col("_t").alias("to")), "chains")
        length *= 2
    return chains.join(wanted, "ctx", "left_semi").select("ctx", F.slice("gen", 1, max(steps, 1)).alias("gen"))


def generate_contexts(prompts: DataFrame, ids: str, counts: DataFrame, order: int, total_length: int,
                      stop: bool = True) -> DataFrame:
    """Adds ``gen``: the greedy continuation by a model of ``order`` (longest known context decides), up to
    ``total_length`` ids with the prompt, or up to and with END; without ``stop`` END is repeated to the full length.

    ``counts``: ``context_counts`` of ``ended`` tokens, of at least that order. A prompt of that length or more, an
    empty or a null one gets no ids.
    """
    best = stored(best_next_contexts(counts, order), "best")
    ctx = F.when((F.size(ids) > 0) & (F.size(ids) < total_length), _last_ids(F.col(ids), order - 1))
    p = prompts.withColumn("_ctx", ctx)
    starts = stored(p.select(F.col("_ctx").alias("ctx")).filter("ctx IS NOT NULL").distinct(), "starts")
    edges = context_edges(starts, best, order, total_length)
    chains = context_chains(edges, starts, total_length)
    j = p.join(chains.select(F.col("ctx").alias("_ctx"), "gen"), "_ctx", "left").drop("_ctx")
    room = _room(ids, total_length)
    gen = _cut(F.col("gen"), room, END if stop else None)
    if not stop:
        gen = F.when(F.col("gen").isNotNull(), F.concat(gen, F.array_repeat(F.lit(END).cast("bigint"), room - F.size(gen)))).otherwise(gen)
    return j.withColumn("gen", gen)
