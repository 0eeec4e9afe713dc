"""Near-duplicate documents: a chosen-path set similarity join on word shingles.

A document is the set of its word shingles; its *minwise tokens* are the least
hashes of that set under many hash functions. In every tree the documents
branch by chosen tokens: through the first ``TOP`` levels, whose nodes always hold
too many of a corpus, by one at each; below by one or two that the node
selects, on average by 1 / threshold, so a pair at the threshold keeps its
number of common paths on average at any depth. A node with few documents is
compared exhaustively, a larger one branches again; one that is still large
after all levels is compared exhaustively too, block by block in many tasks. Independent trees repeat
this until a pair at the threshold has no common node after all levels, those
below the top included, only with probability ``LOST``.

Comparisons in a node use eight bits of each token and let a pair at the
threshold pass except with probability ``MISS``; what passes is confirmed on the full
sets. Equal sets are one document of the join.

Only components count, so pairs that are connected already need no comparison. Every node
hands on a spanning forest of its likely pairs, one fewer than its documents at most, in two passes:

1. The first ``SKETCH`` trees, which end ``SKETCH_DEPTH`` levels below the top, where a node that is large is
   cut at random into blocks of a small node's size: every tree cuts anew, so the blocks of a group of copies
   overlap. What these pairs connect, confirmed or not, is a *group*; confirmed ones connect most of it. The
   documents of a group that are not connected by then are compared on full sets, all with all.
2. All trees, with what is in one group known: a node of one group goes, and only pairs of different groups are
   compared and handed on. The groups that they connect are compared on full sets in turn.

So every likely pair lies in a group or between two that are compared, and what is handed on or compared as
rows grows with the documents, not with the pairs. Groups are compared in cells of two blocks of documents,
by products of the documents' shingle columns, and hand on spanning forests of their links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from lexiforge.llm.common import Scratch, cut_lineage, id_text, partitions, real_id, sized_slices
from lexiforge.llm.components import connected_components

TOKENS = 256
TOP = 3
SKETCH = 8
SKETCH_DEPTH = 1
BLOCK = 16  # times ``limit``: documents of a block of a node that is large after all levels
GROUP_DOCS, GROUP_SHINGLES = 1024, 2_000_000  # of a block of a group that is compared on full sets
LOST = 1e-10
MISS = 1e-7


def _multipliers(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2 ** 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of so many lower-cased (A-Z) words; the whole sequence if it is shorter."""
    w = text.lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxh64_intdigest, w), np.uint64, len(w))
    size = min(words, len(w))
    mult = _multipliers(11, words + 1)
    out = np.full(len(h) - size + 1, mult[size])
    for k in range(size):
        out = _mix(out + h[k:len(h) - size + 1 + k] * mult[k])
    return np.unique(out)


def least_matches(threshold: float, tokens: int = TOKENS, miss: float = MISS) -> int:
    """Fewest equal tokens that a pair at the threshold has, but for a probability of ``miss``."""
    below = 0.0
    for m in range(tokens + 1):
        below += math.comb(tokens, m) * threshold ** m * (1 - threshold) ** (tokens - m)
        if below > miss:
            return m
    return tokens


def survival(threshold: float, depth: int) -> float:
    """Probability that a pair at the threshold shares a node after so many levels below the top, a branching process of mean one."""
    second, out = min(1.0, 1 / threshold - 1), 0.0
    for _ in range(depth):
        out = (1 - threshold + threshold * out) * (1 - second * threshold + second * threshold * out)
    return 1 - out


def tree_count(threshold: float, depth: int) -> int:
    """Trees for a pair at the threshold to meet in one of them, through all levels, except with probability ``LOST``."""
    threshold = min(threshold, 0.999)
    return math.ceil(math.log(LOST) / math.log1p(-threshold ** TOP * survival(threshold, depth)))


def top_tokens(trees: int) -> np.ndarray:
    """The tokens that each tree branches by in its top levels: a row per tree; each token is used before any is again."""
    rng = np.random.Generator(np.random.PCG64(14))
    rounds = -(-trees * TOP // (TOKENS - TOKENS % TOP))
    return np.concatenate([rng.permutation(TOKENS)[:TOKENS - TOKENS % TOP] for _ in range(rounds)]).reshape(-1, TOP)[:trees]


def describe(plain: DataFrame, words: int, trees: int) -> DataFrame:
    """``doc_id, n, c1, c2`` (hash of the set, null if empty)``, sig`` (a byte of each token)``, paths`` (a node of each tree)."""

    chosen = top_tokens(trees)

    def run(batches):
        mult = _multipliers(12, TOKENS)
        for b in batches:
            for part in sized_slices(b, "text", 1_000_000):
                sets = [shingle_set(t, words) for t in part.column("text").to_pylist()]
                n = np.fromiter(map(len, sets), np.int64, len(sets))
                full = np.flatnonzero(n)
                sig = np.zeros((len(sets), TOKENS), np.uint64)
                if len(full):
                    flat = np.concatenate(sets)
                    at = (np.cumsum(n) - n)[full]
                    for k in range(TOKENS):
                        sig[full, k] = np.minimum.reduceat((flat * mult[k]) >> np.uint64(24), at)
                digest = [np.frombuffer(blake2b(s.tobytes(), digest_size=16).digest(), np.int64) if len(s) else None for s in sets]
                paths = np.tile(np.arange(trees, dtype=np.uint64), (len(sets), 1))
                for level in range(TOP):
                    paths = _mix(paths * np.uint64(0x9E3779B97F4A7C15) + sig[:, chosen[:, level]])
                paths = paths.view(np.int64)
                low = (_mix(sig) & np.uint64(255)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array(n), *[pa.array([None if d is None else int(d[k]) for d in digest], pa.int64())
                                                          for k in (0, 1)],
                    pa.array([x.tobytes() for x in low], pa.binary()),
                    pa.array([p.tolist() if m else [] for p, m in zip(paths, n)], pa.list_(pa.int64()))],
                    ["doc_id", "n", "c1", "c2", "sig", "paths"])

    return plain.mapInArrow(run, "doc_id long, n long, c1 long, c2 long, sig binary, paths array<long>")


#: A document in a node; ``root``: its group as far as known.
ROWS = "node long, doc_id long, root long, n long, sig binary"
COLUMNS = [c.split()[0] for c in ROWS.split(", ")]


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _grouped(batches) -> Iterator[dict[str, np.ndarray]]:
    """ROWS sorted by node: arrays of whole nodes, about a batch at a time."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        rows = {c: _matrix(b.column(c), "u1") if c == "sig" else b.column(c).to_numpy() for c in b.schema.names}
        if held:
            rows = {k: np.concatenate([held[k], v]) for k, v in rows.items()}
        cut = int(np.searchsorted(rows["node"], rows["node"][-1]))  # the last node may go on
        if cut:
            yield {k: v[:cut] for k, v in rows.items()}
        held = {k: v[cut:] for k, v in rows.items()}
    if held:
        yield held


def _equal_tokens(r: dict[str, np.ndarray], i, j, percent: int, least: int) -> np.ndarray:
    """Equal tokens of pairs that may reach the threshold, by these and by the size of the sets, and are not known to be connected; else 0."""
    n, sig = r["n"], r["sig"]
    ok = (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])) & (r["root"][i] != r["root"][j])
    equal = (sig[i] == sig[j]).sum(-1)
    return np.where(ok & (equal >= least), equal, 0)


def _forest(i: np.ndarray, j: np.ndarray, equal: np.ndarray) -> np.ndarray:
    """Which pairs make a spanning forest, those of most equal tokens first."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    out = np.zeros(len(i), bool)
    order = np.argsort(-equal, kind="stable")
    for k, a, b in zip(order.tolist(), i[order].tolist(), j[order].tolist()):
        a, b = find(a), find(b)
        if a != b:
            parent[b] = a
            out[k] = True
    return out


def _pairs(r: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, equal: np.ndarray, sketch: bool) -> np.ndarray:
    """Of pairs of rows a spanning forest, as the smaller and the larger root; in the sketch one of every node."""
    hit = equal > 0
    i, j, equal = i[hit], j[hit], equal[hit]
    a, b = r["root"][i], r["root"][j]
    new = _forest(i, j, equal) if sketch else _forest(a, b, equal)  # rows are of one node each
    return np.stack([np.minimum(a, b), np.maximum(a, b)])[:, new]


def _batch(out: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    pairs = np.unique(np.concatenate(out, axis=1), axis=1) if out else np.zeros((2, 0))
    if pairs.shape[1]:
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])


def _node_pairs(batches, percent: int, least: int, sketch: bool) -> Iterator[pa.RecordBatch]:
    """Spanning forests of the pairs of each node that may reach the threshold and are of different roots."""
    for r in _grouped(batches):
        node = r["node"]
        starts = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        sizes = np.diff(np.append(starts, len(node)))
        out = []
        for size in np.unique(sizes[sizes > 1]).tolist():
            at = starts[sizes == size]
            x, y = np.triu_indices(size, 1)
            step = max(1, 200_000 // len(x))
            for lo in range(0, len(at), step):
                i, j = ((at[lo:lo + step, None] + k).ravel() for k in (x, y))
                out.append(_pairs(r, i, j, _equal_tokens(r, i, j, percent, least), sketch))
        yield from _batch(out)


def _children(batches, threshold: float) -> Iterator[pa.RecordBatch]:
    """Every document of a node in the children that the node selects: one, or two with a chance of 1 / threshold - 1."""
    for b in batches:
        node = b.column("node").to_numpy().view(np.uint64)
        sig = _matrix(b.column("sig"), "u1")
        for child in (1, 2):
            draw = _mix(node + _multipliers(13, 3)[child])
            rows = np.arange(len(node)) if child == 1 else np.flatnonzero(
                (draw >> np.uint64(32)).astype(float) / 2 ** 32 < 1 / threshold - 1)
            if not len(rows):
                continue
            which = (draw[rows] % np.uint64(TOKENS)).astype(np.int64)
            token = sig[rows, which].astype(np.uint64) * np.uint64(TOKENS) + which.astype(np.uint64)
            new = _mix(node[rows] ^ _mix(token + np.uint64(child) * np.uint64(0x9E3779B97F4A7C15)))
            take, same = pa.array(rows), ("doc_id", "root", "n", "sig")
            yield pa.RecordBatch.from_arrays([pa.array(new.view(np.int64)), *[b.column(c).take(take) for c in same]], ["node", *same])


def _blocks(large: DataFrame, limit: int) -> DataFrame:
    """Nodes that are large, cut at random into blocks of about ``limit`` documents, each a node of its own."""
    block = F.pmod(F.xxhash64("doc_id", "node"), F.ceil(F.col("size") / limit))
    return large.withColumn("node", F.xxhash64("node", block))


def _spokes(large: DataFrame, few: DataFrame, limit: int) -> DataFrame:
    """Nodes of one large group, ``most``, and few documents besides, cut into blocks of it that have all of the few."""
    blocks = F.ceil(F.col("size") / limit)
    own = F.array(F.pmod(F.xxhash64("doc_id"), blocks))
    every = F.sequence(F.lit(0).cast("long"), blocks - 1)
    rows = large.join(few, "node").withColumn("block", F.explode(F.when(F.col("root") == F.col("most"), own).otherwise(every)))
    return rows.withColumn("node", F.xxhash64("node", "block"))


def _cells(large: DataFrame, block: int, n_parts: int) -> DataFrame:
    """Nodes that are large after all levels, as cells of two blocks of about ``block`` documents each or of one block.

    Every two blocks of a node share a cell, in which ``side`` tells them apart. Of nodes with the same documents one is taken.
    """
    member = [F.sum(F.xxhash64(*c).cast("decimal(20,0)")).alias(k) for k, c in (("h1", ("doc_id", "sig")), ("h2", ("sig", "doc_id")))]
    nodes = large.groupBy("node", "size").agg(*member).groupBy("size", "h1", "h2").agg(F.min("node").alias("node"))
    rows = large.join(nodes.select("node"), "node", "left_semi")
    blocks = F.ceil(F.col("size") / block)
    rows = rows.withColumn("own", F.pmod(F.xxhash64("doc_id"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    rows = rows.withColumn("node", F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")))
    rows = rows.withColumn("side", (F.col("own") > F.col("other")).cast("int"))
    return rows.select(*COLUMNS, "side").repartition(n_parts, "node").sortWithinPartitions("node", "side")


def _spanning(n: int, near) -> Iterator[tuple[int, np.ndarray]]:
    """A spanning forest of ``n`` rows: a row and those first reached from it; ``near(k, left)`` tells which of the left are linked with k."""
    left, todo = np.arange(n), []
    while todo or len(left):
        if not todo:
            todo, left = [int(left[0])], left[1:]
        k = todo.pop()
        if len(left):
            hit = near(k, left)
            if hit.any():
                yield k, left[hit]
                todo += left[hit].tolist()
                left = left[~hit]


def _cell_pairs(batches, percent: int, least: int) -> Iterator[pa.RecordBatch]:
    """The same of two blocks, or within one."""
    for r in _grouped(batches):
        node, side = r["node"], r["side"]
        starts = np.append(np.flatnonzero(np.append(True, node[1:] != node[:-1])), len(node))
        for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist()):
            one = side[lo] == side[hi - 1]

            def near(k, left, lo=lo, one=one):
                equal = _equal_tokens(r, lo + k, lo + left, percent, least)
                return (equal > 0) & (one | (side[lo + k] != side[lo + left]))

            found = [np.stack([np.full(len(j), r["root"][lo + k]), r["root"][lo + j]]) for k, j in _spanning(hi - lo, near)]
            yield from _batch([np.sort(x, axis=0) for x in found])


def candidate_pairs(reps: DataFrame, percent: int, keep: Scratch, limit: int, depth: int, groups: DataFrame | None = None) -> DataFrame:
    """``a < b``: spanning forests of the roots whose documents meet in a node of some tree and may reach the threshold.

    ``groups`` (v, root): the root of a document, itself where it has none. Without them: of the sketch's trees, as far as it goes.
    """
    threshold, sketch = percent / 100, groups is None
    least, n_parts = least_matches(threshold), partitions(reps.sparkSession)
    sigs = reps.select(F.col("doc_id").alias("r"), "n", "sig")

    def signed(rows: DataFrame) -> DataFrame:
        return rows if "sig" in rows.columns else rows.join(sigs, F.col("doc_id") == F.col("r")).drop("r")

    def compared(rows: DataFrame) -> DataFrame:
        placed = signed(rows).select(*COLUMNS).repartition(n_parts, "node").sortWithinPartitions("node")
        return keep(placed.mapInArrow(lambda batches: _node_pairs(batches, percent, least, sketch), "a long, b long").distinct())

    def sized(rows: DataFrame) -> DataFrame:
        # one exchange by node, whatever the sizes: a join with the nodes' counts moves all rows a second time
        node = Window.partitionBy("node")
        counts = {"size": F.count(F.lit(1)).over(node), "lo": F.min("root").over(node), "hi": F.max("root").over(node)}
        return keep(rows.withColumns(counts).filter("lo < hi").drop("lo", "hi"))

    if sketch:
        rows = reps.select("doc_id", F.col("doc_id").alias("root"), F.slice("paths", 1, SKETCH).alias("paths"))
    else:
        rows = reps.select("doc_id", "paths").join(groups, F.col("doc_id") == F.col("v"), "left")
        rows = rows.select("doc_id", F.coalesce("root", "doc_id").alias("root"), "paths")
    rows = sized(rows.select("doc_id", "root", F.explode("paths").alias("node")))
    found = []
    for level in range((SKETCH_DEPTH if sketch else depth) + 1):
        if level:
            rows = sized(signed(large).select(*COLUMNS).mapInArrow(lambda b: _children(b, threshold), ROWS))
        found.append(compared(rows.filter(F.col("size") <= limit)))
        large = rows.filter(F.col("size") > limit)
        if large.isEmpty():
            break
        if not sketch:
            most = large.groupBy("node", "size", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("node", "size")
            most = most.agg(F.max(F.struct("c", "root")).alias("top")).filter(F.col("size") - F.col("top.c") <= limit)
            few = keep(most.select("node", F.col("top.root").alias("most")))
            found.append(compared(_spokes(large, few, limit)))
            large = keep(large.join(few, "node", "left_anti"))
            if large.isEmpty():
                break
    else:
        found.append(compared(_blocks(large, limit)) if sketch else keep(_cells(signed(large), BLOCK * limit, n_parts).mapInArrow(
            lambda batches: _cell_pairs(batches, percent, least), "a long, b long")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return keep(out.distinct())


def _sets(plain: DataFrame, wanted: DataFrame, words: int, keep: Scratch) -> DataFrame:
    """``d, n, shingles`` of the wanted documents; rows of one id are equal here or the class has several rows of it: one of them stands for it."""

    def sets(batches):
        for b in batches:
            for part in sized_slices(b, "text", 1_000_000):
                own = [shingle_set(t, words) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) for x in own], pa.int64()),
                                                  pa.array([x.tobytes() for x in own], pa.binary())], ["d", "n", "shingles"])

    return keep(plain.join(keep(wanted), "doc_id", "left_semi").mapInArrow(sets, "d long, n long, shingles binary"))


def confirmed(pairs: DataFrame, plain: DataFrame, words: int, percent: int, keep: Scratch) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    own = _sets(plain, pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), words, keep)
    left = pairs.join(own, F.col("a") == F.col("d")).select("a", "b", F.col("shingles").alias("sa"))
    both = left.join(own, F.col("b") == F.col("d")).select("a", "b", "sa", F.col("shingles").alias("sb"))

    def check(batches):
        for b in batches:
            a_ids, b_ids = b.column("a").to_pylist(), b.column("b").to_pylist()
            hit = []
            for k, (x, y) in enumerate(zip(b.column("sa"), b.column("sb"))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * common >= percent * (len(x) + len(y) - common):
                    hit.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in hit], pa.int64()) for ids in (a_ids, b_ids)], ["a", "b"])

    return both.mapInArrow(check, "a long, b long")


def common_counts(sets: list[np.ndarray], cut: int) -> np.ndarray:
    """Sizes of the intersections of the first ``cut`` sets with the others; with none others, of all with all."""
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, col, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = held > 1
    row, col = row[shared[col]], (np.cumsum(shared) - 1)[col[shared[col]]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    rest = len(sets) - cut
    out = np.zeros((cut, rest or cut))
    for lo in range(0, int(shared.sum()), 2048):
        at = slice(*np.searchsorted(col, (lo, lo + 2048)))
        m = np.zeros((len(sets), min(2048, int(shared.sum()) - lo)), np.float32)
        m[row[at], col[at] - lo] = 1
        out += m[:cut] @ (m[cut:] if rest else m).T
    return out


def _cell_links(batches, percent: int) -> Iterator[pa.RecordBatch]:
    """Spanning forests of the links of different ``sub`` in each cell: between its two sides, or within the one."""

    def links(docs: list[tuple]) -> Iterator[pa.RecordBatch]:
        side, sub, ids = (np.array([d[k] for d in docs]) for k in range(3))
        sets = [np.frombuffer(d[3].as_buffer(), np.uint64) for d in docs]
        n, cut = np.array([len(x) for x in sets]), int((side == 0).sum())
        common = common_counts(sets, cut)
        i, j = (slice(cut), slice(cut, None)) if cut < len(docs) else (slice(None),) * 2
        hit = (100 * common >= percent * (n[i, None] + n[j] - common)) & (sub[i, None] != sub[j])
        if not hit.any():
            return
        if cut < len(docs):
            def near(k, left):
                at = (left < cut) != (k < cut)
                at[at] = hit[k, left[at] - cut] if k < cut else hit[left[at], k - cut]
                return at
        else:
            def near(k, left):
                return hit[k, left]
        found = [np.sort(np.stack([np.full(len(x), ids[k]), ids[x]]), axis=0) for k, x in _spanning(len(docs), near)]
        yield from _batch(found)

    held, cell = [], None
    for b in batches:
        columns = [b.column(c).to_pylist() for c in ("cell", "side", "sub", "d")]
        for c, *doc, shingles in zip(*columns, b.column("shingles")):
            if held and c != cell:
                yield from links(held)
                held = []
            cell = c
            held.append((*doc, shingles))
    if held:
        yield from links(held)


def group_links(members: DataFrame, plain: DataFrame, words: int, percent: int, keep: Scratch, docs: int = GROUP_DOCS) -> DataFrame:
    """``a < b``: links that connect what is linked of different ``sub`` in a group. ``members``: ``doc_id, cluster, sub``.

    A group is cut into blocks of about ``docs`` documents: a large sub into blocks of its own, the
    others by sub. Every two blocks share a cell, but not two of one sub.
    """
    mixed = members.groupBy("cluster").agg(F.min("sub").alias("lo"), F.max("sub").alias("hi")).filter("lo < hi").select("cluster")
    members = keep(members.join(mixed, "cluster", "left_semi"))
    own = _sets(plain, members.select("doc_id").distinct(), words, keep)
    sizes = members.join(own.groupBy(F.col("d").alias("doc_id")).agg(F.sum("n").alias("n")), "doc_id")
    blocks = F.greatest(F.sum(F.lit(1)) / docs, F.sum("n") / GROUP_SHINGLES)
    subs = keep(sizes.groupBy("cluster", "sub").agg(blocks.alias("blocks")).withColumn("alone", F.col("blocks") > 1))
    pools = subs.filter(~F.col("alone")).groupBy("cluster").agg(F.ceil(F.sum("blocks")).alias("pool"))
    placed = members.join(subs, ["cluster", "sub"]).join(pools, "cluster", "left")
    slot = F.when(F.col("alone"), F.xxhash64("sub", F.pmod(F.xxhash64("doc_id"), F.ceil("blocks")))).otherwise(F.pmod(F.xxhash64("sub"), "pool"))
    placed = keep(placed.select("doc_id", "cluster", "sub", slot.alias("slot"), F.when(F.col("alone"), F.col("sub")).alias("only")))
    at = placed.select("cluster", "slot", "only").distinct()
    other = at.select(F.col("cluster").alias("c2"), F.col("slot").alias("s2"), F.col("only").alias("o2"))
    cells = at.join(other, (F.col("cluster") == F.col("c2")) & (F.col("slot") <= F.col("s2")))
    cells = keep(cells.filter(F.coalesce(F.col("only") != F.col("o2"), F.lit(True)))
                 .select("cluster", "slot", "s2", F.xxhash64("cluster", "slot", "s2").alias("cell")))
    sides = cells.select("cluster", "slot", "cell", F.lit(0).alias("side")).union(
        cells.filter("slot <> s2").select("cluster", "s2", "cell", F.lit(1)))
    rows = placed.join(sides, ["cluster", "slot"]).join(own, F.col("doc_id") == F.col("d")).select("cell", "side", "sub", "d", "shingles")
    rows = rows.repartition(partitions(plain.sparkSession), "cell").sortWithinPartitions("cell", "side")
    return keep(rows.mapInArrow(lambda batches: _cell_links(batches, percent), "a long, b long"))


def near_duplicates(docs: DataFrame, percent: int = 80, words: int = 5, limit: int = 128, depth: int = 6,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    Two documents are linked if the Jaccard similarity of their shingle sets is at
    least ``percent`` hundredths; a component is what links connect, its id the
    smallest document id in it (null counts as the smallest), which alone is
    ``kept``. ``limit``: documents of a node that is compared exhaustively; ``depth``: levels
    below the top. Texts without words are linked with nothing. Equal sets, so all
    copies and repeated rows, are one component. Of rows that share an id but not
    the text, each is in its own component or in those of both texts if one of
    them is linked. An empty table gives no rows.
    """
    plain = id_text(docs, id_col, text_col).select("doc_id", F.col("text").cast("binary").alias("text"))
    with Scratch(docs.sparkSession) as keep:
        info = keep(describe(plain, words, tree_count(percent / 100, depth)))
        classes = keep(info.filter("n > 0").groupBy("c1", "c2").agg(F.min("doc_id").alias("rep")))
        first = classes.select(F.col("c1").alias("k1"), F.col("c2").alias("k2"), "rep")
        same = (F.col("c1") == F.col("k1")) & (F.col("c2") == F.col("k2")) & (F.col("doc_id") == F.col("rep"))
        reps = keep(info.filter("n > 0").join(first, same).select("doc_id", "n", "sig", "paths"))
        likely = candidate_pairs(reps, percent, keep, limit, depth)
        links = keep(confirmed(likely, plain, words, percent, keep))
        groups = keep(connected_components(likely, keep))
        known = connected_components(links, keep).select(F.col("v").alias("k"), F.col("root").alias("sub"))
        members = groups.join(known, F.col("v") == F.col("k"), "left").select(
            F.col("v").alias("doc_id"), F.col("root").alias("cluster"), F.coalesce("sub", "v").alias("sub"))
        links = links.unionByName(group_links(members, plain, words, percent, keep))
        pairs = candidate_pairs(reps, percent, keep, limit, depth, groups)
        wider = connected_components(pairs, keep).select(F.col("v").alias("sub"), F.col("root").alias("cluster"))
        members = reps.select("doc_id").distinct().join(groups, F.col("doc_id") == F.col("v"), "left")
        members = members.select("doc_id", F.coalesce("root", "doc_id").alias("sub")).join(wider, "sub").select("doc_id", "cluster", "sub")
        links = links.unionByName(group_links(members, plain, words, percent, keep))
        roots = connected_components(keep(links), keep)
        rooted = keep(classes.join(roots, F.col("rep") == F.col("v"), "left")
                      .select(F.col("c1").alias("k1"), F.col("c2").alias("k2"), F.coalesce("root", "rep").alias("component_id")))
        out = info.join(rooted, (F.col("c1") == F.col("k1")) & (F.col("c2") == F.col("k2")), "left")
        out = cut_lineage(out.select("doc_id", "n", F.coalesce("component_id", "doc_id").alias("component_id")))
    return out.select(real_id().alias("doc_id"), F.col("n").alias("n_shingles"), real_id("component_id").alias("component_id"),
                      (F.col("doc_id") == F.col("component_id")).alias("kept"))
