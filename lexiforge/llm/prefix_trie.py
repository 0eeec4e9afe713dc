"""Prefix trie of conversations by fixed-length block hashing.

A conversation is cut into blocks of ``block`` turns. The digest of its prefix up
to a block's end is the exclusive-or of the block digests so far, each salted with its
number, so prefixes of any length come from sums by stretches and no level waits
for the one above. First the conversations are grouped by successive block
digests: a *variant* is one content of one block behind one prefix, with the number of
its conversations. A block behind whose prefix all go on alike is a chain of
nodes with one and the same membership; only where siblings diverge are the variants
(no longer the conversations) split at every turn and grouped again.

Sums over subtrees need no recursion. A node belongs to its smallest member, so
what a conversation owns is the end of its path, and a node's subtree is what
its members own, less what its owner owns above it. Every step is a grouping with
partial sums or a join on keys that are unique on one side; keys that could be hot on
the other (a long conversation, a node with very many children) are split into
stretches or looked up in a broadcast of at most ``HOT`` rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.llm.common import NULL_ID, Scratch, cut_lineage, partitions, real_id
from lexiforge.operators.ordering import ordered_index

#: Turns or blocks of one conversation that are handled together.
STRETCH = 65_536
#: A key is hot if it has more than this share (one in so many) of all rows, so there are at most so many.
HOT = 10_000
#: Identifiers of one row of text on the way to a node's hash.
PIECE = 500


def placed_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """``conv, at`` (from 0)``, a, b`` (digest of role and text)``, size`` (bytes of the text): by turn, nulls first, then by digest."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = turns.select(F.coalesce(F.col(f"`{conv_col}`").cast("long"), F.lit(NULL_ID)).alias("conv"),
                        F.col(f"`{turn_col}`").alias("turn"), F.xxhash64(role, text).alias("a"),
                        F.xxhash64(F.lit(1), text, role).alias("b"), F.octet_length(text).cast("long").alias("size"))
    return ordered_index(rows, ["conv"], ["turn", "a", "b"], out="at").select("conv", "at", "a", "b", "size")


def with_shared_heads(placed: DataFrame, every: int, heads: int) -> tuple[DataFrame, DataFrame]:
    """Sequences in which conversation c starts with the first h turns of c - c % ``every``, and goes on with its own after its first h.

    h is the unsigned crc32 of the decimal c modulo ``heads``. Gives ``conv, pos`` (from 1)``, n, a, b, size`` and, for all
    conversations, ``conv, n`` (turns in the end, 0 for none). A null conversation keeps its own turns.
    """
    real = F.col("conv") != NULL_ID
    h = F.when(real, F.crc32(F.col("conv").cast("string").cast("binary")) % heads).otherwise(F.lit(0))
    base = F.when(real, F.col("conv") - F.col("conv") % every).otherwise(F.col("conv"))
    info = placed.groupBy("conv").agg(F.count(F.lit(1)).alias("own")).withColumns({"h": h, "base": base})
    head = (placed.filter((F.col("conv") == base) & (F.col("at") < heads - 1))  # fewer than ``heads`` turns each
            .groupBy(F.col("conv").alias("base_conv")).agg(F.sort_array(F.collect_list(F.struct("at", "a", "b", "size"))).alias("head")))
    info = info.join(head, F.col("base") == F.col("base_conv"), "left").select(
        "conv", "own", "h", F.expr("slice(coalesce(head, array()), 1, cast(h as int))").alias("head"))
    info = info.withColumn("m", F.size("head").cast("long"))
    info = info.withColumn("n", F.col("m") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    first = info.select("conv", "n", F.explode("head").alias("t")).select(
        "conv", (F.col("t.at") + 1).alias("pos"), "n", "t.a", "t.b", "t.size")
    # a long conversation joins by stretches
    wanted = info.select(F.col("conv").alias("c"), "h", "m", "n",
                         F.explode(F.expr(f"sequence(0L, (own - 1) div {STRETCH})")).alias("stretch"))
    rest = placed.join(wanted, (F.col("conv") == F.col("c")) & (F.expr(f"at div {STRETCH}") == F.col("stretch"))).filter("at >= h")
    rest = rest.select("conv", (F.col("m") + F.col("at") - F.col("h") + 1).alias("pos"), "n", "a", "b", "size")
    return first.unionByName(rest), info.select("conv", "n")


def _block_rows(sequences: DataFrame, block: int, keep: Scratch) -> DataFrame:
    """``conv, k, n, hs`` (turns of the block)``, sx, sy`` (its digest)``, px, py, pb`` (digest and bytes of what is before it)."""
    rows = sequences.withColumn("k", F.expr(f"(pos - 1) div {block}"))
    rows = rows.groupBy("conv", "k").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "a", "b", "size"))).alias("hs"))
    rows = rows.withColumn("hs", F.transform("hs", lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b"), t["size"].alias("size"))))
    rows = rows.withColumns({"sx": F.xxhash64(F.lit(0), "k", "hs"), "sy": F.xxhash64(F.lit(1), "k", "hs"),
                             "bytes": F.expr("aggregate(hs, 0L, (s, t) -> s + t.size)"), "stretch": F.expr(f"k div {STRETCH}")})
    before = Window.partitionBy("conv", "stretch").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)

    def so_far(col: str, kind) -> F.Column:
        return F.coalesce(kind(col).over(before), F.lit(0).cast("long"))

    rows = keep(rows.withColumns({"px": so_far("sx", F.bit_xor), "py": so_far("sy", F.bit_xor), "pb": so_far("bytes", F.sum)}))
    if rows.filter("stretch > 0").isEmpty():
        return rows
    parts = rows.groupBy("conv", "stretch").agg(F.bit_xor("sx").alias("sx"), F.bit_xor("sy").alias("sy"), F.sum("bytes").alias("bytes"))
    before = Window.partitionBy("conv").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("conv").alias("c"), F.col("stretch").alias("s"), so_far("sx", F.bit_xor).alias("ox"),
                         so_far("sy", F.bit_xor).alias("oy"), so_far("bytes", F.sum).alias("ob")).filter("s > 0")
    late = rows.join(parts, (F.col("conv") == F.col("c")) & (F.col("stretch") == F.col("s")), "left")
    return keep(late.select(*[c for c in rows.columns if c not in ("px", "py", "pb")], F.expr("px ^ coalesce(ox, 0L)").alias("px"),
                            F.expr("py ^ coalesce(oy, 0L)").alias("py"), F.expr("pb + coalesce(ob, 0L)").alias("pb")))


def _split_hot(rows: DataFrame, of: DataFrame, key: dict[str, str], weight: str, total: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` joined with ``of`` (unique key, ``weight`` rows each): those of hot keys by broadcast, and the rest."""
    least = max(1_000, total // HOT)
    hot = F.broadcast(of.filter(F.col(weight) > least))  # at most HOT rows: their weights add up to the total
    on = [F.col(a) == F.col(b) for a, b in key.items()]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    rest = rows.join(hot, cond, "left_anti").join(of.filter(F.col(weight) <= least), cond)
    return rows.join(hot, cond), rest


#: Digests of a prefix that ends in turn j, or before it, of the block; the blocks before are in px and py.
INNER = ["px ^ xxhash64(0, k, slice(hs, 1, j)) AS x", "py ^ xxhash64(1, k, slice(hs, 1, j)) AS y",
         "CASE WHEN j = 1 THEN px ELSE px ^ xxhash64(0, k, slice(hs, 1, j - 1)) END AS ux",
         "CASE WHEN j = 1 THEN py ELSE py ^ xxhash64(1, k, slice(hs, 1, j - 1)) END AS uy"]


def _nodes(variants: DataFrame, sums: list[str], block: int, keep: Scratch) -> DataFrame:
    """``depth, x, y, ux, uy`` (parent)``, bytes, before, rep, rep_up, ends`` and ``sums`` of every node below the root.

    ``rep_up`` is the parent's smallest member where the block does not diverge, else null.
    """
    total = variants.count()
    parents = variants.groupBy(F.col("k").alias("gk"), F.col("px").alias("gx"), F.col("py").alias("gy")).agg(F.count(F.lit(1)).alias("ways"))
    hot, rest = _split_hot(variants, keep(parents), {"k": "gk", "px": "gx", "py": "gy"}, "ways", total)

    def turns(rows: DataFrame, *more: str) -> DataFrame:
        return rows.selectExpr("*", "explode(sequence(1, size(hs))) AS j").selectExpr(
            f"k * {block} + j AS depth", *INNER, "element_at(hs, j).size AS bytes", "pb + aggregate(slice(hs, 1, j - 1), 0L, (s, t) -> s + t.size) AS before",
            "rep", "CASE WHEN j = size(hs) THEN ends ELSE 0L END AS ends", *sums, *more)

    alike = turns(rest.filter("ways = 1"), "CASE WHEN j > 1 THEN rep END AS rep_up")
    diverge = turns(hot.unionByName(rest.filter("ways > 1")))
    split = diverge.groupBy("depth", "x", "y").agg(
        *[F.first(c).alias(c) for c in ("ux", "uy", "bytes", "before")], F.min("rep").alias("rep"), F.sum("ends").alias("ends"),
        *[F.sum(c).alias(c) for c in sums]).withColumn("rep_up", F.lit(None).cast("long"))
    return keep(alike.unionByName(split))


def _ends_sha256(ends: DataFrame, n_parts: int) -> DataFrame:
    """``ed, ex, ey, ends_sha256`` of ``depth, x, y, conv``: sorted by ranges into pieces of text, then one hash a node, piece by piece."""
    def pieces(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(zip(*(b.column(c).to_pylist() for c in ("depth", "x", "y", "conv"))))
            out, lo = [], 0
            for hi in range(1, len(rows) + 1):
                if hi == len(rows) or rows[hi][:3] != rows[lo][:3] or hi - lo >= PIECE:
                    out.append((*rows[lo], ",".join("" if r[3] == NULL_ID else str(r[3]) for r in rows[lo:hi])))
                    lo = hi
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 4 + [pa.string()])],
                                                 ["depth", "x", "y", "conv", "ids"])

    def hashes(batches) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for b in batches:
            done = []
            for *at, ids in zip(*(b.column(c).to_pylist() for c in ("depth", "x", "y", "ids"))):
                if at != node:
                    if node is not None:
                        done.append((*node, state.hexdigest()))
                    node, state = at, sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                yield out(done)
        if node is not None:
            yield out([(*node, state.hexdigest())])

    def out(rows) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 3 + [pa.string()])], ["ed", "ex", "ey", "ends_sha256"])

    order = ["depth", "x", "y", "conv"]
    text = ends.select(*order).repartitionByRange(n_parts, *order).sortWithinPartitions(*order).mapInArrow(
        pieces, "depth long, x long, y long, conv long, ids string")
    text = text.repartition(n_parts, "depth", "x", "y").sortWithinPartitions(*order)
    return text.mapInArrow(hashes, "ed long, ex long, ey long, ends_sha256 string")


def prefix_trie(sequences: DataFrame, convs: DataFrame, block: int = 4) -> DataFrame:
    """A row per distinct prefix: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``sequences``: ``conv, pos`` (from 1, without gaps)``, n`` (turns in all)``, a, b, size``; ``convs``: ``conv, n`` of all
    conversations, also those without turns. ``saved_tokens`` sums (members - 1) * bytes of the last text over the
    subtree. ``ends_sha256`` hashes the identifiers of the members that end there, ascending, joined by commas; a null
    identifier sorts first and is empty there. No conversations give no rows. Sums exceeding a long raise an error.
    """
    n_parts = partitions(sequences.sparkSession)
    with Scratch(sequences.sparkSession) as keep:
        blocks = _block_rows(sequences, block, keep)
        content = ["k", "px", "py", "sx", "sy"]
        last = F.when(F.col("n") == F.col("k") * block + F.size("hs"), F.lit(1)).otherwise(F.lit(0)).cast("long")
        variants = keep(blocks.groupBy(*content).agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("rep"), F.sum(last).alias("ends"),
                                                     F.first("hs").alias("hs"), F.first("pb").alias("pb")))
        nodes = _nodes(variants, ["n_convs"], block, keep)
        root = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("rep"),
                         F.sum(F.when(F.col("n") == 0, 1).otherwise(0)).cast("long").alias("ends")).filter("n_convs > 0")
        zero = [F.lit(0).cast("long").alias(c) for c in ("depth", "x", "y", "bytes", "before")]
        none = [F.lit(None).cast("long").alias(c) for c in ("ux", "uy", "rep_up")]
        nodes = nodes.unionByName(root.select("*", *zero, *none))
        kids = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("kd"), F.col("ux").alias("kx"), F.col("uy").alias("ky")).agg(
            F.count(F.lit(1)).alias("n_children"))
        same = (F.col("depth") == F.col("kd")) & (F.col("x") == F.col("kx")) & (F.col("y") == F.col("ky"))
        nodes = keep(nodes.join(kids, same, "left").drop("kd", "kx", "ky").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))

        # what a conversation owns: the nodes of which it is the smallest member
        own = keep(nodes.groupBy(F.col("rep").alias("owner")).agg(
            F.sum("bytes").alias("owned"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaf"), F.min("before").alias("above"),
            F.max("depth").alias("deepest")))
        ends = blocks.filter(last == 1).select("conv", F.col("n").alias("depth"), F.expr("px ^ sx").alias("x"), F.expr("py ^ sy").alias("y"),
                                               (F.col("pb") + F.col("bytes")).alias("total"))
        ends = keep(ends.unionByName(convs.filter("n = 0").select("conv", *[F.lit(0).cast("long").alias(c) for c in ("depth", "x", "y", "total")])))
        per_conv = keep(ends.join(own, F.col("conv") == F.col("owner"), "left").select(
            F.col("conv").alias("c"), F.col("depth").alias("length"), "total", F.coalesce("owned", F.lit(0).cast("long")).alias("owned"),
            F.coalesce("leaf", F.lit(0).cast("long")).alias("leaf")))
        sums = ["total", "owned", "leaf"]
        spread = per_conv.withColumn("s", F.explode(F.expr(f"sequence(0L, greatest(length - 1, 0L) div {block} div {STRETCH})")))
        weighed = blocks.select(*content, "hs", "pb", "conv", "stretch").join(
            spread, (F.col("conv") == F.col("c")) & (F.col("stretch") == F.col("s"))).groupBy(*content).agg(
            F.first("hs").alias("hs"), F.first("pb").alias("pb"), F.min("conv").alias("rep"), F.lit(0).cast("long").alias("ends"),
            *[F.sum(c).alias(c) for c in sums])
        below = _nodes(keep(weighed), sums, block, keep).select(F.col("depth").alias("wd"), F.col("x").alias("wx"), F.col("y").alias("wy"), *sums)
        below = below.unionByName(per_conv.agg(*[F.sum(c).alias(c) for c in sums]).filter("total IS NOT NULL").select(
            *[F.lit(0).cast("long").alias(c) for c in ("wd", "wx", "wy")], *sums))
        full = nodes.join(below, (F.col("depth") == F.col("wd")) & (F.col("x") == F.col("wx")) & (F.col("y") == F.col("wy")))
        # only nodes with several members save anything; a lone member's chain has one leaf
        many = full.filter("n_convs > 1").withColumn("stretch", F.expr(f"depth div {STRETCH}"))
        owners = own.select("owner", "above", F.explode(F.expr(f"sequence(0L, deepest div {STRETCH})")).alias("s"))
        many = many.join(owners, (F.col("rep") == F.col("owner")) & (F.col("stretch") == F.col("s")))
        saved = F.col("total") - F.col("n_convs") * F.col("before") - F.col("owned") + F.col("before") - F.col("above")
        cols = ["depth", "x", "y", "ux", "uy", "rep", "rep_up", "n_convs", "n_children"]
        done = many.select(*cols, F.col("leaf").alias("n_leaves"), saved.alias("saved_tokens")).unionByName(
            full.filter("n_convs = 1").select(*cols, F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens")))
        hashes = _ends_sha256(ends, n_parts)
        at_end = (F.col("depth") == F.col("ed")) & (F.col("x") == F.col("ex")) & (F.col("y") == F.col("ey"))
        done = keep(done.join(hashes, at_end, "left").drop("ed", "ex", "ey"))

        ups = keep(done.filter("n_children > 0").select(F.col("depth").alias("td"), F.col("x").alias("tx"), F.col("y").alias("ty"),
                                                        F.col("rep").alias("above_rep"), F.col("n_children").alias("ways")))
        asks = done.filter("depth > 0 AND rep_up IS NULL").withColumn("up", F.col("depth") - 1)
        hot, rest = _split_hot(asks, ups, {"up": "td", "ux": "tx", "uy": "ty"}, "ways", done.count())
        out = done.filter("depth = 0 OR rep_up IS NOT NULL").withColumn("parent", F.col("rep_up"))
        for found in (hot, rest):
            out = out.unionByName(found.withColumn("parent", F.col("above_rep")).select(*out.columns))
        out = cut_lineage(out.select("rep", "depth", "parent", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"))
    return out.select(real_id("rep").alias("conv_id"), "depth", real_id("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
                      "saved_tokens", F.coalesce("ends_sha256", F.lit(sha256(b"").hexdigest())).alias("ends_sha256"))


def conversation_trie(turns: DataFrame, every: int = 5, heads: int = 9, block: int = 4) -> DataFrame:
    """The trie of conversations that share their heads: ``prefix_trie`` over ``with_shared_heads``.

    ``turns``: ``conv_id, turn, role, text``; further columns are ignored. A null role or text is empty, a null turn comes
    first, rows of one turn are ordered by a digest of their content, a null conv_id is a conversation of its own.
    """
    sequences, convs = with_shared_heads(placed_turns(turns), every, heads)
    with Scratch(turns.sparkSession) as keep:
        return prefix_trie(keep(sequences), keep(convs), block)
