"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

Per word, the leaves of a segment tree hold ``rank << 32 | position`` of each
adjacent pair of symbols (a large value where the pair has no merge), and an
inner node the smaller of its two children. The root is therefore the leftmost
pair of lowest rank; a merge changes three leaves, each repaired in
logarithmic time, until the root holds no merge. The trees of many words are
rows of one matrix and take their steps together.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexiforge.llm.common import id_text, real_id
from lexiforge.llm.words import ChunkTable, byte_letters

NONE = np.int64(2 ** 62)
LOW = np.int64(2 ** 32 - 1)


class PairRanks:
    """Vocabulary and merges of a word-end BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        vocab, end = data["model"]["vocab"], data["model"]["end_of_word_suffix"] or ""
        self.tokens = {i: t for t, i in vocab.items()} | {x["id"]: x["content"] for x in data["added_tokens"]}
        self.inner = np.array([vocab[c] for c in byte_letters()], np.int64)
        self.last = np.array([vocab[c + end] for c in byte_letters()], np.int64)
        self.width = np.int64(max(self.tokens) + 1)
        left, right, made = (np.array(x, np.int64) for x in zip(*[
            (vocab[a], vocab[b], vocab[a.removesuffix(end) + b if end and a.endswith(end) else a + b])
            for a, b in data["model"]["merges"]]))
        pairs = left * self.width + right
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.rank, self.made = pairs[order], order.astype(np.int64), made

    def keys(self, left: np.ndarray, right: np.ndarray, position: np.ndarray) -> np.ndarray:
        pair = left * self.width + right
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pair, self.rank[at] << 32 | position, NONE)


def _merge_all(model: PairRanks, sym: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``sym``: a word's symbols in each row, ``n`` of them; merges in place, returns what is alive."""
    rows, size = sym.shape
    at = np.arange(size, dtype=np.int64)
    alive = at[None, :] < n[:, None]
    nxt = np.tile(at + 1, (rows, 1))
    prv = np.tile(at - 1, (rows, 1))
    tree = np.full((rows, 2 * size), NONE)
    has = at[None, :-1] + 1 < n[:, None]
    r, c = np.nonzero(has)
    tree[r, size + c] = model.keys(sym[r, c], sym[r, c + 1], c)
    for level in range(size.bit_length() - 2, -1, -1):
        lo = 1 << level
        tree[:, lo:2 * lo] = np.minimum(tree[:, 2 * lo:4 * lo:2], tree[:, 2 * lo + 1:4 * lo:2])
    flat, act = tree.reshape(-1), np.arange(rows)

    def repair(base: np.ndarray, leaf: np.ndarray) -> None:
        node = (leaf + size) >> 1
        while node.size and node[0]:
            k = base + 2 * node
            flat[base + node] = np.minimum(flat[k], flat[k + 1])
            node = node >> 1

    while act.size:
        root = tree[act, 1]
        act = act[root < NONE]
        root = root[root < NONE]
        if not act.size:
            break
        pos, base = root & LOW, act * (2 * size)
        right = nxt[act, pos]
        after, before = nxt[act, right], prv[act, pos]
        made = model.made[root >> 32]
        sym[act, pos], alive[act, right], nxt[act, pos] = made, False, after
        more, less = after < n[act], before >= 0
        prv[act[more], after[more]] = pos[more]
        key = np.full(len(act), NONE)
        key[more] = model.keys(made[more], sym[act[more], after[more]], pos[more])
        flat[base + size + pos] = key
        flat[base + size + right] = NONE
        flat[base[less] + size + before[less]] = model.keys(sym[act[less], before[less]], made[less], before[less])
        repair(base, pos)
        repair(base, right)
        repair(base[less], before[less])
    return alive


def merge_words(model: PairRanks, words: list[bytes], cells: int = 400_000) -> list[bytes]:
    """Little-endian uint32 ids of each word."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    out: list[bytes] = [b""] * len(words)
    letters = np.frombuffer(b"".join(words), np.uint8)
    starts = np.cumsum(n) - n
    size_of = np.maximum(2, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    order = np.argsort(size_of, kind="stable")
    order = order[n[order] > 0]
    lo = 0
    while lo < len(order):
        size = int(size_of[order[lo]])
        hi = min(int(np.searchsorted(size_of[order], size, "right")), lo + max(1, cells // size))
        take = order[lo:hi]
        lo = hi
        at = np.minimum(starts[take][:, None] + np.arange(size), len(letters) - 1)
        sym = model.inner[letters[at]]
        rows = np.arange(len(take))
        sym[rows, n[take] - 1] = model.last[letters[starts[take] + n[take] - 1]]
        alive = _merge_all(model, sym, n[take])
        data = sym[alive].astype("<u4").tobytes()
        ends = np.cumsum(alive.sum(1)) * 4
        a = 0
        for k, b in zip(take.tolist(), ends.tolist()):
            out[k] = data[a:b]
            a = b
    return out


@functools.cache
def model_of(path: str) -> PairRanks:
    return PairRanks(path)


@functools.cache
def chunks_of(path: str) -> ChunkTable:
    """Kept by the worker from task to task; a table of fixed size."""
    return ChunkTable(path, lambda words: merge_words(model_of(path), words))


def decode_ids(path: str, ids: np.ndarray) -> str:
    """The vocabulary has no decoder: its tokens joined by blanks; ids it does not know are left out."""
    return " ".join([t for t in map(model_of(path).tokens.get, ids.tolist()) if t is not None])


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
               decode: bool = False) -> DataFrame:
    """``doc_id``, ``ids`` (array<int>) and, with ``decode``, ``decoded``: the text that the ids stand for.

    A null or empty text, or one of blanks only, has no ids and decodes to the
    empty text. Strings of special tokens in a text are those tokens. Rows are
    independent: repeated rows repeat their result, an empty table gives none.
    """

    def run(batches):
        table = chunks_of(path)
        for b in batches:
            ids = list(table.ids(b.column("text").to_pylist()))
            sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            lo = 0
            while lo < len(ids):  # at most about 8 MB of ids in a batch, one row at least
                hi = max(lo + 1, int(np.searchsorted(np.cumsum(sizes[lo:]), 2_000_000, "right")) + lo)
                flat = np.frombuffer(b"".join(ids[lo:hi]), "<u4").astype(np.int32)
                ends = np.concatenate([[0], np.cumsum(sizes[lo:hi])]).astype(np.int32)
                cols = [b.column("doc_id").slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
                if decode:
                    cols.append(pa.array([decode_ids(path, np.frombuffer(x, "<u4")) for x in ids[lo:hi]], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "ids", "decoded"][:len(cols)])
                lo = hi

    out = id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>" + ", decoded string" * decode)
    return out.withColumn("doc_id", real_id())


def bpe_decode(encoded: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds ``out``: the text of ``ids_col``. Null ids give null; unknown or null ids inside are left out."""
    names = [f"c{k}" for k in range(len(encoded.columns))]
    at = encoded.columns.index(ids_col)

    def run(batches):
        for b in batches:
            text = [None if x is None else decode_ids(path, np.array([i for i in x if i is not None], np.int64))
                    for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, pa.string())], [*names, "decoded"])

    plain = encoded.toDF(*names)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields)
    return plain.mapInArrow(run, schema + ", decoded string").toDF(*encoded.columns, out)
