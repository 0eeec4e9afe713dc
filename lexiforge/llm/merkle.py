"""Document fingerprints: a Merkle tree over sections, paragraphs and stretches of text.

A paragraph is a line; its leaves are stretches of up to fourteen words or marks,
in a text's first line of 2, 3, 4, 6 and 8 at first, so that short texts have several.
A leaf's hash is that of its bytes, every other node's that of its children's
hashes: paragraphs hash their leaves, sections their paragraphs, the root the
sections (128 bits each). Sections are cut after a paragraph whose hash says so
(about every eighth), so that an insertion moves no later border. Equal roots
mean equal texts; unequal ones are compared from the top, only nodes without an
equal partner are opened, and the leaves left over locate the edits.

Written out, a fingerprint is the root and, for each section, ``;``, its hash
and its paragraphs: ``,``, a hash and the leaves' hashes. Below the root hashes
are shortened (sections to 48 bits, paragraphs and leaves to 24), for the parsed
tree as for the built one, so both compare alike: by chance a few leaves of two
texts of 10,000 leaves seem equal, never the texts.
"""

from __future__ import annotations

import hashlib
import math
import re
from base64 import b64decode, b64encode
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.common import NULL_ID, id_text, partitions, real_id

LEAF = re.compile(rb"(?:[^ ,.;:!?]*[ ,.;:!?]){1,14}|[^ ,.;:!?]+")
FIRST = [re.compile(LEAF.pattern.replace(b"14", b"%d" % n)) for n in (2, 3, 4, 6, 8)]
SECTION = 8  # a paragraph in so many ends a section
SHORT, LONG = 3, 6  # bytes written of a leaf's or paragraph's hash, of a section's


class Node(NamedTuple):
    code: bytes           # the written part of its hash
    n: int                # leaves below
    children: list        # nodes, or the codes of leaves


class Tree(NamedTuple):
    root: str
    sections: list[Node]

    @property
    def n(self) -> int:
        return sum(s.n for s in self.sections)

    def __str__(self) -> str:
        out = [self.root]
        for s in self.sections:
            out += [";", b64encode(s.code).decode(), *["," + b64encode(p.code + b"".join(p.children)).decode() for p in s.children]]
        return "".join(out)

    @staticmethod
    def parse(text: str) -> Tree:
        root, *sections = text.split(";")
        found = []
        for s in sections:
            code, *rest = s.split(",")
            paragraphs = []
            for p in map(b64decode, rest):
                codes = [p[k:k + SHORT] for k in range(0, len(p), SHORT)]
                paragraphs.append(Node(codes[0], len(codes) - 1, codes[1:]))
            found.append(Node(b64decode(code), sum(p.n for p in paragraphs), paragraphs))
        return Tree(root, found)


def _hash(kind: bytes, data: bytes) -> bytes:
    return hashlib.blake2b(kind + data, digest_size=16).digest()


def _leaves(line: bytes, first: bool) -> list[bytes]:
    found, at = [], 0
    for pattern in FIRST if first else ():
        if at < len(line):
            found.append(pattern.match(line, at)[0])
            at += len(found[-1])
    return found + LEAF.findall(line, at)


def merkle_tree(text: str) -> Tree:
    """The tree of a text: every hash above the leaves is that of the hashes below it."""
    data = text.encode("utf-8", "surrogatepass")
    sections, tops, paragraphs, below = [], [], [], []

    def close() -> None:
        node = _hash(b"s", b"".join(below))
        sections.append(Node(node[:LONG], sum(p.n for p in paragraphs), paragraphs[:]))
        tops.append(node)
        paragraphs.clear()
        below.clear()

    for k, line in enumerate(data.split(b"\n") if data else []):
        leaves = [_hash(b"l", leaf) for leaf in _leaves(line, k == 0)]
        node = _hash(b"p", b"".join(leaves))
        paragraphs.append(Node(node[:SHORT], len(leaves), [h[:SHORT] for h in leaves]))
        below.append(node)
        if node[0] % SECTION == 0:
            close()
    if paragraphs:
        close()
    return Tree(_hash(b"r", b"".join(tops)).hex(), sections)


class Comparison(NamedTuple):
    left: list[tuple[int, int]]    # (line, leaf) of the first text's leaves that the second has not, from 0
    right: list[tuple[int, int]]   # the same for the second text
    opened: int                    # nodes of both trees whose children were looked at


def _unmatched(a: list[tuple], b: list[tuple], code) -> tuple[list[tuple], list[tuple]]:
    """Entries of each side without a partner of the same code on the other; of more equal ones the last stay."""
    both = Counter(code(x) for x in a) & Counter(code(x) for x in b)
    rest = []
    for side in (a, b):
        left, out = both.copy(), []
        for x in side:
            if left[code(x)]:
                left[code(x)] -= 1
            else:
                out.append(x)
        rest.append(out)
    return rest[0], rest[1]


def compare(a: Tree, b: Tree) -> Comparison:
    """Where two texts differ: from the roots down, opening only nodes that the other tree has not."""
    if a.root == b.root:
        return Comparison([], [], 0)
    sides, opened = [], 2
    for t in (a, b):
        line, entries = 0, []
        for s in t.sections:
            entries.append((line, s))
            line += len(s.children)
        sides.append(entries)
    sections = _unmatched(*sides, code=lambda x: x[1].code)
    paragraphs = _unmatched(*[[(line + k, p) for line, s in side for k, p in enumerate(s.children)] for side in sections],
                            code=lambda x: (x[1].code, x[1].n))
    leaves = _unmatched(*[[(line, k, c) for line, p in side for k, c in enumerate(p.children)] for side in paragraphs],
                        code=lambda x: x[2])
    opened += sum(map(len, sections)) + sum(map(len, paragraphs))
    return Comparison([x[:2] for x in leaves[0]], [x[:2] for x in leaves[1]], opened)


def likeness(a: Tree, b: Tree) -> float:
    """Share of the leaves of both texts that the other has too: 1 for equal texts, 0 without a common leaf."""
    if a.root == b.root:
        return 1.0
    total = a.n + b.n
    if not total:
        return 0.0
    found = compare(a, b)
    return 1.0 - (len(found.left) + len(found.right)) / total


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint``. A null text is empty; rows are independent, null ids stay, no rows give none."""

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(
                    [str(merkle_tree(t)) for t in part.column("text").to_pylist()], pa.string())], ["doc_id", "fingerprint"])

    return (id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fingerprint string")
            .withColumn("doc_id", real_id()))


def edited(text: str, follower: str) -> str:
    """``text`` with its last third (code points, rounded down) replaced by as much of ``follower``'s beginning."""
    n = len(text) // 3
    return text[:len(text) - n] + follower[:n]


def compare_with_edit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      rows_a_range: int = 2000) -> DataFrame:
    """Fingerprints of each text and of its edit by the next one's beginning, and how alike they are.

    ``doc_id, n_chars, edited`` (text)``, fingerprint, edited_fingerprint, near_edited,
    near_next``. The next document is that of the next smaller id (null: the
    smallest; equal ids by text, then anyhow); after the last comes the first,
    so a single document follows itself. No rows give none.

    Ids are cut into ranges of about ``rows_a_range`` rows; each range also gets
    the first row of the next one, so every text moves once and no task needs
    more than its ranges, row by row.
    """
    spark = docs.sparkSession
    d = id_text(docs, id_col, text_col)
    n = max(1, min(d.count() // rows_a_range, partitions(spark)))
    d = d.withColumn("as_double", F.col("doc_id").cast("double"))
    cuts = sorted(set(d.approxQuantile("as_double", [k / n for k in range(1, n)], 1 / (8 * n)))) if n > 1 else []
    if cuts:  # ranges by descending id: the smallest number holds the greatest ids
        ranges = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="as_double", outputCol="range")
        d = ranges.transform(d).withColumn("part", -F.col("range").cast("int"))
    else:
        d = d.withColumn("part", F.lit(0))
    d = d.select("doc_id", "text", "part")
    # a range's first row is of its greatest id, among equal ones of the smallest text (by its hash, then itself)
    rank = F.struct((-F.greatest(F.col("doc_id"), F.lit(NULL_ID + 1))).alias("a"), (F.col("doc_id") == NULL_ID).alias("b"),
                    F.xxhash64("text").alias("h"))
    d = d.withColumn("rank", rank)
    firsts = {r["part"]: (r["m"]["a"], r["m"]["b"], r["m"]["h"])
              for r in d.groupBy("part").agg(F.min("rank").alias("m")).collect()}  # a row per range
    there = sorted(firsts)
    before = {p: there[k - 1] for k, p in enumerate(there)}  # the range that ends with p's first row
    heads = spark.createDataFrame([(p, *firsts[p], before[p]) for p in there] or [(1, 0, False, 0, 1)],
                                  "part int, a long, b boolean, h long, goes int")
    d = d.join(F.broadcast(heads), "part").withColumn(  # a row per range
        "head", (F.col("rank") == F.struct("a", "b", "h")))
    d = d.withColumn("to", F.explode(F.when(F.col("head"), F.array(
        F.struct(F.col("part").alias("part"), F.lit(False).alias("tail")),
        F.struct(F.col("goes").alias("part"), F.lit(True).alias("tail"))))
        .otherwise(F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("tail"))))))
    moved = (d.select(F.col("to.part").alias("part"), F.col("to.tail").alias("tail"), "rank", "doc_id", "text")
             .repartition(n, "part").sortWithinPartitions("part", "tail", "rank", "text"))
    out = ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], out)

    def run(batches):
        last = None  # part, id, text and tree of the row that waits for its follower
        rows, size = [], 0
        for b in batches:
            for part, tail, i, text in zip(*[b.column(c).to_pylist() for c in ("part", "tail", "doc_id", "text")]):
                if last and last[0] != part:
                    last = None
                if tail and last is None:
                    continue  # a further copy of the tail
                tree = merkle_tree(text)
                if last:
                    _, j, own, fp = last
                    changed = edited(own, text)
                    other = merkle_tree(changed)
                    rows.append((j, len(own), changed, str(fp), str(other), likeness(fp, other), likeness(fp, tree)))
                    size += len(own)
                last = None if tail else (part, i, text, tree)
                if size > 2_000_000:
                    yield batch_of(rows)
                    rows, size = [], 0
        if rows:
            yield batch_of(rows)

    res = moved.select("part", "tail", "doc_id", "text").mapInArrow(
        run, "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, "
             "near_edited double, near_next double")
    return res.withColumn("doc_id", real_id())
