"""Line deduplication with two Bloom filters.

Every task keeps two filters of fixed size, one of the line hashes that it has
seen in a document and one of those that it has seen in a second one, and hands
on their set bits by segment. Merged, a bit is in the second filter if one task
has it there or two tasks have it in the first. So a line of two documents is
always found in the second filter; only such suspected repeats are shuffled,
as 128-bit hashes, for exact counts and the choice of the document that keeps
the line. With more lines than the filters have room for, more lines are
suspected; the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.common import NULL_ID, Carried, cut_lineage, partitions, sized_slices

BLANKS = b" \t\n\x0b\x0c\r"
HASHES = 3
SEGMENT = 1 << 16  # bits


def line_key(line: bytes, least: int) -> bytes | None:
    """The line without blanks at its ends, A-Z lower-cased; None if it has under ``least`` code points."""
    key = line.strip(BLANKS).lower()
    n = len(key)
    if n < least or n < 4 * least and not key.isascii() and len(key.decode("utf-8", "replace")) < least:
        return None
    return key


def _digest(key: bytes) -> bytes:
    return blake2b(key, digest_size=16).digest()


def _document_keys(text: bytes, least: int) -> set[bytes]:
    keys = {line_key(x, least) for x in text.split(b"\n")} - {None}
    return {_digest(k) for k in keys}


def _bits(words: np.ndarray, bits: int) -> np.ndarray:
    """Bit numbers of each hash (a row of two words), a column for each hash function."""
    step = words[:, 1] | np.uint64(1)
    at = words[:, :1] + step[:, None] * np.arange(HASHES, dtype=np.uint64)
    return (at % np.uint64(bits)).astype(np.int64)


def _packed(piece: bytes) -> np.ndarray:
    """A segment as packed bits, from packed bits or from the numbers of its set bits."""
    if len(piece) == SEGMENT // 8:
        return np.frombuffer(piece, np.uint8)
    full = np.zeros(SEGMENT, np.uint8)
    full[np.frombuffer(piece, "<u2")] = 1
    return np.packbits(full)


def _piece(packed: np.ndarray) -> bytes:
    """A segment of packed bits, or the numbers of its set bits if those are shorter."""
    on = np.flatnonzero(np.unpackbits(packed))
    return on.astype("<u2").tobytes() if 2 * len(on) < SEGMENT // 8 else packed.tobytes()


def _places(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The byte of each bit number in packed bits, and the bit's mask there."""
    return at >> 3, np.uint8(128) >> (at & 7).astype(np.uint8)


def filter_pieces(batches, least: int, bits: int) -> Iterator[pa.RecordBatch]:
    """``segment, once, twice`` of a task's texts: both filters as packed bits, since a worker has them next to all else it holds."""
    once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
    for b in batches:
        for part in sized_slices(b, "text", 2_000_000):
            seen = [d for t in part.column("text").to_pylist() for d in _document_keys(t, least)]
            if not seen:
                continue
            words, n = np.unique(np.frombuffer(b"".join(seen), "<u8").reshape(-1, 2), axis=0, return_counts=True)
            byte, mask = _places(_bits(words, bits))
            again = (n > 1) | (once[byte] & mask).all(1)
            np.bitwise_or.at(twice, byte[again], mask[again])
            np.bitwise_or.at(once, byte, mask)
    pieces = list(zip(once.reshape(-1, SEGMENT // 8), twice.reshape(-1, SEGMENT // 8)))
    for lo in range(0, len(pieces), 128):
        rows = [(lo + k, _piece(a), _piece(b)) for k, (a, b) in enumerate(pieces[lo:lo + 128]) if a.any()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], ["segment", "once", "twice"])


def twice_seen(docs: DataFrame, least: int, bits: int) -> np.ndarray:
    """The second filter over all documents (a column ``text``), ``bits`` bits packed."""

    def merge(batches):
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for k, o, t in zip(*[c.to_pylist() for c in b.columns]):
                once, twice = found.get(k, (np.zeros(SEGMENT // 8, np.uint8),) * 2)
                o = _packed(o)
                found[k] = (once | o, twice | _packed(t) | (once & o))
        if found:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.int32()), pa.array([t.tobytes() for _, t in found.values()], pa.binary())],
                ["segment", "twice"])

    n = min(partitions(docs.sparkSession), max(1, bits // SEGMENT))
    merged = (docs.select(F.col("text").cast("binary").alias("text"))
              .mapInArrow(lambda batches: filter_pieces(batches, least, bits), "segment int, once binary, twice binary")
              .repartition(n, "segment").mapInArrow(merge, "segment int, twice binary"))
    out = np.zeros(bits // 8, np.uint8)
    for r in merged.collect():  # bits / 8 bytes in all, whatever the corpus holds
        out[r["segment"] * SEGMENT // 8:(r["segment"] + 1) * SEGMENT // 8] = np.frombuffer(r["twice"], np.uint8)
    return out


def dedup_lines(docs: DataFrame, least: int = 20, documents: int = 3, bits: int = 1 << 26, id_col: str = "doc_id",
                text_col: str = "text", names: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text_col``, and two counts: of lines before, of lines dropped.

    A line whose key (blanks at the ends stripped, A-Z lower-cased) has at least
    ``least`` code points and occurs in at least ``documents`` rows goes from all
    but the row of the greatest id that holds it (rows of one id keep it
    together, a null id is the smallest). The other lines stay, joined by a line
    feed. A null or empty text is one empty line, its new text is empty. Input
    columns named like ``names`` are replaced. ``bits`` (a multiple of 65,536)
    sets the size of the filters, not the result.
    """
    if bits % SEGMENT:
        raise ValueError(f"bits must be a multiple of {SEGMENT}")
    c = Carried(docs, id_col, text_col)
    spark = docs.sparkSession
    ids = F.coalesce(F.col(c.id).cast("long"), F.lit(NULL_ID))
    plain = c.df.select(ids.alias("doc_id"), F.coalesce(F.col(c.text), F.lit("")).cast("binary").alias("text"))
    filters = spark.sparkContext.broadcast(twice_seen(plain, least, bits))

    def suspects(batches):
        twice = filters.value
        for b in batches:
            for part in sized_slices(b, "text", 2_000_000):
                doc, seen = [], []
                for i, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    keys = _document_keys(t, least)
                    seen += keys
                    doc += [i] * len(keys)
                if not seen:
                    continue
                words = np.frombuffer(b"".join(seen), "<u8").reshape(-1, 2)
                byte, mask = _places(_bits(words, bits))
                hit = (twice[byte] & mask).all(1)
                words = words[hit].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words[:, 0]), pa.array(words[:, 1]), pa.array(np.array(doc, np.int64)[hit])],
                    ["k1", "k2", "doc_id"])

    suspected = cut_lineage(plain.mapInArrow(suspects, "k1 long, k2 long, doc_id long"))
    repeated = cut_lineage(suspected.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper"))
                           .filter(F.col("n") >= documents).drop("n"))
    gone = (suspected.join(repeated, ["k1", "k2"]).filter(F.col("doc_id") < F.col("keeper"))
            .groupBy("doc_id").agg(F.collect_set(F.struct("k1", "k2")).alias("gone")))
    joined = (c.df.withColumn("key_id", ids).join(gone, F.col("key_id") == gone["doc_id"], "left")
              .select(*c.names, F.transform("gone", lambda g: g["k1"]).alias("g1"),
                      F.transform("gone", lambda g: g["k2"]).alias("g2")))
    names_in, at = c.names, c.names.index(c.text)

    def keep(batches):
        for b in batches:
            texts = b.column(at).cast(pa.binary()).to_pylist()
            kept, n, dropped = [], [], []
            for t, g1, g2 in zip(texts, b.column("g1").to_pylist(), b.column("g2").to_pylist()):
                t = t or b""
                n.append(t.count(b"\n") + 1)
                stay = None
                if g1:
                    gone = {d.tobytes() for d in np.array([g1, g2], np.int64).T.astype("<i8")}
                    lines = t.split(b"\n")
                    keys = [line_key(x, least) for x in lines]
                    stay = [x for x, k in zip(lines, keys) if k is None or _digest(k) not in gone]
                dropped.append(0 if stay is None else n[-1] - len(stay))
                kept.append(t if stay is None else b"\n".join(stay))
            cols = b.columns[:len(names_in)]
            cols[at] = pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(dropped, pa.int64())],
                                             [*names_in, "n_lines", "n_dropped"])

    out = joined.mapInArrow(keep, c.fields() + ", n_lines long, n_dropped long")
    return c.restored(out, {"n_lines": names[0], "n_dropped": names[1]})
