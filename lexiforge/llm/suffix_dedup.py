"""Removal of repeated passages by a depth-limited radix sort of suffixes.

Suffixes are ordered only through ``depth`` bytes, by passes over digits of
those bytes, the most significant first; what is alone after a pass is out,
and equal groups after the last pass are exactly the repeated windows.

* First digit: of the ``depth - WORD + 1`` strings of ``WORD`` bytes in a window the one
  of least hash. Equal windows have an equal first digit at the same place, and
  neighbouring windows share it, so a *run* of windows is one row, and only
  about one position in 35 gets a row.
* Second digit: all bytes that the windows of a run cover. Runs equal in it are
  equal as a whole: the first one stays, all windows of the others are repeats.
* Runs that share the first digit with a run of other bytes are cut into shorter
  ones, whose first digit is what all their windows have in common, and in the
  end into single windows, of which first and second digit are all bytes.

Digits are compared by 64-bit hashes, each pass by two independent ones. A task
groups its own rows before anything is shuffled, so that a passage in a third
of all documents meets another task's as one row of each task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.llm.common import NULL_ID, Carried, Scratch, cut_lineage, sized_slices

WORD = 32


def _odd(seed: int, n: int) -> list[np.uint64]:
    """``n`` odd multipliers by a splitmix sequence."""
    out = []
    for k in range(1, n + 1):
        x = (seed + k * 0x9E3779B97F4A7C15) % 2 ** 64
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2 ** 64
        x = (x ^ x >> 27) * 0x94D049BB133111EB % 2 ** 64
        out.append(np.uint64((x ^ x >> 31) | 1))
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(29)
    x *= _odd(7, 1)[0]
    x ^= x >> np.uint64(32)
    return x


def word_hashes(data: np.ndarray, seeds: tuple[int, ...]) -> list[np.ndarray]:
    """For each seed a hash of every ``WORD`` bytes of ``data``."""
    n = len(data)
    if n < WORD:
        return [np.zeros(0, np.uint64) for _ in seeds]
    two = data[:-1].astype(np.uint16) | data[1:].astype(np.uint16) << np.uint16(8)
    four = two[:-2].astype(np.uint32) | two[2:].astype(np.uint32) << np.uint32(16)
    eight = four[:-4].astype(np.uint64) | four[4:].astype(np.uint64) << np.uint64(32)
    out = []
    for seed in seeds:
        a, b, c, d = _odd(seed, 4)
        h = _mix(eight * a)
        h = _mix(h[:-8] * b + h[8:])
        out.append(_mix(h[:-16] * c + h[16:] * d))
    return out


def joined_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray, longest: int, seed: int) -> np.ndarray:
    """Hash of the bytes ``start`` to ``end``: of the words that tile them, the last one flush with the end."""
    mult = _odd(seed, -(-longest // WORD) + 1)
    out = (end - start).astype(np.uint64) * mult[-1]
    for j, m in enumerate(mult[:-1]):
        out = _mix(out + h[np.minimum(start + j * WORD, end - WORD)] * m)
    return out


def runs_of(data: np.ndarray, ends: np.ndarray, depth: int) -> dict[str, np.ndarray]:
    """Runs of windows in texts that lie one after the other in ``data`` and end at ``ends``.

    ``start`` and ``last``: first and last window of a run, in ``data``; ``lead``: from
    its start to the word of least hash; ``text``: its text's number; ``digit1``,
    ``digit2``: hashes as signed 64-bit numbers.
    """
    n, wide = len(data), depth - WORD + 1
    none = {k: np.zeros(0, np.int64) for k in ("start", "last", "lead", "text", "digit1", "digit2")}
    if n < depth:
        return none
    h1, h2 = word_hashes(data, (1, 2))
    # least hash in each window, leftmost first: the position fills the low bits
    bits = np.uint64(max(1, int(n).bit_length()))
    key = (h1 >> bits << bits) | np.arange(len(h1), dtype=np.uint64)
    span = 1
    while 2 * span <= wide:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if wide > span:
        key = np.minimum(key[:span - wide], key[wide - span:])
    anchor = (key & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    at = np.arange(n - depth + 1)
    text = np.searchsorted(ends, at, "right")
    inside = at + depth <= ends[text]
    change = np.ones(len(at), bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | ~inside[:-1]
    first = np.flatnonzero(change & inside)
    if not len(first):
        return none
    stop = np.flatnonzero(np.append(change[1:] | ~inside[1:], True) & inside)
    return {"start": first, "last": stop, "lead": anchor[first] - first, "text": text[first], "digit1": h1[anchor[first]].view(np.int64),
            "digit2": joined_hash(h2, first, stop + depth, depth + wide, 3).view(np.int64)}


def cut_runs(data: np.ndarray, start: np.ndarray, last: np.ndarray, lead: np.ndarray, depth: int,
             width: int) -> dict[str, np.ndarray]:
    """Runs cut into shorter ones of at most ``width`` windows, at fixed distances from the word of least hash.

    ``of``: the number of the run; the others as ``runs_of`` has them.
    """
    h1, h2 = word_hashes(data, (1, 2))
    anchor = start + lead
    low, high = (anchor - last) // width, lead // width
    of = np.repeat(np.arange(len(start)), high - low + 1)
    block = np.arange(len(of)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1) + low[of]
    near = anchor[of] - block * width  # the window nearest to the word, if the run has it
    first, stop = np.maximum(start[of], near - width + 1), np.minimum(last[of], near)
    return {"of": of, "start": first, "last": stop, "lead": anchor[of] - first,
            "digit1": joined_hash(h1, near, near - width + 1 + depth, depth, 5).view(np.int64),
            "digit2": joined_hash(h2, first, stop + depth, depth + width, 3).view(np.int64)}


#: Rows between passes. known: 0 alone in its task by digit1, 1 not alone, 2 a span of repeats (start to last, exclusive).
ROW = ["route", "digit1", "digit2", "doc_id", "start", "last", "lead", "known"]
KINDS = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.int16(), pa.int8()]
ROW_SCHEMA = "route long, digit1 long, digit2 long, doc_id long, start int, last int, lead short, known byte"


def settle(r: dict[str, np.ndarray], depth: int) -> Iterator[pa.RecordBatch]:
    """Groups a task's runs: later equal ones become spans, and of each digit only one row stands for the others.

    ``route`` is the first digit for that one row and something even for the rest, so that no
    digit, however common, has more rows under its route than there are tasks.
    """
    order = np.lexsort((r["start"], r["doc_id"]))
    r = {k: v[order] for k, v in r.items()}
    order = np.lexsort((r["digit2"], r["digit1"]))  # stable: the earliest of equal runs stays first
    r = {k: v[order] for k, v in r.items()}
    n = len(order)
    head1, head = np.ones(n, bool), np.ones(n, bool)
    head1[1:] = r["digit1"][1:] != r["digit1"][:-1]
    head[1:] = head1[1:] | (r["digit2"][1:] != r["digit2"][:-1])
    chief = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    later = ~head & ((r["doc_id"] != r["doc_id"][chief]) | (r["start"] != r["start"][chief]))
    # spans of repeats, joined where they touch
    doc, a, b = r["doc_id"][later], r["start"][later], r["last"][later] + depth
    order = np.lexsort((a, doc))
    doc, a, b = doc[order], a[order], b[order]
    if len(doc):
        new = np.ones(len(doc), bool)
        new[1:] = doc[1:] != doc[:-1]
        # texts' starts grow within a document, and runs are short: the furthest end so far is that of the last few
        reach = np.maximum.accumulate(b + np.cumsum(new) * np.int64(2 ** 32)) - np.cumsum(new) * np.int64(2 ** 32)
        new[1:] |= a[1:] > reach[:-1]
        at = np.flatnonzero(new)
        yield from _rows({"route": (doc[at] * 1_000_003 + a[at]) * -7046029254386353131, "digit1": doc[at] * 0, "digit2": doc[at] * 0,
                          "doc_id": doc[at], "start": a[at], "last": np.maximum.reduceat(b, at), "lead": doc[at] * 0,
                          "known": np.full(len(at), 2)})
    same = r["digit1"][head]
    lead_row = np.ones(len(same), bool)
    lead_row[1:] = same[1:] != same[:-1]
    group = np.cumsum(lead_row) - 1
    known = (np.bincount(group)[group] > 1) | (np.bincount(np.cumsum(head1) - 1, weights=later) > 0)[group]
    yield from _rows({k: v[head] for k, v in r.items()} | {"route": np.where(lead_row, same, r["digit2"][head]), "known": known})


def _rows(cols: dict[str, np.ndarray], size: int = 200_000) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays([pa.array(cols[k]).cast(t, safe=False) for k, t in zip(ROW, KINDS)], ROW)
    for lo in range(0, whole.num_rows, size):
        yield whole.slice(lo, size)


def _gathered(found: Iterator[dict[str, np.ndarray]], depth: int, limit: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Settles runs by the million."""
    parts, n = [], 0
    for f in found:
        parts.append(f)
        n += len(f["start"])
        if n >= limit:
            yield from settle({k: np.concatenate([p[k] for p in parts]) for k in parts[0]}, depth)
            parts, n = [], 0
    if n:
        yield from settle({k: np.concatenate([p[k] for p in parts]) for k in parts[0]}, depth)


def _laid_out(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts of a slice one after the other: bytes, starts, ends and document ids."""
    texts = part.column("text").to_pylist()
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    return (np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], ends[:-1]]), ends,
            part.column("doc_id").to_numpy().astype(np.int64))


def _first_runs(batches, depth: int) -> Iterator[dict[str, np.ndarray]]:
    for b in batches:
        for part in sized_slices(b, "text", 500_000):
            data, starts, ends, ids = _laid_out(part)
            r = runs_of(data, ends, depth)
            text = r.pop("text")
            if len(text):
                yield r | {"doc_id": ids[text], "start": r["start"] - starts[text], "last": r["last"] - starts[text]}


def _shorter_runs(batches, depth: int, width: int) -> Iterator[dict[str, np.ndarray]]:
    for b in batches:
        for part in sized_slices(b, "text", 500_000):
            data, starts, _, ids = _laid_out(part)
            cols = [part.column(c) for c in ("starts", "lasts", "leads")]
            text = np.repeat(np.arange(part.num_rows), [len(x) for x in cols[0].to_pylist()])
            start, last, lead = (c.flatten().to_numpy().astype(np.int64) for c in cols)
            r = cut_runs(data, start + starts[text], last + starts[text], lead, depth, width)
            text = text[r.pop("of")]
            yield r | {"doc_id": ids[text], "start": r["start"] - starts[text], "last": r["last"] - starts[text]}


def repeated_spans(plain: DataFrame, depth: int, widths: tuple[int, ...] = (8, 1)) -> DataFrame:
    """``doc_id, starts, ends``: the spans of repeated windows of ``plain`` (doc_id, text as bytes, neither null)."""
    with Scratch(plain.sparkSession) as keep:
        rows = plain.mapInArrow(lambda batches: _gathered(_first_runs(batches, depth), depth), ROW_SCHEMA)
        spans = None
        for width in (None, *widths):
            if width:
                of_doc = undecided.groupBy("doc_id").agg(*[F.collect_list(c).alias(c + "s") for c in ("start", "last", "lead")])
                rows = plain.join(of_doc, "doc_id").mapInArrow(
                    lambda batches, width=width: _gathered(_shorter_runs(batches, depth, width), depth), ROW_SCHEMA)
            # first digit: what is alone everywhere is out
            alone = Window.partitionBy("route")
            rows = rows.withColumn("n", F.count(F.lit(1)).over(alone)).filter("known > 0 OR n > 1").drop("route", "n")
            # second digit: of equal runs the earliest stays. A span of repeats is a group of its own.
            own = F.when(F.col("known") == 2, F.xxhash64("doc_id", "start")).otherwise(F.col("digit1"))
            equal = Window.partitionBy("own", "digit2")
            here = F.struct("doc_id", "start")
            rows = rows.withColumn("own", own).withColumn("later", here > F.min(here).over(equal)).drop("own")
            rows = keep(rows.select("digit1", "digit2", "doc_id", "start", "last", "lead", F.when(
                F.col("known") == 2, 2).when(F.col("later"), 1).otherwise(0).alias("kind")))
            found = rows.filter("kind > 0").select("doc_id", "start", F.when(
                F.col("kind") == 2, F.col("last")).otherwise(F.col("last") + depth).alias("end"))
            spans = found if spans is None else spans.unionByName(found)
            if width == 1:
                break
            chiefs = rows.filter("kind = 0")
            mixed = keep(chiefs.groupBy("digit1").agg(F.count_distinct("digit2").alias("n")).filter("n > 1").drop("n"))
            undecided = chiefs.join(mixed, "digit1").select("doc_id", "start", "last", "lead")
        return cut_lineage(spans.groupBy("doc_id").agg(F.collect_list("start").alias("starts"),
                                                       F.collect_list("end").alias("ends")))


def merged(starts: list[int], ends: list[int]) -> list[list[int]]:
    """Maximal spans of the union, in order."""
    out: list[list[int]] = []
    for a, b in sorted(zip(starts, ends)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def remove_repeats(docs: DataFrame, depth: int = 100, id_col: str = "doc_id", text_col: str = "text",
                   names: tuple[str, str, str] = ("n_bytes", "n_removed", "n_spans"), as_text: bool = False) -> DataFrame:
    """``docs`` without the bytes of windows of ``depth`` bytes that also start earlier, and three counts.

    Earlier is a smaller id (null: the smallest) or the same id and an earlier
    byte; windows are judged on the input. The text becomes binary, the bytes
    that are left; with ``as_text`` it stays a string, without characters of
    which only a part is left. The counts: bytes before, bytes removed, maximal
    removed spans. Rows of one id are one document: equal ones lose the same
    bytes, and a byte that goes from one goes, at its place, from all. A null or
    empty text becomes empty. Input columns named like ``names`` are replaced.
    """
    if depth < WORD:
        raise ValueError(f"depth must be at least {WORD}")
    c = Carried(docs, id_col, text_col)
    ids = F.coalesce(F.col(c.id).cast("long"), F.lit(NULL_ID))
    plain = c.df.select(ids.alias("doc_id"), F.coalesce(F.col(c.text), F.lit("")).cast("binary").alias("text"))
    spans = repeated_spans(plain, depth)
    joined = (c.df.withColumn("key_id", ids).join(spans, F.col("key_id") == F.col("doc_id"), "left")
              .select(*c.names, "starts", "ends"))
    fields = ", ".join(f"{n} binary" if n == c.text and not as_text else f"{n} {f.dataType.simpleString()}"
                       for n, f in zip(c.names, c.df.schema.fields))
    inputs, at = c.names, c.names.index(c.text)

    def keep(batches):
        for b in batches:
            kept, counts = [], []
            for t, starts, ends in zip(b.column(at).cast(pa.binary()).to_pylist(), b.column("starts").to_pylist(),
                                       b.column("ends").to_pylist()):
                t = t or b""
                gone = [(x, min(y, len(t))) for x, y in merged(starts or [], ends or []) if x < len(t)]
                stay = b"".join([t[x:y] for x, y in zip([0, *[y for _, y in gone]], [*[x for x, _ in gone], len(t)])])
                kept.append(stay.decode("utf-8", "ignore") if as_text else stay)
                counts.append((len(t), len(t) - len(stay), len(gone)))
            cols = b.columns[:len(inputs)]
            cols[at] = pa.array(kept, pa.string() if as_text else pa.binary())
            yield pa.RecordBatch.from_arrays([*cols, *[pa.array(x, pa.int64()) for x in zip(*counts)]] if counts else [
                *cols, *[pa.array([], pa.int64())] * 3], [*inputs, "n_bytes", "n_removed", "n_spans"])

    out = joined.mapInArrow(keep, fields + ", n_bytes long, n_removed long, n_spans long")
    return c.restored(out, dict(zip(("n_bytes", "n_removed", "n_spans"), names)))
