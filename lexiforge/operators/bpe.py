"""Byte-level BPE vocabulary learned from distributed word counts.

Data flow (all on executors):

* ``word_counts``: pre-tokenize the training split with a JVM regex, explode,
  ``groupBy(word).count()`` (partial + final hash aggregate; a frequent word is
  combined map-side, so a hot word never reaches one task as raw rows).
* ``alphabet``: distinct bytes (at most 256 rows) ordered by the printable
  stand-in code point; ids start after the three special tokens.
* Training runs over *word-type blocks* (``words_to_blocks``): the symbols of up
  to ``BLOCK_WORDS`` distinct words in one flat array. All pairs are counted only
  at a refresh, which gives the driver the best ``PAIRS`` pairs and the bound that
  every other pair keeps below. A round then sends a list of merges to the blocks
  and gets back the *changes* of pair counts, step by step, from the words that
  hold a merged pair and from no others. The driver replays the steps: as long as
  the pair merged in a step is the best one by the counts of that moment, the step
  stands; the first that is not ends the round. So the merges are exactly those of
  one-at-a-time training, at one Spark job for many merges.

Only bounded things reach the driver: the 256-entry alphabet, ``PAIRS`` pairs at a
refresh, the changes of a round (at most four pairs a merge for every symbol of
the vocabulary) and the vocabulary itself (bounded by ``vocab_size``).
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiforge.functions.text import (SPECIAL_TOKENS, code_point_to_string, pretokenize,
                                      printable_code_point, utf8_bytes)
from lexiforge.operators.encode import flat_bytes
from lexiforge.session import dropped, stored

#: Distinct words of one block, at most.
BLOCK_WORDS = 8_192
#: Symbols of one block, at most (a longer word is a block of its own).
BLOCK_SYMBOLS = 131_072
#: Pairs that the driver holds after a refresh.
PAIRS = 16_384
#: Merges that a round tries, at most.
ROUND = 64
#: Bits of an id where (step, left, right) is one number; steps get the rest.
ID_BITS = 28
ID_MASK = (1 << ID_BITS) - 1
#: Changes of pair counts that a task holds before it sums them.
HELD_CHANGES = 4_000_000
#: Rounds between two written block tables; in between, blocks are cached and can be rebuilt.
WRITE_EVERY = 16


def word_counts(df: DataFrame, feature: str = "text") -> DataFrame:
    """(word, cnt): distinct pre-tokenized words with their frequency."""
    return (df.select(F.explode(pretokenize(F.col(feature))).alias("word"))
            .groupBy("word").agg(F.count(F.lit(1)).alias("cnt")))


def alphabet(wc: DataFrame) -> DataFrame:
    """(byte, id, token): bytes seen in the words, ids after the specials.

    Bytes are de-duplicated inside each task first (at most 256 survive),
    then across tasks by a partial/final aggregate.
    """
    b = wc.select("word").mapInArrow(_bytes_seen, "byte int").distinct()
    cp = printable_code_point(F.col("byte"))
    # at most 256 rows: a single-partition window is bounded
    w = Window.orderBy(cp)
    return b.select("byte", (F.row_number().over(w) + len(SPECIAL_TOKENS) - 1).cast("int").alias("id"),
                    code_point_to_string(cp).alias("token"))


def _bytes_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(256, bool)
    for b in batches:
        seen[flat_bytes(b.column("word"))[0]] = True
    yield pa.RecordBatch.from_pydict({"byte": pa.array(np.flatnonzero(seen), pa.int32())})


def text_alphabet(df: DataFrame, feature: str = "text") -> DataFrame:
    """Same alphabet straight from the texts (words concatenate to the text)."""
    return alphabet(df.select(F.col(feature).alias("word")))


def byte_id_table(alpha_rows) -> list:
    """256-entry list byte -> id (unknown bytes -> <unk> id 2)."""
    table = [2] * 256
    for r in alpha_rows:
        table[r["byte"]] = r["id"]
    return table


def to_symbols(wc: DataFrame, byte_ids: list) -> DataFrame:
    """(word, cnt) -> (word, syms array<int>, cnt) via a 256-entry literal map."""
    lut = F.array(*[F.lit(int(x)) for x in byte_ids])
    return wc.select("word", F.transform(utf8_bytes(F.col("word")),
                                         lambda b: F.element_at(lut, b + 1)).alias("syms"), "cnt")


def pair_counts(words: DataFrame) -> DataFrame:
    """(left, right, cnt): adjacent symbol pairs weighted by word count.

    Every occurrence counts, so ``a a a`` counts the pair (a, a) twice.
    """
    pairs = F.expr("transform(sequence(0, size(syms) - 2), i -> named_struct('l', syms[i], 'r', syms[i + 1]))")
    return (words.filter(F.size("syms") >= 2)
            .select(F.explode(pairs).alias("p"), "cnt")
            .groupBy(F.col("p.l").alias("left"), F.col("p.r").alias("right"))
            .agg(F.sum("cnt").alias("cnt")))


def top_pairs(pairs: DataFrame, k: int) -> DataFrame:
    """Best pairs: count desc, then left id, then right id (a top-k, not a sort)."""
    return pairs.orderBy(F.desc("cnt"), "left", "right").limit(k)


def merge_expr(merges: list[tuple[int, int, int]]) -> F.Column:
    """Column expression applying merges (left, right, new) to ``syms``.

    For distinct-symbol pairs occurrences cannot overlap, so one vectorised
    transform + filter does it. A self pair (a, a) is applied by a
    left-to-right fold, which merges non-overlapping occurrences.
    """
    if len(merges) == 1 and merges[0][0] == merges[0][1]:
        return _self_merge(merges[0][0], merges[0][2])
    case_at = "case " + " ".join(
        f"when syms[i] = {a} and syms[i + 1] = {b} then {new}" for a, b, new in merges) + " end"
    case_prev = "case " + " ".join(
        f"when syms[i - 1] = {a} and syms[i] = {b} then {new}" for a, b, new in merges) + " end"
    return F.expr(
        "filter(transform(sequence(0, size(syms) - 1), i -> "
        f"case when i < size(syms) - 1 and ({case_at}) is not null then {case_at} "
        f"when i > 0 and ({case_prev}) is not null then -1 else syms[i] end), x -> x >= 0)")


def _self_merge(a: int, new: int) -> F.Column:
    # Fold state: the output so far; a just-merged symbol has id `new` != a,
    # so a run a a a becomes [new, a] (left to right, non-overlapping).
    return F.expr(
        "aggregate(syms, cast(array() as array<int>), (acc, x) -> "
        f"case when size(acc) > 0 and element_at(acc, -1) = {a} and x = {a} "
        f"then concat(slice(acc, 1, size(acc) - 1), array({new})) else concat(acc, array(x)) end)")


@dataclass
class BpeModel:
    """Vocabulary (id -> bytes) and ordered merges; bounded by vocab_size."""
    byte_ids: list
    vocab: dict = field(default_factory=dict)        # id -> tuple of bytes
    merges: list = field(default_factory=list)       # (left, right, new_id)
    rounds: int = 0

    def token_bytes(self, i: int) -> tuple:
        return self.vocab[i]


BLOCK_SCHEMA = "kind int, syms binary, words binary, counts binary, step int, left int, right int, change long"


def words_to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(syms, cnt) rows -> block rows: all symbols (-1 after each word), the word of each, a count by word."""
    syms, counts, held = [], [], 0
    for b in batches:
        flat, off = b.column("syms").flatten().to_numpy(), b.column("syms").offsets.to_numpy()
        off = off - off[0]
        cnt = b.column("cnt").to_numpy()
        for i in range(len(cnt)):
            word = flat[off[i]:off[i + 1]]
            if syms and (len(syms) >= BLOCK_WORDS or held + len(word) > BLOCK_SYMBOLS):
                yield _block_row(*_flat(syms, counts))
                syms, counts, held = [], [], 0
            syms.append(word)
            counts.append(cnt[i])
            held += len(word)
    if syms:
        yield _block_row(*_flat(syms, counts))


def _flat(syms: list, counts: list):
    n = np.fromiter((len(w) + 1 for w in syms), np.int64, len(syms))
    s = np.full(int(n.sum()), -1, np.int32)
    word = np.repeat(np.arange(len(syms), dtype=np.int32), n)
    inside = np.ones(len(s), bool)
    inside[np.cumsum(n) - 1] = False
    s[inside] = np.concatenate(syms)
    return s, word, np.asarray(counts, np.int64)


def _block_row(s: np.ndarray, word: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "kind": pa.array([0], pa.int32()), "syms": pa.array([s.tobytes()], pa.binary()), "words": pa.array([word.tobytes()], pa.binary()),
        "counts": pa.array([counts.tobytes()], pa.binary()), "step": pa.array([0], pa.int32()), "left": pa.array([0], pa.int32()),
        "right": pa.array([0], pa.int32()), "change": pa.array([0], pa.int64())})


def _change_rows(key: np.ndarray, change: np.ndarray) -> pa.RecordBatch:
    n = len(key)
    none = pa.nulls(n, pa.binary())
    return pa.RecordBatch.from_pydict({
        "kind": pa.array(np.ones(n, np.int32)), "syms": none, "words": none, "counts": none,
        "step": pa.array((key >> 2 * ID_BITS).astype(np.int32)), "left": pa.array((key >> ID_BITS & ID_MASK).astype(np.int32)),
        "right": pa.array((key & ID_MASK).astype(np.int32)), "change": pa.array(change)})


def _keys(step, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """(step, left, right) as one number."""
    return (np.asarray(step, np.int64) << 2 * ID_BITS) | (left.astype(np.int64) << ID_BITS) | right.astype(np.int64)


def _summed(keys: list, changes: list):
    """Distinct keys and the sum of their changes, without those that come to nothing."""
    key, change = np.concatenate(keys), np.concatenate(changes)
    order = np.argsort(key)
    key, change = key[order], change[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    total = np.add.reduceat(change, first) if len(first) else change
    hit = total != 0
    return key[first][hit], total[hit]


class _Sums:
    """Changes of many blocks, summed within the task before they leave it."""

    def __init__(self):
        self.keys, self.changes, self.held = [], [], 0

    def add(self, key: np.ndarray, change: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.keys.append(key)
        self.changes.append(change)
        self.held += len(key)
        if self.held > HELD_CHANGES:
            key, change = _summed(self.keys, self.changes)
            self.keys, self.changes, self.held = [key], [change], len(key)
            if self.held > HELD_CHANGES // 2:
                yield from self.rows()

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.keys:
            key, change = _summed(self.keys, self.changes)
            self.keys, self.changes, self.held = [], [], 0
            if len(key):
                yield _change_rows(key, change)


def _together(merges: list) -> list:
    """``merges`` cut into lists whose places cannot overlap and which make no symbol that a later one of the list
    takes, so that all places of a list are known before its first merge. What ``_guess`` gives is one list."""
    out, ends, begins, made = [], set(), set(), set()
    for a, b, new in merges:
        if not out or a == b or out[-1][-1][0] == out[-1][-1][1] or a in ends or b in begins or a in made or b in made:
            out.append([])
            ends, begins, made = set(), set(), set()
        out[-1].append((a, b, new))
        ends.add(b)
        begins.add(a)
        made.add(new)
    return out


def _places(s: np.ndarray, merges: list):
    """Where one list of ``_together`` merges, in order, and which of it at each place; one pass over the symbols.

    Of overlapping ``a a a`` the leftmost is merged, then every second one.
    """
    size = max(int(s.max(initial=0)), max(max(a, b) for a, b, _ in merges)) + 2
    left, right = np.zeros(size, bool), np.zeros(size, bool)      # the last entry stands for -1, the end of a word
    left[[a for a, _, _ in merges]] = True
    right[[b for _, b, _ in merges]] = True
    at = np.flatnonzero(left[s[:-1]] & right[s[1:]])
    wanted = _keys(0, np.asarray([a for a, _, _ in merges]), np.asarray([b for _, b, _ in merges]))
    order = np.argsort(wanted)
    found = _keys(0, s[at], s[at + 1])
    nearest = order[np.minimum(np.searchsorted(wanted[order], found), len(merges) - 1)]
    hit = wanted[nearest] == found
    at, which = at[hit], nearest[hit]
    if merges[0][0] == merges[0][1] and len(at) > 1:
        new_run = np.concatenate([[True], np.diff(at) != 1])
        first = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
        keep = (np.arange(len(at)) - first) % 2 == 0
        at, which = at[keep], which[keep]
    return at, which


def _merged(s: np.ndarray, word: np.ndarray, at: np.ndarray, new: np.ndarray):
    s = s.copy()
    s[at] = new
    keep = np.ones(len(s), bool)
    keep[at + 1] = False
    return s[keep], word[keep]


def _place_changes(s: np.ndarray, n: np.ndarray, at: np.ndarray, step: np.ndarray, new: np.ndarray):
    """(key, change) of every pair that a merge at ``at`` takes or makes, as it stands when the merge's step comes.

    A neighbour that an earlier step has merged is its new symbol by then; one that the same step merges is counted
    from the place left of it.
    """
    a, b, left, right = s[at], s[at + 1], s[at - 1], s[at + 2]    # a block ends with -1, which is s[-1] too
    joined = at[1:] == at[:-1] + 2
    earlier, same = step[:-1], joined & (step[:-1] == step[1:])
    before_left = left.copy()
    before_left[1:] = np.where(joined & (earlier < step[1:]), new[:-1], left[1:])
    before_right, after_right = right.copy(), right.copy()
    before_right[:-1] = np.where(joined & (step[1:] < earlier), new[1:], right[:-1])
    after_right[:-1] = np.where(joined & (step[1:] <= earlier), new[1:], right[:-1])
    has_left, has_right = left >= 0, right >= 0
    has_left[1:] &= ~same
    sl, sr, nl, nr = step[has_left], step[has_right], n[has_left], n[has_right]
    return (np.concatenate([_keys(step, a, b), _keys(sl, before_left[has_left], a[has_left]), _keys(sl, before_left[has_left], new[has_left]),
                            _keys(sr, b[has_right], before_right[has_right]), _keys(sr, new[has_right], after_right[has_right])]),
            np.concatenate([-n, -nl, nl, -nr, nr]))


def _round(done: list, tried: list):
    """A block with ``done`` merged (kind 0), and the changes that each of ``tried`` would make in turn (kind 1).

    A block is passed over once for each list; all else is work on the places found.
    """
    def fn(batches):
        sums = _Sums()
        for b in batches:
            for kind, syms, words, cnt in zip(*(b.column(c).to_pylist() for c in ("kind", "syms", "words", "counts"))):
                if kind != 0:
                    continue
                s, word, counts = np.frombuffer(syms, np.int32), np.frombuffer(words, np.int32), np.frombuffer(cnt, np.int64)
                for merges in _together(done):
                    at, which = _places(s, merges)
                    s, word = _merged(s, word, at, np.asarray([new for _, _, new in merges], np.int32)[which])
                yield _block_row(s, word, counts)
                step = 0
                for merges in _together(tried):
                    at, which = _places(s, merges)
                    new = np.asarray([new for _, _, new in merges], np.int32)[which]
                    if len(at):
                        yield from sums.add(*_place_changes(s, counts[word[at]], at, which + step, new))
                    step += len(merges)
                    if step < len(tried):
                        s, word = _merged(s, word, at, new)
        yield from sums.rows()
    return fn


def _block_pairs(batches):
    """Pair counts of the blocks, aggregated by task."""
    sums = _Sums()
    for b in batches:
        for kind, syms, words, cnt in zip(*(b.column(c).to_pylist() for c in ("kind", "syms", "words", "counts"))):
            if kind == 0:
                s, word, counts = np.frombuffer(syms, np.int32), np.frombuffer(words, np.int32), np.frombuffer(cnt, np.int64)
                inside = np.flatnonzero((s[:-1] >= 0) & (s[1:] >= 0))
                key, n = _keys(0, s[inside], s[inside + 1]), counts[word[inside]]
                yield from sums.add(*_summed([key], [n]))
    yield from sums.rows()


class _Best:
    """The best pairs by (count descending, left, right): all that rank before ``bound`` are known exactly."""

    def __init__(self, rows: list, limit: int):
        self.count = {(r["left"], r["right"]): r["cnt"] for r in rows}
        self.heap = [(-c, *p) for p, c in self.count.items()]
        heapq.heapify(self.heap)
        self.bound = max(self.heap) if len(rows) == limit else (0, -1, -1)

    def top(self):
        """The best pair, or None where a pair that is not held could be better."""
        while self.heap:
            c, a, b = self.heap[0]
            now = self.count.get((a, b), 0)
            if now == -c and now > 0:
                return (a, b) if self.heap[0] <= self.bound else None
            heapq.heappop(self.heap)
            if now > 0 and now < -c:
                heapq.heappush(self.heap, (-now, a, b))
        return None

    def first(self, n: int) -> list:
        return heapq.nsmallest(n, ((-c, *p) for p, c in self.count.items() if c > 0))

    def apply(self, changes: list, new: int) -> bool:
        """Fold in one step; False if a pair whose count is not held has grown."""
        known = True
        for a, b, change in changes:
            held = self.count.get((a, b))
            if held is not None:
                self.count[a, b] = held + change
                if change > 0:
                    heapq.heappush(self.heap, (-held - change, a, b))
            elif new in (a, b):
                if change > 0 and (-change, a, b) <= self.bound:
                    self.count[a, b] = change
                    heapq.heappush(self.heap, (-change, a, b))
            elif change > 0:
                known = False
        return known


def _guess(best: _Best, model: BpeModel, by_bytes: dict, most: int) -> list:
    """Merges to try: the best pairs in order, without those that an earlier one of the list would take symbols from."""
    out, ends, begins, size = [], set(), set(), len(model.vocab)
    for _, a, b in best.first(4 * most):
        if len(out) >= most:
            break
        if a in ends or b in begins or (a == b and out):
            continue
        existing = by_bytes.get(model.vocab[a] + model.vocab[b])
        out.append((a, b, size if existing is None else existing))
        ends.add(b)
        begins.add(a)
        if existing is not None or a == b:
            break
        size += 1
    return out


def train_bpe(wc: DataFrame, vocab_size: int | None = None, merges: int | None = None, pairs: int = PAIRS) -> BpeModel:
    """Learn merges until ``vocab_size`` tokens, ``merges`` merges or no pair is left."""
    wc = counted_words = stored(wc, "word-counts")
    alpha_rows = alphabet(wc).collect()          # <= 256 rows
    model = BpeModel(byte_id_table(alpha_rows))
    for i, tok in enumerate(SPECIAL_TOKENS):
        model.vocab[i] = tuple(tok.encode("utf-8"))
    for r in alpha_rows:
        model.vocab[r["id"]] = (r["byte"],)
    limit = merges if vocab_size is None else None
    by_bytes = {v: i for i, v in model.vocab.items() if i >= len(SPECIAL_TOKENS)}
    words = to_symbols(wc, model.byte_ids).filter(F.size("syms") >= 2).select("syms", "cnt")
    blocks = written = stored(words.mapInArrow(words_to_blocks, BLOCK_SCHEMA), "bpe-blocks")
    dropped(counted_words)
    cached = None
    best, done, stood = None, [], 4
    try:
        while True:
            room = limit - len(model.merges) if limit is not None else vocab_size - len(model.vocab)
            if room <= 0:
                break
            if best is None:
                if done:             # bring the blocks up to date, then count all pairs
                    fresh = stored(blocks.mapInArrow(_round(done, []), BLOCK_SCHEMA), "bpe-blocks")
                    _release(cached, written)
                    blocks = written = fresh
                    cached, done = None, []
                counted = (blocks.mapInArrow(_block_pairs, BLOCK_SCHEMA).groupBy("left", "right")
                           .agg(F.sum("change").alias("cnt")))
                best = _Best(top_pairs(counted, pairs).collect(), pairs)      # <= ``pairs`` rows
                if best.top() is None:
                    break
            tried = _guess(best, model, by_bytes, min(ROUND, room, 2 * stood + 8))
            after = blocks.mapInArrow(_round(done, tried), BLOCK_SCHEMA)
            model.rounds += 1
            if model.rounds % WRITE_EVERY == 0:
                after = stored(after, "bpe-blocks")
                changes = _changes(after)
                _release(cached, written)
                blocks = written = after
                cached = None
            else:
                after = after.persist()
                changes = _changes(after)        # computes and keeps the blocks of this round
                if cached is not None:
                    cached.unpersist()
                blocks = cached = after
            done = []
            for step, (a, b, new) in enumerate(tried):
                if best.top() != (a, b):
                    break
                if new not in model.vocab:
                    model.vocab[new] = model.vocab[a] + model.vocab[b]
                    by_bytes[model.vocab[new]] = new
                model.merges.append((a, b, new))
                done.append((a, b, new))
                if not best.apply(changes.get(step, ()), new):
                    best = None
                    break
            stood = len(done)
            if best is not None and best.top() is None:
                best = None          # the pairs not held have to be looked at
    finally:
        _release(cached, written)
    return model


def _changes(after: DataFrame) -> dict:
    """Step -> (left, right, change) of the whole corpus."""
    rows = (after.filter("kind = 1").groupBy("step", "left", "right").agg(F.sum("change").alias("change"))
            .filter("change <> 0").collect())
    out = defaultdict(list)
    for r in rows:
        out[r["step"]].append((r["left"], r["right"], r["change"]))
    return out


def _release(cached: DataFrame | None, written: DataFrame | None) -> None:
    if cached is not None:
        cached.unpersist()
    if written is not None:
        dropped(written)


def vocab_frame(spark, model: BpeModel) -> DataFrame:
    """(id, token, hex): token is the printable byte-level rendering."""
    rows = []
    for i, bs in sorted(model.vocab.items()):
        if i < len(SPECIAL_TOKENS):
            tok = SPECIAL_TOKENS[i]
        else:
            tok = "".join(chr(_cp(b)) for b in bs)
        rows.append((i, tok, bytes(bs).hex().upper()))
    return spark.createDataFrame(rows, "id int, token string, hex string")


def merges_frame(spark, model: BpeModel) -> DataFrame:
    rows = [(r, a, b, n) for r, (a, b, n) in enumerate(model.merges)]
    return spark.createDataFrame(rows, "rank int, left_id int, right_id int, new_id int")


def _cp(b: int) -> int:
    """Python twin of ``printable_code_point`` for the driver-side vocabulary."""
    if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
        return b
    if b <= 32:
        return b + 256
    if b <= 160:
        return b - 127 + 289
    return 323
