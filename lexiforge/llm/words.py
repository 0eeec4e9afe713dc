"""Distinct pieces of text for the word-level BPE vocabulary, encoded once and kept.

The vocabulary lower-cases, drops white space and never merges across it, so a
text's ids are the ids of its blank-separated chunks in order. Chunks repeat
(Zipf), so each Python worker keeps a bounded table chunk -> ids and only new
chunks are encoded. Texts with characters outside ``PLAIN`` (combining marks,
unusual blanks, special tokens, other scripts) are split by the vocabulary's
own normaliser and splitter instead.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: ASCII without the separators 1C-1F, Latin-1 and Latin Extended-A letters and signs (their
#: composed form is the normal form), general punctuation. Lower-casing them never changes the number of characters.
PLAIN = re.compile("[\x00-\x1b\x20-\x7f\xa1-įı-ňŊ-ſ‐-‧‰-⁞€]*").fullmatch
#: Fixed value: the pattern of the vocabulary file, for lower-cased chunks without white space.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
SPECIAL = re.compile(r"<\|startoftext\|>|<\|endoftext\|>")


@functools.cache
def library(path: str):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


@functools.cache
def special_ids(path: str) -> dict[str, int]:
    with open(path, encoding="utf-8") as f:
        return {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}


@functools.cache
def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else the next free one from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


def stretches(text: str, limit: int = 1_000_000) -> Iterator[str]:
    """A long text cut at blanks, so that a very long one needs no more memory than this."""
    lo = 0
    while len(text) - lo > limit:
        cut = text.find(" ", lo + limit)
        if cut < 0:
            break
        yield text[lo:cut]
        lo = cut
    yield text[lo:] if lo else text


class ChunkTable:
    """Bounded table chunk -> little-endian uint32 ids. ``encode`` maps distinct words (UTF-8) to their id bytes."""

    def __init__(self, path: str, encode: Callable[[list[bytes]], list[bytes]], limit: int = 700_000):
        import regex
        self.path, self.encode, self.limit = path, encode, limit
        self.known: dict[str, bytes] = {}
        self.words = regex.compile(WORD).findall

    def parts(self, chunk: str) -> list[str]:
        """The words of a chunk: one if it is all letters, two if a full stop or comma follows, else by the pattern."""
        if chunk.isalpha():
            return [chunk]
        if chunk[-1] in ".," and chunk[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return self.words(chunk)

    def learn(self, new: list[str], at_once: int = 40_000) -> None:
        for lo in range(0, len(new), at_once):  # what it takes besides the table does not grow with the texts
            some = new[lo:lo + at_once]
            parts = [self.parts(c) for c in some]
            words = dict.fromkeys(chain.from_iterable(parts))
            ids = dict(zip(words, map(self.known.get, words)))
            distinct = [w for w, known in ids.items() if known is None]
            ids.update(zip(distinct, self.encode([w.encode() for w in distinct])))
            found = [ids[p[0]] if len(p) == 1 else b"".join([ids[w] for w in p]) for p in parts]
            self.known.update(zip(some, found))

    def plain(self, texts: list[str]) -> list[bytes]:
        """Ids of texts within PLAIN, about so many characters together as ``ids`` sees to.

        Arrow lower-cases, splits and finds the distinct chunks; ids of all places are gathered at once.
        """
        rows = pc.ascii_split_whitespace(pc.utf8_lower(pa.array(texts, pa.large_string())))  # PLAIN has no other blanks
        flat = rows.flatten().dictionary_encode()
        chunks = flat.dictionary.to_pylist()
        known = self.known
        known[""] = b""
        ids = list(map(known.get, chunks))
        missing = [i for i, v in enumerate(ids) if v is None]
        new = [chunks[i] for i in missing]
        if len(known) + len(new) > self.limit:  # of the older half, only what these texts use stays
            used = set(chunks)
            for k in list(islice(known, len(known) // 2)):
                if k not in used:
                    del known[k]
        self.learn(new)
        for i in missing:
            ids[i] = known[chunks[i]]
        size = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        place = flat.indices.to_numpy()
        n = size[place]
        ends = np.cumsum(n)
        at = np.repeat((np.cumsum(size) - size)[place] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
        data = np.frombuffer(b"".join(ids), "<u4")[at].tobytes()
        offsets = rows.offsets.to_numpy()
        cuts = (4 * np.append(0, ends))[offsets - offsets[0]].tolist()
        return [data[lo:hi] for lo, hi in zip(cuts[:-1], cuts[1:])]

    def other(self, text: str) -> bytes:
        """Ids of any text: special tokens first, then the vocabulary's normaliser and splitter."""
        t, special, back = library(self.path), special_ids(self.path), {c: b for b, c in enumerate(byte_letters())}
        out, lo = [], 0
        for m in [*SPECIAL.finditer(text), None]:
            part = t.normalizer.normalize_str(text[lo:m.start() if m else len(text)])
            words = [bytes(map(back.__getitem__, w)) for w, _ in t.pre_tokenizer.pre_tokenize_str(part)]
            distinct = list(dict.fromkeys(words))
            ids = dict(zip(distinct, self.encode(distinct)))
            out += [ids[w] for w in words]
            if m:
                out.append(np.uint32(special[m[0]]).astype("<u4").tobytes())
                lo = m.end()
        return b"".join(out)

    def ids(self, texts: list[str], at_once: int = 4_000_000) -> Iterator[bytes]:
        """Id bytes of each text, in order."""
        group: list[str] = []
        size = 0
        for t in texts:
            plain = PLAIN(t) and not SPECIAL.search(t)
            if group and (not plain or size + len(t) > at_once):
                yield from self.plain(group)
                group, size = [], 0
            if not plain:
                yield self.other(t)
            elif len(t) > at_once:
                yield b"".join(x for s in stretches(t, at_once) for x in self.plain([s]))
            else:
                group.append(t)
                size += len(t)
        if group:
            yield from self.plain(group)
