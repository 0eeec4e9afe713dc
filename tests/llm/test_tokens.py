"""BPE codec against the library; packing."""
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import SCHEMA, documents, edge_rows, ordered, wide
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexiforge.llm.bpe_codec import bpe_decode, bpe_encode, chunks_of, decode_ids
from lexiforge.llm.packing import best_fit_pack, plan_bins, token_pieces
from lexiforge.llm.words import ChunkTable

PATH = public_tokenizers.path("word_bpe_49k.json")
LIB = Tokenizer.from_file(PATH)


def ids_of(text):
    return LIB.encode(text or "", add_special_tokens=False).ids


def test_codec_equals_the_library_on_edge_rows(spark):
    want = ordered((r[0], ids_of(r[1]), LIB.decode(ids_of(r[1]), skip_special_tokens=False)) for r in edge_rows())
    for d in (documents(spark), wide(spark)):
        assert ordered((r[0], list(r[1]), r[2]) for r in bpe_encode(d, PATH, decode=True).collect()) == want
    back = bpe_decode(bpe_encode(documents(spark), PATH), PATH)
    assert ordered((r[0], list(r[1]), r[2]) for r in back.collect()) == want
    assert bpe_encode(spark.createDataFrame([], SCHEMA), PATH, decode=True).count() == 0


def test_decode_of_null_and_unknown_ids(spark):
    d = spark.createDataFrame([(1, None), (2, []), (3, [320, None, 10 ** 6])], "k int, ids array<int>")
    assert [r["decoded"] for r in bpe_decode(d, PATH).orderBy("k").collect()] == [None, "", LIB.decode([320])]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdefgh éÉßıİΣ.,'!0123 \n\t\x1c\x85\xa0日é<|>"), max_size=60))
def test_codec_equals_the_library(text):
    ids = np.frombuffer(next(chunks_of(PATH).ids([text])), "<u4")
    assert ids.tolist() == ids_of(text)
    assert decode_ids(PATH, ids) == LIB.decode(ids.tolist(), skip_special_tokens=False)


def test_long_words_texts_and_a_small_table():
    encode = chunks_of(PATH).encode
    table = ChunkTable(PATH, encode, limit=50)
    rng = random.Random(1)
    texts = ["".join(rng.choice("abc ") for _ in range(5000)), "ab" * 20_000, " ".join("w%d" % k for k in range(3000)), "x y"]
    got = list(table.ids(texts, at_once=2000))
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [ids_of(t) for t in texts]


@pytest.mark.parametrize("rule,extra", [("norm", {}), ("dot", {"documents": 5, "attention": 9000, "weights": (1, 1, 1)}),
                                        ("norm", {"documents": 5, "attention": 9000, "weights": (1, 1, 1)})])
def test_plan_keeps_every_capacity(rule, extra):
    rng = random.Random(2)
    hist = {n: rng.randint(1, 30) for n in range(1, 101) if rng.random() < 0.6}
    plan = plan_bins(hist, 100, rule=rule, **extra)
    bins, seen = {}, {}
    for length, first, count, each, b, offset in zip(*[plan[k].tolist() for k in ("length", "first", "count", "each", "bin", "offset")]):
        for d in range(count):
            bins.setdefault(b + d // each, []).append((offset + d % each * length, length))
            seen.setdefault(length, []).append(first + d)
    assert {n: sorted(v) for n, v in seen.items()} == {n: list(range(c)) for n, c in hist.items()}
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 100
        if len(pieces) > 1 and extra:
            assert len(pieces) <= 5 and sum(n * n for _, n in pieces) <= 9000
    if not extra:
        assert len(bins) <= 1.03 * sum(n * c for n, c in hist.items()) / 100 + 1


def test_pieces_and_sequences_on_edge_rows(spark):
    size = 50
    packed = best_fit_pack(token_pieces(documents(spark), PATH, size), size).collect()
    docs, sequences = {}, {}
    for r in packed:
        docs.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], bytes(r["ids"])))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert len(docs) == len(edge_rows())
    for r in edge_rows():
        ids = [*ids_of(r[1]), 1]
        got = sorted(docs[r[0]])
        assert [p[0] for p in got] == list(range(len(got))) and [p[1] for p in got] == list(range(0, len(ids), size))
        data = b"".join(p[3] for p in got)
        assert data == np.array(ids, "<u4").tobytes() and all(len(p[3]) == 4 * p[2] for p in got)
    for places in sequences.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= size
    total = sum(r["length"] for r in packed)
    assert len(sequences) <= -(-total // size) + 1


def test_packing_of_odd_lengths_repeated_keys_and_nothing(spark):
    rows = [(1, 0, 5), (1, 0, 5), (2, 0, None), (3, 0, 0), (4, 0, 99), (None, 0, 5)]
    d = spark.createDataFrame(rows, "doc_id long, piece int, length long")
    got = best_fit_pack(d, 10).collect()
    assert len(got) == 6 and sum(r["sequence_id"] is None for r in got) == 2
    alone = [r for r in got if r["length"] == 99]
    assert [r["sequence_id"] for r in got].count(alone[0]["sequence_id"]) == 1
    assert best_fit_pack(d.limit(0), 10).count() == 0
    assert token_pieces(d.select("doc_id", F.lit(None).cast("string").alias("text")), PATH, 10, end_id=None).count() == 0


def test_crc_is_that_of_the_ids(spark):
    r = token_pieces(documents(spark).filter("doc_id = 5"), PATH, 4096).withColumn("c", F.crc32("ids")).first()
    assert r["c"] == zlib.crc32(np.array([*ids_of("one two"), 1], "<u4").tobytes())


@pytest.mark.parametrize("caps,weights", [((60, 4, 1500), (1.0, 0.25, 0.25)), ((60, 60, 3600), (1.0, 0.25, 0.25)), ((60, 5, 2000), (0.2, 1.0, 0.7))])
def test_plan_equals_plain_best_fit(caps, weights):
    """Piece by piece, longest first, over all bins one by one; bins of equal residuals are alike."""
    rng = random.Random(sum(caps))
    hist = {n: rng.randint(1, 9) for n in range(1, 61) if rng.random() < 0.7}
    plan = plan_bins(hist, *caps, weights=weights)
    got = {}
    for length, count, each, b in zip(*[plan[k].tolist() for k in ("length", "count", "each", "bin")]):
        for d in range(count):
            got.setdefault(b + d // each, []).append(length)
    bins, cap, w = [], np.array(caps, float), np.array(weights)
    for n in sorted(hist, reverse=True):
        item = np.array([n, 1, n * n], float)
        for _ in range(hist[n]):
            fits = [b for b in bins if (b[0] >= item).all()]
            if fits:
                score = [(w * ((b[0] - item) / cap) ** 2).sum() for b in fits]
                best = fits[int(np.argmin(score))]
            else:
                bins.append(best := [cap.copy(), []])
            best[0] -= item
            best[1].append(n)
    assert sorted(map(sorted, got.values())) == sorted(sorted(b[1]) for b in bins)


def test_packing_replaces_columns_of_its_own_names(spark):
    d = spark.createDataFrame([(1, 0, 5, 7, "x"), (2, 0, 6, 8, "y")], "doc_id long, piece int, length long, sequence_id int, offset string")
    got = best_fit_pack(d, 10)
    assert got.columns == ["doc_id", "piece", "length", "sequence_id", "offset"]
    assert sorted((r["length"], r["offset"]) for r in got.collect()) == [(5, 0), (6, 0)]


def test_chunks_of_a_group_are_looked_up_once():
    from lexiforge.llm.packing import _chunks
    from lexiforge.llm.queries import TOKENIZER
    from lexiforge.llm.words import ChunkTable, library

    class Counted(dict):
        asked = 0

        def __contains__(self, key):
            Counted.asked += 1
            return dict.__contains__(self, key)

    texts = ["", "  ", "\t\x0b\x0c a\x1bb\n\nc  d ", "Ünï œ's DON'T stop.", "x " * 5, "  z", "a b. a, b 12.5", "don't stop."]
    table = ChunkTable(TOKENIZER, _chunks(TOKENIZER).encode, limit=6)     # small: entries are dropped on the way
    table.known = Counted()
    for group in (texts, texts[:3], texts[3:] * 2):
        want = [library(TOKENIZER).encode(t, add_special_tokens=False).ids for t in group]
        assert [np.frombuffer(x, "<u4").tolist() for x in table.plain(group)] == want
    assert Counted.asked == 0


def test_new_chunks_are_learned_in_slices():
    sizes, inner = [], chunks_of(PATH).encode

    def encode(words):
        sizes.append(len(words))
        return inner(words)

    table = ChunkTable(PATH, encode)
    new = [f"w{k:x}," for k in range(90_000)]
    table.learn(new)
    assert max(sizes) <= 3 * 40_000 and len(sizes) >= 3  # at most so many words in a chunk here
    some = new[::3_000]
    assert [np.frombuffer(table.known[c], "<u4").tolist() for c in some] == [ids_of(c) for c in some]
