import hashlib
import random
from collections import defaultdict
from zlib import crc32

import pytest

from lexiforge.llm import prefix_trie as trie
from lexiforge.llm.prefix_trie import conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string, conv long, k int, n long, rep string, depth int"


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(v, key=lambda t: t[0])] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = crc32(str(c).encode()) % 9 if c is not None else 0
        base = c - (abs(c) % 5 if c > 0 else -(abs(c) % 5)) if c is not None else None
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(rows):
    def key(c):
        return -(2 ** 63) if c is None else c
    members, children = defaultdict(list), defaultdict(set)
    convs = rebuilt(rows)
    for c, s in convs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
            if d:
                children[tuple(s[:d - 1])].add(tuple(s[:d]))
    def below(p):
        out = [p]
        for q in children[p]:
            out += below(q)
        return out
    out = []
    for p, m in members.items():
        sub = below(p)
        ends = sorted((c for c in m if len(convs[c]) == len(p)), key=key)
        out.append((min(m, key=key), len(p), min(members[p[:-1]], key=key) if p else None, len(m), len(children[p]),
                    sum(not children[q] for q in sub), sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in sub if q),
                    hashlib.sha256(",".join("" if c is None else str(c) for c in ends).encode()).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, 2, 3, "r", 4) for r in rows], SCHEMA)
    out = conversation_trie(df, **options)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def given(rng, convs, turns=12, words=2):
    rows = []
    for c in convs:
        for t in range(rng.randint(1, turns)):
            rows.append((c, t, rng.choice(["user", "assistant"]) if t > 6 else "user", rng.choice("äbcdefgh"[:words]) * (t + 1)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [1, 3, 4])
def test_trie_matches_brute_force(spark, block):
    rows = given(random.Random(block), list(range(-6, 60)))
    assert run(spark, rows, block=block) == brute(rows)


def test_hot_and_long_conversations_are_split(spark, monkeypatch):
    """Stretches of a few blocks, hot keys from two rows on and pieces of two identifiers."""
    monkeypatch.setattr(trie, "STRETCH", 2)
    monkeypatch.setattr(trie, "PIECE", 2)
    monkeypatch.setattr(trie, "max", lambda a, b: 1, raising=False)
    rng = random.Random(9)
    rows = given(rng, list(range(30)), turns=30, words=1) + [(c, t, "user", "same" * t) for c in range(100, 160) for t in range(14)]
    assert run(spark, rows, block=2) == brute(rows)


def test_nulls_ties_and_copies(spark):
    rows = [(None, 1, "user", "x"), (None, None, None, None), (7, None, "user", None), (7, 2, None, "b"), (5, 1, "user", ""),
            (12, 1, "user", "only"), (10, 1, "u", "same"), (10, 1, "u", "same"), (23, 3, "u", "é" * 50_000)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    assert run(spark, [(1, 1, "u", "t")]) == brute([(1, 1, "u", "t")])
