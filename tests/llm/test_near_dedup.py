"""Near-duplicate join against all pairs; components."""
import math
import random

import numpy as np
from helpers import SCHEMA, documents, edge_rows, near_dedup, ordered, passage, wide

from lexiforge.llm import near_dedup as module
from lexiforge.llm.common import Scratch
from lexiforge.llm.components import connected_components
from lexiforge.llm.near_dedup import TOKENS, TOP, group_links, least_matches, near_duplicates, shingle_set, survival, tree_count

ROWS = [(r[0], r[1]) for r in edge_rows()]


def test_edge_rows_equal_all_pairs(spark):
    rows = ROWS + [(5, "one two"), (6, ROWS[5][1])]
    got = near_duplicates(documents(spark, [(*r, None, None, None) for r in rows]), 80).collect()
    assert ordered(map(tuple, got)) == ordered(near_dedup(rows, 80))


def test_large_nodes_branch_and_stay_exact(spark):
    """One hot group of near copies, groups at many similarities and a passage in every text, in nodes of at most 4."""
    rng = random.Random(3)
    words = ["w%d" % k for k in range(3000)]
    hot = [rng.choice(words) for _ in range(150)]
    common = " ".join(rng.choice(words) for _ in range(12))
    texts = []
    for k in range(60):
        t = list(hot)
        for _ in range(rng.randint(0, 6)):
            t[rng.randrange(150)] = rng.choice(words)
        texts.append(" ".join(t))
    for k in range(60):
        t = passage(rng, 80, words).split()
        texts.append(common + " " + " ".join(t))
        t[rng.randrange(80)] = "other"
        texts.append(common + " " + " ".join(t))
    rows = [(k, t) for k, t in enumerate(texts)]
    d = documents(spark, [(*r, None, None, None) for r in rows])
    got = near_duplicates(d, 85, limit=4, depth=3)
    assert ordered(map(tuple, got.collect())) == ordered(near_dedup(rows, 85))


def test_wide_and_empty_tables(spark):
    got = near_duplicates(wide(spark), 80).collect()
    assert ordered(map(tuple, got)) == ordered(near_dedup(ROWS, 80))
    empty = near_duplicates(spark.createDataFrame([], SCHEMA))
    assert empty.columns == ["doc_id", "n_shingles", "component_id", "kept"] and empty.count() == 0


def test_shingles_and_bounds():
    assert len(shingle_set(b"a b c d e f", 5)) == 2 and len(shingle_set(b"A b", 5)) == 1 and not len(shingle_set(b" \n", 5))
    assert np.array_equal(shingle_set(b"A b C d E", 5), shingle_set(b"a  B c\nD e", 5))
    assert least_matches(0.85) < 0.85 * TOKENS and least_matches(1.0) == TOKENS


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(30)] + [(7, 7), (200, 201), (201, 200)]
    edges += [(300 + rng.randrange(40), 300 + rng.randrange(40)) for _ in range(50)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    want = {v: find(v) for e in edges for v in e if e[0] != e[1]}
    with Scratch(spark) as keep:
        got = {r["v"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), keep).collect()}
    assert got == want


def test_pairs_of_a_node_that_stays_large_meet(spark):
    """Texts of one template that are alike in pairs only, which blocks of a node must not part."""
    rng = random.Random(8)
    words = ["w%d" % k for k in range(3000)]
    template = [rng.choice(words) for _ in range(400)]
    rows = []
    for k in range(60):
        t = [*template[:5 * k + 20], "own%d" % k, *template[5 * k + 21:]]
        rows += [(2 * k, " ".join(t)), (2 * k + 1, " ".join([*t[:-1], "other%d" % k]))]
    d = documents(spark, [(*r, None, None, None) for r in rows])
    got = near_duplicates(d, 98, limit=2, depth=1).collect()
    assert ordered(map(tuple, got)) == ordered(near_dedup(rows, 98))
    assert sum(r["kept"] for r in got) == 60


def test_losses_at_the_threshold_through_all_levels():
    rng = random.Random(9)
    for t in (0.8, 0.85):
        alive = 0
        for _ in range(20_000):
            nodes = 1
            for _ in range(6):
                nodes = sum((rng.random() < t) + (rng.random() < 1 / t - 1 and rng.random() < t) for _ in range(nodes))
            alive += nodes > 0
        assert abs(alive / 20_000 - survival(t, 6)) < 0.015
        assert (1 - t ** TOP * alive / 20_000) ** tree_count(t, 6) < 3e-10
        assert sum(math.comb(TOKENS, m) * t ** m * (1 - t) ** (TOKENS - m) for m in range(least_matches(t))) <= 1e-7
    assert tree_count(0.85, 0) == 25 and survival(0.85, 0) == 1


def test_pairs_handed_on_grow_with_the_documents(spark, monkeypatch):
    """A group of texts that are all just below the threshold hands on no pair for every two of them."""
    rng = random.Random(12)
    words = ["w%d" % k for k in range(3000)]
    core = [rng.choice(words) for _ in range(400)]
    rows = []
    for k in range(70):
        t = list(core)
        for p in rng.sample(range(5, 395), 7):
            t[p] = "own%d" % rng.randrange(10 ** 9)
        rows.append((k, " ".join(t)))
    rows += [(100, rows[3][1] + " end"), (101, rows[40][1] + " end"), (102, passage(rng, 80, words))]
    assert sum(r[3] for r in near_dedup(rows, 85)) == 71
    made = []
    whole = module.candidate_pairs

    def counted(*args):
        out = whole(*args)
        made.append(out.count())
        return out
    monkeypatch.setattr(module, "candidate_pairs", counted)
    d = documents(spark, [(*r, None, None, None) for r in rows])
    got = near_duplicates(d, 85, limit=8, depth=2).collect()
    assert ordered(map(tuple, got)) == ordered(near_dedup(rows, 85))
    assert len(made) == 2 and made[1] <= len(rows) and sum(made) <= (module.SKETCH + 1) * len(rows)


def test_groups_in_blocks_equal_all_pairs(spark):
    """Large subs in blocks of their own, small ones together; links only between different subs, all connected."""
    rng = random.Random(13)
    words = ["w%d" % k for k in range(3000)]
    core = [rng.choice(words) for _ in range(120)]
    rows = []
    for k in range(60):
        t = list(core)
        for p in rng.sample(range(120), k % 5):
            t[p] = "own%d" % rng.randrange(10 ** 9)
        rows.append((k, " ".join(t)))
    sub = {k: 0 if k < 20 else 20 if k < 35 else k for k, _ in rows}
    sets = {k: set(shingle_set(t.encode(), 5).tolist()) for k, t in rows}

    def closure(edges):
        root = {k: k for k in sub}
        for a, b in [*edges, *sub.items()]:
            x, y = root[a], root[b]
            root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
        return root
    links = {(a, b) for a in sub for b in sub if a < b and sub[a] != sub[b]
             and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    plain = spark.createDataFrame([(k, t.encode()) for k, t in rows], "doc_id long, text binary")
    members = spark.createDataFrame([(k, 7, s) for k, s in sub.items()], "doc_id long, cluster long, sub long")
    with Scratch(spark) as keep:
        for docs in (4, 1000):
            got = {tuple(r) for r in group_links(members, plain, 5, 85, keep, docs).collect()}
            assert got <= links and closure(got) == closure(links)
