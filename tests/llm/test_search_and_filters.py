"""Top-k search, url reputation, license scan, quality ranking, fingerprints."""
import hashlib
import math
import random
import re

import numpy as np
import pytest
from helpers import LOWER, SCHEMA, as_bytes, documents, edge_rows, key, ordered, passage, wide
from pyspark.sql import functions as F

from lexiforge.llm import license_scan, merkle
from lexiforge.llm.license_scan import Rule, scan_licenses, signature_rules
from lexiforge.llm.quality_ranker import NAMES, features, fit_ranker, learn_quality, score_quality
from lexiforge.llm.topk_search import exact_topk
from lexiforge.llm.url_reputation import host_path, host_reputation, judge_urls

# --- top-k


def brute_topk(rows, k, wanted):
    take = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, x in take:
        if wanted(q):
            scores = sorted((-min(max(sum(a * b for a, b in zip(x, y)), -2 ** 63), 2 ** 63 - 1), i)
                            for i, y in take if i != q and len(x) == len(y))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return ordered(out)


@pytest.mark.parametrize("scale", [1.0, 1e17])
def test_topk_equals_brute_force(spark, scale):
    rng = random.Random(4)
    centres = [[rng.gauss(0, 1) for _ in range(20)] for _ in range(6)]
    rows = [(k, [scale * (c + rng.gauss(0, 0.2)) for c in rng.choice(centres)]) for k in range(300)]
    rows += [(k, rows[7][1]) for k in range(300, 330)]  # ties
    rows += [(330, None), (331, [None] * 20), (332, [math.nan] * 20), (333, [math.inf] * 20), (None, rows[0][1]),
             (340, []), (350, [0.5] * 3), (360, [0.25] * 3), (370, [0.0] * 20)]
    d = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, score int, b int")
    got = exact_topk(d, F.col("vec_id") % 10 == 0, k=5, block=64, query_block=1)
    assert ordered(map(tuple, got.collect())) == brute_topk(rows, 5, lambda q: q % 10 == 0)


def test_topk_with_repeated_ids_few_candidates_and_none(spark):
    kind = "vec_id long, embedding array<float>"
    d = spark.createDataFrame([(0, [1.0, 2.0]), (0, [1.0, 1.0]), (1, [3.0, 3.0]), (1, [3.0, 3.0])], kind)
    assert [tuple(r) for r in exact_topk(d, F.lit(True), k=5).orderBy("query_id").collect()] == [
        (0, 1, 1, 9 * 1024 ** 2), (1, 1, 0, 9 * 1024 ** 2)]
    assert exact_topk(spark.createDataFrame([], kind), F.lit(True)).count() == 0

# --- urls


def test_host_and_path_of_odd_urls(spark):
    urls = [None, "", "no scheme/x", "http://", "HTTP://EXAMPLE.Com/Ä/?q=/#f", "x://a.b#c/d", "://h/p", "http://É.ORG?x", "a://b://c/d\n/e"]
    d = spark.createDataFrame([(u,) for u in urls], "url string")
    h, p = host_path(F.col("url"))
    want = []
    for u in urls:
        _, sep, rest = (u or "").partition("://")
        host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", rest if sep else "").groups()
        want.append((host.encode().translate(LOWER).decode(), path))
    assert [tuple(r) for r in d.select(h, p).collect()] == want


def test_reputation_shrinks_and_rules_win(spark):
    rows = [("http://bad.x.com/", 0)] * 40 + [("http://good.x.com/", 1)] * 40 + [("http://few.x.com/", 0)] * 2
    rows += [("http://h%d.y.org/" % k, 1) for k in range(30)] + [("http://none.y.org/", None), (None, None)]
    d = spark.createDataFrame(rows, "url string, good int")
    rep = host_reputation(d)
    r = {x["host"]: x for x in rep.collect()}
    assert r["bad.x.com"]["high"] < 0.3 < 0.8 < r["good.x.com"]["low"]
    assert r["bad.x.com"]["rate"] < r["few.x.com"]["rate"] < r["none.y.org"]["rate"]
    assert r["few.x.com"]["domain"] == "x.com" and r["few.x.com"]["suffix"] == "com" and r[""]["n"] == 0
    rules = [("allow", "com/"), ("block", "x.com/en/"), ("allow", "bad.x.com/en/ok")]
    pages = [(1, "http://bad.x.com/"), (2, "http://few.x.com/en/"), (3, "http://bad.x.com/en/ok/1"), (None, None), (4, "a://new.net/"),
             (4, "a://new.net/"), (5, "http://bad.x.com"), (6, "http://bad.x.com?x")]
    p = spark.createDataFrame([(*x, 9, "q") for x in pages], "page_id long, url string, rate int, verdict string")
    got = ordered((x["page_id"], x["rule"], x["verdict"]) for x in judge_urls(p, rep, rules).collect())
    assert got == ordered([(1, "com/", "allow"), (2, "x.com/en/", "block"), (3, "bad.x.com/en/ok", "allow"), (None, None, "allow"),
                           (4, None, "allow"), (4, None, "allow"), (5, None, "block"), (6, None, "block")])
    assert judge_urls(p, host_reputation(d.limit(0)), []).filter("verdict = 'allow'").count() == len(pages)
    assert judge_urls(p.limit(0), rep, rules).count() == 0

# --- licenses


def brute_scan(text, rules):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", as_bytes(text).translate(LOWER))
    joined = " " + b" ".join(words).decode() + " "
    found = []
    for r in rules:
        for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", joined):
            first = joined[:m.start()].count(" ") - 1
            found.append((first, first + m[0].count(" "), r))
    base = [f for f in found if f[2].base]
    more = sorted({(a, -b, -r.priority, r.label, r.confidence) for a, b, r in found if not r.base})
    kept = []
    for a, b, p, label, sure in more:
        if not any(e >= -b and q >= -p for e, q in [(x[1], x[2]) for x in kept]):
            kept.append((a, -b, -p, label, sure))
    starts = [f[0] for f in base]
    labels = sorted({f[2].label for f in base} | {x[3] for x in kept})
    return (len(words), len(base), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({f[2].label for f in base})), ",".join(labels),
            max([f[2].confidence for f in base] + [x[4] for x in kept], default=0.0))


LICENSES = ["Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0. CC BY-NC-SA 4.0", "x" * 5, None, "",
            "Released under the MIT License.\nunder the mit license UNDER THE MIT LICENSE", "MIT", "Élicense mit licenseé",
            "This work is licensed under the GNU General Public License, version 3.", "GNU Lesser General Public License v2.1",
            "All rights reserved; see the Mozilla Public License 2.0", "SPDX-License-Identifier: BSD-3-Clause license",
            "cc by nc cc by nc cc by nc", "apache license version 2 apache license version 2 0", "dedicated to the public domain",
            " ".join(["under the mit license"] * 3000), "a \u212a license under the MIT\x7flicense"]


def test_licenses_equal_brute_force(spark):
    rules = signature_rules()
    assert len(rules) > 250
    rows = [(k, t) for k, t in enumerate(LICENSES + [r[1] for r in edge_rows()])] + [(None, LICENSES[0]), (1, LICENSES[1])]
    d = spark.createDataFrame([(*r, 1, "l") for r in rows], "doc_id long, text string, n_words int, labels string")
    got = scan_licenses(d).drop("detections").collect()
    assert ordered(map(tuple, got)) == ordered((i, *brute_scan(t, rules)) for i, t in rows)
    assert scan_licenses(d.limit(0)).count() == 0


def test_license_containment_and_gate(spark):
    rules = [Rule("long", "b", "a b c d", 1, 0.4), Rule("inside", "b", "b c", 1, 0.6), Rule("above", "c", "c", 2, 0.8),
             Rule("overlap", "d", "d e", 0, 0.3)]
    d = spark.createDataFrame([(1, "a b c d e"), (2, "B-C")], "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in scan_licenses(d, rules, parts=(), whole=("b",)).collect()}
    assert got == {1: "above,long,overlap", 2: "above,inside"}
    for r in signature_rules():  # whatever a rule needs, the gate must let pass
        least = re.sub(r"\(\?:[^()]*\)\?", "", r.pattern)
        assert any(p in least.replace("[cs]", "s") for p in (*license_scan.PARTS, "licen")) or "cc" in least, r


SPELLINGS = [
    ("Creative Commons Attribution-NonCommercial 4.0", "cc-by-nc"), ("Creative Commons Attribution-ShareAlike", "cc-by-sa"),
    ("Creative Commons Attribution-NonCommercial-ShareAlike", "cc-by-nc-sa"), ("Creative Commons Attribution", "cc-by"),
    ("Creative Commons Attribution-NonCommercial-NoDerivs", "cc-by-nc-nd"), ("under the Expat license", "mit"),
    ("Creative Commons Attribution Non-Commercial No Derivatives", "cc-by-nc-nd"), ("see the X11 License", "mit"),
    ("0BSD license", "bsd-0"), ("released under 0BSD licence", "bsd-0"), ("zero-clause BSD", "bsd-0"), ("GPLv3", "gpl-3")]


def _alternatives(parsed):
    """All strings of a pattern; what may repeat stands there not at all and once."""
    out = [""]
    for op, arg in parsed:
        kind = str(op)
        if kind == "LITERAL":
            more = [chr(arg)]
        elif kind == "IN":
            more = [chr(c) for k, v in arg for c in ([v] if str(k) == "LITERAL" else range(v[0], v[1] + 1))]
        elif kind == "SUBPATTERN":
            more = _alternatives(arg[3])
        elif kind == "BRANCH":
            more = [x for a in arg[1] for x in _alternatives(a)]
        else:
            assert kind == "MAX_REPEAT" and arg[:2] == (0, 1)
            more = ["", *_alternatives(arg[2])]
        out = [x + y for x in out for y in more]
    return out


def test_license_spellings_pass_the_keywords(spark):
    d = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(SPELLINGS)], "doc_id long, text string")
    got = {r["doc_id"]: r["labels"].split(",") for r in scan_licenses(d).collect()}
    assert [x for k, x in enumerate(SPELLINGS) if x[1] not in got[k]] == []
    rules = signature_rules()
    assert got == {k: brute_scan(t, rules)[5].split(",") for k, (t, _) in enumerate(SPELLINGS)}
    names = [Rule(label, word, name, 1, 0.6) for label, word, name in license_scan.NAMES]
    for r in [*names, *license_scan.OTHERS, *license_scan.BASE]:  # forms put words around a name only
        words = license_scan.keywords(r)
        for x in _alternatives(re._parser.parse(r.pattern)):
            assert any(f" {w}" in f" {x}" for w in words), (r, x)


# --- quality


def junk(rng):
    return " ".join(rng.choice(["$$$", "!!!", "BUY", "NOW", "###"]) for _ in range(60))


def test_ranker_orders_held_out_rows(spark):
    rng = random.Random(6)
    rows = [(k, junk(rng) if k % 4 == 0 else passage(rng, 60)) for k in range(400)]
    labels = [(k, int(k % 4 != 0)) for k in range(200)] + [(None, 1), (3, None), (10 ** 9, 0)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    d = spark.createDataFrame([(*r, 0.1) for r in rows + [(None, None), (400, "")]], "doc_id long, text string, score double")
    model = learn_quality(d, lab, at=0.3)
    got = {r["doc_id"]: r["score"] for r in score_quality(d, model).collect()}
    assert len(got) == 402 and all(0 <= s <= 1 for s in got.values()) and got[None] == got[400]
    assert all((got[k] >= 0.3) == (k % 4 != 0) for k in range(200, 400))
    small = learn_quality(d, lab, sample=40)
    held = score_quality(d, small).filter("doc_id >= 200").collect()
    assert np.mean([(r["score"] >= 0.5) == (r["doc_id"] % 4 != 0) for r in held]) > 0.95
    nothing = learn_quality(d, lab.limit(0), at=0.3)
    assert {round(r["score"], 9) for r in score_quality(d, nothing).collect()} == {0.3}
    assert score_quality(d.limit(0), model).count() == 0


def test_features_are_defined_for_every_text():
    for r in edge_rows():
        x = features(as_bytes(r[1]))
        assert len(x) == len(NAMES) and np.isfinite(x).all()
    one = fit_ranker(np.zeros((5, len(NAMES))), np.ones(5, int), at=0.4)
    assert np.allclose(one.score(np.zeros((2, len(NAMES)))), 0.4)

# --- fingerprints


def test_fingerprints_and_edits(spark):
    rng = random.Random(8)
    rows = [(r[0], r[1]) for r in edge_rows()] + [(k, passage(rng, rng.randint(0, 40))) for k in range(-300, 0)]
    rows += [(7, rows[6][1]), (rows[5][0], "again")]
    for d, rows_a_range in ((documents(spark, [(*r, None, None, None) for r in rows]), 20), (wide(spark), 1000)):
        want, data = [], [(key(r["doc_id"]), r["text"] or "") for r in d.collect()]
        data.sort(key=lambda r: (r[0], r[1]))
        got = merkle.compare_with_edit(d, rows_a_range=rows_a_range).collect()
        assert len(got) == len(data)
        ids = [i for i, _ in data]
        for r in got:
            assert r["n_chars"] - r["n_chars"] // 3 <= len(r["edited"]) <= r["n_chars"] and r["fingerprint"].count(";") >= (r["n_chars"] > 0)
        single = [k for k, i in enumerate(ids) if ids.count(i) == 1 and ids.count(ids[k - 1]) == 1]
        by_id = {r["doc_id"]: r for r in got}
        for k in single:
            i, t = data[k]
            f = data[k - 1][1]
            e = merkle.edited(t, f)
            a, b, c = (merkle.merkle_tree(x) for x in (t, e, f))
            want = (len(t), e, str(a), str(b), merkle.likeness(a, b), merkle.likeness(a, c))
            assert tuple(by_id[None if i == key(None) else i])[1:] == want
    assert merkle.compare_with_edit(spark.createDataFrame([], SCHEMA)).count() == 0
    one = merkle.compare_with_edit(documents(spark, [(1, "abc def", None, None, None)])).first()
    assert one["edited"] == "abc dab" and one["near_next"] == 1.0


def test_trees_locate_edits_and_survive_writing():
    rng = random.Random(9)
    lines = [passage(rng, 30) for _ in range(60)]
    a = merkle.merkle_tree("\n".join(lines))
    changed = [*lines[:17], lines[17].replace(" ", " new ", 1), *lines[18:]]
    b = merkle.merkle_tree("\n".join(changed))
    found = merkle.compare(a, b)
    assert {x[0] for x in found.left} == {x[0] for x in found.right} == {17} and 0.9 < merkle.likeness(a, b) < 1
    # both roots, the section that holds the line and the line itself, on each side (a changed line may move a border)
    assert found.opened <= 10 < len(a.sections) + len(lines)
    assert merkle.compare(a, a) == merkle.Comparison([], [], 0)
    moved = merkle.compare(a, merkle.merkle_tree("\n".join([lines[0], "new line", *lines[1:]])))
    assert moved.left == [] and {x[0] for x in moved.right} == {1} and moved.opened <= 8
    for t in (a, b, merkle.merkle_tree("")):
        assert merkle.Tree.parse(str(t)) == t
    assert merkle.likeness(merkle.merkle_tree(""), merkle.merkle_tree("")) == 1.0
    assert merkle.likeness(merkle.merkle_tree(""), a) == 0.0 and a.root != merkle.merkle_tree("\n".join(lines) + "\n").root
    prose = "\n".join(passage(rng, 60) for _ in range(80))
    assert len(str(merkle.merkle_tree(prose))) < 0.1 * len(prose.encode())


def test_trees_against_plain_hashing():
    """Node hashes by a plain recursion, likeness by the leaves of both texts alone, without any tree."""
    from base64 import b64encode
    from collections import Counter

    def plain(text):
        data, leaves, groups, group = text.encode("utf-8", "surrogatepass"), Counter(), [], []
        for number, line in enumerate(data.split(b"\n") if data else []):
            parts, rest = [], line
            while rest:  # up to so many words or marks, each with what ends it
                cut = count = 0
                size = [2, 3, 4, 6, 8][len(parts)] if number == 0 and len(parts) < 5 else 14
                while cut < len(rest) and count < size:
                    end = next((k for k in range(cut, len(rest)) if rest[k:k + 1] in b" ,.;:!?"), None)
                    if end is None:
                        cut = cut or len(rest)
                        break
                    cut, count = end + 1, count + 1
                parts.append(rest[:cut])
                rest = rest[cut:]
            leaves.update(parts)
            hashes = [hashlib.blake2b(b"l" + x, digest_size=16).digest() for x in parts]
            group.append((hashlib.blake2b(b"p" + b"".join(hashes), digest_size=16).digest(), hashes))
            if group[-1][0][0] % 8 == 0:
                groups, group = [*groups, group], []
        groups += [group] if group else []
        tops = [hashlib.blake2b(b"s" + b"".join(h for h, _ in g), digest_size=16).digest() for g in groups]
        written = hashlib.blake2b(b"r" + b"".join(tops), digest_size=16).hexdigest()
        for top, g in zip(tops, groups):
            written += ";" + b64encode(top[:6]).decode()
            for h, below in g:
                written += "," + b64encode(b"".join(x[:3] for x in [h, *below])).decode()
        return written, leaves

    rng = random.Random(10)
    texts = [r[1] or "" for r in edge_rows()] + ["", "\n", "\n\n", "a", "a,", "\ud800 x"]
    texts += ["\n".join(passage(rng, rng.randint(0, 40)) for _ in range(rng.randint(1, 12))) for _ in range(60)]
    texts += [merkle.edited(t, texts[k - 1]) for k, t in enumerate(texts)]
    trees = [merkle.merkle_tree(t) for t in texts]
    for k, (t, tree) in enumerate(zip(texts, trees)):
        written, leaves = plain(t)
        assert str(tree) == written and tree.n == leaves.total()
        for j in {k - 1, (k + len(texts) // 2) % len(texts), rng.randrange(len(texts))}:
            other = plain(texts[j])[1]
            n = leaves.total() + other.total()
            want = 1.0 if t == texts[j] else 2 * (leaves & other).total() / n if n else 0.0
            assert abs(merkle.likeness(tree, trees[j]) - want) < 1e-12
            assert (tree.root == trees[j].root) == (t == texts[j])


def test_fingerprints_of_all_rows(spark):
    got = merkle.fingerprints(documents(spark)).collect()
    assert ordered(map(tuple, got)) == ordered((r[0], str(merkle.merkle_tree(r[1] or ""))) for r in edge_rows())
