"""The pipeline against its stages done by brute force, and registration."""
import random
import zlib

import numpy as np
from helpers import SCHEMA, as_bytes, edge_rows, line_dedup, near_dedup, ordered, passage, suffix_dedup
from tokenizers import Tokenizer

import __spark_entry__ as E
import corpus_pipeline as P
from lexiforge.llm.queries import QUALITY_CUT, SEQUENCE, TOKENIZER, quality_model
from lexiforge.llm.quality_ranker import NAMES, features

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    rng = random.Random(12)
    rows = edge_rows()
    shared = passage(rng, 60)
    for k in range(100, 160):
        text = passage(rng, rng.randint(20, 90)) + ("\n" + shared if k % 7 == 0 else "")
        rows.append((k, text, "en", "s", len(text)))
        if k % 5 == 0:
            rows.append((k + 1000, text.replace(" ", "  ", 1) + " end", "en", "s", None))
        if k % 6 == 0:
            rows.append((k + 2000, " ".join(rng.choice(["$$$", "!!!", "BUY", "NOW", "###"]) for _ in range(60)), "en", "s", None))
    rows += [(k, " ".join(rng.choice(["$$$", "!!!", "BUY", "NOW", "###"]) for _ in range(50)), "en", "s", 0) for k in range(3000, 3030)]
    return rows + [rows[6], rows[-1]]


def write(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(r[0], 0 if "$$$" in (r[1] or "") else 1, 0) for r in rows if r[0] is not None and r[0] >= 100]
    spark.createDataFrame(labels or [], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_every_stage_equals_brute_force(spark, tmp_path):
    rows = corpus()
    write(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = quality_model(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    score = model.score(np.array([features(as_bytes(r[1])) for r in rows]).reshape(-1, len(NAMES)))
    want = [r for r, s in zip(rows, score) if s >= QUALITY_CUT]
    assert not any("$$$" in (r[1] or "") for r in want) and all(r in want for r in rows if r[0] in range(100, 160))

    got = {}
    for k, (name, stage) in enumerate(P.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        got[name] = docs
        if k < len(P.STAGES) - 1:
            assert docs.columns == COLUMNS
    assert [k for k, _ in P.STAGES] == ["quality classifier", "line dedup", "MinHash near-dedup", "suffix-array dedup", "best-fit packing"]

    def pairs(name):
        return ordered((r["doc_id"], r["text"]) for r in got[name].collect())

    assert pairs("quality classifier") == ordered((r[0], r[1]) for r in want)
    lined = [(i, t) for i, _, _, t in line_dedup([(r[0], r[1]) for r in want])]
    assert pairs("line dedup") == ordered(lined)
    assert all(r["n_chars"] == len(r["text"]) for r in got["line dedup"].collect())
    groups = near_dedup(lined, P.NEAR_PERCENT)
    kept = list({(i, t): None for (i, t), g in zip(lined, groups) if g[3]})
    assert pairs("MinHash near-dedup") == ordered(kept)
    cut = [(r[0], r[4].decode("utf-8", "ignore")) for r in suffix_dedup(kept)]
    assert pairs("suffix-array dedup") == ordered(cut)
    lib = Tokenizer.from_file(TOKENIZER)
    pieces = ordered((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in got["best-fit packing"].collect())
    ids = {i: [*lib.encode(t, add_special_tokens=False).ids, 1] for i, t in cut}
    assert pieces == ordered((i, s, len(v[s:s + SEQUENCE]), zlib.crc32(np.array(v[s:s + SEQUENCE], "<u4").tobytes()))
                             for i, v in ids.items() for s in range(0, len(v), SEQUENCE))
    whole = ordered((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in P.run(spark, str(tmp_path)).collect())
    assert whole == pieces


def test_pipeline_of_nothing(spark, tmp_path):
    write(spark, tmp_path, [])
    assert P.run(spark, str(tmp_path)).count() == 0


def test_one_query_for_each_operator():
    q = E.queries()
    assert "pipeline" in q and [sum(k.startswith(f"op{n}_") for k in q) for n in range(1, 11)] == [1] * 10
    assert set(E.oracle_sql()) <= set(q)
