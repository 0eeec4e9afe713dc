"""Line dedup and suffix dedup against brute force, on edge rows."""
import tracemalloc

import pyarrow as pa
import pytest
from helpers import SCHEMA, documents, edge_rows, line_dedup, ordered, suffix_dedup, wide

from lexiforge.llm import line_dedup as lines
from lexiforge.llm.line_dedup import dedup_lines
from lexiforge.llm.suffix_dedup import remove_repeats

ROWS = [(r[0], r[1]) for r in edge_rows()]


@pytest.mark.parametrize("bits", [1 << 16, 1 << 20])
def test_lines_equal_brute_force_whatever_the_filter_size(spark, bits):
    got = dedup_lines(documents(spark).repartition(3), bits=bits).select("doc_id", "n_lines", "n_dropped", "text").collect()
    assert ordered(map(tuple, got)) == ordered(line_dedup(ROWS))


def test_lines_repeated_rows_keep_together_and_ties(spark):
    rows = [(1, "x" * 20), (1, "x" * 20), (2, " " + "X" * 20), (2, "x" * 20 + "\ny"), (3, "x" * 19)]
    d = documents(spark, [(*r, None, None, None) for r in rows])
    got = dedup_lines(d).select("doc_id", "n_lines", "n_dropped", "text").collect()
    assert ordered(map(tuple, got)) == ordered(line_dedup(rows))


def test_lines_of_a_wide_and_an_empty_table(spark):
    out = dedup_lines(wide(spark))
    assert set(out.columns) == set(wide(spark).columns) | {"n_dropped"}
    assert ordered((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in out.collect()) == ordered(line_dedup(ROWS))
    assert {(r["c0"], r["row"]["text"]) for r in out.collect()} == {("c", "x")}
    assert dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        dedup_lines(wide(spark), bits=1000)


def test_a_task_holds_its_line_filters_as_bits():
    bits = 1 << 26
    texts = [f"{k:030d}\n{k % 7:040d}".encode() for k in range(200)]
    tracemalloc.start()
    got = list(lines.filter_pieces([pa.RecordBatch.from_pydict({"text": texts})], 20, bits))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * bits // 8  # two filters of bits / 8 bytes; a byte for each bit takes 16 times as much
    rows = [r for b in got for r in b.to_pylist()]
    of = {x: lines._bits(lines.np.frombuffer(lines._digest(x), "<u8").reshape(-1, 2), bits)[0] for t in texts for x in t.split(b"\n")}
    for name, least in (("once", 1), ("twice", 2)):
        found = {r["segment"] * lines.SEGMENT + i for r in rows for i in lines.np.flatnonzero(lines.np.unpackbits(lines._packed(r[name])))}
        assert found == {i for x, at in of.items() for i in at.tolist() if sum(x in t.split(b"\n") for t in texts) >= least}


def test_repeats_equal_brute_force(spark):
    got = remove_repeats(documents(spark).repartition(4)).select("doc_id", "n_bytes", "n_removed", "n_spans", "text").collect()
    assert ordered((*r[:4], bytes(r[4])) for r in got) == ordered(suffix_dedup(ROWS))


def test_repeats_within_and_across_documents_at_another_depth(spark):
    rows = [(2, "abcdefghij" * 20), (1, "xyz" + "abcdefghij" * 5), (1, "xyz" + "abcdefghij" * 5), (3, "q" * 39), (4, "q" * 41), (5, None)]
    d = documents(spark, [(*r, None, None, None) for r in rows])
    got = remove_repeats(d, depth=40).select("doc_id", "n_bytes", "n_removed", "n_spans", "text").collect()
    assert ordered((*r[:4], bytes(r[4])) for r in got) == ordered(suffix_dedup(rows, 40))
    with pytest.raises(ValueError):
        remove_repeats(d, depth=8)


def test_repeats_as_text_drop_torn_characters_and_keep_columns(spark):
    out = remove_repeats(wide(spark), as_text=True)
    want = {r[0]: r[4].decode("utf-8", "ignore") for r in suffix_dedup(ROWS)}
    assert {r["doc_id"]: r["text"] for r in out.collect()} == want
    assert set(wide(spark).columns) <= set(out.columns)
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
