from pyspark.sql import functions as F

from lexiforge.functions.text import pretokenize, unicode_strip, utf8_bytes
from lexiforge.operators.splits import filter_blank, split_corpus

BLANK = ["", "   ", "\t\n", "\u00a0", "\u2028", "\u001c", "\u0085"]
KEPT = ["\u200b", " a "]


def test_blank_filter_matches_python_strip(spark):
    rows = [(i, t) for i, t in enumerate(BLANK + KEPT)] + [(99, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in filter_blank(df).collect()}
    assert kept == {i for i, t in enumerate(BLANK + KEPT) if t.strip() != ""}
    kept_null = {r["doc_id"] for r in filter_blank(df, keep_null=True).collect()}
    assert 99 in kept_null


def test_blank_class_equals_python_strip_on_bmp(spark):
    chars = [chr(c) for c in range(0x3000 + 1) if not 0xD800 <= c <= 0xDFFF]
    df = spark.createDataFrame([(c,) for c in chars], "text string")
    spark_blank = {r["text"] for r in df.filter(~F.col("text").rlike(r"[^\s\x0B\x1C-\x1F\x85\p{Z}]")).collect()}
    assert spark_blank == {c for c in chars if c.strip() == ""}


def test_word_regex_edge_row(spark):
    text = "Hello  world's 123abc!!\n\n x\u00a0y  "
    df = spark.createDataFrame([(text,)], "text string")
    words = df.select(pretokenize(F.col("text")).alias("w")).first()["w"]
    assert words == ["Hello", " ", " world", "'s", " 123", "abc", "!!", "\n\n", " x", "\u00a0", "y", "  "]
    assert "".join(words) == text


def test_pretokenize_concatenates_back(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bad = docs.filter(F.array_join(pretokenize(F.col("text")), "") != F.col("text")).count()
    assert bad == 0


def test_unicode_strip_and_bytes(spark):
    df = spark.createDataFrame([("  hé  ",)], "t string")
    r = df.select(unicode_strip(F.col("t")).alias("s"), utf8_bytes(F.lit("hé")).alias("b")).first()
    assert r["s"] == "hé" and r["b"] == [104, 195, 169]


def test_split_is_deterministic_and_complete(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a = split_corpus(docs).select("doc_id", "split")
    b = split_corpus(docs.repartition(7)).select("doc_id", "split")
    assert a.exceptAll(b).count() == 0 and a.count() == docs.count()
    swapped = split_corpus(docs, reference_order=True).select("doc_id", "split")
    assert {r["split"] for r in swapped.collect()} <= {"train", "validation", "test"}
