"""Corpus scans, blank filter, splits and pre-tokenization."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiforge.functions.text import pretokenize, unicode_strip, utf8_bytes
from lexiforge.operators import bpe, splits
from lexiforge.operators.ordering import ordered_index
from lexiforge.plans.params import (RATIOS, SEED, SQL_NONBLANK, sql_bytes, sql_pretokenize,
                                    sql_split_docs, SQL_CP)
from lexiforge.plans.registry import register, table


def split_docs(spark, sf_dir):
    return splits.split_corpus(table(spark, sf_dir, "documents"), ratios=RATIOS, seed=SEED)


def train_docs(spark, sf_dir):
    return split_docs(spark, sf_dir).filter(F.col("split") == "train")


@register("scan_corpus", sql="SELECT doc_id, text, lang, source, n_chars FROM documents")
def scan_corpus(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")


@register("scan_feature", sql="SELECT text FROM documents")
def scan_feature(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("text")


@register("filter_blank", sql=f"""
SELECT doc_id, n_chars FROM documents WHERE regexp_matches(text, '{SQL_NONBLANK}')""")
def filter_blank(spark, sf_dir):
    return splits.filter_blank(table(spark, sf_dir, "documents")).select("doc_id", "n_chars")


@register("null_passthrough", sql=f"""
SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE CAST(len({sql_pretokenize('text')}) AS INTEGER) END AS n_words
FROM documents""")
def null_passthrough(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.when(F.col("text").isNotNull(), F.size(pretokenize(F.col("text"))))
                    .cast("int").alias("n_words"))


@register("split_three_way", sql=f"WITH s AS ({sql_split_docs()}) SELECT doc_id, split FROM s")
def split_three_way(spark, sf_dir):
    return split_docs(spark, sf_dir).select("doc_id", "split")


@register("split_report", sql=f"""
WITH s AS ({sql_split_docs()}), c AS (SELECT split, count(*) AS n_rows FROM s GROUP BY split)
SELECT split, n_rows, round(n_rows / sum(n_rows) OVER (), 6) AS share,
       round(CASE split WHEN 'train' THEN {RATIOS[0]} WHEN 'validation' THEN {RATIOS[1]} ELSE {RATIOS[2]} END
             / {sum(RATIOS)!r}, 6) AS target
FROM c""")
def split_report(spark, sf_dir):
    return splits.split_report(split_docs(spark, sf_dir), RATIOS)


@register("split_invariants", sql=f"""
WITH s AS ({sql_split_docs()}),
     k AS (SELECT doc_id, count(DISTINCT split) AS n_splits FROM s GROUP BY doc_id),
     src AS (SELECT DISTINCT doc_id, 1 AS in_source FROM documents WHERE regexp_matches(text, '{SQL_NONBLANK}')),
     j AS (SELECT * FROM src FULL OUTER JOIN k USING (doc_id))
SELECT CAST(coalesce(sum(CASE WHEN n_splits > 1 THEN 1 END), 0) AS BIGINT) AS keys_in_two_splits,
       CAST(coalesce(sum(CASE WHEN n_splits IS NULL THEN 1 END), 0) AS BIGINT) AS missing_keys,
       CAST(coalesce(sum(CASE WHEN in_source IS NULL THEN 1 END), 0) AS BIGINT) AS extra_keys
FROM j""")
def split_invariants(spark, sf_dir):
    src = splits.filter_blank(table(spark, sf_dir, "documents"))
    return splits.split_invariants(src, split_docs(spark, sf_dir))


@register("split_shuffle", sql=f"""
WITH s AS ({sql_split_docs()})
SELECT doc_id, split, row_number() OVER (PARTITION BY split ORDER BY md5('{SEED}:' || CAST(doc_id AS VARCHAR))) - 1 AS pos_in_split
FROM s""")
def split_shuffle(spark, sf_dir):
    s = splits.shuffle_within_split(split_docs(spark, sf_dir).select("doc_id", "split"), seed=SEED)
    # a split holds up to 70 % of the rows: skew-safe ordered index, not a window per split
    return ordered_index(s, ["split"], ["shuffle_key"], "pos_in_split").select("doc_id", "split", "pos_in_split")


@register("pretokenize", sql=f"""
WITH w AS (SELECT doc_id, {sql_pretokenize('text')} AS words FROM documents)
SELECT doc_id, unnest(range(0, len(words))) AS pos, unnest(words) AS word FROM w""")
def pretokenize_q(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(pretokenize(F.col("text"))).alias("pos", "word")) \
        .withColumn("pos", F.col("pos").cast("bigint"))


@register("word_counts", sql=f"""
WITH s AS ({sql_split_docs()})
SELECT word, count(*) AS cnt FROM (SELECT unnest({sql_pretokenize('text')}) AS word FROM s WHERE split = 'train')
GROUP BY word""")
def word_counts(spark, sf_dir):
    return bpe.word_counts(train_docs(spark, sf_dir))


@register("word_bytes", sql=f"""
WITH s AS ({sql_split_docs()}),
     w AS (SELECT DISTINCT unnest({sql_pretokenize('text')}) AS word FROM s WHERE split = 'train')
SELECT word, CAST(strlen(word) AS INTEGER) AS n_bytes, array_to_string({sql_bytes('hex(encode(word))')}, ',') AS bytes_csv
FROM w""")
def word_bytes(spark, sf_dir):
    w = bpe.word_counts(train_docs(spark, sf_dir)).select("word")
    b = utf8_bytes(F.col("word"))
    return w.select("word", F.size(b).cast("int").alias("n_bytes"), F.array_join(b, ",").alias("bytes_csv"))


@register("bpe_alphabet", sql=f"""
WITH s AS ({sql_split_docs()}),
     b AS (SELECT DISTINCT unnest({sql_bytes('hex(encode(text))')}) AS b FROM s WHERE split = 'train')
SELECT b AS byte, CAST(row_number() OVER (ORDER BY {SQL_CP}) + 2 AS INTEGER) AS id, chr({SQL_CP}) AS token
FROM b""")
def bpe_alphabet(spark, sf_dir):
    return bpe.alphabet(bpe.word_counts(train_docs(spark, sf_dir)))


@register("unicode_strip", sql=r"""
SELECT doc_id, CAST(length(regexp_replace(text, '^[\s\x0b\x1c-\x1f\x{85}\p{Z}]+|[\s\x0b\x1c-\x1f\x{85}\p{Z}]+$', '', 'g')) AS INTEGER) AS stripped_len
FROM documents""")
def unicode_strip_q(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.length(unicode_strip(F.col("text"))).cast("int").alias("stripped_len"))
