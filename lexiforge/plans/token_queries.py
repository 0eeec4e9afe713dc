"""Tokenizer queries (T5-T15): pair counts, merges, BPE training, encode, decode."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiforge.functions.text import SPECIAL_TOKENS
from lexiforge.operators import bpe, encode
from lexiforge.plans.corpus_queries import split_docs, train_docs
from lexiforge.plans.params import (SEED, SEQ_LEN, SQL_ALPHA_MAP, VOCAB_SIZE, sql_alphabet, sql_bytes, sql_pretokenize,
                                    sql_split_docs, sql_token_ctes)
from lexiforge.plans.registry import register, table
from lexiforge.session import scratch_path
from lexiforge.sources import io


def byte_vocab(spark, sf_dir):
    """(byte -> id list of 256, vocab hex list, vocab size) of the byte-level vocabulary (at most 256 rows)."""
    rows = bpe.text_alphabet(train_docs(spark, sf_dir)).collect()   # <= 256 rows
    lut = bpe.byte_id_table(rows)
    vocab_hex = [t.encode("utf-8").hex().upper() for t in SPECIAL_TOKENS]
    vocab_hex += [f"{r['byte']:02X}" for r in sorted(rows, key=lambda r: r["id"])]
    return lut, vocab_hex, len(vocab_hex)


_SAVED: dict = {}


def saved_tokenizer(spark, sf_dir) -> str:
    """Path of a tokenizer of VOCAB_SIZE ids learned on the training split; learned once a session and input."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _SAVED:
        model = bpe.train_bpe(bpe.word_counts(train_docs(spark, sf_dir)), VOCAB_SIZE)
        _SAVED[key] = io.save_tokenizer(bpe.vocab_frame(spark, model), bpe.merges_frame(spark, model),
                                        {"pad_id": 0, "bos_id": 1, "unk_id": 2, "template": "<bos> $A"},
                                        scratch_path(spark, "tokenizer"))
    return _SAVED[key]


def learned_tokens(spark, sf_dir, path: str | None = None, keep=("doc_id", "split")):
    """Every document's ids by the saved and reloaded tokenizer."""
    tok = io.load_tokenizer(spark, path or saved_tokenizer(spark, sf_dir))
    return encode.encode_corpus(split_docs(spark, sf_dir), tok.byte_ids, tok.merges, keep=keep), tok


def byte_tokens(spark, sf_dir, lut=None, **cut):
    """(doc_id, split, ids): every document as byte-level ids with <bos>; ``first`` or ``last`` so many ids of each."""
    lut = lut or byte_vocab(spark, sf_dir)[0]
    if not cut:
        return encode.encode_bytes(split_docs(spark, sf_dir), lut, keep=("doc_id", "split"))
    return split_docs(spark, sf_dir).select(
        "doc_id", "split", encode.byte_level_ids(F.col("text"), lut, **cut).alias("ids"))


def train_word_symbols(spark, sf_dir):
    wc = bpe.word_counts(train_docs(spark, sf_dir))
    lut, _, _ = byte_vocab(spark, sf_dir)
    return bpe.to_symbols(wc, lut)


_WORD_SYMS = f"""
splitdocs AS MATERIALIZED ({sql_split_docs()}), alpha AS MATERIALIZED ({sql_alphabet()}), alpha_map AS MATERIALIZED ({SQL_ALPHA_MAP}),
wc AS MATERIALIZED (SELECT word, count(*) AS cnt FROM (SELECT unnest({sql_pretokenize('text')}) AS word FROM splitdocs WHERE split = 'train') GROUP BY word),
ws AS MATERIALIZED (SELECT word, cnt, list_transform({sql_bytes('hex(encode(word))')}, lambda b: m[b + 1]) AS syms FROM wc, alpha_map),
pc AS MATERIALIZED (SELECT p.l AS left_id, p.r AS right_id, CAST(sum(cnt) AS BIGINT) AS cnt
       FROM (SELECT cnt, unnest(list_transform(range(1, len(syms)), lambda i: {{'l': syms[i], 'r': syms[i + 1]}})) AS p FROM ws WHERE len(syms) >= 2)
       GROUP BY p.l, p.r)"""


@register("bpe_pair_counts", sql=f"WITH {_WORD_SYMS} SELECT left_id, right_id, cnt FROM pc")
def bpe_pair_counts(spark, sf_dir):
    return bpe.pair_counts(train_word_symbols(spark, sf_dir)).withColumnRenamed(
        "left", "left_id").withColumnRenamed("right", "right_id")


@register("bpe_best_pair", sql=f"""
WITH {_WORD_SYMS}
SELECT CAST(row_number() OVER (ORDER BY cnt DESC, left_id, right_id) AS INTEGER) AS pair_rank, left_id, right_id, cnt
FROM pc ORDER BY cnt DESC, left_id, right_id LIMIT 10""")
def bpe_best_pair(spark, sf_dir):
    top = bpe.top_pairs(bpe.pair_counts(train_word_symbols(spark, sf_dir)), 10).withColumnRenamed(
        "left", "left_id").withColumnRenamed("right", "right_id")
    # 10 rows: a single-partition window over the top-k result is bounded
    from pyspark.sql.window import Window
    return top.withColumn("pair_rank", F.row_number().over(
        Window.orderBy(F.desc("cnt"), "left_id", "right_id")).cast("int"))


@register("bpe_merge_once", sql=f"""
WITH {_WORD_SYMS},
best AS MATERIALIZED (SELECT left_id, right_id FROM pc ORDER BY cnt DESC, left_id, right_id LIMIT 1),
nid AS (SELECT vocab_size AS new_id FROM alpha_map),
enc AS (SELECT word, '<' || array_to_string(syms, '><') || '>' AS s FROM ws),
mer AS (SELECT word, replace(s, '<' || left_id || '><' || right_id || '>', '<' || new_id || '>') AS s FROM enc, best, nid)
SELECT word, replace(substr(s, 2, length(s) - 2), '><', ',') AS syms_csv FROM mer""")
def bpe_merge_once(spark, sf_dir):
    words = train_word_symbols(spark, sf_dir)
    best = bpe.top_pairs(bpe.pair_counts(words), 1).collect()[0]      # one row
    lut, vocab_hex, vsize = byte_vocab(spark, sf_dir)
    merged = words.withColumn("syms", bpe.merge_expr([(best["left"], best["right"], vsize)]))
    return merged.select("word", F.array_join("syms", ",").alias("syms_csv"))


@register("bpe_train")
def bpe_train(spark, sf_dir):
    """The merges learned on the training split: (rank, ids, token); tests compare them with the public trainer."""
    tok = io.load_tokenizer(spark, saved_tokenizer(spark, sf_dir))
    return tok.merge_table.join(tok.vocab.select(F.col("id").alias("new_id"), "token"), "new_id").select(
        "rank", "left_id", "right_id", "new_id", "token")


@register("tokenize_corpus")
def tokenize_corpus(spark, sf_dir):
    """All splits in one job with the saved tokenizer: (doc_id, split, n_tokens, ids_csv)."""
    enc, _ = learned_tokens(spark, sf_dir)
    return enc.select("doc_id", "split", F.size("ids").alias("n_tokens"),
                      F.array_join("ids", ",").alias("ids_csv"))


# whatever the merges are, a text comes back unless a byte of it is not in the alphabet of the training split
@register("detokenize", sql=f"""
WITH {sql_token_ctes()}
SELECT doc_id, len(list_filter(ids, lambda i: i = 2)) = 0 AS roundtrip_ok,
       CAST(len(list_filter(ids, lambda i: i = 2)) AS INTEGER) AS n_unk FROM toks""")
def detokenize(spark, sf_dir):
    """Merged ids back to text, with the vocabulary of the saved tokenizer."""
    enc, tok = learned_tokens(spark, sf_dir, keep=("doc_id", "text"))
    back = encode.decode_corpus(enc, tok.vocab_hex, out="decoded")
    return back.select("doc_id", (F.col("decoded") == F.concat(F.lit("<bos>"), F.col("text"))).alias("roundtrip_ok"),
                       F.size(F.filter("ids", lambda i: i == 2)).cast("int").alias("n_unk"))


@register("truncate_tokens", sql=f"""
WITH {sql_token_ctes()}
SELECT doc_id, array_to_string(list_slice(ids, 1, {SEQ_LEN + 1}), ',') AS ids_csv FROM toks""")
def truncate_tokens(spark, sf_dir):
    t = byte_tokens(spark, sf_dir, first=SEQ_LEN + 1)
    return t.select("doc_id", F.array_join(encode.truncate_ids(F.col("ids"), SEQ_LEN + 1), ",").alias("ids_csv"))


@register("pad_tokens", sql=f"""
WITH {sql_token_ctes()}
SELECT doc_id, array_to_string(list_concat(list_slice(ids, 1, {SEQ_LEN + 1}),
       list_transform(range(0, greatest(0, {SEQ_LEN + 1} - len(list_slice(ids, 1, {SEQ_LEN + 1})))), lambda i: 0)), ',') AS ids_csv
FROM toks""")
def pad_tokens(spark, sf_dir):
    t = byte_tokens(spark, sf_dir, first=SEQ_LEN + 1)
    padded = encode.pad_ids(encode.truncate_ids(F.col("ids"), SEQ_LEN + 1), SEQ_LEN + 1)
    return t.select("doc_id", F.array_join(padded, ",").alias("ids_csv"))


@register("special_ids", sql=f"""
WITH {sql_token_ctes()},
sp AS (SELECT * FROM (VALUES ('<pad>', 0), ('<bos>', 1), ('<unk>', 2)) v(token, id)),
occ AS (SELECT i AS id, count(*) AS n FROM (SELECT unnest(ids) AS i FROM toks) WHERE i < 3 GROUP BY i)
SELECT token, CAST(id AS INTEGER) AS id, CAST(coalesce(n, 0) AS BIGINT) AS occurrences FROM sp LEFT JOIN occ USING (id)""")
def special_ids(spark, sf_dir):
    t = byte_tokens(spark, sf_dir)
    occ = (t.select(F.explode("ids").alias("id")).filter(F.col("id") < 3)
           .groupBy("id").agg(F.count(F.lit(1)).alias("n")))
    sp = spark.createDataFrame([(tok, i) for i, tok in enumerate(SPECIAL_TOKENS)], "token string, id int")
    return (sp.join(F.broadcast(occ.withColumn("id", F.col("id").cast("int"))), "id", "left")
            .select("token", "id", F.coalesce("n", F.lit(0)).cast("bigint").alias("occurrences")))


@register("tokenize_splits")
def tokenize_splits(spark, sf_dir):
    """One job tokenizes every split with the saved tokenizer into a typed array<bigint>
    table partitioned by split; a reader of chosen splits prunes the other directories."""
    enc, _ = learned_tokens(spark, sf_dir)
    path = io.write_splits(enc, scratch_path(spark, "tokenized"))
    t = io.read_split(spark, path, ["train", "validation", "test"])
    return t.select("doc_id", "split", F.size("ids").cast("int").alias("n_tokens"),
                    F.array_join("ids", ",").alias("ids_csv"))


@register("random_tokens", sql=f"""
WITH {sql_token_ctes()},
b AS (SELECT item_id, CAST(strlen(text) + 1 AS INTEGER) AS n FROM benchmark)
SELECT item_id, CAST(unnest(range(0, n)) AS INTEGER) AS i,
       CAST(floor(unnest(list_transform(range(0, n), lambda j: (('0x' || substr(md5('{SEED}:' || CAST(item_id AS VARCHAR) || ':' || CAST(j AS VARCHAR)), 1, 8))::BIGINT) / 4294967296.0)) * vocab_size) AS BIGINT) AS token_id
FROM b, alpha_map""")
def random_tokens(spark, sf_dir):
    """Uniform random ids in [0, V) per benchmark item, as long as the item's token list
    (deterministic: keyed by seed, item and position)."""
    from lexiforge.functions.hashing import keyed_uniform
    _, _, vsize = byte_vocab(spark, sf_dir)
    b = table(spark, sf_dir, "benchmark").select(
        "item_id", (F.octet_length("text") + 1).cast("int").alias("n"))
    r = b.select("item_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    return r.select("item_id", F.col("i").cast("int"),
                    F.floor(keyed_uniform(SEED, F.col("item_id"), F.col("i")) * vsize).cast("bigint").alias("token_id"))
