import pytest

from lexiforge.operators import bpe, encode

tokenizers = pytest.importorskip("tokenizers")


def wheel(texts, vocab_size):
    from tokenizers import Tokenizer, pre_tokenizers, processors
    from tokenizers.models import BPE
    from tokenizers.trainers import BpeTrainer
    tok = Tokenizer(BPE(unk_token="<unk>"))
    tok.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    tok.train_from_iterator(iter(texts), trainer=BpeTrainer(vocab_size=vocab_size, show_progress=False,
                                                            special_tokens=["<pad>", "<bos>", "<unk>"]))
    tok.post_processor = processors.TemplateProcessing(single="<bos> $A", special_tokens=[("<bos>", 1)])
    return tok


def train(spark, texts, vocab_size):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    return bpe.train_bpe(bpe.word_counts(df), vocab_size)


def vocab_of(spark, model):
    return {r["token"]: r["id"] for r in bpe.vocab_frame(spark, model).collect()}


def test_self_pairs_match_wheel(spark):
    texts = ["aaaa aaa aaaaa baaab xyxyxyx zz zzz zzzzzz"] * 3 + ["aaaaaaa zzzzzzzz xyxy"] * 2
    for v in (20, 26, 32):
        model = train(spark, texts, v)
        assert vocab_of(spark, model) == wheel(texts, v).get_vocab()


def test_corpus_vocab_and_encoding_match_wheel(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id")
    texts = [r["text"] for r in docs.select("text").collect()]
    model = train(spark, texts[:150], 260)
    tok = wheel(texts[:150], 260)
    assert vocab_of(spark, model) == tok.get_vocab()
    held = spark.createDataFrame([(i, t) for i, t in enumerate(texts[150:])], "doc_id long, text string")
    enc = encode.encode_corpus(held, model.byte_ids, model.merges, keep=("doc_id", "text")).collect()
    assert all(tok.encode(r["text"]).ids == list(r["ids"]) for r in enc)


def test_every_number_of_merges_matches_wheel(spark):
    """Training may stop after any merge, whatever the round; with few pairs held, refreshes come often."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(40)
    texts = [r["text"] for r in docs.select("text").collect()]
    wc = bpe.word_counts(spark.createDataFrame([(t,) for t in texts], "text string"))
    for merges, pairs in ((33, 64), (34, bpe.PAIRS), (40, 7)):
        model = bpe.train_bpe(wc, merges=merges, pairs=pairs)
        assert len(model.merges) == merges
        assert vocab_of(spark, model) == wheel(texts, len(model.vocab)).get_vocab()


def test_round_reports_changes_of_touched_words_only():
    import numpy as np
    import pyarrow as pa
    words = pa.RecordBatch.from_pydict({"syms": pa.array([[5, 6, 5, 6], [7, 8], [5, 5, 5]], pa.list_(pa.int32())),
                                        "cnt": pa.array([2, 100, 3], pa.int64())})
    block, = bpe.words_to_blocks([words])
    out = list(bpe._round([], [(5, 6, 9), (5, 5, 10)])([block]))
    change = {(s, a, b): c for o in out[1:] for s, a, b, c in zip(*(o.column(k).to_pylist() for k in ("step", "left", "right", "change")))}
    assert change == {(0, 5, 6): -4, (0, 6, 5): -2, (0, 9, 9): 2, (1, 5, 5): -6, (1, 10, 5): 3}
    after = list(bpe._round([(5, 6, 9), (5, 5, 10)], [])([out[0]]))[0]
    assert np.frombuffer(after.column("syms")[0].as_py(), np.int32).tolist() == [9, 9, -1, 7, 8, -1, 10, 5, -1]


def test_unseen_bytes_and_empty_text(spark):
    model = train(spark, ["abc abc ab"], 10)
    df = spark.createDataFrame([(0, ""), (1, "日"), (2, None)], "doc_id long, text string")
    out = {r["doc_id"]: r["ids"] for r in encode.encode_corpus(df, model.byte_ids, model.merges, keep=("doc_id",)).collect()}
    assert out[0] == [1] and out[1] == [1, 2, 2, 2] and out[2] is None


def test_decode_round_trip(spark):
    texts = ["hello world, hello spark"]
    model = train(spark, texts, 40)
    hexes = [bytes(model.vocab[i]).hex().upper() if i >= 3 else t.encode().hex().upper()
             for i, t in zip(range(len(model.vocab)), ["<pad>", "<bos>", "<unk>"] + [""] * len(model.vocab))]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    enc = encode.encode_corpus(df, model.byte_ids, model.merges, keep=("text",))
    r = encode.decode_corpus(enc, hexes).first()
    assert r["decoded"] == "<bos>" + r["text"]


def test_changes_leave_a_task_summed_and_a_block_is_passed_over_once(monkeypatch):
    """Many merges of one round and many blocks: one pass a block, one row a step and pair."""
    import pyarrow as pa
    words = pa.RecordBatch.from_pydict({"syms": pa.array([[5, 6, 7, 8], [7, 8, 5, 6, 5, 6], [4, 7, 8]], pa.list_(pa.int32())),
                                        "cnt": pa.array([2, 3, 10], pa.int64())})
    block, = bpe.words_to_blocks([words])
    passes, places = [], bpe._places
    monkeypatch.setattr(bpe, "_places", lambda *a: passes.append(1) or places(*a))
    out = list(bpe._round([], [(5, 6, 9), (7, 8, 10)])([block, block]))
    rows = [r for o in out if o.column("kind")[0].as_py() == 1 for r in zip(*(o.column(k).to_pylist() for k in ("step", "left", "right", "change")))]
    assert len(passes) == 2 and len(rows) == len({r[:3] for r in rows})
    assert {r[:3]: r[3] for r in rows} == {
        (0, 5, 6): -16, (0, 6, 7): -4, (0, 9, 7): 4, (0, 8, 5): -6, (0, 8, 9): 6, (0, 6, 5): -6, (0, 9, 9): 6,
        (1, 7, 8): -30, (1, 9, 7): -4, (1, 9, 10): 4, (1, 8, 9): -6, (1, 10, 9): 6, (1, 4, 7): -20, (1, 4, 10): 20}


def test_merges_that_overlap_are_taken_in_turn():
    import numpy as np
    import pyarrow as pa
    words = pa.RecordBatch.from_pydict({"syms": pa.array([[5, 6, 7, 5, 6], [5, 5, 5, 6]], pa.list_(pa.int32())), "cnt": pa.array([1, 1], pa.int64())})
    block, = bpe.words_to_blocks([words])
    merges = [(5, 6, 9), (6, 7, 10), (9, 7, 11), (5, 5, 12)]
    assert [len(m) for m in bpe._together(merges)] == [1, 2, 1]
    after = list(bpe._round(merges, [])([block]))[0]
    assert np.frombuffer(after.column("syms")[0].as_py(), np.int32).tolist() == [11, 9, -1, 12, 9, -1]
