"""Encoding and decoding whole corpora with a learned byte-level BPE.

Encode is a *narrow* operator: the JVM splits text into words
(``regexp_extract_all``), then one Arrow pass per partition maps words to ids.
Each batch finds its distinct words with Arrow's C++ dictionary encoding, each
partition encodes a distinct word once (merge ranks travel with the function;
their size is bounded by the vocabulary) and ids are expanded with numpy
gathers, so there is no per-token Python work, no shuffle and no join of token
positions.

Decode is narrow too: an Arrow pass gathers the bytes of every id from one flat
table of the vocabulary (bounded by ``vocab_size``, sent with the function).
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiforge.functions.text import BOS_ID, PAD_ID, UNK_ID, pretokenize


#: Distinct words that a task keeps encoded between batches.
MAX_CACHED_WORDS = 500_000
#: Ids that one Arrow batch of byte-level ids holds, at most (a longer text is a batch of its own).
CHUNK_IDS = 2_000_000


def _bpe_word(ids: list, ranks: dict) -> list:
    """Merge the lowest-ranked adjacent pair (leftmost on ties) until none.

    A heap of (rank, position) over a linked list of symbols: n log n in the
    length of the word. An entry is stale when its pair is no longer there.
    """
    n = len(ids)
    if n < 2:
        return ids
    ids, right, left = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r[0], i) for i in range(n - 1) if (r := ranks.get((ids[i], ids[i + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        j = right[i]
        if ids[i] is None or j >= n:
            continue
        r = ranks.get((ids[i], ids[j]))
        if r is None or r[0] != rank:
            continue
        ids[i], ids[j], right[i] = r[1], None, right[j]
        if right[j] < n:
            left[right[j]] = i
        for a, b in ((left[i], i), (i, right[i])):
            if a >= 0 and b < n and (r := ranks.get((ids[a], ids[b]))) is not None:
                heapq.heappush(heap, (r[0], a))
    return [x for x in ids if x is not None]


def _encoder(byte_ids: list, merges: list, add_bos: bool):
    ranks = {(a, b): (r, n) for r, (a, b, n) in enumerate(merges)}
    lut = np.asarray(byte_ids, dtype=np.int64)

    def encode_word(w: str) -> list:
        return _bpe_word(lut[np.frombuffer(w.encode("utf-8"), dtype=np.uint8)].tolist(), ranks)

    def fn(batches):
        cache: dict = {}
        for b in batches:
            if len(cache) > MAX_CACHED_WORDS:
                cache.clear()
            words = b.column("_words")
            if isinstance(words, pa.ChunkedArray):
                words = words.combine_chunks()
            valid = np.asarray(words.is_valid().to_numpy(zero_copy_only=False))
            n_words = np.diff(np.asarray(words.offsets.to_numpy())).astype(np.int64)
            n_words[~valid] = 0
            flat = words.flatten()
            if len(flat):
                # distinct words found in C++; only those become Python strings
                de = pc.dictionary_encode(flat)
                inverse = de.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                uniq = de.dictionary.to_pylist()
            else:
                inverse, uniq = np.array([], np.int64), []
            enc = []
            for w in uniq:
                v = cache.get(w)
                if v is None:
                    v = encode_word(w)
                    cache[w] = v
                enc.append(v)
            ulen = np.fromiter((len(v) for v in enc), dtype=np.int64, count=len(enc))
            uval = np.fromiter((x for v in enc for x in v), dtype=np.int64, count=int(ulen.sum()))
            ustart = np.concatenate([[0], np.cumsum(ulen)[:-1]]) if len(ulen) else ulen
            wlen = ulen[inverse] if len(flat) else np.array([], np.int64)
            # gather ids of every word occurrence in order
            total = int(wlen.sum())
            starts = np.repeat(ustart[inverse] if len(flat) else wlen, wlen)
            within = np.arange(total, dtype=np.int64) - np.repeat(np.cumsum(wlen) - wlen, wlen)
            vals = uval[starts + within] if total else np.array([], np.int64)
            # per-document token counts (sum of word lengths), plus <bos>
            word_doc = np.repeat(np.arange(len(n_words)), n_words)
            doc_len = np.bincount(word_doc, weights=wlen, minlength=len(n_words)).astype(np.int64)
            if add_bos:
                doc_len = doc_len + valid.astype(np.int64)
                bos_at = np.concatenate([[0], np.cumsum(doc_len)[:-1]])[valid]
                out = np.empty(int(doc_len.sum()), dtype=np.int64)
                mask = np.ones(len(out), dtype=bool)
                mask[bos_at] = False
                out[~mask] = BOS_ID
                out[mask] = vals
                vals = out
            offsets = np.concatenate([[0], np.cumsum(doc_len)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(vals, pa.int64()),
                                           mask=pa.array(~valid))
            cols = [b.column(i) for i, name in enumerate(b.schema.names) if name != "_words"]
            names = [n for n in b.schema.names if n != "_words"]
            yield pa.RecordBatch.from_arrays(cols + [ids], names=names + ["ids"])

    return fn


def encode_corpus(df: DataFrame, byte_ids: list, merges: list, feature: str = "text",
                  keep: tuple = (), add_bos: bool = True) -> DataFrame:
    """(keep..., ids array<bigint>): one id list per row; NULL text -> NULL ids.

    Unknown bytes become one ``<unk>`` id each; ``<bos>`` is put in front.
    """
    cols = [F.col(c) for c in keep]
    staged = df.select(*cols, pretokenize(F.col(feature)).alias("_words"))
    schema = T.StructType([f for f in staged.schema.fields if f.name != "_words"]
                          + [T.StructField("ids", T.ArrayType(T.LongType()))])
    return staged.mapInArrow(_encoder(byte_ids, merges, add_bos), schema)


def byte_level_ids(text: Column, byte_ids: list, add_bos: bool = True, first: int | None = None, last: int | None = None) -> Column:
    """Zero-merge encoding as a native expression (alphabet lookup per byte); of all ids or of the ``first`` or ``last`` so many."""
    from lexiforge.functions.text import utf8_bytes
    lut = F.array(*[F.lit(int(x)) for x in byte_ids])
    some = first - add_bos if first is not None else None
    ids = F.transform(utf8_bytes(text, some, last), lambda b: F.element_at(lut, b + 1).cast("bigint"))
    if not add_bos:
        return ids
    with_bos = F.concat(F.array(F.lit(BOS_ID).cast("bigint")), ids)
    return with_bos if last is None else F.when(F.octet_length(text) < last, with_bos).otherwise(ids)


def flat_bytes(col: pa.Array):
    """UTF-8 bytes of a string column, one after the other, and the length of each row's (0 for a null)."""
    col = pc.fill_null(col, "")
    size = pc.binary_length(col).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.frombuffer(col.buffers()[1], np.int64 if pa.types.is_large_string(col.type) else np.int32)
    start = int(offsets[col.offset]) if len(col) else 0
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[start:start + int(size.sum())]
    return data, size


def row_chunks(size: np.ndarray, limit: int):
    """(first row, end row) of stretches of at most ``limit`` elements together, or of one longer row."""
    ends, lo = np.cumsum(size), 0
    while lo < len(size):
        before = int(ends[lo - 1]) if lo else 0
        hi = max(int(np.searchsorted(ends, before + limit, "right")), lo + 1)
        yield lo, hi
        lo = hi


def _byte_encoder(byte_ids: list, feature: str, add_bos: bool):
    lut = np.asarray(byte_ids, np.int64)

    def fn(batches):
        for batch in batches:
            whole = pc.binary_length(batch.column(feature)).fill_null(0).to_numpy(zero_copy_only=False)
            for lo, hi in row_chunks(whole, CHUNK_IDS):
                b = batch.slice(lo, hi - lo)
                col = b.column(feature)
                valid = col.is_valid().to_numpy(zero_copy_only=False)
                data, size = flat_bytes(col)
                n = size + (valid if add_bos else 0)
                ends = np.cumsum(n)
                ids = np.full(int(n.sum()), BOS_ID, np.int64)
                real = np.ones(len(ids), bool)
                if add_bos:
                    real[(ends - n)[valid]] = False
                ids[real] = lut[data]
                out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids), mask=pa.array(~valid))
                names = [c for c in b.schema.names if c != feature]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), out], names=[*names, "ids"])

    return fn


def encode_bytes(df: DataFrame, byte_ids: list, feature: str = "text", keep: tuple = (), add_bos: bool = True) -> DataFrame:
    """(keep..., ids array<bigint>): ``byte_level_ids`` of whole texts in one Arrow pass, a table lookup for each batch."""
    staged = df.select(*keep, F.col(feature).alias("_text"))
    schema = T.StructType([f for f in staged.schema.fields if f.name != "_text"] + [T.StructField("ids", T.ArrayType(T.LongType()))])
    return staged.mapInArrow(_byte_encoder(byte_ids, "_text", add_bos), schema)


def _decoder(vocab_hex: list, ids: str, out: str):
    tokens = [bytes.fromhex(h) for h in vocab_hex]
    flat = np.frombuffer(b"".join(tokens), np.uint8)
    size = np.asarray([len(t) for t in tokens], np.int64)
    start = np.cumsum(size) - size

    def fn(batches):
        for b in batches:
            col = b.column(ids)
            valid = col.is_valid().to_numpy(zero_copy_only=False)
            per_row = np.where(valid, pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False), 0)
            i = col.flatten().to_numpy()
            n = size[i]
            ends = np.cumsum(n)
            at = np.repeat(start[i] - (ends - n), n) + np.arange(int(n.sum()))
            text = flat[at].tobytes()
            cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per_row)])]
            texts = [text[lo:hi].decode("utf-8", "replace") if ok else None
                     for ok, lo, hi in zip(valid.tolist(), cuts[:-1].tolist(), cuts[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, out])

    return fn


def decode_corpus(df: DataFrame, vocab_hex: list, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` and the text of its id lists; special tokens decode to their literal names, a null list to null."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])
    return df.mapInArrow(_decoder(vocab_hex, ids, out), schema)


def truncate_ids(ids: Column, length: int) -> Column:
    """Keep the first ``length`` ids (right truncation)."""
    return F.slice(ids, 1, length)


def pad_ids(ids: Column, length: int, pad_id: int = PAD_ID) -> Column:
    """Right-pad with ``pad_id`` up to ``length`` (longer lists stay as they are)."""
    fill = F.greatest(F.lit(0), F.lit(length) - F.size(ids))
    return F.concat(ids, F.array_repeat(F.lit(pad_id).cast("bigint"), fill))


__all__ = ["encode_corpus", "encode_bytes", "byte_level_ids", "decode_corpus", "truncate_ids", "pad_ids", "UNK_ID"]
