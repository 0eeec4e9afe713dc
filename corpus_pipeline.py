"""Corpus pipeline: from raw documents to packed training sequences.

Each stage reads what the one before has kept. All but the last return the
columns of ``documents``, with ``n_chars`` brought up to date.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm.common import NULL_ID, Scratch, table
from lexiforge.llm.line_dedup import dedup_lines
from lexiforge.llm.near_dedup import near_duplicates
from lexiforge.llm.packing import best_fit_pack, token_pieces
from lexiforge.llm.quality_ranker import quality_score
from lexiforge.llm.queries import QUALITY_CUT, SEQUENCE, TOKENIZER, quality_model
from lexiforge.llm.suffix_dedup import remove_repeats

#: Word-shingle similarity, in hundredths, from which documents are near duplicates.
NEAR_PERCENT = 80


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold; a null text is judged as an empty one."""
    ranker = quality_model(docs, table(spark, sf_dir, "labels"))
    return docs.filter(quality_score(ranker, F.col("text")) >= QUALITY_CUT)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines of at least 20 characters that three documents share, but for their last holder."""
    kept = dedup_lines(docs, names=("_n_lines", "_n_dropped")).drop("_n_lines", "_n_dropped")
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document of smallest id; of equal rows one."""
    found = near_duplicates(docs, NEAR_PERCENT).filter("kept")
    stay = found.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("_key"))
    keyed = docs.withColumns({"_key": F.coalesce("doc_id", F.lit(NULL_ID)), "_hash": F.xxhash64("text")})
    return keyed.join(stay, "_key", "left_semi").dropDuplicates(["_key", "_hash"]).select(*docs.columns)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 100 bytes and more that occur earlier."""
    kept = remove_repeats(docs, names=("_n_bytes", "_n_removed", "_n_spans"), as_text=True)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token pieces and their places in sequences."""
    pieces = token_pieces(docs, TOKENIZER, SEQUENCE)
    return best_fit_pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), SEQUENCE)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("best-fit packing", best_fit_packing),
]

#: SQL can express neither the learned classifier nor the tokenizer; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written to shared storage and reread."""
    with Scratch(spark) as keep:
        docs = table(spark, sf_dir, "documents")
        for _, stage in STAGES[:-1]:
            docs = keep(stage(spark, docs, sf_dir))
        return STAGES[-1][1](spark, docs, sf_dir)  # rests on a checkpoint of its pieces, no longer on these tables
