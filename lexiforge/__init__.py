"""lexiforge: corpus preparation and experiment analytics on Spark DataFrames.

Sub-packages
------------
sources    readers and writers (Parquet, JSON, CSV, tokenizer artifacts, config)
functions  column expressions (text classes, byte mapping, hashing, vectors)
operators  DataFrame -> DataFrame operators (splits, BPE, encode, examples,
           n-gram model, metrics, grid, routing, decay, segments)
plans      registered queries and their SQL oracles
streaming  Structured Streaming versions of the example and decay operators
"""

from lexiforge.session import get_spark, checkpoint_dir, scratch_path  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir", "scratch_path"]
