"""Helpers shared by the operators: input columns, reliable lineage cuts, batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.plans.registry import table
from lexiforge.session import cut_lineage, scratch_path

__all__ = ["NULL_ID", "Carried", "Scratch", "batch_rows", "cut_lineage", "id_text", "partitions", "real_id", "sized_slices", "table"]

#: A null identifier inside an operator: smaller than every other one.
NULL_ID = -(2 ** 63)


def id_text(docs: DataFrame, id_col: str, text_col: str, keep: bool = False) -> DataFrame:
    """``doc_id`` (no nulls), ``text`` (no nulls) and, with ``keep``, the whole input row as ``row``."""
    cols = [F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)).alias("doc_id"),
            F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")]
    if keep:
        cols.append(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return docs.select(*cols)


def real_id(col: str = "doc_id") -> Column:
    return F.when(F.col(col) != NULL_ID, F.col(col))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def sized_slices(batch: pa.RecordBatch, text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of about ``limit`` text bytes (one row at least)."""
    ends = pc.cumulative_sum(pc.binary_length(batch.column(text))).to_numpy(zero_copy_only=False)
    lo = base = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(ends.searchsorted(base + limit, "right")))
        yield batch.slice(lo, hi - lo)
        lo, base = hi, int(ends[hi - 1])


def batch_rows(columns: dict[str, pa.Array], size: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``size`` rows."""
    whole = pa.RecordBatch.from_pydict(columns)
    for lo in range(0, whole.num_rows, size):
        yield whole.slice(lo, size)


class Carried:
    """An input whose columns travel under neutral names, so that no name can clash.

    ``df`` has ``c0, c1, ...``; ``id`` and ``text`` are the names of two of them.
    """

    def __init__(self, docs: DataFrame, id_col: str, text_col: str):
        self.docs, self.columns = docs, docs.columns
        self.names = [f"c{k}" for k in range(len(self.columns))]
        self.id, self.text = (self.names[self.columns.index(c)] for c in (id_col, text_col))
        self.df = docs.toDF(*self.names)

    def fields(self) -> str:
        return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in self.df.schema.fields)

    def restored(self, df: DataFrame, more: dict[str, str]) -> DataFrame:
        """The input's names again, and ``more``: new name by the name in ``df``; a new name replaces an old column."""
        old = [F.col(n).alias(c) for n, c in zip(self.names, self.columns) if c not in more.values()]
        return df.select(*old, *[F.col(n).alias(c) for n, c in more.items()])


class Scratch:
    """Tables of one operator's steps, written to the shared checkpoint folder and deleted at the end.

    Executors can be lost between steps: what a step has written stays. Calling
    it with a DataFrame writes and rereads it.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> Scratch:
        self.root = scratch_path(self.spark, "steps")
        self.count = 0
        return self

    def __call__(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        # shuffle files of a finished step go as soon as the driver's JVM has collected its garbage
        self.spark.sparkContext._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(path)

    def __exit__(self, *_) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
