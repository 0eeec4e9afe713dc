"""Readers and writers: corpora, split directories, CSV/JSON result tables,
tokenizer artifacts, emissions files and the run configuration.

Everything goes through ``spark.read`` / ``df.write`` (the Hadoop file-system
layer resolves local, HDFS or object-store URIs). Paths for intermediate and
result tables come from ``lexiforge.session.scratch_path`` (shared storage).
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_corpus(spark: SparkSession, path: str, fmt: str = "parquet", glob: str | None = None,
                recursive: bool = False, columns: list | None = None, schema=None) -> DataFrame:
    """Scan a corpus directory or glob; ``columns`` prunes the scan."""
    r = spark.read.format(fmt)
    if schema is not None:
        r = r.schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if recursive:
        r = r.option("recursiveFileLookup", "true")
    try:
        df = r.load(path)
    except Exception as e:  # surface a missing dataset clearly
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            raise ValueError(f"dataset path does not exist: {path}") from e
        raise
    return df.select(*columns) if columns else df


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list | None = None, **options) -> str:
    w = df.write.mode(mode).format(fmt)
    for k, v in options.items():
        w = w.option(k, v)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
    return path


def write_splits(split_df: DataFrame, path: str) -> str:
    """One write for all splits: ``split=train/validation/test`` sub-directories."""
    return write_table(split_df, path, partition_by=["split"])


def read_split(spark: SparkSession, path: str, splits: list) -> DataFrame:
    """Read chosen splits; the filter prunes whole directories."""
    return spark.read.parquet(path).filter(F.col("split").isin(*splits))


def append_csv(df: DataFrame, path: str, header: bool = True, quote_all: bool = False) -> str:
    return write_table(df, path, fmt="csv", mode="append", header=str(header).lower(),
                       quoteAll=str(quote_all).lower(), escape='"',
                       ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false")


def read_csv(spark: SparkSession, path: str, schema, header: bool = True) -> DataFrame:
    return spark.read.schema(schema).option("header", str(header).lower()).option("escape", '"').option(
        "ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)


# ---- fixed values: emissions file, 31 typed columns, geo fields may be empty -----
EMISSIONS_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampType()), T.StructField("project_name", T.StringType()),
    T.StructField("run_id", T.StringType()), T.StructField("duration", T.DoubleType()),
    T.StructField("emissions", T.DoubleType()), T.StructField("emissions_rate", T.DoubleType()),
    T.StructField("cpu_power", T.DoubleType()), T.StructField("gpu_power", T.DoubleType()),
    T.StructField("ram_power", T.DoubleType()), T.StructField("cpu_energy", T.DoubleType()),
    T.StructField("gpu_energy", T.DoubleType()), T.StructField("ram_energy", T.DoubleType()),
    T.StructField("energy_consumed", T.DoubleType()), T.StructField("country_name", T.StringType()),
    T.StructField("country_iso_code", T.StringType()), T.StructField("region", T.StringType()),
    T.StructField("cloud_provider", T.StringType()), T.StructField("cloud_region", T.StringType()),
    T.StructField("os", T.StringType()), T.StructField("python_version", T.StringType()),
    T.StructField("codecarbon_version", T.StringType()), T.StructField("cpu_count", T.IntegerType()),
    T.StructField("cpu_model", T.StringType()), T.StructField("gpu_count", T.IntegerType()),
    T.StructField("gpu_model", T.StringType()), T.StructField("longitude", T.DoubleType()),
    T.StructField("latitude", T.DoubleType()), T.StructField("ram_total_size", T.DoubleType()),
    T.StructField("tracking_mode", T.StringType()), T.StructField("on_cloud", T.StringType()),
    T.StructField("pue", T.DoubleType()),
])


def to_emissions_schema(df: DataFrame) -> DataFrame:
    """Fill missing emission columns with NULL, in file column order."""
    cols = []
    for f in EMISSIONS_SCHEMA.fields:
        c = F.col(f.name) if f.name in df.columns else F.lit(None)
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)


def read_emissions(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, EMISSIONS_SCHEMA)


# ---- tokenizer artifact: three tables -------------------------------------------
def save_tokenizer(vocab: DataFrame, merges: DataFrame, meta: dict, path: str) -> str:
    spark = vocab.sparkSession
    write_table(vocab, f"{path}/vocab")
    write_table(merges, f"{path}/merges")
    rows = [(str(k), str(v)) for k, v in meta.items()]
    write_table(spark.createDataFrame(rows, "key string, value string"), f"{path}/meta")
    return path


@dataclass
class LoadedTokenizer:
    """What an encoder and a decoder need: as many entries as the vocabulary has."""
    vocab: DataFrame
    merge_table: DataFrame
    byte_ids: list
    merges: list
    vocab_hex: list
    meta: dict


def load_tokenizer(spark: SparkSession, path: str) -> LoadedTokenizer:
    """Read a saved tokenizer; vocabulary and merges (bounded by ``vocab_size``) also as lists."""
    meta = {r["key"]: r["value"] for r in spark.read.parquet(f"{path}/meta").collect()}  # a few rows
    vocab, merge_table = spark.read.parquet(f"{path}/vocab"), spark.read.parquet(f"{path}/merges")
    rows = vocab.orderBy("id").collect()
    special = {int(v) for k, v in meta.items() if k.endswith("_id")}
    byte_ids = [int(meta["unk_id"])] * 256
    for r in rows:
        if len(r["hex"]) == 2 and r["id"] not in special:
            byte_ids[int(r["hex"], 16)] = r["id"]
    merges = [(r["left_id"], r["right_id"], r["new_id"]) for r in merge_table.orderBy("rank").collect()]
    return LoadedTokenizer(vocab, merge_table, byte_ids, merges, [r["hex"] for r in rows], meta)


# ---- run configuration --------------------------------------------------------
NULL_STRINGS = {"None", "none", "null", "~", ""}


def normalise(value: Any) -> Any:
    """YAML 'None' strings become real nulls (the string would name a file 'None')."""
    return None if isinstance(value, str) and value.strip() in NULL_STRINGS else value


@dataclass(frozen=True)
class RunConfig:
    """Validated settings of a corpus/model run (frozen: no dynamic attributes)."""
    dataset_feature: str = "text"
    splits: tuple = (0.7, 0.2, 0.1)
    rand_seed: int = 42
    vocab_size: int = 50000
    seq_len: int = 512
    batch_size: int = 8
    num_workers: int = 2
    learning_rate: float = 0.001
    gamma: float = 0.9
    early_stopping: int = 3
    save_top_k: int = 3
    every_n_hours: float | None = None
    every_n_train_steps: int | None = None
    accumulate_grad_batches: int = 1
    tasks: tuple = ()
    csv_path: str | None = None
    extra: dict = field(default_factory=dict)

    @staticmethod
    def from_dict(d: dict) -> "RunConfig":
        known = {f for f in RunConfig.__dataclass_fields__ if f != "extra"}
        vals = {k: normalise(v) for k, v in d.items()}
        kw = {k: (tuple(v) if isinstance(v, list) else v) for k, v in vals.items() if k in known}
        cfg = RunConfig(**kw, extra={k: v for k, v in vals.items() if k not in known})
        cfg.validate()
        return cfg

    def validate(self) -> None:
        if abs(sum(self.splits) - 1.0) > 1e-9 or len(self.splits) != 3:
            raise ValueError(f"splits must be three shares summing to 1: {self.splits}")
        if self.seq_len <= 0 or self.batch_size <= 0:
            raise ValueError("seq_len and batch_size must be positive")


def config_table(spark: SparkSession, cfg: RunConfig, per_row: int = 4) -> DataFrame:
    """'key: value' cells, ``per_row`` per row, in field order (a record of the run)."""
    items = [(k, v) for k, v in asdict(cfg).items() if k != "extra"] + list(cfg.extra.items())
    cells = [f"{k}: {v}" for k, v in items]
    rows = [(i // per_row, i % per_row, c) for i, c in enumerate(cells)]
    df = spark.createDataFrame(rows, "row int, col int, cell string")
    return df.groupBy("row").pivot("col", list(range(per_row))).agg(F.first("cell"))


# ---- shard store -------------------------------------------------------------------------------------------------
def write_shards(df: DataFrame, path: str, n_parts: int | None = None) -> str:
    """Rows with ``shard_columns`` as ``path/rank=.../worker=...``, each shard in a few files that follow its order.

    Rows are cut into ranges of (rank, worker, idx_in_shard): a shard of any size is split over tasks, and a task
    writes one or two directories only.
    """
    n = n_parts or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    keys = ["rank", "worker", "idx_in_shard"]
    df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).write.partitionBy("rank", "worker").parquet(path)
    return path


def read_shard(spark: SparkSession, path: str, rank: int, worker: int) -> DataFrame:
    """The rows of one loader worker; no other shard's directory is opened."""
    return spark.read.parquet(path).filter((F.col("rank") == rank) & (F.col("worker") == worker))
