"""Session helpers: building a session for tests/bench and locating shared storage.

The shared folder comes from ``spark.checkpoint.dir`` (set by the cluster); where
it is unset, from the warehouse directory. No machine-local folder is used.
"""

from __future__ import annotations

import atexit
import os
import uuid

from pyspark.sql import SparkSession

_SCRATCH_ROOTS: set = set()

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int = 8,
              app: str = "lexiforge", extra: dict | None = None) -> SparkSession:
    """Session for tests and the bench script (cluster jobs bring their own)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "8g")
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: ``spark.checkpoint.dir``, as the cluster sets it.

    Where it is unset (tests, a notebook) a folder under the warehouse directory,
    which driver and executors share as well, is set for the session.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None)
    sc.setCheckpointDir(conf or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for an intermediate or output table in shared storage.

    ``lexiforge.output.dir`` wins if set; otherwise a sub-folder of the
    checkpoint folder is used.
    """
    root = spark.conf.get("lexiforge.output.dir", None)
    if not root:
        root = f"{checkpoint_dir(spark).rstrip('/')}/lexiforge-tables"
        if root not in _SCRATCH_ROOTS:
            _SCRATCH_ROOTS.add(root)
            atexit.register(_drop_scratch, spark, root)
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df, name: str = "table"):
    """``df`` written once to shared storage and read back: its size is known to the optimizer,
    and what reads it does not compute it again. Scratch tables go when the session ends."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df) -> None:
    """Delete the files of a table that ``stored`` has written; nothing may read it afterwards."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for root in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(hadoop).delete(path, True)


def _drop_scratch(spark: SparkSession, root: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session is gone already
        pass


def cut_lineage(df):
    """Reliable checkpoint (never a local one): survives executor loss."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")
