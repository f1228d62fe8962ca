"""Session helpers: tables, checkpoints and sizes that a plan may rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Most rows that may be copied to every task. Callers check a table's size against it first.
MAX_BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; a temporary one only where none is set, as in tests."""
    jsc = spark.sparkContext._jsc.sc()
    set_dir = jsc.getCheckpointDir()
    if set_dir.isDefined():
        return set_dir.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")  # one machine, as in tests
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write a result that several later stages read to the shared folder, so that a lost executor costs no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _hadoop_path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on the store it names."""
    fs, p = _hadoop_path(spark, path)
    return fs.exists(p)


def list_paths(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that match a pattern on the store it names, in order."""
    fs, p = _hadoop_path(spark, pattern)
    return sorted(str(s.getPath()) for s in fs.globStatus(p) or [])


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop_path(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path on the shared store."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
