"""Where tables are read from and where intermediate results are put.

Intermediate results are written as Parquet below the shared folder that the
cluster names in ``spark.checkpoint.dir``: every executor sees them, so a lost
executor costs only the tasks it was running.  A folder of this machine is used
only where that setting is absent and the master is local (tests).
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; falls back to a temporary one on a local master only."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="threadmill-")
    return _own_dir


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder if it is there."""
    fs, at = _filesystem(spark, path)
    fs.delete(at, True)


def stamp(spark: SparkSession, path: str) -> tuple[int, int]:
    """Size and time of the latest change of a file or folder."""
    fs, at = _filesystem(spark, path)
    times = [s.getModificationTime() for s in fs.listStatus(at)]
    return fs.getContentSummary(at).getLength(), max([fs.getFileStatus(at).getModificationTime(), *times])


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, deleted when this process ends."""
    path = f"{shared_dir(spark)}/threadmill/{what}-{uuid.uuid4().hex}"

    def drop() -> None:
        try:
            delete(spark, path)
        except Exception:  # the JVM may be gone already
            pass

    atexit.register(drop)
    return path


def settle(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` in at least as many partitions as there are cores.

    For work that costs far more than reading does (Python over texts): a small
    input of few files would otherwise leave cores idle.  Larger inputs already
    have more partitions and aren't shuffled.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n, key)
