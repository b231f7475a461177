"""Where a plan is cut: written tables and checkpoints in the folder all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple] = []  # (path, its file system's configuration), both of the JVM


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Only a session without one (a test on one
    machine) gets a temporary folder of its own."""
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="vdjloom-")
    sc.setCheckpointDir(path)
    return sc._jsc.sc().getCheckpointDir().get()


def new_path(spark: SparkSession, suffix: str = "") -> str:
    """A new place in the shared folder, which release() deletes."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}{suffix}"
    _written.append((spark._jvm.org.apache.hadoop.fs.Path(path), spark._jsc.hadoopConfiguration()))
    return path


def settle(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """df written once to the shared folder and read back: later passes read the files
    (columns pruned, filters pushed), and a lost executor costs only its running tasks."""
    path = new_path(df.sparkSession)
    out = df.write.mode("overwrite")
    (out.partitionBy(*partition_by) if partition_by else out).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release() -> int:
    """Deletes what was written through new_path(), and tells how many places; frames that read them cannot
    be computed any more. It runs by itself when the program ends."""
    n = 0
    while _written:
        path, conf = _written.pop()
        try:
            n += bool(path.getFileSystem(conf).delete(path, True))
        except Exception:  # the JVM is gone: the folder stays to whoever set it
            return n
    return n


atexit.register(release)
