"""Shared storage for intermediate tables: lineage ends at what is written there, so lost executors lose nothing."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors see: the session's spark.checkpoint.dir.

    Where it is unset, local mode (tests) gets a temporary folder of its own; a
    cluster raises, since no other folder is known to be shared.
    """
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if given:
        return given.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="strandlake-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return "file://" + _own[app]


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path in its form."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, hadoop = file_system(spark, path)
    fs.deleteOnExit(hadoop)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read back."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._strandlake_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove what materialize() wrote; for generations that nothing reads any more."""
    if path := getattr(df, "_strandlake_path", None):
        fs, hadoop = file_system(df.sparkSession, path)
        fs.delete(hadoop, True)


def write_bytes(spark: SparkSession, path: str, body: bytes) -> str:
    """A small file in any file system that Spark knows; the path."""
    fs, hadoop = file_system(spark, path)
    out = fs.create(hadoop, True)
    out.write(bytearray(body))
    out.close()
    return path
