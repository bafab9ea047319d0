"""The folder that driver and executors share, and lineage cuts through it."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint folder.

    Only a local master, which has no other machines, gets one made where neither is set; a cluster gets an error.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="citegrid-checkpoint-"))
        found = sc.getCheckpointDir()
    return found


#: Paths that shared_path() gave, by application.
_MADE: dict[str, list[str]] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for tables between steps; see discard_intermediates()."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def discard_intermediates(spark: SparkSession) -> None:
    """Delete what stands under the paths of shared_path(). Results are lazy and read from there, so this is for the caller,
    once the results have been written."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for made in _MADE.pop(spark.sparkContext.applicationId, []):
        path = jvm.org.apache.hadoop.fs.Path(made)
        path.getFileSystem(conf).delete(path, True)


@contextlib.contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of each query that is run go as soon as it has ended."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        gc.collect()
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def checkpoint(df: DataFrame) -> DataFrame:
    """df, computed once and read from the checkpoint folder from here on, so that plans of loops stay flat."""
    base, sc = shared_dir(df.sparkSession), df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return df.checkpoint(eager=True)


def settled(df: DataFrame, name: str) -> DataFrame:
    """df, written in the shared folder and read again. Its shuffle files go at once (those of a checkpoint stay), so that the
    disk holds those of one such step only."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    with dropping_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
