"""Cutting long lineages so that a lost executor never replays a whole pipeline."""

from __future__ import annotations

import threading
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

#: Spark removes the shuffle files of an execution when it ends.
_REMOVE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock, _inside, _before = threading.Lock(), Counter(), {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    The session names it in ``spark.checkpoint.dir`` or by ``setCheckpointDir``; without one
    there is nowhere to write, local or not.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not configured:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(configured)
    return configured


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """While what is inside is written, each execution's shuffle files go when it ends.

    Written rows need no shuffle to be read again; otherwise the files stay until the driver happens to collect garbage, which
    in a loop of small steps adds up to more than the data.  Threads may be inside together; the last one out puts
    the session's own setting back.  A version of Spark without the setting keeps the files.
    """
    key = id(spark)
    with _lock:
        _inside[key] += 1
        if _inside[key] == 1:
            _before[key] = spark.conf.get(_REMOVE, "false")
            try:
                spark.conf.set(_REMOVE, "true")
            except PySparkException:
                pass
    try:
        yield
    finally:
        with _lock:
            _inside[key] -= 1
            if not _inside[key]:
                del _inside[key]
                try:
                    spark.conf.set(_REMOVE, _before.pop(key))
                except PySparkException:
                    pass


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from the written rows."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    with shuffles_removed(spark):
        # The setting is read when a plan is made, so the plan is made here.
        return df.select("*").checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a written table that nothing will read any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
