"""Cuts in long plans, and rows dealt out to idle cores."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from threading import Lock

from pyspark.sql import DataFrame, SparkSession

_THRESHOLDS = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
_LOCK, _HELD = Lock(), {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of this application in the shared one that the session names in spark.checkpoint.dir, or, in a local session that names none, one of our own. What is kept there goes with the application."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    folder = spark._jvm.org.apache.hadoop.fs.Path(context.getCheckpointDir())
    folder.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read from the shared folder from now on."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def unasked_broadcasts_off(spark: SparkSession) -> Iterator[None]:
    """Joins that are planned meanwhile broadcast what is marked for it, and nothing because it is thought small. The settings are as before when the last of several at a time ends."""
    key = spark.sparkContext.applicationId, id(spark._jsparkSession)
    with _LOCK:
        depth, before = _HELD.get(key, (0, {k: spark.conf.get(k, None) for k in _THRESHOLDS}))
        _HELD[key] = depth + 1, before
        for k in _THRESHOLDS:
            spark.conf.set(k, "-1")
    try:
        yield
    finally:
        with _LOCK:
            depth, before = _HELD.pop(key)
            if depth > 1:
                _HELD[key] = depth - 1, before
            else:
                for k, v in before.items():
                    spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cut_shuffled(df: DataFrame) -> DataFrame:
    """As cut, of a step between tables that all grow with the input: its joins are made by shuffles.

    A side that comes out at some megabytes would be broadcast otherwise, by way of the driver, where it takes several
    times that, and a step has many such sides at once.
    """
    with unasked_broadcasts_off(df.sparkSession):
        return cut(df)


def spread(rows: DataFrame) -> DataFrame:
    """The same rows in as many partitions as there are cores, if they come in fewer; where there are enough, nothing is shuffled."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows
