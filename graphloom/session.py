"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows that a join may broadcast once they are counted; more are shuffled.
BROADCAST_ROWS = 1_000_000


def importable(spark: SparkSession) -> None:
    """Lets Python workers that are started from now on import this package from where the driver has it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; that of ``spark.checkpoint.dir`` if none is set yet.

    A session on one machine that names none gets a temporary folder.
    """
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not spark.sparkContext.master.startswith("local["):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="graphloom-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` from files in the shared folder, where its lineage ends."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session with other settings, for a write."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Rows of a task that groups or joins by a key with about as many values as rows.
TASK_ROWS = 1_000_000


def spread(df: DataFrame, *keys: str, rows: int | None = None, task_rows: int | None = None) -> DataFrame:
    """``df`` by its keys, in as many parts as its rows ask for (of ``rows`` if they are known).

    A group by such keys needs no further exchange: nothing is added up before this one, where a task would hold all keys
    of its files, and no part grows with the table.
    """
    rows = df.count() if rows is None else rows
    return df.repartition(max(1, -(-rows // (task_rows or TASK_ROWS))), *keys)
