"""Cutting lineage, and folders for stores, where all executors share them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of our own only where none is set and driver and executors are one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return folder or tempfile.mkdtemp(prefix="manyfold-")


def settle(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared folder and read from there.

    Level-by-level algorithms call this now and then, so that their plans stay short and a lost executor
    costs one level only.
    """
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession) -> str:
    """A new folder for a store."""
    return f"{shared_folder(spark)}/stores/{uuid.uuid4().hex}"


_written: dict[tuple, str] = {}
_opened: dict[tuple, object] = {}


def written(spark: SparkSession, name: str, source: str, write, opened):
    """What ``opened(path)`` gives of the folder where ``write(path)`` has put the layout ``name`` of the tables in ``source``.

    It is written once an application and opened once a session. Tables don't change while a session looks at them; a changed table
    needs another folder or application.
    """
    key = (spark.sparkContext.applicationId, source, name)
    if key not in _written:
        path = f"{scratch(spark)}/{name}"
        write(path)
        _written[key] = path
    session = (*key, spark._jsparkSession.hashCode())
    if session not in _opened:
        _opened[session] = opened(_written[key])
    return _opened[session]
