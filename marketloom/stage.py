"""Stage tables: written once to the folder that driver and executors share, read again by what follows."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Stage tables of this process that no one has removed.
_STORED: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's `spark.checkpoint.dir`. Where none is set: one of our own if all runs in this process, else an error, since executors
    would each write to a disk of their own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (folder or os.path.join(tempfile.gettempdir(), "checkpoints")).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _STORED.append(path)
    return path


def handed_over(df: DataFrame, name: str = "stage") -> DataFrame:
    """Written as Parquet and read again: computed once, and safe from lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stage = path
    return out


def stored_bytes(df: DataFrame) -> int:
    """Size of a stage table as Catalyst knows it: that of its files."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
    if path in _STORED:
        _STORED.remove(path)


def discard(*tables: DataFrame) -> None:
    """Removes stage tables that no later step reads."""
    for df in tables:
        if getattr(df, "_stage", None):
            _delete(df.sparkSession, df._stage)


def clean_up(spark: SparkSession) -> None:
    """Removes every stage table. Results are lazy and read some of them: call it when they have been written."""
    for path in list(_STORED):
        _delete(spark, path)
