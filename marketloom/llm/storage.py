"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A hot key's rows are joined in so many pieces.
SALTS = 16


def shared_dir(spark: SparkSession) -> str:
    """The cluster's `spark.checkpoint.dir`. Where none is set: one of our own if all runs in this process, else an error, since executors
    would each write to a disk of their own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (folder or os.path.join(tempfile.gettempdir(), "checkpoints")).rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Written as Parquet and read again: cuts the lineage, and survives the loss of any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    spark.sparkContext._jvm.System.gc()  # what was shuffled for it can go now
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    _STORED.append(path)
    return out


#: Tables of this process that no one has removed.
_STORED: list[str] = []


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
    if path in _STORED:
        _STORED.remove(path)


def clean_up(spark: SparkSession) -> None:
    """Removes every table that operators have left in the shared folder. Results are lazy and read some of them: call it when
    they have been written."""
    for path in list(_STORED):
        _delete(spark, path)


def discard(*tables: DataFrame) -> None:
    """Removes tables that no later step reads, and lets Spark drop the shuffles behind them."""
    for df in tables:
        path = getattr(df, "_stored_at", None)
        if path:
            _delete(df.sparkSession, path)
    if tables:
        tables[0].sparkSession._jvm.System.gc()


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def parts_for(df: DataFrame, bytes_each: int = 64 << 20) -> int:
    """Enough shuffle partitions that each is of bounded size, however large the input is. Where Catalyst knows no size, it says a
    very large one: four for each partition of the input are the most."""
    known = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = -(-input_bytes(df) // bytes_each)
    return known if wanted <= known else max(known, min(wanted, 4 * df.rdd.getNumPartitions()))


def salted_join(big: DataFrame, small: DataFrame, key: str, salt_by: str, how: str = "inner") -> DataFrame:
    """Equi-join on a key that may hold a large share of `big`: its rows are dealt over SALTS pieces, and `small`,
    which has each key once, is repeated as often."""
    salt = free_name("_salt", big.columns + small.columns)
    spread = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = big.withColumn(salt, F.pmod(F.xxhash64(salt_by), F.lit(SALTS)).cast("int"))
    return dealt.join(spread, [key, salt], how).drop(salt)


def free_name(name: str, taken: list[str]) -> str:
    """The name, with as many underscores after it as make it a new one."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


NO_ID = (1 << 63) - 1


def id_in(df: DataFrame, id_col: str):
    """An id that joins: a null number counts as the largest there is."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)) if dict(df.dtypes)[id_col] in ("int", "bigint", "smallint") else F.coalesce(F.col(id_col), F.lit("\0null"))


def id_out(df: DataFrame, id_col: str):
    kind = dict(df.dtypes)[id_col]
    return F.nullif("id", F.lit(NO_ID) if kind in ("int", "bigint", "smallint") else F.lit("\0null")).cast(kind).alias(id_col)
