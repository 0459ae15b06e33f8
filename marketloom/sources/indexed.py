"""A folder of Parquet files with an index of what each holds: a scan opens the files that can match, and no others."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

FORMAT = "indexed_files"


def store(table: DataFrame, folder: str, keys: list[str], files: int | None = None) -> None:
    """Writes the table in order of its keys, dealt by range, so that a value is in few files, and the index: for each file, the distinct
    values of each key, as texts, and the number of rows. A value that many rows have is in many files, each of bounded size."""
    spark = table.sparkSession
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a hash after the keys parts rows that share them
    spread = F.xxhash64(*table.columns)
    table.withColumn("_spread", spread).repartitionByRange(n, *keys, "_spread").sortWithinPartitions(*keys).drop("_spread").write.parquet(f"{folder}/data")
    stored = spark.read.schema(table.schema).parquet(f"{folder}/data").withColumn("file", F.col("_metadata.file_name"))
    seen = stored.groupBy("file").agg(F.count("*").alias("n"), *(F.collect_set(F.col(k).cast("string")).alias(f"k{i}") for i, k in enumerate(keys)))
    told = seen.select(F.to_json(F.struct("file", "n", F.array(*(f"k{i}" for i in range(len(keys)))).alias("values"))).alias("value"))
    told.write.text(f"{folder}/index")
    spark.createDataFrame([(json.dumps({"keys": keys, "schema": table.schema.jsonValue()}),)], "value string").coalesce(1).write.text(f"{folder}/about")


def _lines(folder: str) -> Iterator[dict]:
    system, path = fs.FileSystem.from_uri(folder)
    for info in sorted(system.get_file_info(fs.FileSelector(path)), key=lambda x: x.path):
        if info.is_file and info.base_name.startswith("part-"):
            with system.open_input_stream(info.path) as f:
                yield from (json.loads(x) for x in f.read().decode().splitlines() if x)


class _File(InputPartition):
    def __init__(self, name: str, rows: int):
        self.name, self.rows = name, rows


class _Reader(DataSourceReader):
    def __init__(self, folder: str, schema: StructType, wanted: dict[str, list], keys: list[str]):
        self.folder, self.schema, self.wanted, self.keys = folder, schema, wanted, keys

    def partitions(self):
        found = []
        for x in _lines(f"{self.folder}/index"):
            by_key = dict(zip(self.keys, x["values"]))
            if all({str(v) for v in values} & set(by_key[k]) for k, values in self.wanted.items()):
                found.append(_File(x["file"], x["n"]))
        return found or [_File("", 0)]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        system, path = fs.FileSystem.from_uri(f"{self.folder}/data/{partition.name}")
        names = [f.name for f in self.schema.fields]
        for batch in pq.ParquetFile(system.open_input_file(path)).iter_batches(columns=names):
            for k, values in self.wanted.items():
                batch = batch.filter(pc.is_in(batch.column(names.index(k)), pa.array(list(values), batch.column(names.index(k)).type)))
            if batch.num_rows:
                yield batch.select(names)


class IndexedSource(DataSource):
    """`spark.read.format("indexed_files").load(folder)` of a folder that `store` wrote, which driver and executors see: a partition a file. Option
    `wanted`: JSON of the values wanted by key, which choose files and rows.

    The choice is an option and no pushed filter: Spark keeps what was pushed with the relation, so that of two filters on one loaded table
    the second would be read with the files of the first."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _about(self) -> dict:
        return next(_lines(f"{self.options['path']}/about"))

    def schema(self) -> StructType:
        return StructType.fromJson(self._about()["schema"])

    def reader(self, schema: StructType) -> DataSourceReader:
        keys, wanted = self._about()["keys"], json.loads(self.options.get("wanted", "{}"))
        if not set(wanted) <= set(keys):
            raise ValueError(f"not indexed: {sorted(set(wanted) - set(keys))}; keys are {keys}")
        return _Reader(self.options["path"], schema, wanted, keys)


def scan(spark: SparkSession, folder: str, wanted: dict[str, list] | None = None) -> DataFrame:
    """Rows whose keys have one of the values wanted (not null), from the files that hold any."""
    spark.dataSource.register(IndexedSource)
    return spark.read.format(FORMAT).option("wanted", json.dumps(wanted or {})).load(folder)
