"""The registry as a Spark data source over stored pages, with filters pushed to the reader, and a made-up market of any size."""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

#: The registry's columns.
COLUMNS = ("siret", "nom_entreprise", "adresse", "code_postal", "commune", "latitude", "longitude", "telephone", "email", "site_internet", "domaine", "lien_date_debut", "lien_date_fin")


class _Pages(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, folder: str, columns: list[str], column: str):
        self.folder, self.columns, self.column, self.wanted = folder, columns, column, None

    def pushFilters(self, filters: list[Filter]):
        """Which domains are wanted is used here, before rows are made; Spark checks all filters again, as a search may be loose."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == (self.column,):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = values if self.wanted is None else self.wanted & values
            yield f

    def partitions(self):
        return [_Pages(p) for p in sorted(glob.glob(os.path.join(self.folder, "*.json")))] or [_Pages("")]

    def read(self, partition: _Pages) -> Iterator[tuple]:
        if not partition.path:
            return
        with open(partition.path, encoding="utf-8") as f:
            for row in json.load(f).get("results") or ():
                if self.wanted is None or row.get(self.column) in self.wanted:
                    yield tuple(row.get(c) for c in self.columns)


class RegistrySource(DataSource):
    """`spark.read.format("registry_pages").load(folder)`: rows of stored pages, a partition a page. The folder is one that all executors see.
    Option `columns`: the columns to make, separated by commas."""

    @classmethod
    def name(cls) -> str:
        return "registry_pages"

    def _columns(self) -> list[str]:
        return [c.strip() for c in self.options.get("columns", ",".join(COLUMNS)).split(",")]

    def schema(self) -> str:
        return ", ".join(f"{c} {'double' if c in ('latitude', 'longitude') else 'string'}" for c in self._columns())

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self._columns(), self.options.get("filter", "domaine"))


def registry(spark: SparkSession, folder: str, domains: list[str] | None = None, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """Qualifications of the domains wanted; the filter goes to the reader and is checked again after it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RegistrySource)
    found = spark.read.format("registry_pages").option("columns", ",".join(columns)).load(folder)
    return found if domains is None else found.where(F.col("domaine").isin(list(domains)))


def capped(found: DataFrame, by: str, cap: int = 10_000) -> DataFrame:
    """(by, n, truncated): a search that gives as many rows as its cap may have left some out."""
    return found.groupBy(by).agg(F.count("*").alias("n"), (F.count("*") >= cap).alias("truncated"))


def made_up_market(spark: SparkSession, groups: int = 6000, seed: int = 7, partitions: int | None = None) -> DataFrame:
    """A market for tests of any scale: each row follows from its number and the seed alone, so that any partitioning gives the same."""
    draw = lambda name, n: F.pmod(F.xxhash64(F.lit(seed), F.lit(name), "id"), F.lit(n))
    pick = lambda name, *values: F.element_at(F.array(*map(F.lit, values)), (draw(name, len(values)) + 1).cast("int"))
    name = F.concat_ws(" ", pick("first", "ATELIER", "MAISON", "SOCIETE", "ENERGIE", "CHALEUR"), pick("second", "DU NORD", "DES ALPES", "MODERNE", "VERTE", "DURAND"), pick("form", "SARL", "SAS", "EURL"))
    base = spark.range(0, groups, 1, partitions) if partitions else spark.range(groups)
    return base.select(
        F.concat(F.lit("g9"), F.lpad(F.col("id").cast("string"), 8, "0")).alias("group_id"), name.alias("name"), pick("band", "NN", "03", "11", "12", "12", "21", "22", "31").alias("band"),
        F.transform(F.sequence(F.lit(0), draw("members", 4)), lambda k: F.concat(F.lit("9"), F.lpad((F.col("id") * 4 + k).cast("string"), 8, "0"))).alias("members"),
        F.array_distinct(F.array(pick("line1", "STANDARD", "LARGE", "SMALL"), pick("line2", "STANDARD", "PROMO", "ECONOMY"))).alias("domains"),
        pick("region", "11", "24", "32", "44", "53", "76", "84", "93").alias("region"), (F.lit(43.0) + draw("lat", 7000) / 1000).alias("lat"), (F.lit(-1.0) + draw("lon", 8000) / 1000).alias("lon"),
        F.when(draw("site", 10) < 7, F.concat(F.lit("https://www.g"), F.col("id").cast("string"), F.lit(".example/"))).alias("website"), F.date_format(F.date_sub(F.to_date(F.lit("2026-09-29")), draw("age", 9000).cast("int")), "yyyy-MM-dd").alias("created"),
    )
