"""Tables of vectors, queries that are handed to tasks in batches, and best rows so far.

Scores are inner products, exact as long as sums of the products' sizes stay below 2 ** 53 for components that are integers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A batch of queries, which each task holds, is of so many bytes at most.
BATCH_BYTES = 16 << 20
#: A task compares so many queries with a block at once.
SIDE = 512
NO_ID = np.iinfo(np.int64).max


def usable(vector: str) -> Column:
    """No null vector, no null or non-finite component."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.col(vector).isNotNull() & finite


def prepared(table: DataFrame, id_col: str, vec_col: str, *more: Column, scale: int | None = None) -> DataFrame:
    """(id, vec, ...) of the rows that take part, with vec as doubles (scale: floor(scale * x)). Rows without an id take no part; of rows that
    repeat an id, the one whose vector (and then the rest) sorts first does."""
    x = F.transform(vec_col, lambda v: (F.floor(v.cast("double") * scale) if scale else v).cast("double"))
    rows = table.where(usable(vec_col)).select(F.col(id_col).cast("long").alias("id"), x.alias("vec"), *more).where("id IS NOT NULL")
    rest = [c for c in rows.columns if c != "id"]
    return rows.groupBy("id").agg(F.min(F.struct(*rest)).alias("row")).select("id", *(F.col("row")[c].alias(c) for c in rest))


def matrix(column: pa.Array, dims: int | None = None) -> np.ndarray:
    """A row for each vector; missing components are 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    values, dims = column.flatten().to_numpy(zero_copy_only=False), dims if dims is not None else int(sizes.max(initial=0))
    if (sizes == dims).all():
        return values.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims))
    row, at = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, at] = values
    return out


def widened(x: np.ndarray, dims: int) -> np.ndarray:
    return x if x.shape[1] >= dims else np.pad(x, ((0, 0), (0, dims - x.shape[1])))


def batches(queries: DataFrame, name: str) -> Iterator[tuple[pa.Table, int]]:
    """A stored table of queries (id, vec, ...) in batches of bounded size, by hash of the id."""
    n, dims = queries.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    parts = -(-n * 8 * (dims + 8) // BATCH_BYTES)
    for i in range(parts):
        yield queries.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == i).toArrow(), dims


@dataclass
class Best:
    """The k best (score, id) of each query so far: higher scores first, then smaller ids."""

    k: int
    score: np.ndarray
    ids: np.ndarray

    @classmethod
    def of(cls, n: int, k: int) -> Best:
        return cls(k, np.full((n, k), -np.inf), np.full((n, k), NO_ID))

    def kth(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(query):
            return
        own = np.unique(query)
        q = np.concatenate((np.repeat(own, self.k), query))
        s, i = np.concatenate((self.score[own].ravel(), score)), np.concatenate((self.ids[own].ravel(), ids))
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        starts = np.searchsorted(q, own)
        take = starts[:, None] + np.arange(self.k)
        self.score[own], self.ids[own] = s[take], i[take]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of those there are."""
        query, at = np.nonzero(self.score > -np.inf)
        return query, self.ids[query, at], self.score[query, at]


def select_best(scores: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the k largest of each column, and all that equal the last of them, from `least` on; -inf is none."""
    cut = least
    if len(scores) > k:
        cut = np.maximum(least, np.partition(scores, len(scores) - k, axis=0)[len(scores) - k])
    return np.nonzero((scores >= cut) & (scores > -np.inf))


def ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """What tasks have each found best, at most k each, as the k best of all, with their rank."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def in_tasks(table: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return table.mapInArrow(run, schema)


def union(parts: list[DataFrame], empty: DataFrame) -> DataFrame:
    out = empty
    for p in parts:
        out = out.union(p)
    return out
