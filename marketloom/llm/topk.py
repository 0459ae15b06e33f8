"""Exact top-k search by an impact-ordered index, score at a time.

Documents (here: vectors) are dealt over blocks of bounded size. A block's postings (term, document, value) are put in segments by quantised impact, the
half powers of 2 of the value's size; a segment of high impact comes first. A query takes a block's segments in that order and adds what they give
to the documents' accumulators. After each impact level the rest of a document's score is bounded by Cauchy-Schwarz over the terms it has not shown
yet: the root of what is left of its squared values times that of the query's. A query stops on proof: when the documents whose upper bound
reaches the kth score known are so few that they can be scored exactly, as they then are; one whose bound falls below can't be among the best, and
ties are never below. The kth score known is the larger of the kth lower bound in the block and the kth exact score of the blocks the task has read before.

Every query meets every block, in batches of queries of bounded size, one Spark job each; a task sends k rows a query at most, and the best of
all are taken by a window that keeps k rows in each task first. Equal vectors are dealt over all blocks, so no group of copies meets in one task.

Handling: vectors that are null, empty of use (null or non-finite components) or without an id take no part, as queries or candidates. An empty vector scores 0, as
components that the shorter of two vectors lacks are 0. Rows that repeat an id are one: that whose vector sorts first. Ties go to the smaller id. Without
queries or candidates the result is empty. Columns beyond id and vector are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vectors
from .storage import discard, materialize

#: Rows of a block. A query may stop when so few of them, or so small a share, are left.
BLOCK, LEFT, SHARE = 4096, 32, 64
SEGMENTS = "array<struct<impact:int,doc:binary,term:binary,value:binary>>"


def impact(values: np.ndarray) -> np.ndarray:
    """Values that aren't 0 by size, in half powers of 2."""
    return np.floor(2 * np.log2(np.abs(values))).astype(np.int32)


def _packed(block: pa.Table) -> pa.Table:
    ids = block.column("id").to_numpy()
    order = np.argsort(ids)
    x = vectors.matrix(block.column("vec"))[order]
    doc, term = np.nonzero(x)
    value = x[doc, term]
    level = impact(value)
    segments = []
    for i in np.unique(level)[::-1].tolist():
        at = np.flatnonzero(level == i)
        at = at[np.argsort(term[at], kind="stable")]
        segments.append({"impact": i, "doc": doc[at].astype(np.int32).tobytes(), "term": term[at].astype(np.int32).tobytes(), "value": value[at].tobytes()})
    return pa.Table.from_pylist(
        [{"dims": x.shape[1], "ids": ids[order].tobytes(), "segments": segments}],
        pa.schema([("dims", pa.int32()), ("ids", pa.binary()), ("segments", pa.list_(pa.struct([("impact", pa.int32()), ("doc", pa.binary()), ("term", pa.binary()), ("value", pa.binary())])))]),
    )


def index(rows: DataFrame) -> DataFrame:
    """A row a block of (id, vec): its ids, and its postings in segments by descending impact."""
    blocks = max(1, -(-rows.count() // BLOCK))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    return materialize(dealt.groupBy("block").applyInArrow(_packed, f"dims int, ids binary, segments {SEGMENTS}"), "postings")


def visit(ids: np.ndarray, segments: list[dict], dims: int, qids: np.ndarray, q: np.ndarray, best: vectors.Best) -> int:
    """Adds to `best` what a block has for the queries; gives the number of rows scored exactly."""
    k, n = best.k, len(ids)
    q = vectors.widened(q, dims)
    dims = q.shape[1]
    levels = []
    for s in segments:
        m = np.zeros((n, dims))
        m[np.frombuffer(s["doc"], np.int32), np.frombuffer(s["term"], np.int32)] = np.frombuffer(s["value"], np.float64)
        levels.append(m)
    whole = np.sum(levels, axis=0) if levels else np.zeros((n, dims))
    left = (whole**2).sum(axis=1)
    own = np.searchsorted(ids, qids)
    own = np.where(ids[np.minimum(own, n - 1)] == qids, np.minimum(own, n - 1), -1)
    going = np.arange(len(q))  # queries that have not stopped
    gained, shown, scored = np.zeros((n, len(q))), np.zeros((n, len(q))), 0
    for i in range(len(levels) + 1):
        last = i == len(levels)
        if i:
            m = levels[i - 1]
            some = np.flatnonzero(m.any(axis=1))
            gained[some] += m[some] @ q[going].T
            shown[some] += (m[some] != 0) @ (q[going] ** 2).T
            left -= (m**2).sum(axis=1)
        # nothing is proved before half of what the rows hold is known
        if not last and left.sum() > 0.5 * (whole**2).sum():
            continue
        rest = np.sqrt(np.maximum((q[going] ** 2).sum(axis=1) - shown, 0) * np.maximum(left, 0)[:, None]) * (1 + 1e-9) if not last else 0.0
        lower, upper = gained - rest, gained + rest
        mine = np.flatnonzero(own[going] >= 0)
        lower[own[going][mine], mine] = upper[own[going][mine], mine] = -np.inf
        known = best.kth()[going]
        if n > k:
            known = np.maximum(known, np.partition(lower, n - k, axis=0)[n - k])
        possible = (upper >= known) & (upper > -np.inf)
        stop = (possible.sum(axis=0) <= max(LEFT, n // SHARE)) | last
        doc, col = np.nonzero(possible[:, stop])
        who = going[stop]
        for a in range(0, len(doc), 1 << 16):  # exact scores, in pieces of bounded size
            d, c = doc[a : a + (1 << 16)], who[col[a : a + (1 << 16)]]
            best.add(c, np.einsum("ij,ij->i", whole[d], q[c]), ids[d])
        scored += len(doc)
        going, gained, shown = going[~stop], gained[:, ~stop], shown[:, ~stop]
        if not len(going):
            break
    return scored


def _search(batch, dims: int, k: int):
    def run(some: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, packed = batch.value
        qids, q = np.frombuffer(ids, np.int64), np.frombuffer(packed, np.float64).reshape(-1, dims)
        parts = [vectors.Best.of(len(qids[a : a + vectors.SIDE]), k) for a in range(0, len(qids), vectors.SIDE)]
        for rows in some:
            for j in range(rows.num_rows):
                row = rows.slice(j, 1).to_pylist()[0]
                for p, best in enumerate(parts):
                    at = slice(p * vectors.SIDE, (p + 1) * vectors.SIDE)
                    visit(np.frombuffer(row["ids"], np.int64), row["segments"], row["dims"], qids[at], q[at], best)
        for p, best in enumerate(parts):
            query, found, score = best.rows()
            yield pa.RecordBatch.from_arrays([pa.array(qids[p * vectors.SIDE + query]), pa.array(found), pa.array(score)], ["query", "id", "score"])

    return run


def search(table: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vec_col: str = "embedding", scale: int | None = None) -> DataFrame:
    """(query_id, rank, id, score): for each row that is_query says, the k best other rows by inner product."""
    spark = table.sparkSession
    asked = is_query.alias("asked")
    rows = materialize(vectors.prepared(table, id_col, vec_col, asked, scale=scale), "rows")
    blocks = index(rows.select("id", "vec"))
    found = []
    for batch, dims in vectors.batches(materialize(rows.where("asked").select("id", "vec"), "queries"), "queries"):
        held = spark.sparkContext.broadcast((batch.column("id").to_numpy().tobytes(), vectors.matrix(batch.column("vec"), dims).tobytes()))
        found.append(materialize(blocks.mapInArrow(_search(held, dims, k), "query long, id long, score double"), "found"))
        held.unpersist()
    discard(blocks, rows)
    out = vectors.union(found, spark.createDataFrame([], "query long, id long, score double"))
    return vectors.ranked(out, ["query"], k).select(F.col("query").alias("query_id"), "rank", "id", F.col("score"))
