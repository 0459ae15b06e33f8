"""Hard negatives from K-means inverted lists, visited by bound.

Rows are put in the list of their nearest centroid; lists are cut by hash to pieces of bounded size, so copies that are everywhere make many pieces of one
centroid, and each piece stores its centroid and its radius, the largest distance of its rows from it. By Cauchy-Schwarz the scores
of a piece lie within |anchor| * radius of anchor * centroid. An anchor visits a task's pieces by descending upper bound: a piece is skipped if its
range is outside all windows that are still open, and visiting stops when the bound falls strictly below the kth score (equal ones may still win by
id). The first pass finds the positives, the second, for each of them, the best rows of other labels in the window that its score sets.

Every anchor meets every task's pieces, in batches of anchors of bounded size, a Spark job each; a task sends k rows a window at most. Centroids are
fitted on SAMPLE rows at most, those of least hash; every row is in a list, and bounds and scores are exact, so the fit changes cost only.

Handling: rows with a null label, an unusable vector (null, or with null or non-finite components) or no id take no part. Missing components
are 0. Rows that repeat an id are one: that whose vector, then label, sorts first. Ties go to the smaller id. An anchor without other rows of its
label has no positives and no result; a positive of score below 0 has an empty window. Without anchors the result is empty. Columns
beyond id, vector and label are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vectors
from .storage import discard, materialize

#: Rows that K-means is fitted on, most centroids, rounds of it, rows of a piece of a list, and pieces that are put in order at once.
SAMPLE, CENTROIDS, ROUNDS, PIECE, AT_ONCE = 16384, 256, 8, 2048, 16
#: Room for rounding, as a share.
SLACK = 1e-9


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids**2).sum(axis=1) - 2 * (x @ centroids.T), axis=1)


def fitted(rows: DataFrame) -> np.ndarray:
    """Centroids of a stored table (id, vec): Lloyd's rounds over the rows of least hash."""
    n = rows.count()
    x = vectors.matrix(rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vec").toArrow().column("vec"))
    k = min(len(x), CENTROIDS, max(1, int(np.sqrt(n)) // 4))
    c = x[:k].copy()
    for _ in range(ROUNDS if k > 1 else 0):
        own = nearest(x, c)
        size = np.bincount(own, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c[size > 0] = sums[size > 0] / size[size > 0, None]
    return c


def _assign(centroids: np.ndarray):
    def run(some: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in some:
            x = vectors.matrix(rows.column("vec"))
            own = nearest(vectors.widened(x, centroids.shape[1]), vectors.widened(centroids, x.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), *rows.columns], ["cluster", *rows.schema.names])

    return run


def _packed(centroids: np.ndarray):
    schema = pa.schema([("cluster", pa.int32()), ("dims", pa.int32()), ("centroid", pa.binary()), ("radius", pa.float64()), ("ids", pa.binary()), ("labels", pa.binary()), ("vecs", pa.binary())])

    def run(rows: pa.Table) -> pa.Table:
        ids = rows.column("id").to_numpy()
        order = np.argsort(ids)
        cluster = rows.column("cluster")[0].as_py()
        x = vectors.matrix(rows.column("vec"))[order]
        c = vectors.widened(centroids[cluster : cluster + 1], x.shape[1])
        x = vectors.widened(x, c.shape[1])
        radius = float(np.sqrt(((x - c) ** 2).sum(axis=1)).max(initial=0))
        return pa.Table.from_pylist([{"cluster": cluster, "dims": x.shape[1], "centroid": c[0].tobytes(), "radius": radius, "ids": ids[order].tobytes(), "labels": rows.column("label").to_numpy()[order].tobytes(), "vecs": np.ascontiguousarray(x).tobytes()}], schema)

    return run


def lists(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Pieces of inverted lists of a stored table (id, vec, label)."""
    assigned = materialize(rows.select("id", "vec", "label").mapInArrow(_assign(centroids), "cluster int, id long, vec array<double>, label long"), "assigned")
    pieces = assigned.groupBy("cluster").agg(F.ceil(F.count("*") / PIECE).alias("pieces"))  # a row a centroid
    cut = assigned.join(F.broadcast(pieces), "cluster").withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces"))).drop("pieces")
    stored = materialize(cut.groupBy("cluster", "piece").applyInArrow(_packed(centroids), "cluster int, dims int, centroid binary, radius double, ids binary, labels binary, vecs binary"), "lists")
    discard(assigned)
    return stored


def visit(pieces: list[dict], qids: np.ndarray, q: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, bests: list[vectors.Best]) -> int:
    """Adds to `bests`, one for each window, what the pieces have for the anchors: rows of the same label or of others whose score lies
    within low to high (a column a window; low over high: none). Gives the number of scores computed."""
    dims = max([q.shape[1], *(p["dims"] for p in pieces)])
    q = vectors.widened(q, dims)
    size, computed = np.sqrt((q**2).sum(axis=1)), 0
    middle = np.stack([vectors.widened(np.frombuffer(p["centroid"])[None], dims)[0] for p in pieces]) @ q.T
    reach = np.array([p["radius"] for p in pieces])[:, None] * size
    room = SLACK * (np.abs(middle) + reach) + SLACK
    upper, lower = middle + reach + room, middle - reach - room
    order = np.argsort(-upper, axis=0, kind="stable")
    opened = [None] * len(pieces)
    going = np.arange(len(q))
    for step in range(len(pieces)):
        kth = np.stack([b.kth() for b in bests], axis=1)[going]
        least = np.maximum(kth, low[going])
        at = order[step, going]
        # bounds fall from here on: an anchor stops when all its windows need more
        on = ((upper[at, going][:, None] >= least) & (low[going] <= high[going])).any(axis=1)
        going, at, kth = going[on], at[on], kth[on]
        up, down = upper[at, going][:, None], lower[at, going][:, None]
        meets = (low[going] <= high[going]) & (up >= low[going]) & (down <= high[going]) & (np.minimum(up, high[going]) >= kth)
        for p in np.unique(at[meets.any(axis=1)]).tolist():
            if opened[p] is None:
                piece = pieces[p]
                opened[p] = (np.frombuffer(piece["ids"], np.int64), np.frombuffer(piece["labels"], np.int64), vectors.widened(np.frombuffer(piece["vecs"]).reshape(-1, piece["dims"]), dims))
            ids, own, x = opened[p]
            here = (at == p) & meets.any(axis=1)
            who = going[here]
            scores = x @ q[who].T
            computed += scores.size
            fits = (own[:, None] == labels[who]) == same
            fits &= ids[:, None] != qids[who]
            for w, best in enumerate(bests):
                in_window = np.where(fits & (scores >= low[who, w]) & (scores <= high[who, w]), scores, -np.inf)
                row, col = vectors.select_best(in_window, best.k, best.kth()[who])
                best.add(who[col], scores[row, col], ids[row])
        if not len(going):
            break
    return computed


def _mine(batch, dims: int, k: int, windows: int, same: bool):
    def run(some: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, vecs, low, high = (np.frombuffer(x, t) for x, t in zip(batch.value, (np.int64, np.int64, np.float64, np.float64, np.float64)))
        vecs, low, high = vecs.reshape(-1, dims), low.reshape(-1, windows), high.reshape(-1, windows)
        cuts = [slice(a, a + vectors.SIDE) for a in range(0, len(ids), vectors.SIDE)]
        bests = [[vectors.Best.of(len(ids[c]), k) for _ in range(windows)] for c in cuts]
        for rows in some:
            for j in range(0, rows.num_rows, AT_ONCE):
                pieces = rows.slice(j, AT_ONCE).to_pylist()
                for c, b in zip(cuts, bests):
                    visit(pieces, ids[c], vecs[c], labels[c], low[c], high[c], same, b)
        for c, b in zip(cuts, bests):
            for w, best in enumerate(b):
                query, found, score = best.rows()
                yield pa.RecordBatch.from_arrays([pa.array(ids[c][query]), pa.array(np.full(len(query), w, np.int32)), pa.array(found), pa.array(score)], ["query", "slot", "id", "score"])

    return run


FOUND = "query long, slot int, id long, score double"


def _passes(stored: DataFrame, anchors: DataFrame, k: int, windows: int, same: bool) -> DataFrame:
    """The k best of each window of anchors (id, vec, label, low, high), which are stored."""
    spark, found = stored.sparkSession, []
    for batch, dims in vectors.batches(anchors, "anchors"):
        cells = [batch.column("id").to_numpy(), batch.column("label").to_numpy(), vectors.matrix(batch.column("vec"), dims)]
        for name, empty in (("low", np.inf), ("high", -np.inf)):
            listed, out = batch.column(name).to_pylist(), np.full((batch.num_rows, windows), empty)
            for i, x in enumerate(listed):
                out[i, : len(x)] = x
            cells.append(out)
        held = spark.sparkContext.broadcast(tuple(np.ascontiguousarray(x).tobytes() for x in cells))
        found.append(materialize(stored.mapInArrow(_mine(held, dims, k, windows, same), FOUND), "found"))
        held.unpersist()
    return vectors.ranked(vectors.union(found, spark.createDataFrame([], FOUND)), ["query", "slot"], k)


def mine(table: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, id_col: str = "vec_id", vec_col: str = "embedding", scale: int | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its best `positives` rows of its
    label, the best `negatives` rows of other labels that score from low to high percent of the positive's score."""
    marked = vectors.prepared(table.where(label.isNotNull()), id_col, vec_col, label.cast("long").alias("label"), is_anchor.alias("asked"), scale=scale)
    rows = materialize(marked, "rows")
    stored = lists(rows, fitted(rows))
    open_window = [F.array(F.lit(x)).alias(c) for c, x in (("low", float("-inf")), ("high", float("inf")))]
    anchors = materialize(rows.where("asked").select("id", "vec", "label", *open_window), "anchors")
    near = materialize(_passes(stored, anchors, positives, 1, True).select("query", F.col("id").alias("positive"), (F.col("rank") - 1).alias("slot"), F.col("score").alias("positive_score")), "positives")
    # scores are integers where components are; the window is closed
    edges = near.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("slot", (F.col("positive_score") * low / 100).alias("low"), (F.col("positive_score") * high / 100).alias("high")))).alias("w"))
    asked = anchors.drop("low", "high").join(edges.withColumnRenamed("query", "id"), "id").select("id", "vec", "label", F.col("w.low").alias("low"), F.col("w.high").alias("high"))
    found = _passes(stored, materialize(asked, "anchors"), negatives, positives, False)
    out = found.select("query", "slot", "rank", F.col("id").alias("negative"), F.col("score").alias("negative_score")).join(near, ["query", "slot"])
    return out.select(F.col("query").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("negative").alias("negative_id"), "positive_score", "negative_score")
