"""Connected components: tasks replace their edges by a spanning forest; alternating large-star and small-star steps join what is left."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialize, salted_join

#: Edges that a task holds before it sends their forest; edges up to which one task joins all forests. Cost alone differs.
HELD, SMALL = 1 << 19, 1 << 19


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node of a task's edges with the smallest node that they lead to, in place of them; one row or more a node that isn't that itself."""
    parent: dict = {}

    def root(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    def sent() -> pa.RecordBatch:
        found = [(x, r) for x in list(parent) if (r := root(x)) != x]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], kind) for i in (0, 1)], ["a", "b"])

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > HELD:
            yield sent()
    if parent:
        yield sent()


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Each node u links its (for small: not larger) neighbours to the smallest of them and itself."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    turned = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    if small:
        near = both.where("u >= v").unionAll(turned.where("u >= v"))
    else:
        near = both.unionAll(turned)
    # the minimum is aggregated map-side, and joined back by salted key: a hot node is never one task's group
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    linked = salted_join(near, least, "u", "v")
    if small:
        out = linked.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        out = linked.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, left: str, right: str, small: int = SMALL) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has an edge to another.

    Nulls and loops link nothing. Forests of up to `small` edges in all are joined by one task. More are joined in rounds, whose number grows with
    the logarithm of the longest path; each is written to the shared folder, so a lost executor costs no more than the round at hand."""
    pairs = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a <> b")
    now = materialize(pairs.mapInArrow(_forest, pairs.schema), "edges")
    if now.count() <= small:
        before, now = now, materialize(now.coalesce(1).mapInArrow(_forest, pairs.schema), "edges")
        discard(before)
    else:
        now = _joined(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select("b", "b").distinct())


def _joined(now: DataFrame) -> DataFrame:
    """Rounds until nothing changes: each node has one edge, to the smallest node."""
    before = None
    while True:
        new = materialize(_star(_star(now, False), True), "edges")
        mark = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(now)
        now = new
        if mark == before:
            return now
        before = mark
