"""Shuffles of packed numbers.

Many small records (hashes, positions) travel as binary cells of a few rows instead of a row each; rows are dealt
by `part`, and a task takes all rows of its parts. Records are reduced within a task before they are sent, so that a key
that is everywhere is sent once a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = ("key", "low", "id", "pos")
TYPES = {"key": np.uint64, "low": np.uint32, "id": np.int64, "pos": np.int32}
SCHEMA = "part int, kind int, " + ", ".join(f"{c} binary" for c in COLUMNS)
#: A task sends what it has gathered when it holds so many records.
FLUSH = 6_000_000
NO_ID = np.iinfo(np.int64).max


def bucket(ids: np.ndarray, parts: int) -> np.ndarray:
    """The part of a document, as `bucket_sql` has it."""
    return ((ids ^ (ids.view(np.uint64) >> np.uint64(16)).view(np.int64)) % parts).astype(np.int64)


def bucket_sql(id_col: str, parts: int) -> str:
    return f"cast(pmod({id_col} ^ shiftrightunsigned({id_col}, 16), {parts}L) as int)"


def part_of_key(keys: np.ndarray, parts: int) -> np.ndarray:
    """Grows with the key, so that what is sorted by key is sorted by part."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def rows(part: np.ndarray, kind: int, **columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each part; records are put in order of part first."""
    if not len(part):
        return
    if (np.diff(part) < 0).any():
        order = np.argsort(part, kind="stable")
        part, columns = part[order], {k: v[order] for k, v in columns.items()}
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(part)]))
    cells = {c: [columns[c][a:b].astype(TYPES[c]).tobytes() for a, b in zip(cuts[:-1], cuts[1:])] if c in columns else [None] * (len(cuts) - 1) for c in COLUMNS}
    for i in range(0, len(cuts) - 1, 256):
        own = part[cuts[i : min(i + 256, len(cuts) - 1)]]
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(np.full(len(own), kind, np.int32)), *(pa.array(cells[c][i : i + 256], pa.binary()) for c in COLUMNS)], ["part", "kind", *COLUMNS])


def unpacked(batches: Iterator[pa.RecordBatch]) -> dict[int, dict[str, np.ndarray]]:
    """All records of a task by kind."""
    found: dict[int, dict[str, list[np.ndarray]]] = {}
    for batch in batches:
        kinds = batch.column("kind").to_pylist()
        for c in COLUMNS:
            column = batch.column(c)
            for i, kind in enumerate(kinds):
                if column[i].is_valid:
                    found.setdefault(kind, {}).setdefault(c, []).append(np.frombuffer(column[i].as_buffer(), TYPES[c]))
    return {k: {c: np.concatenate(v) for c, v in x.items()} for k, x in found.items()}


def runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths) of runs of equal keys in sorted columns."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(n, bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    starts = np.flatnonzero(new)
    return starts, np.diff(np.append(starts, n))


def dealt(df: DataFrame, n: int) -> DataFrame:
    """Each part a task of its own."""
    return df.repartitionById(n, F.col("part"))


def with_texts(texts: DataFrame, blobs: DataFrame, parts: int) -> DataFrame:
    """Rows of texts (id, text) and records about them in one task, the records of a part before its texts."""
    a = texts.selectExpr(f"{bucket_sql('id', parts)} as part", "1 as kind", "id", "text", "cast(null as binary) as ids", "cast(null as binary) as pos")
    b = blobs.selectExpr("part", "0 as kind", "cast(null as long) as id", "cast(null as string) as text", "id as ids", "pos")
    return dealt(a.unionAll(b), parts).sortWithinPartitions("part", "kind")


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch]]:
    """(ids, positions, texts): records of a part, in order of id and position, with some of its texts."""
    part, ids, pos, table = None, [], [], None
    for batch in batches:
        p, k = batch.column("part").to_numpy(), batch.column("kind").to_numpy()
        starts, lengths = runs(p, k)
        for a, n in zip(starts.tolist(), lengths.tolist()):
            if p[a] != part:
                part, ids, pos, table = p[a], [], [], None
            some = batch.slice(a, n)
            if k[a] == 0:
                ids += [np.frombuffer(x.as_buffer(), np.int64) for x in some.column("ids")]
                pos += [np.frombuffer(x.as_buffer(), np.int32) for x in some.column("pos")]
                continue
            if table is None:
                i, q = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((ids, np.int64), (pos, np.int32)))
                order = np.lexsort((q, i))
                table = (i[order], q[order])
            yield *table, some


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(int(NO_ID))).alias("id"), F.col(text_col).alias("text"))
