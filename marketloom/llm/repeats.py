"""Substring dedup by seeds and window hashes, which stand in for pairwise extension.

Seeds: of each `window` consecutive words the `window - anchor + 1` runs of `anchor` words are hashed, and the least
hash is its anchor (winnowing), so equal windows have equal anchors. Anchors that stand at one place only are dropped.
Windows: those that chose an anchor that is left are grouped by hash. No match is aligned or extended, and spans have no partner: removed
windows of a document that follow one another or touch merge to one span, which is as long as `window` words at least. Of equal windows the first, by document and position, stays.

A task sends each of its anchors and windows once, so a passage that is everywhere costs as many records as there are tasks.
Equal windows are told by 96 bits of hash over 64-bit hashes of words, so that among n distinct words a false equality has odds of about n * n / 2 ** 65.

Handling: null, empty and blank texts have no words, and nothing goes. Rows that repeat an id and its text get the same result, and aren't repeats of
one another. Texts that share an id are told by a hash, and come in its order; texts without an id come last, by a hash, and those with the same text are
one. Ids of any type that has an order will do. A very
long text is read whole. An empty table gives an empty result. Columns beyond id and text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rank import numbered
from . import blobs
from .storage import discard, materialize, parts_for
from .words import PRINTED, SECOND_MULTIPLIER, Block, blocks, gram_rows, grams, sliding_min

WINDOW, ANCHOR = 20, 8
#: The largest ids name texts without an id, by a hash of the text.
NULL_IDS = 1 << 40
SPANS = "array<struct<start:int,end:int>>"


def anchored(b: Block, h: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of `anchor` words, least of them in each window; 0 where a text has no such window)"""
    g = grams(h, anchor)
    g[~gram_rows(b.bounds, anchor)] = np.iinfo(np.uint64).max
    least = sliding_min(g, window - anchor + 1)
    if len(least):
        least[~gram_rows(b.bounds, window)] = 0
    return g, least


def chosen(g: np.ndarray, least: np.ndarray, width: int) -> np.ndarray:
    """Places of anchors: those where some window over them has their hash as its least."""
    if not len(least):
        return np.zeros(0, np.int64)
    pad = np.zeros(width - 1, np.uint64)
    most = ~sliding_min(~np.concatenate((pad, least, pad)), width)
    return np.flatnonzero((most == g) & (g != np.iinfo(np.uint64).max) & (g != 0))


def _anchors(window: int, anchor: int, parts: int):
    width = window - anchor + 1

    def send(found: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        if not found:
            return
        key, ids, pos = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(key, kind="stable")
        key, ids, pos = key[order], ids[order], pos[order]
        starts, n = blobs.runs(key)
        again = np.repeat(n > 1, n)
        part = blobs.part_of_key(key, parts)
        yield from blobs.rows(part[again], 1, id=ids[again], pos=pos[again])
        # one of each: of those that this task has twice, others need to know only that they are
        at = np.where(n > 1, -1, pos[starts])
        yield from blobs.rows(part[starts], 0, key=key[starts], id=ids[starts], pos=at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for b in blocks(batch.column(1), PRINTED):
                g, least = anchored(b, b.hashes(), window, anchor)
                q = chosen(g, least, width)
                row = np.searchsorted(b.bounds, q, "right") - 1
                found.append((g[q], ids[b.first + row], (q - b.bounds[row]).astype(np.int32)))
                held += len(q)
                if held > blobs.FLUSH:
                    yield from send(found)
                    found, held = [], 0
        yield from send(found)

    return run


def _live(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = blobs.unpacked(batches)
        ids, pos = [], []
        if 0 in got:
            key = got[0]["key"]
            order = np.argsort(key, kind="stable")
            _, n = blobs.runs(key[order])
            live = order[np.repeat(n > 1, n)]
            live = live[got[0]["pos"][live] >= 0]
            ids.append(got[0]["id"][live])
            pos.append(got[0]["pos"][live])
        if 1 in got:
            ids.append(got[1]["id"])
            pos.append(got[1]["pos"])
        if ids:
            ids, pos = np.concatenate(ids), np.concatenate(pos)
            yield from blobs.rows(blobs.bucket(ids, parts), 0, id=ids, pos=pos)

    return run


def _windows(window: int, anchor: int, parts: int):
    def send(found: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        if not found:
            return
        key, low, ids, pos = (np.concatenate(x) for x in zip(*found))
        first, later = earliest(key, low, ids, pos)
        part = blobs.part_of_key(key, parts)
        yield from blobs.rows(part[later], 1, id=ids[later], pos=pos[later])
        yield from blobs.rows(part[first], 0, key=key[first], low=low[first], id=ids[first], pos=pos[first])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for ids, pos, texts in blobs.joined(batches):
            if not len(ids):
                continue
            own = texts.column("id").to_numpy()
            at = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
            some = np.flatnonzero(ids[at] == own)
            own, column = own[some], texts.column("text").take(pa.array(some))
            for b in blocks(column, PRINTED):
                h = b.hashes()
                g, least = anchored(b, h, window, anchor)
                here = own[b.first : b.first + b.n]
                lo, hi = np.searchsorted(ids, here), np.searchsorted(ids, here, "right")
                places = np.concatenate([b.bounds[i] + pos[x:y] for i, (x, y) in enumerate(zip(lo, hi))])
                live = np.flatnonzero(np.isin(least, np.unique(g[places]))) if len(least) else np.zeros(0, np.int64)
                live = live[least[live] != 0]
                row = np.searchsorted(b.bounds, live, "right") - 1
                found.append((grams(h, window)[live], (grams(h, window, SECOND_MULTIPLIER)[live] >> np.uint64(32)).astype(np.uint32), here[row], (live - b.bounds[row]).astype(np.int32)))
                held += len(live)
                if held > blobs.FLUSH:
                    yield from send(found)
                    found, held = [], 0
        yield from send(found)

    return run


def earliest(key: np.ndarray, low: np.ndarray, ids: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which records are the first of their key, and which come later, at another place than it."""
    order = np.lexsort((pos, ids, low, key))
    starts, n = blobs.runs(key[order], low[order])
    first = order[np.repeat(starts, n)]
    later = (ids[order] != ids[first]) | (pos[order] != pos[first])
    return order[starts], order[later]


def _removed(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = blobs.unpacked(batches)
        ids, pos = [], []
        if 0 in got:
            x = got[0]
            _, later = earliest(x["key"], x["low"], x["id"], x["pos"])
            ids.append(x["id"][later])
            pos.append(x["pos"][later])
        if 1 in got:
            ids.append(got[1]["id"])
            pos.append(got[1]["pos"])
        if ids:
            ids, pos = np.concatenate(ids), np.concatenate(pos)
            yield from blobs.rows(blobs.bucket(ids, parts), 0, id=ids, pos=pos)

    return run


def _kept(window: int):
    schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("kept", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for ids, pos, texts in blobs.joined(batches):
            own = texts.column("id").to_numpy()
            lo, hi = np.searchsorted(ids, own), np.searchsorted(ids, own, "right")
            column = texts.column("text")
            for i, x in enumerate(own.tolist()):
                words = (column[i].as_py() or "").encode().split()  # at the bytes 0x20 and 0x09 to 0x0D
                spans, gone = [], 0
                if lo[i] < hi[i]:
                    starts = np.unique(pos[lo[i] : hi[i]])
                    cut = np.flatnonzero(np.diff(starts) > window) + 1
                    # repeats that touch are one
                    spans = [{"start": int(a[0]), "end": int(a[-1]) + window} for a in np.split(starts, cut)]
                    kept, last = [], 0
                    for s in spans:
                        kept += words[last : s["start"]]
                        last = s["end"]
                        gone += s["end"] - s["start"]
                    kept += words[last:]
                else:
                    kept = words
                text = b" ".join(kept)
                out.append({"id": x, "n_words": len(words), "n_removed": gone, "spans": spans, "kept": text.decode()})
                held += len(text)
                if held > 4 << 20 or len(out) >= 4096:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, held = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def named(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """(texts, ids): texts has (id, text) with a number that names one text each, in order of ids; ids says which id a number stands for, where it isn't
    the id itself. Numbers are the ids if those are integers that name one text each, with texts without an id last, by hash; else texts are ranked by (id,
    hash of the text), whatever the ids' type."""
    whole = dict(docs.dtypes)[id_col] in ("int", "bigint", "smallint", "tinyint")
    tid = F.xxhash64(text_col)
    if whole:
        seen = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), tid.alias("tid")).groupBy("id").agg(F.min("tid").alias("a"), F.max("tid").alias("b"))
        if seen.where("a <> b").isEmpty():
            own = F.lit(int(blobs.NO_ID)) - F.pmod(tid, F.lit(NULL_IDS))
            return docs.select(F.coalesce(F.col(id_col).cast("long"), own).alias("id"), F.col(text_col).alias("text")), None
    rows = docs.select(F.col(id_col).alias("own"), tid.alias("tid"), F.col(text_col).alias("text"))
    numbers = materialize(numbered(rows.select("own", "tid").distinct(), [F.asc_nulls_last("own"), F.asc("tid")], {"id": None}).select("own", "tid", F.col("id").cast("long").alias("id")), "numbers")
    n = numbers.withColumnRenamed("own", "its").withColumnRenamed("tid", "its_tid")
    met = rows.join(n, F.col("tid").eqNullSafe(F.col("its_tid")) & F.col("own").eqNullSafe(F.col("its")))
    return materialize(met.select("id", "text"), "named"), numbers.select("id", "own")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """One row a document: its id, n_words, n_removed, spans (word ranges removed, end exclusive) and kept, its other words
    joined by one space."""
    texts, own = named(docs, id_col, text_col)
    parts = parts_for(docs)
    sent = texts.mapInArrow(_anchors(window, anchor, parts), blobs.SCHEMA)
    live = materialize(blobs.dealt(sent, parts).mapInArrow(_live(parts), blobs.SCHEMA), "live")
    found = blobs.with_texts(texts, live, parts).mapInArrow(_windows(window, anchor, parts), blobs.SCHEMA)
    gone = materialize(blobs.dealt(found, parts).mapInArrow(_removed(parts), blobs.SCHEMA), "removed")
    discard(live)
    out = blobs.with_texts(texts, gone, parts).mapInArrow(_kept(window), f"id long, n_words long, n_removed long, spans {SPANS}, kept string")
    if own is not None:
        return out.join(own, "id").select(F.col("own").alias(id_col), "n_words", "n_removed", "spans", "kept")
    return out.select(F.when(F.col("id") <= int(blobs.NO_ID) - NULL_IDS, F.col("id")).alias(id_col), "n_words", "n_removed", "spans", "kept")
