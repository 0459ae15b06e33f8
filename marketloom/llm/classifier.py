"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on each document. Expectation-maximisation over the counts
of vote patterns (at most 3 to the number of labellers, whatever the corpus's size; counted over all documents) estimates
how often each labeller is right on good and on bad documents. The posteriors label a bounded sample, on which a linear
scorer over hashed words and text shape is trained; it then scores every document.

Handling: null texts are empty; a text without words scores 0 and is not kept. Each row is scored by its own text; for the fit, rows are told by id
and a hash of the text, and those that repeat both count once in the sample, which never has more than `sample` rows. Null ids are one id. A
very long text is counted whole. Ties at the threshold are kept. An empty table gives an empty result, by a model without weights. Columns
beyond id and text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import SYMBOLS, repeated_lines, repeated_words
from .storage import discard, id_in, materialize
from .words import PRINTED, Block, blocks

BITS = 12
#: Documents the scorer is fitted on, at most.
SAMPLE = 6000
ABSTAIN, BAD, GOOD = 0, 1, 2
LABELLERS = ("symbols", "shouting", "repeats", "lines", "length", "sentences", "pipes")
ROUNDS, STEPS = 50, 300


def shape(b: Block, h: np.ndarray) -> np.ndarray:
    """Rows by measures: words, symbols, capitals, repeated words, repeated lines, mean length of a word, sentence ends, bars; shares but the first and sixth."""
    sums = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[b.edges])
    chars = np.maximum(1, sums(PRINTED[b.data] & ((b.data & 0xC0) != 0x80)))
    words = np.diff(b.bounds)
    last = b.data[np.maximum(b.ends - 1, 0)]
    stops = np.diff(np.concatenate(([0], np.cumsum(np.isin(last, np.frombuffer(b".!?", np.uint8)))))[b.bounds])
    bars = sums(b.data == ord("|"))
    lines = np.array([(d, n) for d, n in (repeated_lines(b.text(i)) for i in range(b.n))]).reshape(b.n, 2)
    again = np.array([repeated_words(h[b.bounds[i] : b.bounds[i + 1]]) for i in range(b.n)])
    some = np.maximum(1, words)
    return np.stack([words, sums(SYMBOLS[b.data]) / chars, sums((b.data >= 65) & (b.data <= 90)) / chars, again / some, lines[:, 0] / np.maximum(1, lines[:, 1]), chars / some, stops / some, bars / some], 1)


def votes(m: np.ndarray) -> np.ndarray:
    """Rows by labellers."""
    pick = lambda bad, good: np.where(bad, BAD, np.where(good, GOOD, ABSTAIN))
    return np.stack([
        pick(m[:, 1] > 0.1, m[:, 1] < 0.02), pick(m[:, 2] > 0.3, m[:, 2] < 0.1), pick(m[:, 3] > 0.2, m[:, 3] < 0.05), pick(m[:, 4] > 0.3, m[:, 4] == 0),
        pick(m[:, 0] < 5, m[:, 0] >= 50), pick(m[:, 6] < 0.01, (m[:, 6] > 0.03) & (m[:, 6] < 0.3)), pick(m[:, 7] > 0.1, np.zeros(len(m), bool)),
    ], 1).astype(np.int64)


def em(patterns: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(posterior that a pattern's documents are good; right[c, labeller, vote], the chance of each vote in class c: 0 bad, 1 good).

    Starts at the share of good votes, bad ones counted twice, so that class 1 stays the one that labellers call good."""
    good, bad = (patterns == GOOD).sum(1), (patterns == BAD).sum(1)
    p = (good + 0.5) / (good + 2.0 * bad + 1.0)
    chance = np.zeros((2, patterns.shape[1], 3))
    for _ in range(rounds):
        for c, weight in ((0, (1 - p) * n), (1, p * n)):
            for j in range(patterns.shape[1]):
                cast = np.bincount(patterns[:, j], weight, minlength=3) + 0.5
                chance[c, j] = cast / cast.sum()
        prior = np.clip((p * n).sum() / max(n.sum(), 1), 1e-3, 1 - 1e-3)
        odds = np.log(prior / (1 - prior)) + sum(np.log(chance[1, j, patterns[:, j]] / chance[0, j, patterns[:, j]]) for j in range(patterns.shape[1]))
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return p, chance


def features(b: Block, h: np.ndarray, m: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each row (columns, values): its distinct hashed words, scaled to length 1, and its shape in the last columns."""
    slot = (h >> np.uint64(64 - bits)).astype(np.int64)
    extra = np.concatenate([np.minimum(np.log1p(m[:, :1]) / 10, 1), m[:, 1:5] * 4, np.minimum(m[:, 5:6] / 20, 1), m[:, 6:] * 4, np.ones((len(m), 1))], 1)
    at = (1 << bits) + np.arange(extra.shape[1])
    for i in range(b.n):
        own = np.unique(slot[b.bounds[i] : b.bounds[i + 1]])
        yield np.concatenate([own, at]), np.concatenate([np.full(len(own), 1 / np.sqrt(max(1, len(own)))), extra[i]])


N_EXTRA = 9


@dataclass
class Model:
    weights: np.ndarray
    bits: int
    accuracy: dict[str, tuple[float, float]]
    prior: float


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, sample: int = SAMPLE) -> Model:
    """EM over the vote patterns of all documents, then the scorer on `sample` of them at most: those first by a hash of
    the id, as many from each side of posterior 1/2 as there are up to half."""
    table = docs.select(id_in(docs, id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tid"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(1), PRINTED):
                v = votes(shape(b, b.hashes()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(b.first, b.n), batch.column(2).slice(b.first, b.n), pa.array((v * 3 ** np.arange(v.shape[1])).sum(1))], ["id", "tid", "pattern"])

    cast = materialize(table.mapInArrow(vote, f"id {dict(table.dtypes)['id']}, tid long, pattern long"), "votes")
    rows = cast.groupBy("pattern").count().collect()  # at most 3 ** len(LABELLERS)
    if not rows:
        return Model(np.zeros((1 << bits) + N_EXTRA), bits, {}, 0.5)
    codes, n = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    patterns = codes[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    p, chance = em(patterns, n)
    posterior = cast.sparkSession.createDataFrame(pa.table({"pattern": codes.astype(np.int64), "p": p.astype(float)}))  # from Arrow: no Python worker of its own
    labelled = cast.join(F.broadcast(posterior), "pattern").withColumn("order", F.xxhash64("id", "tid"))
    # rows that repeat id and text take one place of the sample; most are left out before any are compared, by a cut of their hash
    n_all = float(n.sum())
    sides = [_first(labelled.where(side), sample // 2, n_all) for side in ("p >= 0.5", "p < 0.5")]
    chosen = materialize(sides[0].unionAll(sides[1]).select("id", "tid", "p"), "sample")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(1), PRINTED):
                h = b.hashes()
                found = list(features(b, h, shape(b, h), bits))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(b.first, b.n), pa.array([a.astype(np.int32).tobytes() for a, _ in found], pa.binary()), pa.array([x.astype(np.float32).tobytes() for _, x in found], pa.binary())], ["p", "at", "x"])

    # the sample is small by its bound, and a row that is there many times is taken once
    texts = table.join(F.broadcast(chosen), ["id", "tid"]).dropDuplicates(["id", "tid"]).select("p", "text")
    got = sorted((r.p, bytes(r["at"]), bytes(r.x)) for r in texts.mapInArrow(hashed, "p double, at binary, x binary").collect())
    at, x = [np.frombuffer(r[1], np.int32) for r in got], [np.frombuffer(r[2], np.float32) for r in got]
    accuracy = {name: (float(chance[0, j, BAD] / max(1e-9, chance[0, j, 1:].sum())), float(chance[1, j, GOOD] / max(1e-9, chance[1, j, 1:].sum()))) for j, name in enumerate(LABELLERS)}
    return Model(train(at, x, np.array([r[0] for r in got]), (1 << bits) + N_EXTRA), bits, accuracy, float((p * n).sum() / n.sum()))


def _first(rows: DataFrame, most: int, n: float) -> DataFrame:
    """The `most` distinct (id, tid, p, order) of least order. An order is a 64-bit hash: a cut of it, raised until enough are below it, leaves few rows
    to tell apart."""
    share = min(1.0, 4 * most / max(1.0, n))
    while True:
        some = rows.where(F.col("order") <= F.lit(int(min(2**63 - 1, -(2**63) + share * 2**64)))).dropDuplicates(["id", "tid"])
        if share >= 1:
            return some.orderBy("order", "id", "tid").limit(most)
        some = materialize(some, "below")
        if some.count() >= most:
            return some.orderBy("order", "id", "tid").limit(most)
        discard(some)
        share = min(1.0, share * 8)


def train(at: list[np.ndarray], x: list[np.ndarray], p: np.ndarray, width: int, steps: int = STEPS, decay: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft labels, both classes with equal weight, by Adam on the whole sample."""
    w = np.zeros(width)
    if not len(at):
        return w
    columns, values = np.concatenate(at), np.concatenate(x).astype(float)
    rows = np.repeat(np.arange(len(at)), [len(a) for a in at])
    share = np.where(p >= 0.5, 0.5 / max(1, (p >= 0.5).sum()), 0.5 / max(1, (p < 0.5).sum()))
    first, second = np.zeros(width), np.zeros(width)
    for t in range(1, steps + 1):
        y = 1 / (1 + np.exp(-np.clip(np.bincount(rows, values * w[columns], len(at)), -30, 30)))
        g = np.bincount(columns, values * ((y - p) * share)[rows], width) + decay * w
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w -= 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return w


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row a document: id, n_words, n_bad and n_good votes, score from 0 to 1, and kept: the score reaches the threshold."""
    table = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    weights, bits = model.weights, model.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(1), PRINTED):
                h = b.hashes()
                m = shape(b, h)
                v = votes(m)
                y = np.array([weights[a] @ x for a, x in features(b, h, m, bits)])
                y = np.where(m[:, 0] > 0, 1 / (1 + np.exp(-np.clip(y, -30, 30))), 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(b.first, b.n), pa.array(m[:, 0].astype(np.int64)), pa.array((v == BAD).sum(1)), pa.array((v == GOOD).sum(1)), pa.array(y)], ["id", "n_words", "n_bad", "n_good", "score"])

    found = table.mapInArrow(run, f"id {dict(table.dtypes)['id']}, n_words long, n_bad long, n_good long, score double")
    return found.select(F.col("id").alias(id_col), "n_words", "n_bad", "n_good", F.round("score", 6).alias("score"), (F.col("score") >= threshold).alias("kept"))
