"""Spelling variants, hard negatives and exact top-k against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.llm import negatives, spelling, topk, vectors

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spelled(rows):
    c = Counter()
    for d, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            c[w] += len(w) >= 5
    words = {w: n for w, n in c.items() if n >= 3}
    others = {w: [x for x in words if x != w and abs(len(x) - len(w)) <= 1 and near(w, x)] for w in words}
    forms = {w: b for w, o in others.items() if o and words[b := min(o, key=lambda x: (-words[x], x))] >= 2 * words[w]}

    def root(w):
        while w in forms:
            w = forms[w]
        return w

    return {(w, forms.get(w), root(w), n, len(others[w]), words.get(forms.get(w))) for w, n in words.items()}


COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def test_spelling_variants(spark):
    r = random.Random(3)
    stems = ["".join(r.choice("abé") for _ in range(r.randrange(5, 9))) for _ in range(40)] + ["aaaaa", "aaaaaa", "aaaaaaa", "Éclair", "éclair", "eclair", "ÿ×÷ÀÀ", "aabbb", "abbbb"]
    rows = [(None if i % 11 == 0 else i, " ".join(r.choice(stems).upper() if r.random() < 0.2 else r.choice(stems[: r.randrange(1, 49)]) for _ in range(r.randrange(60)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "ab-cd 12 " * 5), (203, ("z" * 3000 + " ") * 3 + ("z" * 2999 + " ") * 7), (1, rows[1][1]), (1, rows[1][1])]
    docs = spark.createDataFrame([(d, t, "w", 1, "f") for d, t in rows], "doc_id long, text string, word string, n int, form string").repartition(3)
    want = spelled(rows)
    assert {tuple(x) for x in spelling.variants(docs).select(*COLUMNS).collect()} == want
    assert any(x[1] != x[2] and x[1] for x in want)  # a chain of two forms
    assert spelling.variants(docs.where("false")).count() == 0


def test_spelling_by_string_ids(spark):
    rows = [(f"d{i}", "colour colour color") for i in range(9)]
    assert {tuple(x) for x in spelling.variants(spark.createDataFrame(rows, "doc_id string, text string")).select(*COLUMNS).collect()} == spelled(rows)


def test_no_word_meets_one_it_is_not_near(spark):
    """Pairs that share a deletion at different places are two edits apart: they don't leave the join."""
    words = ["abcdef", "bacdef", "abcdfe", "abcde", "aabcde", "aaaaab", "aaaaba", "abbcde", "aabbde"]
    table = spark.createDataFrame(list(enumerate(words)), "wid long, word string")
    got = {tuple(sorted((words[a], words[b]))) for a, b in spelling.near(table).collect()}
    assert got == {tuple(sorted((a, b))) for a in words for b in words if a < b and near(a, b)}


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def inner(a, b):
    return sum(x * y for x, y in zip(a, b))


def cells(rows, labelled):
    out = {}
    for i, v, label in rows:
        if i is None or not usable(v) or (labelled and label is None):
            continue
        if labelled:
            label = (label + 1) % 10 if i % 7 == 0 else label
        row = ([math.floor(256 * x) for x in v], label)
        out[i] = min(out.get(i, row), row)
    return out


@pytest.fixture(scope="module")
def points():
    r = np.random.default_rng(4)
    base = r.normal(size=(12, 6)) / 2
    rows = []
    for i in range(900):
        v = (base[i % 12] + r.normal(size=6) * 0.05 * (i % 5)).astype(np.float32).tolist()
        rows.append((i, v, int(r.integers(0, 3))))
    rows += [(900 + i, rows[0][1], i % 3) for i in range(300)]  # copies of one vector: ties in every block
    rows += [(1300, None, 1), (1350, [0.1, None, 0.2], 1), (1400, [float("nan")] * 6, 1), (1450, [float("inf")] + [0.0] * 5, 2), (1500, [], 1), (1550, [0.0] * 6, 2), (1600, [0.5, -0.25], 1)]
    rows += [(None, rows[3][1], 1), (1650, rows[4][1], None), (50, rows[50][1], rows[50][2]), (100, [-1.0] * 6, 0), (1700, [-x for x in rows[0][1]], 2), (1750, [0.9, 0.0, 0.0, 0.0, 0.0, 0.0], 77)]
    return rows


SCHEMA = "vec_id long, embedding array<float>, label int, id long, query long, score double, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(*x, 1, 2, 0.5, 3) for x in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("block", [64, 4096])
def test_exact_top_k(spark, points, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    own = cells(points, False)
    got = defaultdict(list)
    for x in topk.search(frame(spark, points), F.col("vec_id") % 50 == 0, 5, scale=256).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.rank, x.id, x.score))
    for q in (i for i in own if i % 50 == 0):
        best = sorted(((-inner(own[q][0], v), i) for i, (v, _) in own.items() if i != q))[:5]
        assert got[q] == [(r, i, -s) for r, (s, i) in enumerate(best, 1)], q
    assert set(got) == {i for i in own if i % 50 == 0}


def test_top_k_of_little(spark):
    rows = [(0, [1.0, 2.0], 1), (50, [2.0, 1.0], 1), (3, [0.0, 0.0], None)]
    got = topk.search(frame(spark, rows), F.col("vec_id") % 50 == 0, 5)
    assert sorted((x.query_id, x.rank, x.id, x.score) for x in got.collect()) == [(0, 1, 50, 4.0), (0, 2, 3, 0.0), (50, 1, 0, 4.0), (50, 2, 3, 0.0)]
    assert topk.search(frame(spark, rows).where("false"), F.col("vec_id") % 50 == 0, 5).count() == 0
    assert topk.search(frame(spark, rows[2:]), F.col("vec_id") % 50 == 0, 5).count() == 0


def test_top_k_stops_on_proof():
    """Where few vectors are near a query, others aren't scored exactly."""
    r = np.random.default_rng(1)
    x = np.floor(r.normal(size=(4000, 32)) * 30)
    x[:5] = x[100] + r.integers(-2, 3, size=(5, 32))
    doc, term = np.nonzero(x)
    level = topk.impact(x[doc, term])
    segments = [{"impact": int(i), "doc": doc[level == i].astype(np.int32).tobytes(), "term": term[level == i].astype(np.int32).tobytes(), "value": x[doc, term][level == i].tobytes()} for i in np.unique(level)[::-1]]
    best = vectors.Best.of(1, 5)
    scored = topk.visit(np.arange(4000), segments, 32, np.array([100]), x[100:101], best)
    exact = np.delete(np.arange(4000), 100)
    exact = exact[np.lexsort((exact, -(x[exact] @ x[100])))][:5]
    assert best.ids[0].tolist() == exact.tolist() and scored <= 4000 // topk.SHARE


@pytest.mark.parametrize(("piece", "sample"), [(32, 64), (2048, 16384)])
def test_hard_negatives(spark, points, monkeypatch, piece, sample):
    monkeypatch.setattr(negatives, "PIECE", piece)
    monkeypatch.setattr(negatives, "SAMPLE", sample)
    own = cells(points, True)
    vec_id, label = F.col("vec_id"), F.col("label").cast("long")
    found = negatives.mine(frame(spark, points), vec_id % 50 == 0, F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label), scale=256)
    want = set()
    for a in (i for i in own if i % 50 == 0):
        scores = {i: inner(own[a][0], v) for i, (v, _) in own.items() if i != a}
        for p in sorted((i for i in scores if own[i][1] == own[a][1]), key=lambda i: (-scores[i], i))[:5]:
            fit = [i for i in scores if own[i][1] != own[a][1] and 50 * scores[p] <= 100 * scores[i] <= 95 * scores[p]]
            for rank, n in enumerate(sorted(fit, key=lambda i: (-scores[i], i))[:3], 1):
                want.add((a, p, rank, n, scores[p], scores[n]))
    assert {tuple(x) for x in found.collect()} == want and want
    assert negatives.mine(frame(spark, points).where("false"), vec_id % 50 == 0, label).count() == 0


def test_negatives_skip_lists_by_bound():
    """Lists outside the window, or whose bound is below the kth score, aren't scored."""
    r = np.random.default_rng(2)
    pieces = []
    for i, at in enumerate((100, 60, 20, -50)):
        x = np.floor(r.normal(size=(50, 4)) + [at, 0, 0, 0])
        pieces.append({"dims": 4, "centroid": x.mean(axis=0).tobytes(), "radius": float(np.sqrt(((x - x.mean(axis=0)) ** 2).sum(axis=1)).max()), "ids": np.arange(50 * i, 50 * i + 50).tobytes(), "labels": np.zeros(50, np.int64).tobytes(), "vecs": x.tobytes()})
    q = np.array([[10.0, 0, 0, 0]])
    args = np.array([999]), q, np.array([1]), np.array([[400.0]]), np.array([[800.0]])
    best = [vectors.Best.of(1, 3)]
    assert negatives.visit(pieces, *args, False, best) == 50  # only the list at 60 can score 400 to 800
    assert set(best[0].ids[0] // 50) == {1}
    best = [vectors.Best.of(1, 3)]
    assert negatives.visit(pieces, *args[:3], np.array([[-1e9]]), np.array([[1e9]]), False, best) == 50  # the others' bounds are below the third score
