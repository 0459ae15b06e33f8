"""Operators that have one way for little and another for much: both give the same."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom import stage
from marketloom.operators import quantile, rank, resolve, score, terms


@pytest.mark.parametrize("small", [0, 1 << 30])
@pytest.mark.parametrize("scores", [1, 7])
def test_ranks(spark, small, scores):
    r = random.Random(1)
    rows = [(f"g{i}", f"n{r.randrange(50)}", float(r.randrange(scores)), 0, i % 5 == 0) for i in range(3000)]
    table = spark.createDataFrame(rows, "gid string, name string, score double, evidence_backed int, is_reference boolean").repartition(5)
    got = {x.gid: (x["rank"], x.place) for x in score.ranked(table, small=small).collect()}
    order = sorted(rows, key=lambda x: (-x[2], x[1], x[0]))
    places = {x[0]: i for i, x in enumerate((x for x in order if not x[4]), 1)}
    assert got == {x[0]: (i, places.get(x[0])) for i, x in enumerate(order, 1)}
    assert score.ranked(table.where("false"), small=small).count() == 0


def test_ties_are_parted(spark):
    """All leads tied in score and evidence: no range holds a large part of them."""
    table = spark.range(20000).select(F.concat(F.lit("g"), "id").alias("gid"), F.lit("n").alias("name"), F.lit(1.0).alias("score"), F.lit(0).alias("evidence_backed"), F.lit(False).alias("is_reference"))
    score.ranked(table, small=0)
    ranges = spark.read.parquet(next(p for p in reversed(stage._STORED) if "/ranges-" in p))
    sizes = [x["count"] for x in ranges.groupBy(F.shiftright(rank._AT, 33)).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 8000


@pytest.mark.parametrize("small", [0, 1 << 30])
@pytest.mark.parametrize("nodes", [50, 1 << 20])
def test_components(spark, monkeypatch, small, nodes):
    monkeypatch.setattr(resolve, "SMALL", small)
    monkeypatch.setattr(resolve, "NODES", nodes)
    r = random.Random(2)
    rows = [(i, f"k{i}") for i in range(400)] + [(i + 1, f"k{i}") for i in range(199)]  # a path, and ids alone
    rows += [(r.randrange(400, 900), f"s{r.randrange(300)}") for _ in range(600)] + [(i, "hot") for i in range(1000, 1700)] + [(None, "hot"), (5000, None), (1000, "hot")]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    first = {}
    for i, k in rows:
        if i is not None and k is not None:
            a, b = find(i), find(first.setdefault(k, i))
            parent[max(a, b)] = min(a, b)
    table = spark.createDataFrame(rows, "id long, key string").repartition(6)
    got = {x.id: x.root for x in resolve.components(table).collect()}
    assert got == {i: find(i) if i is not None else None for i in {x[0] for x in rows}}
    assert resolve.linked(table.where("false")).count() == 0


@pytest.mark.parametrize("bins", [16, 4096])
def test_quantiles(spark, bins):
    r = np.random.default_rng(3)
    groups = {"a": r.normal(size=900), "b": np.repeat([1.0, 2.0], 50), "c": np.array([7.0]), None: r.integers(0, 5, 40).astype(float), "wide": 10.0 ** r.integers(-6, 6, 99) * r.choice([-1, 1], 99)}
    rows = [(g, float(x), "x") for g, v in groups.items() for x in v] + [("a", None, "y"), ("a", float("nan"), "y"), ("none", None, "y")]
    table = spark.createDataFrame(rows, "g string, v double, mid string").repartition(4)
    got = {x.g: (x.low, x.mid, x.high) for x in quantile.quantiles(table, "v", {"low": 0.1, "mid": 0.5, "high": 1.0}, ["g"], bins).collect()}
    assert got.pop("none") == (None, None, None) and set(got) == set(groups)
    for g, v in groups.items():
        assert np.allclose(got[g], np.quantile(v, [0.1, 0.5, 1.0]), rtol=1e-9, atol=0), g
    whole = quantile.quantiles(table, "v", {"mid": 0.5}, bins=bins).first()
    assert math.isclose(whole.mid, np.quantile(np.concatenate(list(groups.values())), 0.5), rel_tol=1e-9)
    assert quantile.quantiles(table.where("false"), "v", {"mid": 0.5}).collect()[0].mid is None


def test_quantile_of_many_values(spark):
    table = spark.range(1_000_000).select(F.pmod(F.col("id") * 7919, F.lit(1_000_003)).cast("double").alias("v"))
    values = np.sort(np.arange(1_000_000, dtype=np.int64) * 7919 % 1_000_003)
    got = quantile.quantiles(table, "v", {"a": 0.25, "b": 0.999}).first()
    assert (got.a, got.b) == tuple(np.quantile(values, [0.25, 0.999]))


@pytest.mark.parametrize("most", [40, 8 << 20])
def test_term_scan(spark, most):
    texts = [(1, "the cat sat on the mat"), (2, None), (3, ""), (4, "a" * 5000 + "needle in a haystack"), (5, "concatenate é à"), (1, "the cat sat on the mat"), (6, "no")]
    wanted = ["cat", "needle in a hay", "é à", "mat", "", None, "cat", "x" * 2000, "the cat sat on the mat, it did"]
    table = spark.createDataFrame(texts, "id int, text string").repartition(3)
    got = {(x.id, x.n_terms) for x in terms.scan(table, F.col("text"), spark.createDataFrame([(t,) for t in wanted], "t string"), F.col("t"), ["id"], most).collect()}
    assert got == {(i, n) for i, t in texts if t and (n := sum(w in t for w in set(filter(None, wanted))))}
    assert terms.scan(table, F.col("text"), spark.createDataFrame([], "t string"), F.col("t"), ["id"]).count() == 0


def test_term_scan_holds_one_text_at_a_time():
    """A batch's texts aren't all Python strings at once."""
    import tracemalloc

    import ahocorasick
    import pyarrow as pa

    found = ahocorasick.Automaton()
    for i, t in enumerate(("abc", "bcd", "zz")):
        found.add_word(t, i)
    found.make_automaton()
    batch = pa.array(["abcd" * 50_000, "none", "zz abc"] * 100)
    tracemalloc.start()
    try:
        got = terms.counted(batch, found)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got.to_pylist() == [2, 0, 2] * 100 and peak < 2_000_000  # the texts are 20 MB
