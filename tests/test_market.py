"""Functions, operators and queries of the market engine."""

import os
from datetime import date

import pytest
from pyspark.sql import functions as F

from marketloom.config import Config, Segment, Signal
from marketloom.functions import numbers, text
from marketloom.operators import resolve, score
from marketloom.plans import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def one(spark, column, **values):
    row = {k: v for k, v in values.items()}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'date' if isinstance(v, date) else 'string'}" for k, v in row.items()))
    return df.select(column).first()[0]


@pytest.mark.parametrize(("raw", "want"), [("04 90 11 22 33", "0490112233"), ("+33 4 90 11 22 33", "0490112233"), ("0033490112233", "0490112233"), ("12", None), (None, None)])
def test_phone_key(spark, raw, want):
    assert one(spark, text.phone_key(F.col("x")), x=raw) == want


def test_text(spark):
    assert one(spark, text.normalize(F.col("x")), x="  Été, à Nîmes & Straße ") == "ETE A NIMES STRASSE"
    assert one(spark, text.website_host(F.col("x")), x="WWW.Shop.Example/a?b") == "shop.example"
    assert one(spark, text.website_host(F.col("x")), x="nothing") is None
    assert one(spark, text.normalize_url(F.col("x")), x="https://www.A.example/B/#c") == "a.example/B"
    assert one(spark, text.person_key(F.col("a"), F.col("b"), F.col("c")), a="Durandal (Petit)", b="Aurélie, Anne", c="1975-03") == "DURANDAL|AURELIE|1975-03"
    assert one(spark, text.display_name(F.col("x")), x="ATELIER D'ARC SARL") == "Atelier d'Arc SARL"
    assert one(spark, text.n_words(F.col("x")), x="  ") == 0
    assert one(spark, text.keyword_match(F.col("x"), ["PAC"]), x="ESPACE PACIFIC") is False


@pytest.mark.parametrize(("headcount", "want"), [(60.0, 1), (120.0, 1), (200.0, 1), (30.0, 0.6), (300.0, 0.6), (45.0, 0.8), (250.0, 0.8), (20.0, 0.6), (900.0, 0.6), (None, None)])
def test_size_curve(spark, headcount, want):
    df = spark.createDataFrame([(headcount,)], "x double")
    assert df.select(numbers.size_curve(F.col("x"), Segment())).first()[0] == want


def test_dates_and_bands(spark):
    assert one(spark, numbers.months_before(F.col("x"), 24), x=date(2026, 9, 29)) == date(2024, 9, 28)
    assert one(spark, numbers.band_mid(F.col("x")), x="12") == 34.5
    assert one(spark, numbers.band_mid(F.col("x")), x="NN") is None


def test_config():
    with pytest.raises(ValueError):
        Segment(headcount_min=10, headcount_max=5)
    with pytest.raises(ValueError):
        Config(signals=(Signal("a", "A", 1), Signal("a", "B", 1)))
    with pytest.raises(ValueError):
        Config(product_lines={"x": ("unknown",)})


def test_rubric(spark):
    cfg = Config()
    rows = [(g, g, "ok", s, x, x > 0, 1) for g, xs in (("g1", (1.0, 1.0, 1.0, 1.0)), ("g2", (1.0, 0.5, 0.0, 0.5)), ("g3", (1.0, 1.0, 1.0, 1.0))) for s, x in zip((s.id for s in cfg.signals), xs)]
    signals = spark.createDataFrame(rows, "gid string, name string, status string, signal string, value double, found boolean, n_evidence int")
    market = spark.createDataFrame([("g1", 100.0, False, 0.5, 1), ("g2", 100.0, False, 0.5, 1), ("g3", 100.0, True, 0.5, 1)], "gid string, mid double, is_reference boolean, pre_score double, region int")
    none = spark.createDataFrame([], "gid string, signal string, grade double"), spark.createDataFrame([], "gid string, headcount double")
    got = {r.gid: r for r in score.ranked(score.scored(signals, market, *none, cfg)).collect()}
    assert (got["g1"].score, got["g1"].tier, got["g2"].score, got["g2"].tier) == (10.0, "A", 5.95, "C")
    assert (got["g3"].rank, got["g3"].place, got["g2"].place) == (2, None, 2)


def test_components(spark):
    keys = [(i, f"k{i // 2}") for i in range(40)] + [(i, f"j{(i + 1) // 2}") for i in range(40)] + [(100, "z")]
    got = {r.id: r.root for r in resolve.components(spark.createDataFrame(keys, "id long, key string")).collect()}
    assert got == {i: 0 for i in range(40)} | {100: 100}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["q_queue", "q_merge_establishment", "q_shortlist", "q_cost_per_lead", "q_session", "q_product_mix", "q_rank", "q_hub_rows", "q_contact_rows", "q_copy_checks", "q_lead_card", "q_replay_steps", "q_link_keys", "q_rolled_in", "q_reason"])
def test_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in os.listdir(DATA):
        c.sql(f"create view {t.removesuffix('.parquet')} as select * from '{DATA}/{t}'")
    got, want = QUERIES[name](spark, DATA), c.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    shown = lambda rows: sorted(str(tuple(float(x) if isinstance(x, (int, float)) else str(x) for x in r)) for r in rows)
    assert shown(got.select(*(f"`{c}`" for c in order)).collect()) == shown(want.project(", ".join(f'"{c}"' for c in order)).fetchall())
