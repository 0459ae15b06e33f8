"""Insight operators."""

from pyspark.sql import functions as F

from marketloom.operators import insight


def test_mix_label(spark):
    rows = [(["b", "z", "a", "b"],), (["z", "y"],), (["a"],), ([],), (None,)]
    df = spark.createDataFrame(rows, "lines array<string>")
    got = [r[0] for r in df.select(insight.mix_label(F.col("lines"), ["b", "a"], {"a": "Alpha"})).collect()]
    assert got == ["b + Alpha + z", "y + z", "Alpha only", insight.UNKNOWN, insight.UNKNOWN]
    assert [r[0] for r in df.select(insight.mix_label(F.col("lines"), [])).collect()][:2] == ["a + b + z", "y + z"]


def test_mix_by_population(spark):
    df = spark.createDataFrame([("m1", "A")] * 3 + [("m2", "B")] * 2 + [("m3", "A"), ("m4", None)], "mix string, tier string")
    got = insight.mix_by_population(df, {"all": F.lit(True), "A": F.col("tier") == "A", "none": F.lit(False)}, top=2)
    assert {tuple(r) for r in got.select("population", "mix", "groups", "share").collect()} == {("all", "m1", 3, 0.429), ("all", "m2", 2, 0.286), ("all", "other", 2, 0.286), ("A", "m1", 3, 0.75), ("A", "other", 1, 0.25)}
    assert insight.mix_by_population(df.limit(0), {"all": F.lit(True)}).count() == 0


def test_tier_profile(spark):
    df = spark.createDataFrame([("A", 1.0, 10.0, 1), ("A", 0.5, None, 2), ("B", None, None, 1)], "tier string, growth double, headcount double, members int")
    got = {r["tier"]: tuple(r)[1:] for r in insight.tier_profile(df, ["growth"]).collect()}
    assert got == {"A": (2, 0.75, 10.0, 1.5), "B": (1, None, None, 1.0)}
