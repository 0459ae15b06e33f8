"""Exact quantiles in bounded memory: distributed selection by histograms that are refined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..stage import discard, handed_over

BINS = 4096


def _bin(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Grows with v, from 0 at lo to bins - 1 at hi. Halves, so that no difference overflows."""
    share = (v / 2 - lo / 2) / (hi / 2 - lo / 2)
    return F.when(hi > lo, F.least(F.floor(share * bins), F.lit(bins - 1))).otherwise(0).cast("int")


def quantiles(table: DataFrame, value: str, at: dict[str, float], by: list[str] | None = None, bins: int = BINS) -> DataFrame:
    """A row a group (one, without `by`), with its quantile at[name] as `name`: between the two nearest values in proportion, as percentile() has it. Nulls and NaN are no
    values; a group without values has nulls. Groups may be null.

    A pass counts the values of each group in `bins` bins between the least and the largest that its quantile can be, keeps the bin in which
    its place falls, and goes on with the values within that bin alone, until they are all the same: two or three passes unless values lie in very uneven places. No buffer
    holds more than `bins` counts a quantile of a group, and values are counted where they lie before anything is sent."""
    by, spark = list(by or ()), table.sparkSession
    taken = [f"_g{i}" for i in range(len(by))]
    keyed = handed_over(table.select(*(F.col(c).alias(g) for c, g in zip(by, taken)), F.col(value).cast("double").alias("_v")), "values")
    values = keyed.where("_v IS NOT NULL AND NOT isnan(_v)")
    names = list(at)
    ends = F.explode(F.array(*(F.struct(F.lit(i).alias("_q"), F.lit(j).alias("_end"), F.lit(float(at[n])).alias("_at")) for i, n in enumerate(names) for j in (0, 1))))
    all_ = values.groupBy(*taken).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")).where("_n > 0")
    place = F.col("_at") * (F.col("_n") - 1)
    first = all_.select(*taken, "_n", "_lo", "_hi", ends.alias("_t")).select(*taken, "_n", "_lo", "_hi", "_t.*")
    share = (place - F.floor(place)).alias("_share")
    # _k: how many values of the range come before the one that is sought
    state = handed_over(first.select(*taken, "_q", "_end", share, F.when(F.col("_end") == 0, F.floor(place)).otherwise(F.ceil(place)).cast("long").alias("_k"), "_lo", "_hi"), "places")
    while not state.where("_lo < _hi").isEmpty():
        state = _refined(values, state, taken, bins)
    one = state.groupBy(*taken, "_q").agg(F.max(F.when(F.col("_end") == 0, F.col("_lo"))).alias("_a"), F.max(F.when(F.col("_end") == 1, F.col("_lo"))).alias("_b"), F.max("_share").alias("_share"))
    found = one.groupBy(*taken).agg(*(F.max(F.when(F.col("_q") == i, (1 - F.col("_share")) * F.col("_a") + F.col("_share") * F.col("_b"))).alias(n) for i, n in enumerate(names)))
    groups = keyed.select(*taken).distinct() if by else spark.range(1).select()
    met = groups.alias("g").join(found.alias("f"), _same(taken), "left") if by else groups.join(found, F.lit(True), "left")  # one row and one
    return met.select(*(F.col(f"g.{g}").alias(c) for c, g in zip(by, taken)), *names)


def _same(taken: list[str]) -> Column:
    out = F.lit(True)
    for g in taken:
        out &= F.col(f"g.{g}").eqNullSafe(F.col(f"f.{g}"))
    return out


def _refined(values: DataFrame, state: DataFrame, taken: list[str], bins: int) -> DataFrame:
    """The state after one more pass: ranges that hold one value only stay as they are."""
    # ends of one quantile that still look at the same range are counted once
    ranges = state.where("_lo < _hi").select(*taken, "_lo", "_hi").distinct()
    inside = F.col("f._v").between(F.col("g._lo"), F.col("g._hi"))
    met = ranges.alias("g").join(values.alias("f"), _same(taken) & inside)
    counted = met.select(*(F.col(f"g.{t}").alias(t) for t in taken), F.col("g._lo").alias("_lo"), F.col("g._hi").alias("_hi"), F.col("f._v").alias("_v"))
    counted = counted.groupBy(*taken, "_lo", "_hi", _bin(F.col("_v"), F.col("_lo"), F.col("_hi"), bins).alias("_bin")).agg(F.count("*").alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    along = Window.partitionBy(*taken, "_lo", "_hi").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    summed = counted.withColumn("_upto", F.sum("_n").over(along))
    same = _same([*taken, "_lo", "_hi"])
    hit = state.alias("g").join(summed.alias("f"), same & (F.col("g._k") < F.col("f._upto")) & (F.col("g._k") >= F.col("f._upto") - F.col("f._n")), "left")
    keep = lambda c, new: F.coalesce(new, F.col(f"g.{c}")).alias(c)
    out = handed_over(hit.select(*(F.col(f"g.{c}").alias(c) for c in [*taken, "_q", "_end", "_share"]), keep("_k", F.col("g._k") - (F.col("f._upto") - F.col("f._n"))), keep("_lo", F.col("f._least")), keep("_hi", F.col("f._most"))), "places")
    discard(state)
    return out
