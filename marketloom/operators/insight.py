"""Insight tables: product mixes by population, signals by tier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..stage import handed_over
from .quantile import quantiles

#: Fixed value: a group without any line.
UNKNOWN = "unknown (no certification)"


def mix_label(lines: Column, order: list[str], labels: dict[str, str] | None = None) -> Column:
    """Names of the distinct lines, those of `order` first and as there, others by name; one alone is "X only". Null or no lines: unknown."""
    stated = F.array(*(F.lit(x) for x in order)) if order else F.array().cast("array<string>")
    found = F.array_distinct(lines)
    every = F.concat(F.filter(stated, lambda x: F.array_contains(found, x)), F.array_sort(F.array_except(found, stated)))
    if labels:
        named = F.create_map(*(F.lit(x) for kv in labels.items() for x in kv))
        every = F.transform(every, lambda x: F.coalesce(F.try_element_at(named, x), x))
    n = F.coalesce(F.size(lines), F.lit(0))
    return F.when(n < 1, UNKNOWN).when(F.size(every) == 1, F.concat(F.get(every, F.lit(0)), F.lit(" only"))).otherwise(F.array_join(every, " + "))


def mix_by_population(groups: DataFrame, populations: dict[str, Column], top: int = 5) -> DataFrame:
    """(population, mix, groups, share) of groups (mix, ...): the mixes most frequent in the first population, all others as "other". All
    populations are counted in one pass, and only mixes, never groups, are ranked."""
    names = list(populations)
    n = groups.groupBy("mix").agg(*(F.count_if(populations[p]).alias(p) for p in names))
    kept = n.orderBy(F.desc(names[0]), "mix").limit(top).select("mix", F.lit(True).alias("kept"))
    label = F.when(F.col("kept"), F.col("mix")).otherwise("other").alias("mix")
    long = n.join(F.broadcast(kept), "mix", "left").groupBy(label).agg(*(F.sum(p).alias(p) for p in names)).unpivot("mix", names, "population", "groups")
    return long.where("groups > 0").withColumn("share", N.rounded(F.col("groups") / F.sum("groups").over(Window.partitionBy("population")), 3))


def tier_profile(leads: DataFrame, signals: list[str]) -> DataFrame:
    """(tier, groups, the mean of each signal, median_headcount, companies_per_group) of leads (tier, signals, headcount, members: a number)."""
    means = [N.rounded(F.avg(s), 2).alias(s) for s in signals]
    leads = handed_over(leads.select("tier", *signals, "headcount", "members"), "leads")
    middle = quantiles(leads, "headcount", {"mid": 0.5}, ["tier"]).select("tier", N.rounded(F.col("mid"), 2).alias("median_headcount"))
    return leads.groupBy("tier").agg(F.count("*").alias("groups"), *means, N.rounded(F.avg("members"), 2).alias("companies_per_group")).join(middle, "tier").select("tier", "groups", *signals, "median_headcount", "companies_per_group")


def by_band(leads: DataFrame, band: Column, signals: list[str]) -> DataFrame:
    """(band, groups, the mean of each signal, tier_a: share) of leads by band of headcount; leads without a band are left out, as are bands without leads."""
    means = [N.rounded(F.avg(s), 2).alias(s) for s in signals]
    share = N.rounded(F.avg((F.col("tier") == "A").cast("double")), 2).alias("tier_a")
    return leads.withColumn("band", band).where("band IS NOT NULL").groupBy("band").agg(F.count("*").alias("groups"), *means, share)


def main_area(table: DataFrame, axes: list[str], reach: float = 3.0) -> DataFrame:
    """The table with on_map: on every axis within `reach` interquartile ranges of the median. Rows that lack a coordinate go."""
    placed = handed_over(table.dropna(subset=axes), "placed")
    found = placed
    for a in axes:
        found = found.join(F.broadcast(quantiles(placed, a, {f"_{a}1": 0.25, f"_{a}2": 0.5, f"_{a}3": 0.75})), F.lit(True))  # one row
    near = lambda a: F.col(a).between(F.col(f"_{a}2") - reach * (F.col(f"_{a}3") - F.col(f"_{a}1")), F.col(f"_{a}2") + reach * (F.col(f"_{a}3") - F.col(f"_{a}1")))
    inside = F.lit(True)
    for a in axes:
        inside &= near(a)
    return found.withColumn("on_map", inside).select(*table.columns, "on_map")
