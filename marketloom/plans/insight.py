"""Insight tables over all populations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import insight as I
from ..operators import resolve
from .registry import q
from .scoring import scored

_ORDER = ["PROMO", "STANDARD", "ECONOMY"]
_LABEL = "string_agg(domain,' + ' ORDER BY CASE domain WHEN 'PROMO' THEN 0 WHEN 'STANDARD' THEN 1 WHEN 'ECONOMY' THEN 2 ELSE 3 END, domain)"
_GROUPS = f"SELECT gid, mk.mid, tier, coalesce(s.is_reference, true) AS reference, CASE WHEN k IS NULL THEN 'unknown (no certification)' WHEN k=1 THEN label||' only' ELSE label END AS mix FROM mk LEFT JOIN (SELECT siren, count(*) AS k, {_LABEL} AS label FROM (SELECT DISTINCT siren, domain FROM reg) GROUP BY siren) ON siren=id LEFT JOIN (SELECT gid, tier, is_reference FROM scored) s USING (gid)"
_COUNTED = "SELECT mix, unnest(['Market','In segment','Researched','Tier A']) AS population, unnest([true, coalesce(mid BETWEEN 30 AND 300, false), NOT reference, NOT reference AND tier='A']) AS is_in FROM g"


@q(
    "q_mix_by_population",
    f"SELECT population, mix, n AS groups, round_even(n/sum(n) OVER (PARTITION BY population)::DOUBLE,3) AS share FROM (SELECT population, CASE WHEN mix IN (SELECT mix FROM ({_GROUPS}) GROUP BY mix ORDER BY count(*) DESC, mix LIMIT 5) THEN mix ELSE 'other' END AS mix, count(*) AS n FROM ({_COUNTED.replace('FROM g', f'FROM ({_GROUPS})')}) WHERE is_in GROUP BY ALL)",
    "mk reg scored",
)
def _(v):
    lines = v.reg.groupBy(F.col("siren").alias("id")).agg(F.collect_set("domain").alias("lines"))
    judged = scored(v).select("gid", "tier", "is_reference")
    groups = v.mk.select("gid", "id", "mid").join(lines, "id", "left").join(judged, "gid", "left").withColumn("mix", I.mix_label(F.col("lines"), _ORDER))
    researched = ~F.coalesce("is_reference", F.lit(True))
    low, high = v.cfg.segment.headcount_min, v.cfg.segment.headcount_max
    return I.mix_by_population(groups, {"Market": F.lit(True), "In segment": F.col("mid").between(low, high), "Researched": researched, "Tier A": researched & (F.col("tier") == "A")})


@q(
    "q_tier_profile",
    "SELECT tier, count(*) AS groups, round_even(avg(size_fit),2) AS size_fit, round_even(avg(product_mix),2) AS product_mix, round_even(avg(growth),2) AS growth, round_even(avg(tech_maturity),2) AS tech_maturity, round_even(median(hc),2) AS median_headcount, round_even(avg(members),2) AS companies_per_group FROM scored JOIN (SELECT 'g'||id AS gid, count(*) OVER (PARTITION BY root) AS members FROM comp) USING (gid) WHERE NOT is_reference GROUP BY tier",
    "scored comp",
)
def _(v):
    of = resolve.with_roots(v.co.select("id"), v.keys)
    sizes = of.groupBy("root").agg(F.count("*").alias("members"))
    members = of.join(sizes, "root").select(F.concat(F.lit("g"), "id").alias("gid"), "members")
    leads = scored(v).where("NOT is_reference").withColumnRenamed("hc", "headcount").join(members, "gid")
    return I.tier_profile(leads, [s.id for s in v.cfg.signals])
