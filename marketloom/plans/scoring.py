"""Signals, rubric, ledger, insight, hand-off and event-window queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..operators import score as S
from ..operators import terms
from ..operators.quantile import quantiles
from ..stage import handed_over
from .registry import q
from .testbed import SIGNALS


def scored(v, weights=None):
    v = v.staged
    return S.scored(v.sg, v.mk, v.grades, v.heads, v.cfg, weights)


def ranked(v, weights=None):
    return S.ranked(scored(v, weights))


R = N.rounded

# signals


@q("q_signals_long", "SELECT gid, signal, CASE WHEN status='ok' THEN value END AS value, found, status FROM sg", "sg")
def _(v):
    return v.sg.select("gid", "signal", F.when(F.col("status") == "ok", F.col("value")).alias("value"), "found", "status")


@q("q_validate_answers", "SELECT event_id, CASE WHEN value BETWEEN 0 AND 50 AND event_type IN ('click','view','purchase') THEN 'ok' ELSE 'failed' END AS status FROM events")
def _(v):
    raw = F.to_json(F.struct("event_id", "value", "event_type"))
    r = v.table("events").select(F.from_json(raw, "event_id long, value double, event_type string").alias("r")).select("r.*")
    return r.select("event_id", F.when(F.col("value").between(0, 50) & F.col("event_type").isin("click", "view", "purchase"), "ok").otherwise("failed").alias("status"))


@q("q_evidence_flags", "SELECT gid, signal, CASE WHEN value>0 AND n_evidence=0 THEN 'no_evidence' END AS flag FROM sg WHERE status='ok'", "sg")
def _(v):
    return v.sg.where("status = 'ok'").select("gid", "signal", F.when((F.col("value") > 0) & (F.col("n_evidence") == 0), "no_evidence").alias("flag"))


_HREF = """SELECT page_id, unnest(regexp_extract_all(html,'href="([^"]+)"',1)) AS link FROM pages"""


@q("q_unverified_url", f"SELECT page_id, link FROM (SELECT DISTINCT page_id, link FROM ({_HREF})) a WHERE link NOT IN (SELECT link FROM ({_HREF}) WHERE page_id%2=0)")
def _(v):
    links = v.table("pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("link")).distinct()
    return links.join(links.where("page_id % 2 = 0").select("link").distinct(), "link", "left_anti").select("page_id", "link")


@q("q_evidence_backed", "SELECT * FROM backed", "backed")
def _(v):
    return v.sg.where("status = 'ok'").groupBy("gid").agg(F.count_if(F.col("found") & (F.col("n_evidence") > 0)).alias("evidence_backed"))


@q("q_regrade_override", "SELECT gid, signal, v FROM vals", "vals")
def _(v):
    return S.values(v.sg, v.mk, v.grades, v.heads, v.cfg).select("gid", "signal", "v")


@q("q_replay_miss", "SELECT DISTINCT key FROM lg WHERE event_id%3=0 AND key NOT IN (SELECT key FROM lg WHERE event_id%3<>0)", "lg")
def _(v):
    return v.lg.where("event_id % 3 = 0").select("key").distinct().join(v.lg.where("event_id % 3 <> 0").select("key").distinct(), "key", "left_anti")


@q("q_replay_cost", "SELECT lead, arg_max(key, event_id) AS last_key, count(DISTINCT key) AS n_keys FROM lg GROUP BY lead", "lg")
def _(v):
    return v.lg.groupBy("lead").agg(F.max_by("key", "event_id").alias("last_key"), F.countDistinct("key").alias("n_keys"))


@q("q_fetch_summary", "SELECT doc_id, CAST(round_even(n,-1) AS BIGINT) AS about FROM (SELECT doc_id, len(list_filter(string_split_regex(trim(text,chr(32)||chr(10)||chr(9)),'[ \\n\\t]+'), lambda x: x<>'')) AS n FROM documents) WHERE n>=20")
def _(v):
    return v.table("documents").select("doc_id", F.size(F.array_remove(F.split("text", "[ \n\t]+"), "")).alias("n")).where("n >= 20").select("doc_id", F.bround("n", -1).cast("long").alias("about"))


@q("q_utilization_cap", "SELECT purpose, arg_max(value, (called, event_id)) AS latest, arg_max(value, (called, event_id))/100.0>CASE purpose WHEN 'click' THEN 0.9 ELSE 0.7 END AS stop FROM lg GROUP BY purpose", "lg")
def _(v):
    u = v.lg.groupBy("purpose").agg(F.max_by("value", F.struct("called", "event_id")).alias("latest"))
    return u.select("purpose", "latest", (F.col("latest") / 100.0 > F.when(F.col("purpose") == "click", 0.9).otherwise(0.7)).alias("stop"))


# score


@q("q_size_curve", "SELECT gid, hc, curve FROM curved", "curved")
def _(v):
    return v.mk.join(v.heads, "gid", "left").select("gid", F.coalesce("headcount", "mid").alias("hc")).select("gid", "hc", N.size_curve(F.col("hc"), v.cfg.segment).alias("curve"))


@q("q_score", "SELECT gid, size_fit, product_mix, growth, tech_maturity, score FROM scored", "scored")
def _(v):
    return scored(v).select("gid", *SIGNALS, "score")


@q("q_tier", "SELECT tier, count(*) AS n FROM scored GROUP BY tier", "scored")
def _(v):
    return scored(v).groupBy("tier").agg(F.count("*").alias("n"))


@q("q_rank", "SELECT gid, score, rank FROM ranked", "ranked")
def _(v):
    return ranked(v).select("gid", "score", "rank")


@q("q_queue", "SELECT gid, name, score, tier, evidence_backed, place AS queue_rank FROM ranked WHERE place<=50", "ranked")
def _(v):
    top = S.queue(scored(v), v.cfg.queue_size)
    return top.withColumn("queue_rank", F.row_number().over(Window.orderBy(*S.best_first()))).select("gid", "name", "score", "tier", "evidence_backed", "queue_rank")


@q("q_reference_flag", "SELECT gid, is_reference FROM scored", "scored")
def _(v):
    return scored(v).select("gid", "is_reference")


@q("q_tie_break", "SELECT count(*) FILTER (WHERE place<=50 AND score=(SELECT score FROM ranked WHERE place=51)) AS places FROM ranked", "ranked")
def _(v):
    top = S.queue(scored(v), v.cfg.queue_size + 1).withColumn("place", F.row_number().over(Window.orderBy(*S.best_first())))
    cut = top.where(F.col("place") == v.cfg.queue_size + 1).select(F.col("score").alias("cut"))
    return top.where(F.col("place") <= v.cfg.queue_size).join(F.broadcast(cut), F.lit(True), "left").agg(F.count_if(F.col("score") == F.col("cut")).alias("places"))


@q("q_score_report", "SELECT count(*) AS scored, count(*) FILTER (WHERE tier='A') AS a, count(*) FILTER (WHERE tier='B') AS b, count(*) FILTER (WHERE tier='C') AS c, count(DISTINCT score) AS distinct_scores FROM scored", "scored")
def _(v):
    return scored(v).agg(F.count("*").alias("scored"), *(F.count_if(F.col("tier") == t).alias(t.lower()) for t in "ABC"), F.countDistinct("score").alias("distinct_scores"))


_NEW = "round_even(1+9*(size_fit*3+product_mix*0+growth*5+tech_maturity*2)/10,2)"
_RE = f"SELECT *, row_number() OVER (ORDER BY new_score DESC, evidence_backed DESC, name, gid) AS new_rank, CASE WHEN NOT is_reference THEN row_number() OVER (PARTITION BY is_reference ORDER BY new_score DESC, evidence_backed DESC, name, gid) END AS new_place FROM (SELECT *, {_NEW} AS new_score FROM ranked)"
WEIGHTS = {"size_fit": 3.0, "product_mix": 0.0, "growth": 5.0, "tech_maturity": 2.0}


def reranked(v):
    both = scored(v).withColumn("new_score", S.weighted(WEIGHTS)).select("gid", "name", "evidence_backed", "is_reference", "score", "new_score")
    return S.ranked(S.ranked(both), "new_score", ("new_rank", "new_place"))


@q("q_rerank", f"SELECT gid, score, new_score, rank, new_rank, rank-new_rank AS rank_change FROM ({_RE})", "ranked")
def _(v):
    return reranked(v).select("gid", "score", "new_score", "rank", "new_rank", (F.col("rank") - F.col("new_rank")).alias("rank_change"))


@q("q_queue_moves", f"SELECT gid, CASE WHEN new_place<=50 THEN 'entered' ELSE 'left' END AS move FROM ({_RE}) WHERE (place<=50)<>(new_place<=50)", "ranked")
def _(v):
    a, b = S.queue(scored(v), v.cfg.queue_size).select("gid"), S.queue(scored(v, WEIGHTS), v.cfg.queue_size).select("gid")
    return b.exceptAll(a).withColumn("move", F.lit("entered")).unionByName(a.exceptAll(b).withColumn("move", F.lit("left")))


@q("q_moved_view", f"SELECT gid, CASE WHEN place>50 THEN 'NEW' WHEN place>new_place THEN '▲'||(place-new_place) WHEN place<new_place THEN '▼'||(new_place-place) ELSE '–' END AS moved FROM ({_RE}) WHERE new_place<=50", "ranked")
def _(v):
    d = F.col("place") - F.col("new_place")
    return reranked(v).where("new_place <= 50").select("gid", F.when(F.col("place") > 50, "NEW").when(d > 0, F.concat(F.lit("▲"), d)).when(d < 0, F.concat(F.lit("▼"), -d)).otherwise("–").alias("moved"))


@q("q_queue_filter", "SELECT gid, score, region, CASE WHEN is_reference THEN 'calibration' WHEN place<=50 THEN CAST(place AS VARCHAR) ELSE '' END AS queue FROM ranked WHERE tier='A' AND region IN (1,2)", "ranked")
def _(v):
    return ranked(v).where((F.col("tier") == "A") & F.col("region").isin(1, 2)).select("gid", "score", "region", F.when(F.col("is_reference"), "calibration").when(F.col("place") <= 50, F.col("place").cast("string")).otherwise("").alias("queue"))


@q("q_contributions", "SELECT gid, signal, round_even(9*v*CASE signal WHEN 'size_fit' THEN 3 WHEN 'product_mix' THEN 3 ELSE 2 END/10.0,6) AS points FROM vals", "vals")
def _(v):
    w = F.create_map(*(F.lit(x) for kv in v.cfg.weights.items() for x in kv))
    return S.values(v.sg, v.mk, v.grades, v.heads, v.cfg).select("gid", "signal", R(9 * F.col("v") * w[F.col("signal")] / 10.0, 6).alias("points"))


# ledger

_ONE = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY event_id) AS o FROM lg) WHERE o=1)"
_USD = "(input_tokens*5+cache_read*0.5+output_tokens*25)/1000000.0+searches*0.01"


def once(v):
    return v.lg.withColumn("o", F.row_number().over(Window.partitionBy("key").orderBy("event_id"))).where("o = 1").drop("o")


def usd():
    return (F.col("input_tokens") * 5 + F.col("cache_read") * 0.5 + F.col("output_tokens") * 25) / 1e6 + F.col("searches") * 0.01


@q("q_ledger_dedupe", f"SELECT event_id, key FROM {_ONE}", "lg")
def _(v):
    return once(v).select("event_id", "key")


@q("q_cost_per_lead", f"SELECT lead, count(*) AS calls, round_even(sum(({_USD})::DOUBLE),4) AS usd, CAST(sum(input_tokens) AS BIGINT) AS tokens FROM {_ONE} GROUP BY lead", "lg")
def _(v):
    return once(v).groupBy("lead").agg(F.count("*").alias("calls"), R(F.sum(usd()), 4).alias("usd"), F.sum("input_tokens").alias("tokens"))


@q("q_cost_summary", f"SELECT round_even(avg(x),6) AS mean, round_even(quantile_cont(x,0.5),6) AS p50, round_even(quantile_cont(x,0.9),6) AS p90, round_even(max(x),6) AS most FROM (SELECT lead, sum(input_tokens)::DOUBLE AS x FROM {_ONE} GROUP BY lead)", "lg")
def _(v):
    x = once(v).groupBy("lead").agg(F.sum("input_tokens").cast("double").alias("x"))
    x = handed_over(x, "leads")
    return x.agg(R(F.avg("x"), 6).alias("mean"), R(F.max("x"), 6).alias("most")).join(quantiles(x, "x", {"p50": 0.5, "p90": 0.9})).select("mean", R(F.col("p50"), 6).alias("p50"), R(F.col("p90"), 6).alias("p90"), "most")


@q("q_cache_hit", "SELECT purpose, round_even(coalesce(sum(cache_read)/nullif(sum(cache_read+input_tokens),0),0)::DOUBLE,6) AS rate FROM lg GROUP BY purpose", "lg")
def _(v):
    return v.lg.groupBy("purpose").agg(R(F.coalesce(F.try_divide(F.sum("cache_read"), F.sum(F.col("cache_read") + F.col("input_tokens"))), F.lit(0.0)), 6).alias("rate"))


@q("q_notional", "SELECT purpose, round_even(sum(value),4) AS notional FROM lg WHERE backend='cli' AND value IS NOT NULL GROUP BY purpose", "lg")
def _(v):
    return v.lg.where("backend = 'cli' AND value IS NOT NULL").groupBy("purpose").agg(R(F.sum("value"), 4).alias("notional"))


@q("q_run_cost", f"SELECT round_even(sum(coalesce(CASE WHEN backend='cli' THEN value ELSE ({_USD})::DOUBLE END,0)),3) AS cost FROM lg", "lg")
def _(v):
    return v.lg.agg(R(F.sum(F.coalesce(F.when(F.col("backend") == "cli", F.col("value")).otherwise(usd()), F.lit(0.0))), 3).alias("cost"))


@q("q_last_run", "SELECT max(substr(CAST(called AS VARCHAR),1,10)) AS day FROM lg WHERE purpose='view'", "lg")
def _(v):
    return v.lg.where("purpose = 'view'").agg(F.max(F.substr(F.col("called").cast("string"), F.lit(1), F.lit(10))).alias("day"))


_CMP = "SELECT a.gid, a.signal, a.value AS va, CASE WHEN a.id%6=0 THEN NULL ELSE (a.value+CASE WHEN a.id%4=0 THEN 0.25 ELSE 0 END) END AS vb FROM sg a WHERE status='ok'"


def two_runs(v):
    a = v.sg.where("status = 'ok'")
    b = a.select("gid", "signal", F.when(F.col("id") % 6 == 0, None).otherwise(F.col("value") + F.when(F.col("id") % 4 == 0, 0.25).otherwise(0.0)).alias("vb"))
    return a.select("gid", "signal", F.col("value").alias("va")).join(b, ["gid", "signal"])


@q("q_compare_agreement", f"SELECT signal, round_even(avg(CASE WHEN va=vb THEN 1.0 ELSE 0.0 END),6) AS agree, round_even(avg(abs(va-vb)),6) AS diff FROM ({_CMP}) GROUP BY signal", "sg")
def _(v):
    return two_runs(v).groupBy("signal").agg(R(F.avg(F.when(F.col("va") == F.col("vb"), 1.0).otherwise(0.0)), 6).alias("agree"), R(F.avg(F.abs(F.col("va") - F.col("vb"))), 6).alias("diff"))


@q("q_compare_disagreements", f"SELECT gid, signal, va, vb::DOUBLE AS vb FROM ({_CMP}) WHERE va<>vb OR va IS NULL OR vb IS NULL", "sg")
def _(v):
    return two_runs(v).where("va <> vb OR va IS NULL OR vb IS NULL")


# insights


@q("q_researched", "SELECT gid, score, region, place FROM ranked WHERE NOT is_reference", "ranked")
def _(v):
    return ranked(v).where("NOT is_reference").select("gid", "score", "region", "place")


_RK = "(rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1)/2.0)"


@q("q_spearman", f"SELECT round_even(corr(a,b),6) AS rho FROM (SELECT {_RK.format('pre_score')} AS a, {_RK.format('score')} AS b FROM scored)", "scored")
def _(v):
    s = scored(v).select("pre_score", "score")
    for c, r in (("pre_score", "a"), ("score", "b")):
        # ranks by value: a row for each distinct value, not for each lead
        n = s.groupBy(c).agg(F.count("*").alias("n")).withColumn(r, F.sum("n").over(Window.orderBy(c)) - F.col("n") + (F.col("n") + 1) / 2.0).drop("n")
        s = s.join(n, c)
    return s.agg(R(F.corr("a", "b"), 6).alias("rho"))


@q("q_by_level", "SELECT pre_score, count(*) AS n, median(score) AS mid, round_even(avg(CASE WHEN tier='A' THEN 1.0 ELSE 0.0 END),6) AS share_a FROM scored WHERE NOT is_reference GROUP BY pre_score", "scored")
def _(v):
    s = handed_over(scored(v).where("NOT is_reference").select("pre_score", "score", "tier"), "leads")
    level = s.groupBy("pre_score").agg(F.count("*").alias("n"), R(F.avg(F.when(F.col("tier") == "A", 1.0).otherwise(0.0)), 6).alias("share_a"))
    return level.join(quantiles(s, "score", {"mid": 0.5}, ["pre_score"]), "pre_score")


@q("q_topn_overlap", "SELECT count(*) AS n FROM (SELECT gid FROM ranked WHERE place<=50 INTERSECT SELECT gid FROM (SELECT gid FROM scored ORDER BY pre_score DESC, gid LIMIT 50))", "ranked")
def _(v):
    s = scored(v)
    return S.queue(s, 50).select("gid").intersect(s.orderBy(F.desc("pre_score"), "gid").limit(50).select("gid")).agg(F.count("*").alias("n"))


@q("q_pre_rank_refs", "SELECT gid, r FROM (SELECT gid, is_reference, rank() OVER (ORDER BY pre_score DESC) AS r FROM scored) WHERE is_reference", "scored")
def _(v):
    s = scored(v)
    n = s.groupBy("pre_score").agg(F.count("*").alias("n")).withColumn("r", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("pre_score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1).drop("n")
    return s.where("is_reference").join(n, "pre_score").select("gid", "r")


_BIN = "CASE WHEN hc<30 THEN '0-29' WHEN hc<60 THEN '30-59' WHEN hc<100 THEN '60-99' WHEN hc<200 THEN '100-199' ELSE '200+' END"


def bins(x):
    labels = F.array(*map(F.lit, ("0-29", "30-59", "60-99", "100-199", "200+")))
    return F.element_at(labels, 1 + F.size(F.filter(F.array(*map(F.lit, (30.0, 60.0, 100.0, 200.0))), lambda e: x >= e)))


@q("q_headcount_bins", f"SELECT {_BIN} AS bin, count(*) AS n, round_even(avg(growth),6) AS growth, round_even(avg(product_mix),6) AS product_mix FROM scored WHERE hc IS NOT NULL AND NOT is_reference GROUP BY 1", "scored")
def _(v):
    return scored(v).where("hc IS NOT NULL AND NOT is_reference").groupBy(bins(F.col("hc")).alias("bin")).agg(F.count("*").alias("n"), R(F.avg("growth"), 6).alias("growth"), R(F.avg("product_mix"), 6).alias("product_mix"))


@q("q_by_tier", "SELECT tier, count(*) AS n, round_even(avg(growth),6) AS growth, median(hc) AS headcount FROM scored WHERE NOT is_reference GROUP BY tier", "scored")
def _(v):
    s = handed_over(scored(v).where("NOT is_reference").select("tier", "growth", "hc"), "leads")
    return s.groupBy("tier").agg(F.count("*").alias("n"), R(F.avg("growth"), 6).alias("growth")).join(quantiles(s, "hc", {"headcount": 0.5}, ["tier"]), "tier")


@q("q_size_ratio", "SELECT round_even(median(r),6) AS mid, count(*) FILTER (WHERE r>1.5) AS above, count(*) FILTER (WHERE r<1/1.5) AS below FROM (SELECT headcount/nullif(mid,0) AS r FROM heads JOIN mk USING (gid))", "heads mk")
def _(v):
    r = v.heads.join(v.mk, "gid").select(F.try_divide("headcount", "mid").alias("r"))
    r = handed_over(r, "ratios")
    return r.agg(F.count_if(F.col("r") > 1.5).alias("above"), F.count_if(F.col("r") < 1 / 1.5).alias("below")).join(quantiles(r, "r", {"mid": 0.5})).select(R(F.col("mid"), 6).alias("mid"), "above", "below")


@q("q_regions", "SELECT r_name AS region, count(*) AS market, count(*) FILTER (WHERE mid BETWEEN 30 AND 300) AS in_segment, count(score) AS researched, count(*) FILTER (WHERE place<=50) AS queued, count(*) FILTER (WHERE tier='A')/nullif(count(score),0)::DOUBLE AS tier_a_rate FROM mk JOIN region ON r_regionkey=mk.region LEFT JOIN (SELECT gid, score, tier, place FROM ranked) s USING (gid) GROUP BY 1", "ranked mk")
def _(v):
    r = v.table("region").select(F.col("r_regionkey").alias("region"), "r_name")
    j = v.mk.join(F.broadcast(r), "region").join(ranked(v).select("gid", "score", "tier", "place"), "gid", "left")
    return j.groupBy(F.col("r_name").alias("region")).agg(F.count("*").alias("market"), F.count_if(F.col("mid").between(30, 300)).alias("in_segment"), F.count("score").alias("researched"), F.count_if(F.col("place") <= 50).alias("queued"), F.try_divide(F.count_if(F.col("tier") == "A"), F.count("score")).alias("tier_a_rate"))


_MIX = "SELECT siren, CASE WHEN count(DISTINCT domain)=1 THEN min(domain)||' only' ELSE array_to_string(list_sort(list(DISTINCT domain)),' + ') END AS mix, count(DISTINCT domain)>1 AS multi FROM reg GROUP BY siren"
_TOP = f"SELECT mix FROM ({_MIX}) GROUP BY mix ORDER BY count(*) DESC, mix LIMIT 5"


def mixes(v):
    d = v.reg.groupBy("siren").agg(F.array_sort(F.collect_set("domain")).alias("d"))
    return d.select("siren", F.when(F.size("d") == 1, F.concat(F.col("d")[0], F.lit(" only"))).otherwise(F.array_join("d", " + ")).alias("mix"), (F.size("d") > 1).alias("multi"))


@q("q_product_mix", f"SELECT mix, count(*) AS n, round_even(count(*)/sum(count(*)) OVER (),6) AS share FROM (SELECT CASE WHEN mix IN ({_TOP}) THEN mix ELSE 'other' END AS mix FROM ({_MIX})) GROUP BY mix", "reg")
def _(v):
    n = mixes(v).groupBy("mix").agg(F.count("*").alias("n"))
    top = n.orderBy(F.desc("n"), "mix").limit(5).select("mix", F.lit(True).alias("top"))
    kept = n.join(F.broadcast(top), "mix", "left").groupBy(F.when(F.col("top"), F.col("mix")).otherwise("other").alias("mix")).agg(F.sum("n").alias("n"))
    return kept.select("mix", "n", R(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 6).alias("share"))


@q("q_multi_line_share", f"SELECT round_even(avg(CASE WHEN multi THEN 1.0 ELSE 0.0 END),6) AS share FROM ({_MIX})", "reg")
def _(v):
    return mixes(v).agg(R(F.avg(F.when(F.col("multi"), 1.0).otherwise(0.0)), 6).alias("share"))


_WEB = "SELECT id, CASE WHEN id%4=0 THEN NULL ELSE 's'||id END AS a, CASE WHEN id%3=0 THEN NULL WHEN id%5=0 THEN 't'||id ELSE 's'||id END AS b FROM co"
_ST = f"SELECT id, CASE WHEN a IS NULL AND b IS NULL THEN 'none' WHEN b IS NULL THEN 'found' WHEN a IS NULL THEN 'lost' WHEN a=b THEN 'same' ELSE 'different' END AS status FROM ({_WEB})"


def web(v):
    w = v.co.select("id", F.when(F.col("id") % 4 != 0, F.concat(F.lit("s"), "id")).alias("a"), F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 5 == 0, F.concat(F.lit("t"), "id")).otherwise(F.concat(F.lit("s"), "id")).alias("b"))
    a, b = F.col("a"), F.col("b")
    return w.select("id", F.when(a.isNull() & b.isNull(), "none").when(b.isNull(), "found").when(a.isNull(), "lost").when(a == b, "same").otherwise("different").alias("status"))


@q("q_website_status", _ST, "co")
def _(v):
    return web(v)


@q("q_website_counts", f"SELECT s.status, count(w.id) AS n FROM (SELECT unnest(['same','different','found','lost','none','broken']) AS status) s LEFT JOIN ({_ST}) w USING (status) GROUP BY 1", "co")
def _(v):
    every = v.spark.createDataFrame([(s,) for s in ("same", "different", "found", "lost", "none", "broken")], "status string")
    return every.join(web(v).groupBy("status").agg(F.count("*").alias("n")), "status", "left").fillna(0, ["n"])


@q("q_tech_crosstab", f"SELECT status, count(*) FILTER (WHERE id%5=0) AS none, count(*) FILTER (WHERE id%5 IN (1,2)) AS some, count(*) FILTER (WHERE id%5>2) AS full_ FROM ({_ST}) GROUP BY status", "co")
def _(v):
    level = F.when(F.col("id") % 5 == 0, "none").when(F.col("id") % 5 <= 2, "some").otherwise("full_")
    return web(v).withColumn("level", level).groupBy("status").pivot("level", ["none", "some", "full_"]).count().na.fill(0)


@q("q_melt", "SELECT gid, signal, value FROM (SELECT gid, size_fit, product_mix, growth, tech_maturity FROM scored) UNPIVOT (value FOR signal IN (size_fit, product_mix, growth, tech_maturity))", "scored")
def _(v):
    return scored(v).select("gid", *SIGNALS).unpivot("gid", list(SIGNALS), "signal", "value")


_LAYER = "CASE WHEN tier IS NOT NULL THEN 'Tier '||tier WHEN mid BETWEEN 30 AND 300 THEN 'In segment' ELSE 'Market' END"


@q("q_map_layers", f"SELECT {_LAYER} AS layer, count(*) AS n FROM mk LEFT JOIN (SELECT gid, tier FROM ranked WHERE place<=50) s USING (gid) GROUP BY 1", "ranked mk")
def _(v):
    top = S.queue(scored(v), 50).select("gid", "tier")
    layer = F.when(F.col("tier").isNotNull(), F.concat(F.lit("Tier "), "tier")).when(F.col("mid").between(30, 300), "In segment").otherwise("Market")
    return v.mk.join(F.broadcast(top), "gid", "left").groupBy(layer.alias("layer")).agg(F.count("*").alias("n"))


@q("q_map_grid", "SELECT CAST(round_even(bal/500,0) AS BIGINT) AS x, n_orders//5 AS y, count(*) AS n FROM co GROUP BY 1,2", "co")
def _(v):
    return v.co.groupBy(F.rint(F.col("bal") / 500).cast("long").alias("x"), F.floor(F.col("n_orders") / 5).alias("y")).agg(F.count("*").alias("n"))


# hand-off


@q("q_own_domain", r"SELECT page_id, coalesce(CASE WHEN page_id%3<>0 AND host NOT LIKE 'blog.%' THEN host END, 'site'||page_id||'.example') AS domain FROM (SELECT page_id, regexp_replace(regexp_extract(lower(trim(url)),'://([^/?#:]*)',1),'^www\.','') AS host FROM pages)")
def _(v):
    host = T.website_host(F.col("url"))
    return v.table("pages").select("page_id", F.coalesce(F.when((F.col("page_id") % 3 != 0) & ~host.startswith("blog."), host), F.concat(F.lit("site"), "page_id", F.lit(".example"))).alias("domain"))


@q("q_term_scan", "SELECT doc_id, count(DISTINCT term)::INT AS n_terms FROM documents, (SELECT DISTINCT lower(text) AS term FROM benchmark WHERE text <> '') t WHERE contains(lower(text), term) GROUP BY doc_id")
def _(v):
    return terms.scan(v.table("documents"), F.lower("text"), v.table("benchmark"), F.lower("text"), ["doc_id"])


@q("q_term_scan_words", "SELECT doc_id, count(*)::INT AS n_terms FROM documents, (SELECT DISTINCT lower(w) AS term FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]{9,}')) AS w FROM benchmark)) t WHERE contains(lower(text), term) GROUP BY doc_id")
def _(v):
    words = v.table("benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{9,}"), F.lit(0))).alias("w"))
    return terms.scan(v.table("documents"), F.lower("text"), words, F.lower("w"), ["doc_id"])


# event windows


@q("q_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1,2")
def _(v):
    return v.table("events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


@q("q_sliding", "SELECT time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE * k AS start, count(*) AS n FROM events, range(4) t(k) GROUP BY 1")
def _(v):
    return v.table("events").groupBy(F.window("ts", "1 hour", "15 minutes").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


@q("q_session", "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
def _(v):
    return v.table("events").groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


@q("q_stream_ledger", f"SELECT lead, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS tokens FROM {_ONE} GROUP BY lead", "lg")
def _(v):
    from ..streaming.ledger import batch_totals

    return batch_totals(v.lg)
