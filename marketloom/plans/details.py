"""Queries of evidence, runs, insight rows, websites, the map, formats and stage files."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sinks
from ..functions import text as T
from ..operators import evidence as E
from ..operators import handoff as H
from ..operators import insight as I
from ..operators import runs
from ..operators import score as S
from ..sources import cached, files
from ..stage import new_path
from ..streaming import ledger
from .market import _HOST
from .registry import q
from .scoring import _USD, R, bins, ranked, scored, usd
from .testbed import SIGNALS

# evidence

_CLEAN = r"regexp_replace(regexp_replace(lower(regexp_extract(u,'^https?://([^/?]*)',1)),'^www\.','')||regexp_extract(u,'^https?://[^/?]*(.*)$',1),'/+$','')"
_NORM = f"(SELECT *, {_CLEAN} AS clean FROM (SELECT *, regexp_replace(trim(url),'#.*$','') AS u FROM pages))"


@q("q_tool_result_urls", f"SELECT page_id, url FROM {_NORM} p WHERE NOT EXISTS (SELECT 1 FROM {_NORM} s WHERE s.page_id%3=0 AND s.page_id%40=p.page_id%40 AND s.clean=p.clean)")
def _(v):
    """Every page's URL is cited; tools have given those of every third page of a lead, the model's own text names all."""
    kind = F.when(F.col("page_id") % 3 == 0, "web_fetch_tool_result").when(F.col("page_id") % 3 == 1, "tool_result").otherwise("text")
    block = lambda k, t: F.struct(k.alias("type"), t.alias("content"))
    content = F.to_json(F.array(block(kind, F.concat(F.lit("read <"), "url", F.lit(">."))), block(F.lit("text"), F.col("url"))))
    lead = (F.col("page_id") % 40).alias("lead")
    pages = v.table("pages")
    return E.unverified(pages.select(lead, "page_id", "url"), pages.select(lead, content.alias("content"))).select("page_id", "url")


# runs

_CALLS = f"(SELECT * FROM (SELECT backend AS run, lead, key, ({_USD})::DOUBLE AS usd, input_tokens+cache_read AS prompt, output_tokens, searches, CASE WHEN length(key)%2=0 THEN 'large' ELSE 'small' END AS model, row_number() OVER (PARTITION BY backend, key ORDER BY event_id) AS o FROM lg) WHERE o=1)"
_SIG = "(SELECT run, sg.gid AS lead, value, found, n_evidence, status FROM sg, (VALUES ('api'),('cli'),('none')) r(run) WHERE run<>'cli' OR id%2=0)"


@q(
    "q_run_outcome",
    f"""SELECT s.run, leads, coalesce(model,'?') AS model, round_even(usd/paid,3) AS usd_per_lead, round_even(prompt/paid::DOUBLE,2) AS prompt_per_lead, round_even(output/paid::DOUBLE,2) AS output_per_lead, round_even(searches/paid::DOUBLE,2) AS searches_per_lead, failed, flagged, found, mean_value
 FROM (SELECT run, count(DISTINCT lead) AS leads, count(DISTINCT lead) FILTER (WHERE status='failed') AS failed, count(DISTINCT lead) FILTER (WHERE value>0 AND n_evidence=0) AS flagged, round_even(avg(found::INT),4) AS found, round_even(avg(value),4) AS mean_value FROM {_SIG} GROUP BY run) s
 LEFT JOIN (SELECT run, count(DISTINCT lead) AS paid, string_agg(DISTINCT model, ', ' ORDER BY model) AS model, sum(usd) AS usd, sum(prompt) AS prompt, sum(output_tokens) AS output, sum(searches) AS searches FROM {_CALLS} c WHERE EXISTS (SELECT 1 FROM {_SIG} x WHERE x.run=c.run AND x.lead=c.lead) GROUP BY run) p USING (run)""",
    "lg sg",
)
def _(v):
    # a key's calls are alike, so that any of them stands for it
    calls = v.lg.select(F.col("backend").alias("run"), "lead", "key", F.when(F.length("key") % 2 == 0, "large").otherwise("small").alias("model"), usd().alias("usd"), (F.col("input_tokens") + F.col("cache_read")).alias("prompt_tokens"), "output_tokens", "searches")
    run = F.explode(F.array(*map(F.lit, ("api", "cli", "none")))).alias("run")
    signals = v.sg.select(run, "id", F.col("gid").alias("lead"), "signal", "value", "found", "status", ((F.col("value") > 0) & (F.col("n_evidence") == 0)).cast("int").alias("flags")).where("run <> 'cli' OR id % 2 = 0")
    return runs.run_stats(calls, signals)


# insight rows


@q("q_prescore_rows", "SELECT gid, name, round_even(pre_score,3) AS pre_score, score, tier, is_reference, CASE WHEN place<=50 THEN place END AS queue_rank FROM ranked", "ranked")
def _(v):
    return ranked(v).select("gid", "name", R(F.col("pre_score"), 3).alias("pre_score"), "score", "tier", "is_reference", F.when(F.col("place") <= v.cfg.queue_size, F.col("place")).alias("queue_rank"))


_BIN = "CASE WHEN hc<30 THEN '0-29' WHEN hc<60 THEN '30-59' WHEN hc<100 THEN '60-99' WHEN hc<200 THEN '100-199' ELSE '200+' END"


@q("q_signals_by_headcount", f"SELECT {_BIN} AS band, count(*) AS groups, {', '.join(f'round_even(avg({s}),2) AS {s}' for s in SIGNALS)}, round_even(avg((tier='A')::INT),2) AS tier_a FROM scored WHERE hc IS NOT NULL AND NOT is_reference GROUP BY 1", "scored")
def _(v):
    return I.by_band(scored(v).where("NOT is_reference AND hc IS NOT NULL"), bins(F.col("hc")), list(SIGNALS))


@q(
    "q_map_points",
    "SELECT gid, layer, bal BETWEEN m1-3*i1 AND m1+3*i1 AND n_orders BETWEEN m2-3*i2 AND m2+3*i2 AS on_map FROM (SELECT mk.gid, bal*(id%7)^4 AS bal, (n_orders+1)^(id%4)::DOUBLE AS n_orders, CASE WHEN tier IS NOT NULL THEN 'Tier '||tier WHEN mid BETWEEN 30 AND 300 THEN 'In segment' ELSE 'Market' END AS layer FROM mk JOIN (SELECT gid, n_orders FROM co) USING (gid) LEFT JOIN (SELECT gid, tier FROM scored) s USING (gid)), (SELECT median(b) AS m1, quantile_cont(b,0.75)-quantile_cont(b,0.25) AS i1, median(o) AS m2, quantile_cont(o,0.75)-quantile_cont(o,0.25) AS i2 FROM (SELECT bal*(id%7)^4 AS b, (n_orders+1)^(id%4)::DOUBLE AS o FROM co))",
    "mk co scored",
)
def _(v):
    st = v.staged
    points = st.mk.join(st.co.select("gid", "n_orders"), "gid").join(scored(v).select("gid", "tier"), "gid", "left")
    layer = F.when(F.col("tier").isNotNull(), F.concat(F.lit("Tier "), "tier")).when(F.col("mid").between(30, 300), "In segment").otherwise("Market")
    lat, lon = F.col("bal") * F.pow(F.col("id") % 7, F.lit(4)), F.pow(F.col("n_orders") + 1, F.col("id") % 4)
    return I.main_area(points.select("gid", layer.alias("layer"), lat.cast("double").alias("lat"), lon.cast("double").alias("lon")), ["lat", "lon"]).select("gid", "layer", "on_map")


# websites


@q("q_own_domains", f"SELECT page_id%97 AS gid, arg_min(host, (place, host)) FILTER (WHERE host IS NOT NULL AND host NOT IN (SELECT host FROM (SELECT {_HOST} AS host, count(*) AS n FROM pages GROUP BY 1) WHERE n>=21 AND host IS NOT NULL)) AS domain FROM (SELECT page_id, CASE WHEN page_id%3=0 THEN 0 WHEN page_id%97=page_id%89 THEN 1 ELSE 2 END AS place, CASE WHEN contains({_HOST},'.') THEN {_HOST} END AS host FROM pages) GROUP BY 1")
def _(v):
    p = v.table("pages")
    place = F.when(F.col("page_id") % 3 == 0, 0).when(F.col("page_id") % 97 == F.col("page_id") % 89, 1).otherwise(2)
    directories = p.select(T.website_host(F.col("url")).alias("host")).groupBy("host").agg(F.count("*").alias("n")).where("n >= 21")
    return H.own_domains(p.select((F.col("page_id") % 97).alias("gid"), place.alias("place"), "url"), directories)


@q("q_entity_names", "SELECT id, CASE WHEN id%3=0 THEN 's'||id WHEN id%3=1 THEN 'name:'||upper(replace(name,'#',' ')) END AS key FROM co", "co")
def _(v):
    return v.co.select("id", T.entity_key(F.when(F.col("id") % 3 == 0, F.concat(F.lit("s"), "id")).otherwise(""), F.when(F.col("id") % 3 == 2, " - ").otherwise(F.col("name"))).alias("key"))


# stored responses

_STORED = "SELECT DISTINCT key FROM lg WHERE event_id%3<>0"


@q("q_replayed", f"SELECT key, CASE WHEN key IN ({_STORED}) THEN upper(key) END AS response FROM (SELECT DISTINCT key FROM lg WHERE event_id%3=0)", "lg")
def _(v):
    stored = v.lg.where("event_id % 3 <> 0").select("key").distinct().withColumn("response", F.upper("key"))
    wanted = v.lg.where("event_id % 3 = 0").select("key").distinct()
    # what is stored is served without the web; the rest is asked for in mode `normal`, and an error in mode `offline`
    served = cached.replayed(wanted.join(stored.select("key"), "key", "left_semi"), stored, "offline")
    asked = cached.replayed(wanted.join(stored.select("key"), "key", "left_anti"), stored, "normal")
    return served.unionByName(asked).select("key", "response")


# formats


@q("q_formats", "SELECT id, format('{:.0f}%', round_even(bal/100,0)) AS share, format('{:,}', id*1234567) AS many, format('{:g}', bal*(CASE WHEN id%2=0 THEN 1 ELSE 0.00001 END)) AS short FROM co", "co")
def _(v):
    x = F.col("bal") * F.when(F.col("id") % 2 == 0, 1.0).otherwise(0.00001)
    return v.co.select("id", T.whole_percent(F.col("bal") / 100).alias("share"), T.thousands(F.col("id") * 1234567).alias("many"), T.general(x).alias("short"))


# runs in order, and frames whose columns differ


@q("q_first_of_run", "SELECT gid FROM (SELECT gid FROM mk WHERE id%3<>0 ORDER BY pre_score DESC, gid LIMIT 20)", "mk")
def _(v):
    return ledger.to_run(v.mk.select("gid", "pre_score"), v.mk.where("id % 3 = 0").select("gid")).limit(20).select("gid")


@q("q_aligned", "SELECT id, name, NULL::VARCHAR AS band, bal FROM co WHERE id%2=0 UNION ALL SELECT id, NULL, band, NULL FROM co WHERE id%2=1", "co")
def _(v):
    return v.co.where("id % 2 = 0").select("id", "name", "bal").unionByName(v.co.where("id % 2 = 1").select("band", "id"), allowMissingColumns=True).select("id", "name", "band", "bal")


# stage files


@q("q_stage_table", "SELECT id, name, band FROM co", "co")
def _(v):
    folder = new_path(v.spark, "stages")
    sinks.write_stage(v.co.select("id", "name", "band"), folder, "companies")
    return files.stage_table(v.spark, folder, "companies")


@q("q_json_lines", "SELECT event_id, event_type, value FROM events")
def _(v):
    folder = new_path(v.spark, "lines")
    rows = v.table("events").select(F.to_json(F.struct("event_id", "event_type", "value")).alias("value"))
    rows.unionAll(rows.where("value IS NULL")).select(F.concat("value", F.when(F.hash("value") % 7 == 0, "\n\n").otherwise(""))).write.text(folder)
    return files.json_lines(v.spark, folder, "event_id long, event_type string, value double")


@q("q_json_documents", "SELECT page_id, url FROM pages WHERE page_id%4<>1")
def _(v):
    """A document a page, of which those with status ok are read."""
    folder = new_path(v.spark, "documents")
    status = F.when(F.col("page_id") % 4 != 1, "ok").otherwise("failed").alias("status")
    v.table("pages").select("page_id", "url", status).repartition(4, "page_id").write.json(folder)
    return files.json_rows(v.spark, folder, "page_id long, url string, status string", "ok").select("page_id", "url")


@q("q_research", "SELECT gid, CASE WHEN id%9<>4 THEN upper(name) END AS said, CASE WHEN id%9=4 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN id%9=4 THEN 'ValueError: no answer for '||gid END AS reason FROM mk", "mk")
def _(v):
    def answer(lead):
        if lead["id"] % 9 == 4:
            raise ValueError(f"no answer for {lead['gid']}")
        return {"said": lead["name"].upper()}

    return ledger.research(v.mk.select("gid", "id", "name"), answer, "gid string, said string")
