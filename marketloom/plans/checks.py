"""Queries of validation, keys, registry scans, person search, the funnel in one job and the guard as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import canonical as C
from ..operators import person, resolve
from ..operators import score as S
from ..operators import validate as V
from ..operators.funnel import Funnel
from ..sources import indexed
from ..stage import new_path
from .market import flagged
from .registry import q
from .scoring import scored, usd
from .testbed import TODAY

# answers

_EVIDENCE = V.Field("array", items=V.Field("object", {"url": V.Field("string"), "quote": V.Field("string")}))
_SIGNAL = V.Field("object", {"value": V.Field("number", low=0, high=100), "evidence": _EVIDENCE})
_FACTS = V.Field("object", {"open_roles": V.Field("array", items=V.Field("string")), "headcount_stated": V.Field("integer", empty=True)}, absent=frozenset(("open_roles", "headcount_stated")))
ANSWER = V.Field("object", {"website": V.Field("string", empty=True), "kind": V.Field("string", choices=("click", "view", "purchase", "signup", "scroll", "error")), "signals": V.Field("object", {"growth": _SIGNAL}), "facts": _FACTS, "notes_en": V.Field("string")})


@q(
    "q_validate_nested",
    """SELECT event_id, concat_ws('; ', CASE WHEN event_id%11=3 THEN 'no JSON' END, CASE WHEN event_id%11<>3 AND event_id%5=1 THEN 'website: no string' END,
  CASE WHEN event_id%11<>3 AND event_id%4=1 THEN 'signals.growth.value: no number' WHEN event_id%11<>3 AND NOT value BETWEEN 0 AND 100 THEN 'signals.growth.value: out of range' END,
  CASE WHEN event_id%11<>3 AND event_id%3=1 THEN 'signals.growth.evidence.1.quote: missing' END, CASE WHEN event_id%11<>3 AND event_id%6=2 THEN 'signals.growth.evidence.1.seen: extra' END,
  CASE WHEN event_id%11<>3 AND event_id%7=2 THEN 'facts.headcount_stated: no integer' END, CASE WHEN event_id%11<>3 AND event_id%2=1 THEN 'notes_en: missing' END) AS faults FROM events""",
)
def _(v):
    """An answer for each event, with faults by its number."""
    return v.table("events").select("event_id", F.array_join(V.judged(_answer(), ANSWER), "; ").alias("faults"))


def _answer():
    i = F.col("event_id")
    second = F.concat(F.lit('{"url":"https://x.example/'), i, F.lit('"'), F.when(i % 3 != 1, ',"quote":"q"').otherwise(""), F.when(i % 6 == 2, ',"seen":true').otherwise(""), F.lit("}"))
    value = F.when(i % 4 == 1, F.concat(F.lit('"'), "value", F.lit('"'))).otherwise(F.col("value").cast("string"))
    text = F.concat(
        F.lit('{"website":'), F.when(i % 5 == 0, "null").when(i % 5 == 1, "7").otherwise('"w.example"'), F.lit(',"kind":"'), F.lit("view"), F.lit('","signals":{"growth":{"value":'), value, F.lit(',"evidence":[{"url":"https://x.example","quote":"a"},'), second,
        F.lit(']}},"facts":{"open_roles":["r"],"headcount_stated":'), F.when(i % 7 == 2, "1.5").when(i % 7 == 3, "null").otherwise("12"), F.lit("}"), F.when(i % 2 == 0, ',"notes_en":"n"').otherwise(""), F.lit("}"),
    )
    return F.when(i % 11 == 3, F.substr(text, F.lit(1), F.length(text) - 1)).otherwise(text)


# keys


@q(
    "q_canonical_key",
    """SELECT conv_id, sha256('{"max_tokens":'||(1000+conv_id)||',"messages":['||string_agg('{"content":'||coalesce(to_json(text)::VARCHAR,'null')||',"role":'||coalesce(to_json(role)::VARCHAR,'null')||'}', ',' ORDER BY turn, role, text)||'],"model":"m-1","thinking":{"share":'||(count(*)/4.0)::DOUBLE::VARCHAR||'}}') AS key FROM conversations GROUP BY conv_id""",
)
def _(v):
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    asked = v.table("conversations").groupBy("conv_id").agg(turns.alias("turns"), (F.count("*") / 4.0).alias("share"))
    messages = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))
    body = asked.select("conv_id", messages.alias("messages"), F.struct(F.col("share").alias("share")).alias("thinking"), (1000 + F.col("conv_id")).alias("max_tokens"), F.lit("m-1").alias("model"), F.lit(None).cast("string").alias("system"))
    fields = {f.name: (F.col(f.name), f.dataType) for f in body.schema.fields if f.name != "conv_id"}
    return body.select("conv_id", C.answer_key(fields).alias("key"))


@q("q_url_key", "SELECT page_id, sha1(url||'?{\"page\": '||page_id||', \"q\": '||to_json(substr(html,1,40))::VARCHAR||', \"share\": '||((page_id%8)/8.0)::DOUBLE::VARCHAR||'}') AS key FROM pages")
def _(v):
    p = {"q": (F.substr("html", F.lit(1), F.lit(40)), T.StringType()), "page": (F.col("page_id"), T.LongType()), "share": ((F.col("page_id") % 8) / 8.0, T.DoubleType())}
    return v.table("pages").select("page_id", C.url_key(F.col("url"), p).alias("key"))


# registry and persons


@q("q_registry_scan", "SELECT siret, siren, domain, until, line FROM reg WHERE domain IN ('STANDARD','PROMO') AND line=2", "reg")
def _(v):
    folder = new_path(v.spark, "registry")
    indexed.store(v.reg.select("siret", "siren", "domain", "until", "line"), folder, ["domain", "line"])
    return indexed.scan(v.spark, folder, {"domain": ["STANDARD", "PROMO"], "line": [2]})


def _searched(v):
    c = v.co
    wanted = c.where("id % 20 = 0").select(F.col("id").alias("query"), F.when(F.col("id") % 3 == 0, F.substr("name", F.lit(-2))).otherwise(F.substr("name", F.lit(-4))).alias("name"), F.add_months("created", -8).alias("first"), F.date_add("created", 400).alias("last"))
    return person.search(c.select("id", "name", F.col("created").alias("born")), wanted, cap=15)


_HITS = "SELECT w.id AS query, c.id, upper(replace(c.name,'#',' '))=part AS same, row_number() OVER (PARTITION BY w.id ORDER BY c.id) AS o FROM (SELECT *, substr(name, CASE WHEN id%3=0 THEN -2 ELSE -4 END) AS part, CAST(created - INTERVAL 8 MONTH AS DATE) AS first, created + 400 AS last FROM co WHERE id%20=0) w JOIN co c ON contains(c.name, part) AND c.created BETWEEN first AND last"


@q("q_person_search", f"SELECT query, id, same FROM ({_HITS}) WHERE o<=15", "co")
def _(v):
    return _searched(v)[0]


@q("q_person_search_stats", f"SELECT co.id AS query, count(h.id) AS hits, count(h.id) FILTER (WHERE same) AS same, count(h.id)>15 AS truncated FROM co LEFT JOIN ({_HITS}) h ON h.query=co.id WHERE co.id%20=0 GROUP BY co.id", "co")
def _(v):
    return _searched(v)[1].drop("candidates")


# the funnel in one job

_KNOWN = f"SELECT DISTINCT siren AS id FROM reg WHERE until>='{TODAY}'"
_FOUND = f"SELECT DISTINCT b.id FROM keys a JOIN keys b USING (key) WHERE key LIKE 'manager:%' AND a.id IN ({_KNOWN}) AND b.id NOT IN ({_KNOWN})"
_GROUPS = f"SELECT root, count(*) AS n, max((lo+hi)/2.0) AS largest, sum((lo+hi)/2.0) AS mid FROM comp JOIN co USING (id) LEFT JOIN bands ON band=code WHERE id IN ({_KNOWN} UNION {_FOUND}) GROUP BY root"


@q(
    "q_funnel_observed",
    f"""SELECT 0 AS ord, 'rows' AS stage, count(*) AS n FROM reg UNION ALL SELECT 1, 'active', count(*) FROM reg WHERE until>='{TODAY}' UNION ALL SELECT 2, 'establishments', count(DISTINCT siret) FROM reg WHERE until>='{TODAY}'
 UNION ALL SELECT 3, 'companies', count(*) FROM ({_KNOWN}) UNION ALL SELECT 4, 'manager_expansion', count(*) FROM ({_FOUND}) UNION ALL SELECT 5, 'groups', count(*) FROM ({_GROUPS}) UNION ALL SELECT 6, 'in_segment', count(*) FROM ({_GROUPS}) WHERE mid BETWEEN 30 AND 300
 UNION ALL SELECT 7, 'rolled_in', count(*) FROM ({_GROUPS}) WHERE mid BETWEEN 30 AND 300 AND n>1 AND NOT coalesce(largest>=30,false)
 UNION ALL SELECT 8, 'researched', count(*) FROM ({_GROUPS}) JOIN scored ON gid='g'||root WHERE mid BETWEEN 30 AND 300 UNION ALL SELECT 9, 'queue', count(*) FROM (SELECT 1 FROM ({_GROUPS}) JOIN scored ON gid='g'||root WHERE mid BETWEEN 30 AND 300 AND NOT is_reference LIMIT 50)""",
    "co keys comp reg bands scored",
)
def _(v):
    from ..functions import numbers as N

    f, low, high = Funnel(), v.cfg.segment.headcount_min, v.cfg.segment.headcount_max
    rows = f.stage(v.reg, "rows")
    active = f.stage(rows.where(F.col("until") >= TODAY), "active")
    sites = f.stage(active.groupBy("siret").agg(F.min("siren").alias("siren")), "establishments")
    known = f.stage(sites.select(F.col("siren").alias("id")).distinct(), "companies")
    managers = v.keys.where("key LIKE 'manager:%'")
    sought = managers.join(known.withColumn("known", F.lit(True)), "id", "left")
    shared = sought.groupBy("key").agg(F.max("known").alias("hit"))
    found = f.stage(sought.where("known IS NULL").join(shared.where("hit"), "key").select("id").distinct(), "manager_expansion")
    members = known.unionByName(found).join(resolve.with_roots(v.co, v.keys), "id").withColumn("b", N.band_mid(F.col("band")))
    groups = f.stage(members.groupBy("root").agg(F.count("*").alias("n"), F.max("b").alias("largest"), F.sum("b").alias("mid")), "groups")
    inside = f.stage(groups.where(F.col("mid").between(low, high)), "in_segment")
    inside = f.stage(inside, "rolled_in", (F.col("n") > 1) & ~F.coalesce(F.col("largest") >= low, F.lit(False)))
    judged = f.stage(inside.withColumn("gid", F.concat(F.lit("g"), "root")).join(scored(v), "gid"), "researched")
    f.stage(S.queue(judged, v.cfg.queue_size), "queue").write.format("noop").mode("overwrite").save()
    return v.spark.createDataFrame(f.counts(), "ord int, stage string, n long")


# the guard as a stream

_LINES = "SELECT lead, key, event_id, called, backend, purpose, value, (input_tokens*5+cache_read*0.5+output_tokens*25)/1000000.0+searches*0.01 AS usd FROM lg"
_SUMS = f"SELECT lead AS run, count(*) AS calls, round_even(sum(CASE WHEN backend='api' THEN usd ELSE 0 END)::DOUBLE,3) AS usd FROM (SELECT lead, key, any_value(usd) AS usd, any_value(CASE WHEN event_key THEN 'cli' ELSE 'api' END) AS backend FROM (SELECT *, length(key)%4=0 AS event_key FROM ({_LINES})) GROUP BY lead, key) GROUP BY lead"
_SHARES = f"SELECT lead AS run, purpose, arg_max(value, (called, event_id))/100.0 AS share FROM ({_LINES}) GROUP BY lead, purpose"


@q(
    "q_stream_guard",
    f"SELECT run, calls, usd, CASE WHEN usd>=0.12 THEN 'budget' WHEN over IS NOT NULL THEN 'window '||over END AS stop FROM ({_SUMS}) LEFT JOIN (SELECT run, min(purpose) FILTER (WHERE share>=CASE purpose WHEN 'click' THEN 0.9 ELSE 0.7 END) AS over FROM ({_SHARES}) GROUP BY run) USING (run)",
    "lg",
)
def _(v):
    from ..streaming import guard

    cost = F.round(usd(), 12)
    lines = v.lg.select(F.col("lead").alias("run"), "key", F.col("called").cast("timestamp").alias("at"), F.col("event_id").alias("tie"), cost.alias("usd"), (F.length("key") % 4 == 0).alias("replayed"), F.col("purpose").alias("window"), (F.col("value") / 100.0).alias("share"))
    found = guard.watched(lines, 0.12, 0.7, {"click": 0.9})
    return found.select("run", "calls", F.bround(F.col("usd").cast("decimal(38,9)"), 3).cast("double").alias("usd"), "stop")  # halves are halves in whatever order calls were added
