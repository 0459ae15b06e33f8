"""Hand-off, lead card, replay, link keys and run statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..operators import handoff as H
from ..operators import replay as P
from ..operators import resolve
from ..operators import score as S
from ..operators.quantile import quantiles
from ..sources.cached import quoted, request_key_column
from .registry import q
from .scoring import R, once, scored
from .testbed import SQL

# names and texts

_NAME = "CASE id%6 WHEN 0 THEN 'ATELIER D''ARC '||id WHEN 1 THEN 'SOCIETE DES EAUX DU '||seg||' (SLTE)' WHEN 2 THEN 'ACME  ENERGIE (ACMEENERGIE)' WHEN 3 THEN 'Acme Énergie (Petite)' WHEN 4 THEN 'SARL BTP '||seg ELSE 'LE GRAND (LA PETITE MAISON)' END"
_CAP = "upper(substr(seg,1,1))||lower(substr(seg,2))"


@q("q_display_name", f"SELECT id, CASE id%6 WHEN 0 THEN 'Atelier d''Arc '||id WHEN 1 THEN 'Societe des Eaux du '||{_CAP}||' (SLTE)' WHEN 2 THEN 'Acme Energie' WHEN 3 THEN 'Acme Énergie (Petite)' WHEN 4 THEN 'SARL BTP '||{_CAP} ELSE 'Le Grand (La Petite Maison)' END AS name FROM co", "co")
def _(v):
    return v.co.select("id", T.display_name(F.expr(_NAME.replace("''", "\\'"))).alias("name"))


@q("q_request_key", """SELECT page_id, sha1('https://api.example/search?{"page": '||page_id||', "q": '||to_json(url)::VARCHAR||'}') AS key FROM pages""")
def _(v):
    return v.table("pages").select("page_id", request_key_column(F.lit("https://api.example/search"), {"q": F.col("url")}, {"page": F.col("page_id")}).alias("key"))


@q("q_answer_key", """SELECT conv_id, turn, sha256('{"messages":[{"content":'||to_json(text)::VARCHAR||',"role":'||to_json(role)::VARCHAR||'}],"model":"m-1"}') AS key FROM conversations""")
def _(v):
    body = F.concat(F.lit('{"messages":[{"content":'), quoted(F.col("text")), F.lit(',"role":'), quoted(F.col("role")), F.lit('}],"model":"m-1"}'))
    return v.table("conversations").select("conv_id", "turn", F.sha2(body, 256).alias("key"))


@q("q_aim", r"SELECT conv_id, turn, CASE WHEN length(f)<=110 THEN f ELSE regexp_replace(substr(f,1,108),' [^ ]*$','')||' …' END AS aim FROM (SELECT conv_id, turn, regexp_replace(regexp_extract(text||' ','(?s)^(.*?)(?:(?:\.)\s|$)',1),'\.+$','') AS f FROM (SELECT conv_id, turn, replace(text,chr(10),' ') AS text FROM conversations))")
def _(v):
    return v.table("conversations").select("conv_id", "turn", T.aim(F.concat(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit(" "))).alias("aim")).withColumn("aim", F.rtrim("aim"))


@q("q_clean_number", "SELECT event_id, CASE WHEN x=floor(x) THEN CAST(CAST(floor(x) AS BIGINT) AS VARCHAR) ELSE CAST(x AS VARCHAR) END AS shown FROM (SELECT event_id, CASE WHEN event_id%3=0 THEN round(value) ELSE event_id%8+0.5 END AS x FROM events)")
def _(v):
    x = F.when(F.col("event_id") % 3 == 0, F.round("value")).otherwise(F.col("event_id") % 8 + 0.5)
    return v.table("events").select("event_id", T.clean_number(x.cast("double")).alias("shown"))


@q("q_escaped", "SELECT page_id, replace(replace(replace(replace(replace(url,'&','&amp;'),'<','&lt;'),'>','&gt;'),'\"','&quot;'),'''','&#x27;') AS shown FROM pages")
def _(v):
    return v.table("pages").select("page_id", T.escaped(F.col("url")).alias("shown"))


@q("q_extent", "SELECT seg, min(bal) AS low, max(bal) AS high, max(bal)-min(bal) AS extent FROM co GROUP BY seg", "co")
def _(v):
    return v.co.groupBy("seg").agg(F.min("bal").alias("low"), F.max("bal").alias("high"), (F.max("bal") - F.min("bal")).alias("extent"))


# reasons

SQL["said"] = ("co", "SELECT gid, 'hiring for site '||id||'.' AS p_growth, CASE WHEN id%8=0 THEN 'Staff of many' ELSE 'two sites' END AS p_size FROM co WHERE id%4=0")
_SIZE = "CASE WHEN hc IS NOT NULL AND NOT contains(lower(coalesce(p_size,'')),'staff') THEN concat_ws(', ','~'||printf('%.0f',hc)||' staff',p_size) ELSE coalesce(p_size,'headcount in band') END"
_LEAST = "least(size_fit,product_mix,growth,tech_maturity)"
SQL["reasons"] = ("ranked said", f"""SELECT gid, concat_ws(' | ', printf('%.1f',score)||' '||tier, CASE WHEN size_fit>=0.75 THEN ps END, CASE WHEN product_mix>=0.75 THEN 'several lines' END, CASE WHEN growth>=0.75 THEN pg END, CASE WHEN tech_maturity>=0.75 THEN 'online tools' END,
 CASE WHEN {_LEAST}<0.75 THEN 'weakest: '||CASE {_LEAST} WHEN size_fit THEN ps WHEN product_mix THEN 'several lines' WHEN growth THEN pg ELSE 'online tools' END END, CASE WHEN is_reference THEN 'reference (calibration, not queued)' END) AS reason_en
 FROM (SELECT *, {_SIZE} AS ps, coalesce(rtrim(p_growth,'.'),'growing') AS pg FROM ranked LEFT JOIN said USING (gid))""")


def reasons(v, table):
    said = v.co.where("id % 4 = 0").select("gid", F.create_map(F.lit("growth"), F.concat(F.lit("hiring for site "), "id", F.lit(".")), F.lit("size_fit"), F.when(F.col("id") % 8 == 0, "Staff of many").otherwise("two sites")).alias("said"))
    empty = F.create_map().cast("map<string,string>")
    return table.join(said, "gid", "left").withColumn("said", F.coalesce("said", empty)).withColumn("reason_en", S.reason(v.cfg, F.col("said"))).drop("said")


@q("q_reason", "SELECT gid, reason_en FROM reasons", "reasons")
def _(v):
    return reasons(v, scored(v)).select("gid", "reason_en")


@q("q_why", r"SELECT gid, regexp_replace(reason_en,'^\d+(\.\d+)? [A-Z] \| ','') AS why FROM reasons", "reasons")
def _(v):
    return reasons(v, scored(v)).select("gid", T.why(F.col("reason_en")).alias("why"))


# hand-off

_MANAGERS = """CASE id%4 WHEN 0 THEN '[{"type_dirigeant":"personne morale","denomination":"H"}]' WHEN 1 THEN '[{"type_dirigeant":"personne physique","nom":"AUDIT","prenoms":"A","qualite":"Commissaire aux comptes"},{"type_dirigeant":"personne physique","nom":"LE GALL (DURAND)","prenoms":"ANNE, MARIE","qualite":"Gérant"}]'
 WHEN 2 THEN '[{"type_dirigeant":"personne physique","prenoms":"X"},{"type_dirigeant":"personne physique","nom":"D\\u0027ARC","prenoms":"Jean","qualite":"Président de SAS"}]' END"""
SQL["pieces"] = ("sg", "SELECT gid, ord, signal, 'q'||signal||k AS quote, 'e'||signal||k AS quote_en, 'https://s'||id||'.example/'||k AS url, k FROM (SELECT *, unnest(range(n_evidence)) AS k FROM sg WHERE status='ok' AND found)")
SQL["hub"] = ("ranked reasons pieces", """SELECT name, CASE WHEN id%3<>0 THEN 'site'||id||'.example' ELSE '' END AS domain, CASE WHEN nation%2=0 THEN '' ELSE 'p'||nation END AS phone, id||' RUE X' AS street, 'Dijon' AS city, CAST(21000+nation AS VARCHAR) AS postcode, CASE WHEN hc IS NULL THEN '' ELSE CAST(CAST(round_even(hc,0) AS BIGINT) AS VARCHAR) END AS staff,
 printf('%.2f',score) AS score, tier, CAST(place AS VARCHAR) AS place, reason_en, coalesce(quotes,'') AS quotes, '9'||id AS sirens, 'a'||id||'@x.example' AS email, CASE id%4 WHEN 1 THEN 'Anne' WHEN 2 THEN 'Jean' ELSE '' END AS first, CASE id%4 WHEN 1 THEN 'Le Gall' WHEN 2 THEN 'D''Arc' ELSE '' END AS last, CASE id%4 WHEN 1 THEN 'Gérant' WHEN 2 THEN 'Président de SAS' ELSE '' END AS job
 FROM ranked JOIN reasons USING (gid) JOIN co USING (gid) LEFT JOIN (SELECT gid, string_agg(CASE ord WHEN 0 THEN 'Headcount in band' WHEN 1 THEN 'Several lines' WHEN 2 THEN 'Growing' ELSE 'Online tools' END||': «'||quote||'» ('||quote_en||') '||url, chr(10) ORDER BY ord) AS quotes FROM pieces WHERE k=0 GROUP BY gid) USING (gid) WHERE place<=50""".replace("SELECT name,", "SELECT ranked.name AS name,"))


def evidence(v):
    piece = lambda k: F.struct(F.concat(F.lit("q"), "signal", k.cast("string")).alias("quote"), F.concat(F.lit("e"), "signal", k.cast("string")).alias("quote_en"), F.concat(F.lit("https://s"), "id", F.lit(".example/"), k.cast("string")).alias("url"))
    all_ = F.when(F.col("n_evidence") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("n_evidence") - 1, F.lit(0))), piece)).otherwise(F.array().cast("array<struct<quote:string,quote_en:string,url:string>>"))
    return v.sg.where("status = 'ok'").select("gid", "signal", "value", "found", all_.alias("evidence"))


def leads(v):
    """The queue with what the hand-off reads. Its size is configured, so that it can be numbered in one place."""
    top = S.queue(scored(v), v.cfg.queue_size).withColumn("queue_rank", F.row_number().over(Window.orderBy(*S.best_first())))
    none = F.array().cast("array<string>")
    about = v.co.select(
        "gid", F.when(F.col("id") % 3 != 0, F.concat(F.lit("site"), "id", F.lit(".example"))).alias("domain"), F.when(F.col("nation") % 2 == 0, none).otherwise(F.array(F.concat(F.lit("p"), "nation"), F.lit("second"))).alias("phones"),
        F.array(F.concat(F.lit("a"), "id", F.lit("@x.example"))).alias("emails"), F.concat("id", F.lit(" RUE X "), 21000 + F.col("nation"), F.lit(" DIJON")).alias("address"), (21000 + F.col("nation")).cast("string").alias("postcode"),
        F.expr("replace(" + _MANAGERS.replace("\\u0027", "#") + ", '#', chr(39))").alias("managers"), F.array(F.concat(F.lit("9"), "id")).alias("members"),
    )
    return reasons(v, top).join(about, "gid").join(H.top_quotes(evidence(v), v.cfg), "gid", "left").withColumn("headcount", F.col("hc"))


_COMPANY = dict(zip(H.COMPANY_COLUMNS, ("name", "domain", "phone", "street", "city", "postcode", "'France'", "staff", "score", "tier", "place", "reason_en", "quotes", "sirens", "email", "name", "''", "''", "''", "''")))


@q("q_hub_rows", "SELECT " + ", ".join(f'{c} AS "{k}"' for k, c in _COMPANY.items()) + " FROM hub", "hub")
def _(v):
    return H.rows(leads(v)).select(*(f"`{c}`" for c in H.COMPANY_COLUMNS))


@q("q_contact_rows", "SELECT domain AS \"Company Domain Name\", first AS \"First Name\", last AS \"Last Name\", job AS \"Job Title\" FROM hub WHERE domain<>'' AND (first<>'' OR last<>'')", "hub")
def _(v):
    return H.contact_rows(H.rows(leads(v)))


@q("q_contact", "SELECT id, CASE id%4 WHEN 1 THEN 'Anne' WHEN 2 THEN 'Jean' END AS first_name, CASE id%4 WHEN 1 THEN 'Le Gall' WHEN 2 THEN 'D''Arc' END AS last_name, CASE id%4 WHEN 1 THEN 'managing director' WHEN 2 THEN 'president (of the SAS)' END AS role_en FROM co", "co")
def _(v):
    managers = F.expr("replace(" + _MANAGERS.replace("\\u0027", "#") + ", '#', chr(39))")
    return v.co.select("id", H.contact(managers).alias("c")).select("id", "c.first_name", "c.last_name", "c.role_en")


@q("q_evidence_numbering", "SELECT gid, signal, url, row_number() OVER (PARTITION BY gid ORDER BY ord, k) AS n FROM pieces", "pieces")
def _(v):
    return H.evidence_items(evidence(v), v.cfg).select("gid", "signal", "url", "n")


_SEQ = "SELECT conv_id, turn, text AS b1, substr(text,1,200) AS b2, CASE WHEN turn%3=0 THEN 'Marketloom 9.7/10 tu' ELSE text END AS li, CASE WHEN turn%2=0 THEN 'Bonjour, Marketloom' ELSE 'Ta tier' END AS su, turn%4 AS hook FROM conversations"
_WORDS = "len(list_filter(string_split_regex({0},'\\s+'), lambda w: w<>''))"
_ALL = "concat_ws(' ~ ',su,b1,b2,li)"


@q("q_copy_checks", f"""SELECT conv_id, turn, concat_ws('; ', CASE WHEN w1>90 THEN 'email_1_body: '||w1||' words (limit 90)' END, CASE WHEN w2>60 THEN 'email_2_body: '||w2||' words (limit 60)' END, CASE WHEN length(li)>300 THEN 'linkedin: '||length(li)||' characters (limit 300)' END, CASE WHEN hook NOT IN (1,2) THEN 'hook_evidence '||hook||' is no evidence item' END,
 CASE WHEN len(bad)>0 THEN 'informal address: '||array_to_string(bad,', ') END, CASE WHEN regexp_matches({_ALL},'(?i)\\b(score|scoring|tier|rubri\\w*)\\b|\\b\\d+(?:[.,]\\d+)?\\s*/\\s*10\\b') OR contains({_ALL},'9.7') OR contains({_ALL},'9,7') THEN 'a score or tier in the copy' END, CASE WHEN NOT contains(lower({_ALL}),'marketloom') THEN 'Marketloom not named' END) AS flags
 FROM (SELECT *, {_WORDS.format("b1")} AS w1, {_WORDS.format("b2")} AS w2, list_sort(list_filter(['tu','ton','ta','tes','toi'], lambda x: list_contains(regexp_extract_all(lower({_ALL}),'[\\p{{L}}\\p{{N}}_\\p{{M}}]+'), x))) AS bad FROM ({_SEQ}))""")
def _(v):
    t = F.col("text")
    sequence = F.struct((F.col("turn") % 4).alias("hook_evidence"), F.when(F.col("turn") % 2 == 0, "Bonjour, Marketloom").otherwise("Ta tier").alias("email_1_subject"), t.alias("email_1_body"), F.substring(t, 1, 200).alias("email_2_body"), F.when(F.col("turn") % 3 == 0, "Marketloom 9.7/10 tu").otherwise(t).alias("linkedin"))
    return v.table("conversations").select("conv_id", "turn", F.array_join(H.copy_flags(sequence, F.array(F.lit(1), F.lit(2)), F.lit("9.7")), "; ").alias("flags"))


@q("q_lead_card", "SELECT gid, name, score, tier, rank, CASE WHEN place<=50 THEN place END AS queue_rank, region, reason_en, signals FROM ranked JOIN reasons USING (gid) JOIN (SELECT gid, string_agg(sg.signal||':'||CAST(value AS VARCHAR)||':'||CAST(v AS VARCHAR)||':'||CASE WHEN found THEN n_evidence ELSE n_evidence END, ' ' ORDER BY sg.ord) AS signals FROM sg JOIN vals USING (gid, signal) WHERE status='ok' GROUP BY gid) USING (gid)", "ranked reasons vals")
def _(v):
    t = reasons(v, S.ranked(scored(v))).withColumn("queue_rank", F.when(F.col("place") <= v.cfg.queue_size, F.col("place"))).withColumn("headcount", F.col("hc")).withColumn("headcount_source", F.col("hc_source"))
    signals = evidence(v).withColumn("rationale_en", F.lit("")).withColumn("flags", F.array().cast("array<string>"))
    grades = v.grades.select("gid", "signal", F.lit("basis").alias("basis_en"))
    research = v.co.select("gid", F.lit(None).cast("string").alias("website"), F.lit("").alias("notes_en"))
    cards = H.lead_cards(t, signals, v.mk.withColumn("member_names", F.array("name")), grades, research, v.cfg)
    line = F.transform("signals", lambda s: F.concat_ws(":", s["signal"], s["agent_value"].cast("string"), s["value"].cast("string"), F.size(s["evidence"]).cast("string")))
    return cards.select("gid", "name", "score", "tier", "rank", "queue_rank", "region", "reason_en", F.array_join(line, " ").alias("signals"))


# replay

_STEP = "SELECT conv_id, turn, turn%4=0 AS search, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer, length(lead(text) OVER (PARTITION BY conv_id ORDER BY turn)) AS size FROM conversations"


@q("q_replay_steps", f"""SELECT 'g'||conv_id%50 AS lead, 'k'||conv_id AS key, count(*) FILTER (search) AS searches, count(*) FILTER (NOT search) AS fetches, conv_id*7 AS tokens, round_even((conv_id*0.01)::DOUBLE,4) AS usd,
 string_agg(CASE WHEN search THEN 'search:q'||turn||'::'||CASE WHEN answer IS NULL THEN '' ELSE '2 results: a'||size||'.example, b.example' END ELSE 'fetch:https://f'||turn||'.example:Read it:'||CASE WHEN w>=20 THEN 'Read about '||format('{{:,}}',CAST(round_even(w,-1) AS BIGINT))||' words' ELSE '' END END, ' ' ORDER BY turn) AS steps
 FROM (SELECT *, CASE WHEN answer IS NULL THEN 0 ELSE {_WORDS.format("answer")} END AS w FROM ({_STEP}) WHERE turn%2=0) WHERE conv_id IN (SELECT max(conv_id) FROM conversations GROUP BY conv_id%50) GROUP BY conv_id""")
def _(v):
    c = v.table("conversations")
    turn, use, even = F.col("turn").cast("string"), F.concat(F.lit("t"), F.col("turn").cast("string")), F.col("turn") % 2 == 0
    none = F.lit(None).cast("string")
    asked = F.struct(F.lit("tool_use").alias("type"), use.alias("id"), F.when(F.col("turn") % 4 == 0, "WebSearch").otherwise("WebFetch").alias("name"), F.struct(F.concat(F.lit("q"), turn).alias("query"), F.concat(F.lit("https://f"), turn, F.lit(".example")).alias("url"), F.lit("Read it. All of it.").alias("prompt"), none.alias("signals")).alias("input"), none.alias("tool_use_id"), none.alias("content"))
    urls = F.concat(F.lit('[{"url": "https://www.a'), F.length("text"), F.lit('.example/x"}, {"url": "https://b.example/y"}]'))
    got = F.struct(F.lit("tool_result").alias("type"), none.alias("id"), none.alias("name"), F.lit(None).cast("struct<query:string,url:string,prompt:string,signals:string>").alias("input"), F.concat(F.lit("t"), (F.col("turn") - 1).cast("string")).alias("tool_use_id"), F.when(F.col("turn") % 4 == 1, urls).otherwise(F.col("text")).alias("content"))
    message = F.struct(F.when(even, "assistant").otherwise("user").alias("type"), F.struct(F.array(F.when(even, asked).otherwise(got)).alias("content")).alias("message"))
    told = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", message.alias("m")))).alias("t"))
    recordings = told.select(F.concat(F.lit("k"), "conv_id").alias("key"), F.from_json(F.to_json(F.struct(F.transform("t", lambda x: x["m"]).alias("transcript"))), P.RECORDING).alias("r"))
    ledger = c.select("conv_id").distinct().select(F.concat(F.lit("g"), F.col("conv_id") % 50).alias("lead"), F.lit("research").alias("purpose"), F.concat(F.lit("k"), "conv_id").alias("key"), F.lit("small").alias("model"), F.lit("cli").alias("backend"), F.col("conv_id").alias("line"), (F.col("conv_id") * 7).alias("input_tokens"), F.lit(0).alias("cache_write_tokens"), F.lit(0).alias("cache_read_tokens"), F.lit(0).alias("output_tokens"), F.lit(0.0).alias("usd"), (F.col("conv_id") * 0.01).alias("notional_usd"))
    shown = F.array_join(F.transform("steps", lambda s: F.concat_ws(":", s["kind"], s["text"], s["aim"], s["found"])), " ")
    return P.replays(ledger, recordings).select("lead", "key", "searches", "fetches", "tokens", "usd", shown.alias("steps"))


# link keys

SQL["firm_keys"] = ("co", r"""SELECT DISTINCT id, kind, kind||':'||value AS key FROM (SELECT id, 'holding' AS kind, lpad(CAST(id AS VARCHAR),9,'0') AS value FROM co UNION ALL SELECT id, 'holding', lpad(CAST(id//7*7 AS VARCHAR),9,'0') FROM co WHERE id%5=0
 UNION ALL SELECT id, 'manager', 'DURAND|ANNE|19'||(50+nation)||'-0'||(1+id%9) FROM co WHERE id%5<>0 AND id%4<>3 UNION ALL SELECT id, 'phone', '04900'||lpad(CAST(CAST(floor(bal) AS BIGINT)%100000 AS VARCHAR),5,'0') FROM co WHERE bal>=0 UNION ALL SELECT id, 'website', 'site'||id%40||'.example' FROM co UNION ALL SELECT id, 'address', (id//3)||' RUE X '||seg FROM co)""")


def firms(v):
    officer = lambda kind, **k: F.struct(F.lit(kind).alias("type_dirigeant"), *(k.get(c, F.lit(None).cast("string")).cast("string").alias(c) for c in ("nom", "prenoms", "date_de_naissance", "qualite", "siren", "denomination")))
    number = lambda x: F.lpad(x.cast("string"), 9, "0")
    born = F.concat(F.lit("19"), 50 + F.col("nation"), F.lit("-0"), 1 + F.col("id") % 9)
    role = F.when(F.col("id") % 4 == 3, "Commissaire aux comptes").otherwise("Gérant")
    officers = F.when(F.col("id") % 5 == 0, F.array(officer("personne morale", siren=number(F.floor(F.col("id") / 7) * 7)))).otherwise(F.array(officer("personne physique", nom=F.lit("Durand (Petit)"), prenoms=F.lit("Anne, Marie"), date_de_naissance=born, qualite=role)))
    phone = F.when(F.col("bal") >= 0, F.array(F.concat(F.lit("+33 4 900"), F.lpad((F.floor("bal") % 100000).cast("string"), 5, "0")))).otherwise(F.array().cast("array<string>"))
    return v.co.select("id", number(F.col("id")).alias("siren"), officers.alias("officers"), phone.alias("phones"), F.array(F.concat(F.lit("https://www.site"), F.col("id") % 40, F.lit(".example/x"))).alias("websites"), F.concat(F.floor(F.col("id") / 3), F.lit(", rue X "), "seg").alias("address"))


@q("q_company_keys", "SELECT id, kind, key FROM firm_keys", "firm_keys")
def _(v):
    return resolve.company_keys(firms(v))


@q("q_link_keys", "SELECT key, count(*) AS n FROM firm_keys GROUP BY kind, key HAVING count(*)>=2 AND (kind<>'website' OR count(*)<21) AND (kind<>'address' OR count(*)<=3)", "firm_keys")
def _(v):
    return resolve.linking(resolve.company_keys(firms(v))).groupBy("key").agg(F.count("*").alias("n"))


@q("q_person_match", "SELECT id, person FROM (SELECT id, 'DURAND|ANNE|19'||(50+nation)||'-0'||(1+id%9) AS person, id%2=1 AS known, CASE id%3 WHEN 0 THEN '43.22A' WHEN 1 THEN '64.20Z' ELSE '56.10A' END AS naf, active FROM co) WHERE NOT known AND active AND (naf LIKE '43.%' OR naf LIKE '64.20%') AND person IN (SELECT 'DURAND|ANNE|19'||(50+nation)||'-0'||(1+id%9) FROM co WHERE id%2=1)", "co")
def _(v):
    person = T.person_key(F.lit("Durand"), F.lit("Anne"), F.concat(F.lit("19"), 50 + F.col("nation"), F.lit("-0"), 1 + F.col("id") % 9))
    p = v.co.select("id", person.alias("person"), F.element_at(F.array(F.lit("43.22A"), F.lit("64.20Z"), F.lit("56.10A")), (F.col("id") % 3 + 1).cast("int")).alias("naf"), F.col("active").alias("open"))
    asked = p.where("id % 2 = 1").groupBy("person").agg(F.min("id").alias("ord"))
    return resolve.expanded(asked, p, p.where("id % 2 = 1"), ("43.", "64.20", "70.10"), 2000)[0]


@q("q_rolled_in", "SELECT 'g'||root AS gid, n, largest, mid, tier FROM (SELECT root, count(*) AS n, max(CASE WHEN active THEN (lo+hi)/2.0 END)::DOUBLE AS largest, coalesce(sum((lo+hi)/2.0),0)::DOUBLE AS mid FROM comp JOIN co USING (id) LEFT JOIN bands ON band=code GROUP BY root) LEFT JOIN (SELECT gid AS sgid, tier FROM scored) ON sgid='g'||root WHERE n>1 AND mid BETWEEN 30 AND 300 AND NOT coalesce(largest>=30,false)", "comp scored")
def _(v):
    m = resolve.with_roots(v.co, v.keys).withColumn("b", N.band_mid(F.col("band")))
    g = m.groupBy("root").agg(F.count("*").alias("n"), F.max(F.when(F.col("active"), F.col("b"))).alias("largest"), F.coalesce(F.sum("b"), F.lit(0.0)).alias("mid"))
    low, high = v.cfg.segment.headcount_min, v.cfg.segment.headcount_max
    some = g.where((F.col("n") > 1) & F.col("mid").between(low, high) & ~F.coalesce(F.col("largest") >= low, F.lit(False))).withColumn("gid", F.concat(F.lit("g"), "root"))
    return some.join(scored(v).select("gid", "tier"), "gid", "left").select("gid", "n", "largest", "mid", "tier")


# runs

_ONE = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY event_id) AS o FROM lg) WHERE o=1)"


@q("q_run_stats", f"SELECT backend, count(DISTINCT lead) AS leads, round_even(sum(usd)/count(DISTINCT lead),6) AS usd_per_lead, round_even(sum(tokens)/count(DISTINCT lead),4) AS tokens_per_lead, round_even(sum(searches)/count(DISTINCT lead),4) AS searches_per_lead FROM (SELECT backend, lead, searches, input_tokens+cache_read AS tokens, (input_tokens*5+cache_read*0.5+output_tokens*25)/1000000.0::DOUBLE+searches*0.01 AS usd FROM {_ONE}) GROUP BY backend", "lg")
def _(v):
    from .scoring import usd

    per = once(v).groupBy("backend").agg(F.countDistinct("lead").alias("leads"), F.sum(usd()).alias("usd"), F.sum(F.col("input_tokens") + F.col("cache_read")).alias("tokens"), F.sum("searches").alias("searches"))
    return per.select("backend", "leads", R(F.col("usd") / F.col("leads"), 6).alias("usd_per_lead"), R(F.col("tokens") / F.col("leads"), 4).alias("tokens_per_lead"), R(F.col("searches") / F.col("leads"), 4).alias("searches_per_lead"))


@q("q_cost_usd", "SELECT event_id, round_even(CASE WHEN event_id%2=0 THEN (input_tokens*5+cache_read*0.5+output_tokens*25)/1000000.0 ELSE (input_tokens*1+cache_read*0.1+output_tokens*5)/1000000.0 END::DOUBLE+searches*0.01,6) AS usd FROM lg", "lg")
def _(v):
    priced = v.lg.withColumn("model", F.when(F.col("event_id") % 2 == 0, "large").otherwise("small"))
    prices = v.spark.createDataFrame([(k, *p) for k, p in v.cfg.prices.items()], "model string, p_input double, p_write double, p_read double, p_output double")
    # the config's price list is broadcast; a model without a price is an error
    j = priced.join(F.broadcast(prices), "model", "left")
    known = F.when(F.col("p_input").isNull(), F.raise_error(F.concat(F.lit("no price for "), "model")).cast("double")).otherwise(F.col("p_input"))
    return j.select("event_id", R((F.col("input_tokens") * known + F.col("cache_read") * F.col("p_read") + F.col("output_tokens") * F.col("p_output")) / 1e6 + F.col("searches") * v.cfg.search_usd, 6).alias("usd"))


@q("q_budget_stop", "SELECT event_id, coalesce(sum(c) OVER (ORDER BY called, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)<6000000 AS started FROM (SELECT event_id, called, CAST(round(value*100) AS BIGINT) AS c FROM lg)", "lg")
def _(v):
    """One budget a run: what was spent on earlier days is summed over the days, and only a day's lines are put in order together."""
    lines = v.lg.select("event_id", "called", F.to_date("called").alias("day"), F.round(F.col("value") * 100).cast("long").alias("c"))
    days = lines.groupBy("day").agg(F.sum("c").alias("c"))
    ahead = days.select("day", F.coalesce(F.sum("c").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    before = Window.partitionBy("day").orderBy("called", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("own", F.coalesce(F.sum("c").over(before), F.lit(0))).join(ahead, "day").select("event_id", (F.col("ahead") + F.col("own") < 6_000_000).alias("started"))


@q("q_market_page", "SELECT stage, n, round_even(n/first_value(n) OVER (ORDER BY o ROWS BETWEEN 1 PRECEDING AND CURRENT ROW),6) AS ratio, a, b, c FROM (SELECT 0 AS o, 'market' AS stage, count(*) AS n, 0 AS a, 0 AS b, 0 AS c FROM mk UNION ALL SELECT 1, 'in segment', count(*), 0, 0, 0 FROM mk WHERE mid BETWEEN 30 AND 300 UNION ALL SELECT 2, 'researched', count(*), count(*) FILTER (WHERE tier='A'), count(*) FILTER (WHERE tier='B'), count(*) FILTER (WHERE tier='C') FROM ranked UNION ALL SELECT 3, 'queue', count(*), count(*) FILTER (WHERE tier='A'), count(*) FILTER (WHERE tier='B'), count(*) FILTER (WHERE tier='C') FROM ranked WHERE place<=50)", "ranked")
def _(v):
    none = [F.lit(0).cast("long").alias(t) for t in "abc"]
    tiers = [F.count_if(F.col("tier") == t.upper()).alias(t) for t in "abc"]
    low, high = v.cfg.segment.headcount_min, v.cfg.segment.headcount_max
    s = scored(v)
    parts = [
        v.mk.agg(F.count("*").alias("n")).select(F.lit(0).alias("o"), F.lit("market").alias("stage"), "n", *none), v.mk.where(F.col("mid").between(low, high)).agg(F.count("*").alias("n")).select(F.lit(1), F.lit("in segment"), "n", *none),
        s.agg(F.count("*").alias("n"), *tiers).select(F.lit(2), F.lit("researched"), "n", *"abc"), S.queue(s, v.cfg.queue_size).agg(F.count("*").alias("n"), *tiers).select(F.lit(3), F.lit("queue"), "n", *"abc"),
    ]
    stages = parts[0]
    for p in parts[1:]:
        stages = stages.union(p)
    before = F.lag("n", 1).over(Window.orderBy("o"))  # four rows
    return stages.select("stage", "n", R(F.col("n") / F.coalesce(before, "n"), 6).alias("ratio"), *"abc")


@q("q_region_concentration", "SELECT sum(n) FILTER (o<=3)/sum(n)::DOUBLE AS top3 FROM (SELECT count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, region) AS o FROM ranked WHERE place<=50 GROUP BY region)", "ranked")
def _(v):
    n = S.queue(scored(v), v.cfg.queue_size).groupBy("region").agg(F.count("*").alias("n"))
    top = n.orderBy(F.desc("n"), "region").limit(3).agg(F.sum("n").alias("top"))
    return top.join(n.agg(F.sum("n").alias("total"))).select((F.col("top") / F.col("total")).alias("top3"))


@q("q_size_outside", "SELECT count(*) FILTER (WHERE headcount<30 OR headcount>300) AS outside, count(*) AS n FROM heads", "heads")
def _(v):
    s = v.cfg.segment
    return v.heads.agg(F.count_if((F.col("headcount") < s.headcount_min) | (F.col("headcount") > s.headcount_max)).alias("outside"), F.count("*").alias("n"))


@q("q_map_iqr", "SELECT id FROM co, (SELECT median(bal) AS m, quantile_cont(bal,0.75)-quantile_cont(bal,0.25) AS i FROM co) WHERE bal BETWEEN m-3*i AND m+3*i", "co")
def _(v):
    co = v.staged.co
    p = quantiles(co, "bal", {"a": 0.25, "b": 0.5, "c": 0.75})
    return co.join(F.broadcast(p), F.lit(True)).where("bal BETWEEN b - 3 * (c - a) AND b + 3 * (c - a)").select("id")


@q("q_named_groups", "SELECT gid, name FROM mk WHERE gid IN ('g3','g1','g2')", "mk")
def _(v):
    return H.named(v.mk, ["g3", "g1", "g2"]).select("gid", "name")


@q("q_signals_absent", "SELECT gid, signal, CASE WHEN ord<2 THEN value END AS value, ord<2 AND found AS found FROM sg", "sg")
def _(v):
    """A row for each configured signal; one that the answer lacks has no value and isn't found."""
    every = v.sg.select("gid").distinct().withColumn("signal", F.explode(F.array(*(F.lit(s.id) for s in v.cfg.signals))))
    answer = v.sg.where("ord < 2").groupBy("gid").agg(F.map_from_entries(F.collect_list(F.struct("signal", F.struct("value", "found")))).alias("a"))
    return every.join(answer, "gid", "left").select("gid", "signal", F.col("a")[F.col("signal")]["value"].alias("value"), F.coalesce(F.col("a")[F.col("signal")]["found"], F.lit(False)).alias("found"))


@q("q_search_summary", """SELECT page_id, CASE WHEN len(l)=0 THEN '' ELSE len(l)||CASE WHEN len(l)=1 THEN ' result: ' ELSE ' results: ' END||array_to_string(list_slice(list_filter(h, lambda x, i: list_position(h,x)=i),1,3),', ') END AS found FROM (SELECT page_id, l, list_transform(l, lambda u: regexp_replace(string_split(regexp_replace(u,'^https?://',''),'/')[1],'^www\\.','')) AS h FROM (SELECT page_id, CASE WHEN page_id%3=0 THEN [] WHEN page_id%3=1 THEN [url] ELSE [url,'https://www.b.example/y',url,'http://c.example','https://d.example/z'] END AS l FROM pages))""")
def _(v):
    one = lambda u: F.concat(F.lit('{"url": "'), u, F.lit('"}'))
    fixed = [F.lit("https://www.b.example/y"), F.col("url"), F.lit("http://c.example"), F.lit("https://d.example/z")]
    said = F.when(F.col("page_id") % 3 == 0, F.lit("nothing")).when(F.col("page_id") % 3 == 1, one(F.col("url"))).otherwise(F.concat_ws(", ", one(F.col("url")), *map(one, fixed)))
    return v.table("pages").select("page_id", T.search_summary(said).alias("found"))
