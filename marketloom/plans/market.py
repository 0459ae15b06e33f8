"""Sourcing, resolution and pre-filter queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..operators import resolve
from .registry import q
from .testbed import TODAY


@q("q_src_domain_filter", "SELECT siret, siren, domain, until, line FROM reg WHERE domain IN ('STANDARD','PROMO')", "reg")
def _(v):
    return v.reg.where(F.col("domain").isin("STANDARD", "PROMO")).select("siret", "siren", "domain", "until", "line")


@q("q_active_filter", f"SELECT siret, domain, until FROM reg WHERE until IS NULL OR until='' OR until>='{TODAY}'", "reg")
def _(v):
    return v.reg.where(F.col("until").isNull() | (F.col("until") == "") | (F.col("until") >= TODAY)).select("siret", "domain", "until")


@q("q_valid_id", "SELECT id, regexp_replace(raw,' ','','g') AS clean FROM (SELECT id, CASE WHEN id%5=0 THEN '12 '||id ELSE lpad(CAST(id AS VARCHAR),9,'9')||' 00011' END AS raw FROM co) WHERE regexp_full_match(regexp_replace(raw,' ','','g'),'[0-9]{14}')", "co")
def _(v):
    raw = F.when(F.col("id") % 5 == 0, F.concat(F.lit("12 "), "id")).otherwise(F.concat(F.lpad(F.col("id").cast("string"), 9, "9"), F.lit(" 00011")))
    return v.co.select("id", F.regexp_replace(raw, " ", "").alias("clean")).where(F.col("clean").rlike("^[0-9]{14}$"))


_ORD = "row_number() OVER (PARTITION BY siret ORDER BY line, l_partkey, until, domain)"


@q("q_merge_establishment", f"SELECT siret, min(siren) AS siren, array_to_string(list_sort(list(DISTINCT domain)),'|') AS domains, coalesce(arg_min(phone, o) FILTER (WHERE phone<>''),'') AS phone FROM (SELECT *, {_ORD} AS o FROM reg) GROUP BY siret", "reg")
def _(v):
    first = F.struct("line", "l_partkey", "until", "domain")
    return v.reg.groupBy("siret").agg(F.min("siren").alias("siren"), F.array_join(F.array_sort(F.collect_set("domain")), "|").alias("domains"), F.coalesce(F.min_by("phone", F.when(F.col("phone") != "", first)), F.lit("")).alias("phone"))


@q("q_merge_company", "SELECT siren, count(DISTINCT siret) AS n_sites, array_to_string(list_sort(list(DISTINCT siret)),'|') AS sites, array_to_string(list_sort(list(DISTINCT domain)),'|') AS domains FROM reg GROUP BY siren", "reg")
def _(v):
    return v.reg.groupBy("siren").agg(F.countDistinct("siret").alias("n_sites"), F.array_join(F.array_sort(F.collect_set("siret")), "|").alias("sites"), F.array_join(F.array_sort(F.collect_set("domain")), "|").alias("domains"))


@q("q_register_join", "SELECT r.siren, CASE WHEN co.id IS NULL THEN 'not found in the register' WHEN NOT active THEN 'closed' END AS reason FROM (SELECT DISTINCT CASE WHEN siren%11=0 THEN -siren ELSE siren END AS siren FROM reg) r LEFT JOIN co ON co.id=r.siren", "reg co")
def _(v):
    ids = v.reg.select(F.when(F.col("siren") % 11 == 0, -F.col("siren")).otherwise(F.col("siren")).alias("siren")).distinct()
    j = ids.join(v.co, F.col("siren") == F.col("id"), "left")
    return j.select("siren", F.when(F.col("id").isNull(), "not found in the register").when(~F.col("active"), "closed").alias("reason"))


@q("q_register_flatten", "SELECT id, coalesce(nullif(CASE WHEN id%7=0 THEN '' ELSE name END,''), 'company '||id) AS name, region, nation AS department, n_orders AS establishments_open FROM co", "co")
def _(v):
    raw = F.to_json(F.struct("id", F.when(F.col("id") % 7 == 0, "").otherwise(F.col("name")).alias("nom_complet"), F.concat(F.lit("company "), "id").alias("nom_raison_sociale"), F.struct("region", F.col("nation").alias("departement")).alias("siege"), F.col("n_orders").alias("nombre_etablissements_ouverts")))
    r = v.co.select(F.from_json(raw, "id long, nom_complet string, nom_raison_sociale string, siege struct<region:int,departement:int>, nombre_etablissements_ouverts long").alias("r"))
    return r.select("r.id", F.coalesce(F.nullif("r.nom_complet", F.lit("")), "r.nom_raison_sociale").alias("name"), "r.siege.region", F.col("r.siege.departement").alias("department"), F.col("r.nombre_etablissements_ouverts").alias("establishments_open"))


@q("q_safe_cast", "SELECT id, TRY_CAST(x AS DOUBLE) AS x FROM (SELECT id, CASE WHEN id%3=0 THEN 'n/a' ELSE CAST(id AS VARCHAR)||'.5' END AS x FROM co)", "co")
def _(v):
    return v.co.select("id", F.expr("try_cast(CASE WHEN id % 3 = 0 THEN 'n/a' ELSE concat(id, '.5') END AS double)").alias("x"))


_FOUND = "band>='11' AND band<>'NN' AND seg IN ('BUILDING','MACHINERY') AND active"


@q("q_second_source", f"SELECT id, 'registry' AS via FROM co WHERE id%2=0 UNION ALL SELECT id, 'naf_search' FROM co WHERE {_FOUND} AND id%2<>0", "co")
def _(v):
    known = v.co.where("id % 2 = 0").select("id", F.lit("registry").alias("via"))
    return known.unionByName(v.co.where(_FOUND).select("id").join(known, "id", "left_anti").withColumn("via", F.lit("naf_search")))


@q("q_source_cap", f"SELECT band, count(*) AS n, count(*)>100 AS truncated FROM co WHERE {_FOUND} GROUP BY band", "co")
def _(v):
    return v.co.where(_FOUND).groupBy("band").agg(F.count("*").alias("n"), (F.count("*") > 100).alias("truncated"))


@q("q_extra_ids", "SELECT e.id, co.name IS NOT NULL AS found FROM (SELECT unnest([1,2,3,77,-5]) AS id) e LEFT JOIN co USING (id) WHERE e.id NOT IN (SELECT id FROM co WHERE id%2=0)", "co")
def _(v):
    extra = v.spark.createDataFrame([(i,) for i in (1, 2, 3, 77, -5)], "id long")
    return extra.join(v.co.where("id % 2 = 0"), "id", "left_anti").join(v.co.select("id", "name"), "id", "left").select("id", F.col("name").isNotNull().alias("found"))


@q("q_latest_by_key", "SELECT o_custkey AS id, arg_max(o_totalprice, (y, o_orderkey)) AS revenue, max(y) AS revenue_year FROM (SELECT *, year(o_orderdate) AS y FROM orders WHERE o_totalprice>1000) GROUP BY 1")
def _(v):
    o = v.table("orders").where("o_totalprice > 1000").withColumn("y", F.year("o_orderdate"))
    return o.groupBy(F.col("o_custkey").alias("id")).agg(F.max_by("o_totalprice", F.struct("y", "o_orderkey")).alias("revenue"), F.max("y").alias("revenue_year"))


@q("q_funnel", f"SELECT 'rows' AS stage, count(*) AS n FROM reg UNION ALL SELECT 'active', count(*) FROM reg WHERE until>='{TODAY}' UNION ALL SELECT 'establishments', count(DISTINCT siret) FROM reg UNION ALL SELECT 'companies', count(DISTINCT siren) FROM reg", "reg")
def _(v):
    one = v.reg.agg(F.count("*").alias("rows"), F.count_if(F.col("until") >= TODAY).alias("active"), F.countDistinct("siret").alias("establishments"), F.countDistinct("siren").alias("companies"))
    return one.unpivot([], ["rows", "active", "establishments", "companies"], "stage", "n")


@q("q_normalize", "SELECT doc_id, trim(regexp_replace(upper(strip_accents(replace(text,'ß','ss'))),'[^A-Z0-9]+',' ','g')) AS norm FROM documents")
def _(v):
    return v.table("documents").select("doc_id", T.normalize(F.col("text")).alias("norm"))


_PHONE = "CASE id%4 WHEN 0 THEN '0033 4 '||lpad(CAST(id%100000000 AS VARCHAR),8,'0') WHEN 1 THEN '+33 4.'||lpad(CAST(id%100000000 AS VARCHAR),8,'0') WHEN 2 THEN '04'||lpad(CAST(id%100000000 AS VARCHAR),8,'0') ELSE CAST(id AS VARCHAR) END"


@q("q_phone_key", f"SELECT id, CASE WHEN regexp_full_match(l,'0[0-9]{{9}}') THEN l END AS phone FROM (SELECT id, CASE WHEN d LIKE '0033%' THEN '0'||substr(d,5) WHEN d LIKE '33%' AND length(d)=11 THEN '0'||substr(d,3) ELSE d END AS l FROM (SELECT id, regexp_replace({_PHONE},'[^0-9]','','g') AS d FROM co))", "co")
def _(v):
    return v.co.select("id", T.phone_key(F.expr(_PHONE.replace("VARCHAR", "STRING"))).alias("phone"))


_HOST = r"regexp_replace(regexp_extract(lower(trim(url)),'://([^/?#:]*)',1),'^www\.','')"


@q("q_website_host", f"SELECT page_id, CASE WHEN contains({_HOST},'.') THEN {_HOST} END AS host FROM pages")
def _(v):
    return v.table("pages").select("page_id", T.website_host(F.col("url")).alias("host"))


@q("q_normalize_url", r"SELECT page_id, regexp_replace(regexp_replace(lower(regexp_extract(u,'^https?://([^/?]*)',1)),'^www\.','')||regexp_extract(u,'^https?://[^/?]*(.*)$',1),'/+$','') AS clean FROM (SELECT page_id, regexp_replace(trim(url),'#.*$','') AS u FROM pages)")
def _(v):
    return v.table("pages").select("page_id", T.normalize_url(F.col("url")).alias("clean"))


@q("q_url_extract", r"""SELECT page_id, array_to_string(list_transform(regexp_extract_all('see '||url||'. and <'||url||'>, end', '(https?://[^\s"''<>)\]]+)', 1), lambda x: regexp_replace(x,'[.,;:]+$','')),' ') AS urls FROM pages""")
def _(v):
    said = F.concat(F.lit("see "), "url", F.lit(". and <"), "url", F.lit(">, end"))
    return v.table("pages").select("page_id", F.array_join(T.urls_in(said), " ").alias("urls"))


@q("q_keyword_match", "SELECT doc_id FROM documents WHERE contains(' '||trim(regexp_replace(upper(strip_accents(replace(text,'ß','ss'))),'[^A-Z0-9]+',' ','g'))||' ',' THTION ') OR contains(' '||trim(regexp_replace(upper(strip_accents(replace(text,'ß','ss'))),'[^A-Z0-9]+',' ','g'))||' ',' UNG ')")
def _(v):
    return v.table("documents").where(T.keyword_match(T.normalize(F.col("text")), ["THTION", "UNG"])).select("doc_id")


@q("q_split_address", "SELECT id, CASE WHEN i>0 THEN substr(a,1,i-1) ELSE a END AS street, CASE WHEN i>0 THEN substr(a,i+length(m)) ELSE '' END AS city FROM (SELECT *, instr(a,m) AS i FROM (SELECT id, id||' rue '||name||' '||(10000+id%80000)||' '||seg AS a, CASE WHEN id%6=0 THEN ' x ' ELSE ' '||(10000+id%80000)||' ' END AS m FROM co))", "co")
def _(v):
    code = 10000 + F.col("id") % 80000
    a = F.concat("id", F.lit(" rue "), "name", F.lit(" "), code, F.lit(" "), "seg")
    street, city = T.split_address(F.col("a"), F.col("c"))
    return v.co.select("id", a.alias("a"), F.when(F.col("id") % 6 == 0, "x").otherwise(code.cast("string")).alias("c")).select("id", street.alias("street"), city.alias("city"))


@q("q_jitter", "SELECT id, CAST('0x'||substr(sha256(name),1,8) AS BIGINT)/4294967296.0::DOUBLE AS j FROM co", "co")
def _(v):
    return v.co.select("id", T.jitter(F.col("name")).alias("j"))


@q("q_months_before", "SELECT id, CAST(make_date(year(m), month(m), least(day(created),28)) AS VARCHAR) AS cutoff, CAST(last_day(created) AS VARCHAR) AS month_end FROM (SELECT id, created, date_trunc('month',created) - INTERVAL 24 MONTH AS m FROM co WHERE created IS NOT NULL)", "co")
def _(v):
    return v.co.where("created IS NOT NULL").select("id", N.months_before(F.col("created"), 24).cast("string").alias("cutoff"), F.last_day("created").cast("string").alias("month_end"))


@q("q_log_share", "SELECT id, round_even(CASE WHEN n_orders<=1 THEN 0.0 ELSE log10(n_orders)/log10(30) END,6) AS share FROM co", "co")
def _(v):
    return v.co.select("id", N.rounded(N.log_share(F.col("n_orders"), F.lit(30)), 6).alias("share"))


# resolution


@q("q_directory_hosts", f"SELECT {_HOST} AS host, count(DISTINCT page_id) AS n FROM pages GROUP BY 1 HAVING count(DISTINCT page_id)>=21")
def _(v):
    return v.table("pages").select(T.website_host(F.col("url")).alias("host"), "page_id").groupBy("host").agg(F.countDistinct("page_id").alias("n")).where("n >= 21")


@q("q_components", "SELECT id, root FROM comp", "comp")
def _(v):
    return resolve.with_roots(v.co, v.keys).select("id", "root")


def _groups(v):
    return resolve.with_roots(v.co, v.keys).withColumn("mid", N.band_mid(F.col("band"))).withColumn("low", N.band_low(F.col("band"))).withColumn("high", N.band_high(F.col("band")))


@q("q_group_rollup", "SELECT 'g'||root AS gid, array_to_string(list_sort(list(id)),'|') AS members, round_even(sum(CASE WHEN bal>0 THEN bal END),2) AS revenue, CAST(min(created) AS VARCHAR) AS created FROM comp JOIN co USING (id) GROUP BY root", "comp")
def _(v):
    g = _groups(v).groupBy("root").agg(F.array_join(F.array_sort(F.collect_list("id")), "|").alias("members"), N.rounded(F.sum(F.when(F.col("bal") > 0, F.col("bal"))), 2).alias("revenue"), F.min("created").cast("string").alias("created"))
    return g.select(F.concat(F.lit("g"), "root").alias("gid"), "members", "revenue", "created")


@q("q_group_headcount", "SELECT root, CAST(coalesce(sum(lo),0) AS BIGINT) AS low, coalesce(sum((lo+hi)/2.0),0)::DOUBLE AS mid, CAST(coalesce(sum(hi),0) AS BIGINT) AS high, count(*) FILTER (WHERE lo IS NULL) AS unknown FROM comp JOIN co USING (id) LEFT JOIN bands ON band=code GROUP BY root", "comp bands")
def _(v):
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return _groups(v).groupBy("root").agg(zero("low").cast("long").alias("low"), zero("mid").cast("double").alias("mid"), zero("high").cast("long").alias("high"), F.count_if(F.col("low").isNull()).alias("unknown"))


@q("q_group_lead", "SELECT root, arg_max(id, (coalesce(nullif((lo+hi)/2.0,0),-1), n_orders>0, -id)) AS lead FROM comp JOIN co USING (id) LEFT JOIN bands ON band=code GROUP BY root", "comp bands")
def _(v):
    return _groups(v).groupBy("root").agg(F.max_by("id", F.struct(F.coalesce(F.nullif("mid", F.lit(0.0)), F.lit(-1.0)).alias("a"), (F.col("n_orders") > 0).alias("b"), (-F.col("id")).alias("c"))).alias("lead"))


@q("q_group_source", "SELECT root, CASE WHEN count(DISTINCT source)>1 THEN 'both' ELSE min(source) END AS source FROM comp JOIN co USING (id) GROUP BY root", "comp")
def _(v):
    return _groups(v).groupBy("root").agg(F.when(F.countDistinct("source") > 1, "both").otherwise(F.min("source")).alias("source"))


@q("q_link_reason", "SELECT root, array_to_string(list_sort(list(DISTINCT 'same '||split_part(key,':',1))),' + ') AS reason FROM keys JOIN comp USING (id) GROUP BY root", "comp keys")
def _(v):
    roots = resolve.components(v.keys)
    return v.keys.join(roots, "id").groupBy("root").agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("same "), F.split("key", ":")[0]))), " + ").alias("reason"))


@q("q_expansion", "SELECT person, id FROM (SELECT *, row_number() OVER (PARTITION BY person ORDER BY mid DESC, id) AS o FROM (SELECT id, nation||'|'||seg AS person, (lo+hi)/2.0 AS mid FROM co JOIN bands ON band=code WHERE active AND lo>=10 AND (lo+hi)/2.0<30)) WHERE o=1", "co bands")
def _(v):
    c = v.co.select("id", "active", F.concat_ws("|", "nation", "seg").alias("person"), N.band_low(F.col("band")).alias("low"), N.band_mid(F.col("band")).alias("mid")).where("active AND low >= 10 AND mid < 30")
    return c.groupBy("person").agg(F.max_by("id", F.struct("mid", -F.col("id"))).alias("id"))


# pre-filter


@q("q_band_lookup", "SELECT id, band, lo AS low, (lo+hi)/2.0::DOUBLE AS mid, hi AS high FROM co LEFT JOIN bands ON band=code", "co bands")
def _(v):
    return v.co.select("id", "band", N.band_low(F.col("band")).alias("low"), N.band_mid(F.col("band")).alias("mid"), N.band_high(F.col("band")).alias("high"))


_FLAGS = "coalesce(mid BETWEEN 30 AND 300, false) AS in_segment, coalesce(NOT (mid BETWEEN 30 AND 300) AND mid BETWEEN 30-135 AND 300+135, false) AS near_band"


@q("q_size_flags", f"SELECT gid, {_FLAGS} FROM mk", "mk")
def _(v):
    return flagged(v).select("gid", "in_segment", "near_band")


def flagged(v):
    s = v.cfg.segment
    half = (s.headcount_max - s.headcount_min) / 2
    inside = F.coalesce(F.col("mid").between(s.headcount_min, s.headcount_max), F.lit(False))
    near = F.coalesce(F.col("mid").between(s.headcount_min - half, s.headcount_max + half), F.lit(False))
    return v.mk.withColumn("in_segment", inside).withColumn("near_band", near & ~inside)


@q("q_product_lines", "SELECT siren, array_to_string(list_filter([CASE WHEN bool_or(domain IN ('STANDARD','MEDIUM')) THEN 'core' END, CASE WHEN bool_or(domain IN ('LARGE','PROMO')) THEN 'premium' END, CASE WHEN bool_or(domain IN ('SMALL','ECONOMY')) THEN 'budget' END], lambda x: x IS NOT NULL),'|') AS lines FROM reg GROUP BY siren", "reg")
def _(v):
    d = v.reg.groupBy("siren").agg(F.collect_set("domain").alias("domains"))
    lines = F.array_compact(F.array(*(F.when(F.arrays_overlap("domains", F.array(*map(F.lit, proof))), F.lit(line)) for line, proof in v.cfg.product_lines.items())))
    return d.select("siren", F.array_join(lines, "|").alias("lines"))


_PRE = f"SELECT gid, mid, is_reference, CASE WHEN in_segment THEN 1.0 WHEN near_band THEN 0.5 ELSE 0.0 END AS size_fit, CASE WHEN n_orders=0 THEN 0.5 ELSE least(n_orders,4)/4.0 END AS product_mix, CASE WHEN created>='1997-01-01' OR urgent>3 THEN 1.0 ELSE 0.0 END AS growth, CASE WHEN co.id%3>0 THEN 1.0 ELSE 0.0 END AS tech_maturity, in_segment, near_band FROM (SELECT *, {_FLAGS} FROM mk) f JOIN co USING (gid)"


def pre(v):
    c = v.co.select("gid", "n_orders", "created", "urgent", F.col("id").alias("cid"))
    j = flagged(v).join(c, "gid")
    return j.select(
        "gid", "mid", "in_segment", "near_band", F.when(F.col("in_segment"), 1.0).when(F.col("near_band"), 0.5).otherwise(0.0).alias("size_fit"), F.when(F.col("n_orders") == 0, 0.5).otherwise(F.least(F.col("n_orders"), F.lit(4)) / 4.0).alias("product_mix"),
        F.when((F.col("created") >= "1997-01-01") | (F.col("urgent") > 3), 1.0).otherwise(0.0).alias("growth"), F.when(F.col("cid") % 3 > 0, 1.0).otherwise(0.0).alias("tech_maturity"),
    ).withColumn("pre_score", N.rounded((F.col("size_fit") * 3 + F.col("product_mix") * 3 + F.col("growth") * 2 + F.col("tech_maturity") * 2) / 10.0, 4))


@q("q_pre_signals", f"SELECT gid, size_fit::DOUBLE AS size_fit, product_mix::DOUBLE AS product_mix, growth::DOUBLE AS growth, tech_maturity::DOUBLE AS tech_maturity FROM ({_PRE})", "mk co")
def _(v):
    return pre(v).select("gid", "size_fit", "product_mix", "growth", "tech_maturity")


_PS = "round_even(((size_fit*3+product_mix*3+growth*2+tech_maturity*2)/10.0)::DOUBLE,4)"


@q("q_pre_score", f"SELECT gid, {_PS} AS pre_score FROM ({_PRE})", "mk co")
def _(v):
    return pre(v).select("gid", "pre_score")


@q("q_own_website", f"SELECT page_id%97 AS id, arg_min(url, page_id) AS website FROM (SELECT *, {_HOST} AS host FROM pages) WHERE host NOT IN (SELECT host FROM (SELECT {_HOST} AS host, count(*) n FROM pages GROUP BY 1) WHERE n>=21) GROUP BY 1")
def _(v):
    p = v.table("pages").select("page_id", "url", T.website_host(F.col("url")).alias("host"))
    big = p.groupBy("host").agg(F.count("*").alias("n")).where("n >= 21")
    return p.join(big, "host", "left_anti").groupBy((F.col("page_id") % 97).alias("id")).agg(F.min_by("url", "page_id").alias("website"))


@q("q_shortlist", f"SELECT gid, o<=175 AS shortlisted FROM (SELECT gid, row_number() OVER (ORDER BY ps DESC, mid DESC, gid) AS o FROM (SELECT *, {_PS} AS ps FROM ({_PRE})) WHERE in_segment OR near_band)", "mk co")
def _(v):
    c = pre(v).where("in_segment OR near_band")
    # the cut is a top-k; no sort of the market in one task
    top = c.orderBy(F.desc("pre_score"), F.desc("mid"), "gid").limit(v.cfg.shortlist_size).select("gid", F.lit(True).alias("shortlisted"))
    return c.select("gid").join(top, "gid", "left").fillna(False, ["shortlisted"])


@q("q_exclusion_reasons", f"SELECT CASE WHEN mid IS NULL THEN 'headcount unknown' WHEN in_segment THEN 'in segment' WHEN near_band THEN 'near band' WHEN mid>300 THEN 'above the segment' ELSE 'below the segment' END AS reason, count(*) AS n FROM (SELECT *, {_FLAGS} FROM mk) GROUP BY 1", "mk")
def _(v):
    reason = F.when(F.col("mid").isNull(), "headcount unknown").when(F.col("in_segment"), "in segment").when(F.col("near_band"), "near band").when(F.col("mid") > 300, "above the segment").otherwise("below the segment")
    return flagged(v).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))
