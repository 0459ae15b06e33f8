"""Market-shaped tables over the driver's tables: as DataFrames, and as SQL for the oracles."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..stage import handed_over

TODAY = "1998-08-02"
SIGNALS = ("size_fit", "product_mix", "growth", "tech_maturity")


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self.cfg = spark, sf_dir, Config()

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def co(self) -> DataFrame:
        """Companies: customers with what their orders say."""
        o = self.table("orders").groupBy(F.col("o_custkey").alias("id")).agg(
            F.count("*").alias("n_orders"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"), F.count_if(F.col("o_orderstatus") == "F").alias("filled"),
            F.min("o_orderdate").cast("date").alias("created"), F.max("o_orderdate").cast("date").alias("latest"),
        )
        c = self.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("seg"))
        n = self.table("nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"))
        all_ = c.join(n, "nation").join(o, "id", "left").fillna(0, ["n_orders", "urgent", "filled"])
        k = F.col("n_orders")
        band = F.when(k == 0, "NN").when(k <= 2, "03").when(k <= 5, "11").when(k <= 9, "12").when(k <= 13, "21").when(k <= 19, "22").otherwise("31")
        return all_.select("*", band.alias("band"), F.concat(F.lit("g"), "id").alias("gid"), (F.col("bal") > 0).alias("active"), F.when(F.col("id") % 3 == 0, "both").when(F.col("id") % 3 == 1, "registry").otherwise("register").alias("source"))

    @cached_property
    def staged(self) -> Views:
        """The same with companies as a stage table: what is derived from them several times reads it."""
        other = Views(self.spark, self.dir)
        other.__dict__.update(co=handed_over(self.co, "companies"), staged=other)
        return other

    @cached_property
    def sg(self) -> DataFrame:
        """Signals in long form."""
        k = F.col("n_orders")
        values = {"size_fit": F.when(k >= 6, 1.0).when(k >= 3, 0.5).otherwise(0.0), "product_mix": (F.col("urgent") % 5) / 4.0, "growth": (F.col("filled") % 5) / 4.0, "tech_maturity": (F.col("id") % 5) / 4.0}
        rows = F.explode(F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(s).alias("signal"), values[s].cast("double").alias("value")) for i, s in enumerate(SIGNALS))))
        return self.co.select("id", "gid", "name", F.when(F.col("id") % 17 == 0, "failed").otherwise("ok").alias("status"), rows.alias("s")).select("id", "gid", "name", "status", "s.*").withColumn("found", F.col("value") > 0).withColumn("n_evidence", ((F.col("id") + F.col("ord")) % 3).cast("int"))

    @cached_property
    def grades(self) -> DataFrame:
        return self.co.where("id % 4 = 0").select("gid", F.lit("growth").alias("signal"), (F.floor(F.col("id") / 4) % 5 / 4.0).alias("grade"))

    @cached_property
    def heads(self) -> DataFrame:
        return self.co.where("id % 8 = 0").select("gid", (40 + F.col("id") % 200).cast("double").alias("headcount"))

    @cached_property
    def mk(self) -> DataFrame:
        """Market: one row a group, here a company of its own."""
        from ..functions.numbers import band_mid

        return self.co.select("gid", "id", "name", "region", "nation", band_mid(F.col("band")).alias("mid"), "bal", (F.col("id") % 50 == 1).alias("is_reference"), ((F.col("n_orders") % 10) / 10.0).alias("pre_score"))

    @cached_property
    def lg(self) -> DataFrame:
        """Ledger: events as calls."""
        k = F.get_json_object("props", "$.k").cast("long")
        return self.table("events").select("event_id", F.concat(F.lit("g"), "user_id").alias("lead"), F.concat_ws("|", "user_id", "props").alias("key"), F.col("event_type").alias("purpose"), F.col("ts").alias("called"), k.alias("input_tokens"), (k * 3).alias("cache_read"), (k % 7).alias("output_tokens"), (k % 3).alias("searches"), "value", F.when(F.col("event_id") % 2 == 0, "api").otherwise("cli").alias("backend"))

    @cached_property
    def keys(self) -> DataFrame:
        """Link keys shared by 2 to 20 companies."""
        c = self.co
        kinds = F.explode(F.array(F.concat(F.lit("phone:"), F.floor("bal")), F.concat_ws("|", F.concat(F.lit("manager:"), "nation"), "seg", F.floor(F.col("bal") / 50))))
        k = c.select("id", kinds.alias("key"))
        n = k.groupBy("key").agg(F.countDistinct("id").alias("n")).where("n BETWEEN 2 AND 20").select("key")
        return k.join(n, "key")

    @cached_property
    def reg(self) -> DataFrame:
        """Registry rows: an order line is a qualification of an establishment."""
        l, o, p = self.table("lineitem"), self.table("orders"), self.table("part")
        j = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
        return j.select(F.col("l_orderkey").alias("siret"), F.col("o_custkey").alias("siren"), F.element_at(F.split("p_type", " "), 1).alias("domain"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("until"), F.col("l_linenumber").alias("line"), F.when(F.col("l_suppkey") % 3 == 0, "").otherwise(F.concat(F.lit("p"), "l_suppkey")).alias("phone"), "l_partkey")


#: name: (views it needs, SQL)
SQL: dict[str, tuple[str, str]] = {
    "co": ("", """SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation, n_regionkey AS region, c_acctbal AS bal, c_mktsegment AS seg, coalesce(n,0) AS n_orders, coalesce(u,0) AS urgent, coalesce(f,0) AS filled, created, latest,
 CASE WHEN coalesce(n,0)=0 THEN 'NN' WHEN n<=2 THEN '03' WHEN n<=5 THEN '11' WHEN n<=9 THEN '12' WHEN n<=13 THEN '21' WHEN n<=19 THEN '22' ELSE '31' END AS band, 'g'||c_custkey AS gid, c_acctbal>0 AS active,
 CASE c_custkey%3 WHEN 0 THEN 'both' WHEN 1 THEN 'registry' ELSE 'register' END AS source
 FROM customer JOIN nation ON c_nationkey=n_nationkey LEFT JOIN (SELECT o_custkey, count(*) n, count(*) FILTER (WHERE o_orderpriority='1-URGENT') u, count(*) FILTER (WHERE o_orderstatus='F') f, CAST(min(o_orderdate) AS DATE) created, CAST(max(o_orderdate) AS DATE) latest FROM orders GROUP BY 1) ON o_custkey=c_custkey"""),
    "sg": ("co", """SELECT id, gid, name, CASE WHEN id%17=0 THEN 'failed' ELSE 'ok' END AS status, ord, signal, CASE ord WHEN 0 THEN CASE WHEN n_orders>=6 THEN 1.0 WHEN n_orders>=3 THEN 0.5 ELSE 0.0 END WHEN 1 THEN (urgent%5)/4.0 WHEN 2 THEN (filled%5)/4.0 ELSE (id%5)/4.0 END::DOUBLE AS value, (CASE ord WHEN 0 THEN CASE WHEN n_orders>=3 THEN 1 ELSE 0 END WHEN 1 THEN urgent%5 WHEN 2 THEN filled%5 ELSE id%5 END)>0 AS found, (id+ord)%3 AS n_evidence FROM co, (VALUES (0,'size_fit'),(1,'product_mix'),(2,'growth'),(3,'tech_maturity')) s(ord,signal)"""),
    "grades": ("co", "SELECT gid, 'growth' AS signal, ((id//4)%5)/4.0 AS grade FROM co WHERE id%4=0"),
    "heads": ("co", "SELECT gid, CAST(40+id%200 AS DOUBLE) AS headcount FROM co WHERE id%8=0"),
    "bands": ("", "SELECT * FROM (VALUES ('00',0,0),('01',1,2),('02',3,5),('03',6,9),('11',10,19),('12',20,49),('21',50,99),('22',100,199),('31',200,249)) b(code,lo,hi)"),
    "mk": ("co bands", "SELECT gid, id, name, region, nation, (lo+hi)/2.0::DOUBLE AS mid, bal, id%50=1 AS is_reference, (n_orders%10)/10.0::DOUBLE AS pre_score FROM co LEFT JOIN bands ON band=code"),
    "lg": ("", "SELECT event_id, 'g'||user_id AS lead, user_id||'|'||props AS key, event_type AS purpose, ts AS called, k AS input_tokens, k*3 AS cache_read, k%7 AS output_tokens, k%3 AS searches, value, CASE WHEN event_id%2=0 THEN 'api' ELSE 'cli' END AS backend FROM (SELECT *, CAST(json_extract_string(props,'$.k') AS BIGINT) AS k FROM events)"),
    "allkeys": ("co", "SELECT id, 'phone:'||CAST(floor(bal) AS BIGINT) AS key FROM co UNION ALL SELECT id, 'manager:'||nation||'|'||seg||'|'||CAST(floor(bal/50) AS BIGINT) FROM co"),
    "keys": ("allkeys", "SELECT id, key FROM allkeys WHERE key IN (SELECT key FROM allkeys GROUP BY key HAVING count(DISTINCT id) BETWEEN 2 AND 20)"),
    "links": ("keys", "SELECT DISTINCT a.id AS a, b.id AS b FROM keys a JOIN keys b USING (key)"),
    "reach": ("links", "SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b=links.a"),
    "comp": ("co reach", "SELECT co.id, coalesce(min(b), co.id) AS root FROM co LEFT JOIN reach ON a=id GROUP BY co.id"),
    "reg": ("", "SELECT l_orderkey AS siret, o_custkey AS siren, split_part(p_type,' ',1) AS domain, strftime(l_shipdate,'%Y-%m-%d') AS until, l_linenumber AS line, CASE WHEN l_suppkey%3=0 THEN '' ELSE 'p'||l_suppkey END AS phone, l_partkey FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN part ON l_partkey=p_partkey"),
    "curve": ("mk heads", "SELECT mk.*, coalesce(headcount, mid) AS hc, CASE WHEN headcount IS NOT NULL THEN 'regrade' WHEN mid IS NOT NULL THEN 'registry' END AS hc_source FROM mk LEFT JOIN heads USING (gid)"),
    "curved": ("curve", "SELECT *, CASE WHEN hc IS NOT NULL THEN round_even(0.6+(1-0.6)*CASE WHEN hc BETWEEN 60 AND 200 THEN 1.0 WHEN hc<60 THEN least(greatest((hc-30)/30.0,0.0),1.0) ELSE least(greatest((300-hc)/100.0,0.0),1.0) END,4) END AS curve FROM curve"),
    "vals": ("sg grades curved", "SELECT gid, sg.name, signal, ord, CASE WHEN signal='size_fit' AND value=1 AND curve IS NOT NULL THEN curve ELSE coalesce(grade, value) END AS v FROM sg LEFT JOIN grades USING (gid, signal) LEFT JOIN curved USING (gid) WHERE status='ok'"),
    "wide": ("vals", "SELECT gid, name, max(v) FILTER (WHERE ord=0) AS size_fit, max(v) FILTER (WHERE ord=1) AS product_mix, max(v) FILTER (WHERE ord=2) AS growth, max(v) FILTER (WHERE ord=3) AS tech_maturity FROM vals GROUP BY ALL"),
    "backed": ("sg", "SELECT gid, count(*) FILTER (WHERE found AND n_evidence>0) AS evidence_backed FROM sg WHERE status='ok' GROUP BY gid"),
    "scored": ("wide backed curved", "SELECT w.*, evidence_backed, hc, hc_source, is_reference, pre_score, region, score, CASE WHEN score>=8 THEN 'A' WHEN score>=6 THEN 'B' ELSE 'C' END AS tier FROM (SELECT *, round_even(1+9*(size_fit*3+product_mix*3+growth*2+tech_maturity*2)/10,2) AS score FROM wide) w JOIN backed USING (gid) JOIN curved USING (gid)"),
    "ranked": ("scored", "SELECT *, row_number() OVER (ORDER BY score DESC, evidence_backed DESC, name, gid) AS rank, CASE WHEN NOT is_reference THEN row_number() OVER (PARTITION BY is_reference ORDER BY score DESC, evidence_backed DESC, name, gid) END AS place FROM scored"),
}
