"""A lead's last research run, step by step, from its recording and the ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Names of the tools that search and that fetch.
SEARCHES, FETCHES = ("WebSearch", "web_search"), ("WebFetch", "web_fetch")
BLOCK = "struct<type:string,id:string,name:string,input:struct<query:string,url:string,prompt:string,signals:string>,tool_use_id:string,content:string>"
RECORDING = f"transcript array<struct<type:string,message:struct<content:array<{BLOCK}>>>>, request struct<messages:array<struct<role:string,content:array<{BLOCK}>>>>, response struct<content:array<{BLOCK}>>"


def last_runs(ledger: DataFrame) -> DataFrame:
    """(lead, key, model, notional, tokens, usd): the last recorded research call of each lead, and what its run took: of a run by command line, that
    call alone; else every call of the lead on the same model, each recording once. ledger lines have `line`, their order."""
    lines = ledger.where("purpose = 'research'")
    last = lines.groupBy("lead").agg(F.max_by(F.struct("key", "model", "backend"), "line").alias("last"))
    first = Window.partitionBy("lead", "key").orderBy("line")
    final = lines.join(last, "lead").withColumn("final", F.max("line").over(Window.partitionBy("lead")))
    once = final.where((~F.col("last.backend").eqNullSafe(F.lit("cli")) & F.col("model").eqNullSafe(F.col("last.model"))) | (F.col("line") == F.col("final")))
    once = once.withColumn("n", F.row_number().over(first)).where("n = 1")
    tokens = sum((F.coalesce(c, F.lit(0)) for c in ("input_tokens", "cache_write_tokens", "cache_read_tokens", "output_tokens")), F.lit(0))
    cost = F.coalesce(F.when(F.col("last.backend").eqNullSafe(F.lit("cli")), F.col("notional_usd")).otherwise(F.col("usd")), F.lit(0.0))
    out = once.groupBy("lead", "last").agg(F.sum(tokens).cast("long").alias("tokens"), F.sum(cost).alias("usd"))
    return out.select("lead", "last.key", "last.model", (F.coalesce("last.backend", F.lit("")) == "cli").alias("notional"), "tokens", (F.rint(F.col("usd") * 1e4) / 1e4).alias("usd"))


def blocks(recordings: DataFrame) -> DataFrame:
    """(key, said, results): what the assistant said in a recording, and results by the id of the use that asked for them."""
    r = F.col("r")
    turns = F.when(r["transcript"].isNotNull(), F.flatten(F.transform(F.filter(r["transcript"], lambda m: m["type"] == "assistant"), lambda m: F.coalesce(m["message"]["content"], F.array().cast(f"array<{BLOCK}>")))))
    earlier = F.flatten(F.transform(F.filter(F.coalesce(r["request"]["messages"], F.array().cast(f"array<struct<role:string,content:array<{BLOCK}>>>")), lambda m: (m["role"] == "assistant") & m["content"].isNotNull()), lambda m: m["content"]))
    said = F.coalesce(turns, F.concat(earlier, F.coalesce(r["response"]["content"], F.array().cast(f"array<{BLOCK}>"))))
    all_ = F.when(r["transcript"].isNotNull(), F.flatten(F.transform(r["transcript"], lambda m: F.coalesce(m["message"]["content"], F.array().cast(f"array<{BLOCK}>"))))).otherwise(
        F.concat(F.flatten(F.transform(F.coalesce(r["request"]["messages"], F.array().cast(f"array<struct<role:string,content:array<{BLOCK}>>>")), lambda m: F.coalesce(m["content"], F.array().cast(f"array<{BLOCK}>")))), F.coalesce(r["response"]["content"], F.array().cast(f"array<{BLOCK}>")))
    )
    results = F.filter(all_, lambda b: b["type"].endswith("tool_result") & b["tool_use_id"].isNotNull())
    return recordings.select("key", said.alias("said"), results.alias("results"))


def steps(recordings: DataFrame) -> DataFrame:
    """(key, n, kind, text, aim, found) of recordings (key, r: RECORDING): searches, fetches and the final record in the order of the run."""
    parts = blocks(recordings).select("key", F.posexplode("said").alias("n", "b"), "results").where(F.col("b.type").isin("tool_use", "server_tool_use"))
    # the last result of a use stands
    answer = F.expr("try_element_at(filter(results, x -> x.tool_use_id = b.id), -1).content")
    kind = F.when(F.col("b.name").isin(*SEARCHES), "search").when(F.col("b.name").isin(*FETCHES), "fetch").when(F.col("b.input.signals").isNotNull(), "record")
    found = parts.withColumn("kind", kind).withColumn("answer", answer).where("kind IS NOT NULL")
    text = F.when(F.col("kind") == "search", F.col("b.input.query")).when(F.col("kind") == "fetch", F.col("b.input.url"))
    seen: Column = F.when(F.col("kind") == "search", T.search_summary(F.col("answer"))).when(F.col("kind") == "fetch", T.fetch_summary(F.col("answer")))
    aim = F.when(F.col("kind") == "fetch", T.aim(F.coalesce("b.input.prompt", F.lit(""))))
    blank = lambda c: F.coalesce(c, F.lit(""))
    return found.select("key", F.row_number().over(Window.partitionBy("key").orderBy("n")).alias("n"), "kind", blank(text).alias("text"), blank(aim).alias("aim"), blank(seen).alias("found"))


def replays(ledger: DataFrame, recordings: DataFrame) -> DataFrame:
    """One row for each lead whose last run is recorded: steps in order, searches, fetches, tokens, usd and whether that is an estimate."""
    listed = steps(recordings).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("n", "kind", "text", "aim", "found"))).alias("steps"), F.count_if(F.col("kind") == "search").alias("searches"), F.count_if(F.col("kind") == "fetch").alias("fetches"))
    return last_runs(ledger).join(recordings.select("key"), "key", "left_semi").join(listed, "key", "left").select("lead", "key", "steps", F.coalesce("searches", F.lit(0)).alias("searches"), F.coalesce("fetches", F.lit(0)).alias("fetches"), "tokens", "usd", "notional")
