"""Web responses and recorded answers kept by key, as tables: keys, and what is stored for them."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The fields of a model request that make its answer.
ANSWER_FIELDS = ("model", "system", "messages", "tools", "tool_choice", "output_config", "thinking", "max_tokens")


def request_key(url: str, params: dict | None = None) -> str:
    """SHA-1 of url and parameters, whatever the parameters' order."""
    return hashlib.sha1(f"{url}?{json.dumps(params or {}, sort_keys=True, ensure_ascii=False)}".encode()).hexdigest()


def answer_key(request: dict) -> str:
    """SHA-256 of the canonical JSON of the fields that make an answer; how it is sent doesn't count."""
    held = {k: v for k, v in request.items() if k in ANSWER_FIELDS}
    return hashlib.sha256(json.dumps(held, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def request_key_column(url: Column, texts: dict[str, Column], numbers: dict[str, Column]) -> Column:
    """`request_key` over rows, of text and whole-number parameters."""
    shown = {k: quoted(v) for k, v in texts.items()} | {k: v.cast("string") for k, v in numbers.items()}
    return F.sha1(F.concat(url, F.lit("?{"), F.concat_ws(", ", *(F.concat(F.lit(f'"{k}": '), v) for k, v in sorted(shown.items(), key=lambda kv: kv[0]))), F.lit("}")))


def quoted(text: Column) -> Column:
    """A JSON string with characters beyond ASCII as they are."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("x"))), r'(?s)^\{"x":(".*")\}$', 1)


def replayed(wanted: DataFrame, stored: DataFrame, mode: str = "normal") -> DataFrame:
    """Rows of `wanted` (key, ...) with the stored response of their key, which is null where there is none; in mode `offline` a row without one
    is an error. Stored ones have a row a key."""
    found = wanted.join(stored.select("key", "response"), "key", "left")
    if mode != "offline":
        return found
    missing = F.raise_error(F.concat(F.lit("not stored: "), "key"))
    return found.withColumn("response", F.when(F.col("response").isNull(), missing.cast("string")).otherwise(F.col("response")))


def stored_table(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """(key, response) of the files of a folder, by Spark's readers, so that a cluster reads them in parallel. response: struct of `schema`."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json").select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1).alias("key"), "value")
    return files.select(F.expr("try_url_decode(key)").alias("key"), F.from_json("value", schema).alias("response"))
