"""Cited URLs against those that tools retrieved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: The end of the kinds of blocks that hold what a server's tools gave; a bare one is the client's own.
RESULT, OWN = "_tool_result", "tool_result"
BLOCKS = "array<variant>"


def seen_urls(content: Column) -> Column:
    """Distinct URLs, normalised, in the tool-result blocks of a JSON array of blocks; those a model wrote itself are not seen. What is no JSON holds none."""
    blocks = F.coalesce(F.try_variant_get(F.try_parse_json(content), "$", BLOCKS), F.array().cast(BLOCKS))
    kind = lambda b: F.coalesce(F.try_variant_get(b, "$.type", "string"), F.lit(""))
    given = F.filter(blocks, lambda b: kind(b).endswith(RESULT) & (kind(b) != OWN))
    return F.array_distinct(F.flatten(F.transform(given, lambda b: F.transform(T.urls_in(F.to_json(b)), T.normalize_url))))


def unverified(cited: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Rows of cited (lead, url, ...) whose URL, normalised, is in no tool result of the lead. retrieved: (lead, content). A lead's results are matched
    by (lead, url), so that neither one lead's many pages nor one page's many leads meet in a task."""
    seen = retrieved.select("lead", F.explode(seen_urls(F.col("content"))).alias("_url")).distinct()
    return cited.withColumn("_url", T.normalize_url(F.col("url"))).join(seen, ["lead", "_url"], "left_anti").drop("_url")
