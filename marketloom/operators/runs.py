"""Statistics of a run: what it cost a lead, and what came of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import rounded


def run_stats(calls: DataFrame, signals: DataFrame) -> DataFrame:
    """A row a run. calls: (run, lead, key, model, usd, prompt_tokens, output_tokens, searches), of which a key counts once, and only those of leads that
    signals has; signals: (run, lead, signal, value, found, flags: a number, status of the lead). Runs without calls have no cost."""
    leads = signals.select("run", "lead").distinct()
    once = calls.dropDuplicates(["run", "key"]).join(leads, ["run", "lead"], "left_semi")
    per = once.groupBy("run").agg(
        F.countDistinct("lead").alias("paid"), F.array_join(F.array_sort(F.collect_set("model")), ", ").alias("model"), F.sum("usd").alias("usd"), F.sum("prompt_tokens").alias("prompt"), F.sum("output_tokens").alias("output"), F.sum("searches").alias("searches")
    )
    about = signals.groupBy("run").agg(
        F.countDistinct("lead").alias("leads"), F.countDistinct(F.when(F.col("status") == "failed", F.col("lead"))).alias("failed"), F.countDistinct(F.when(F.col("flags") > 0, F.col("lead"))).alias("flagged"),
        rounded(F.avg(F.col("found").cast("double")), 4).alias("found"), rounded(F.avg("value"), 4).alias("mean_value"),
    )
    share = lambda c, n: rounded(F.try_divide(F.col(c).cast("double"), F.col("paid")), n).alias(f"{c}_per_lead")
    return about.join(per, "run", "left").select("run", "leads", F.coalesce("model", F.lit("?")).alias("model"), share("usd", 3), share("prompt", 2), share("output", 2), share("searches", 2), "failed", "flagged", "found", "mean_value")
