"""The append-only cost ledger: the same totals in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def totals(lines: DataFrame) -> DataFrame:
    return lines.groupBy("lead").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("tokens"))


def batch_totals(lines: DataFrame) -> DataFrame:
    """A key's tokens are a part of it, so that any of its lines stands for it."""
    return totals(lines.groupBy("key", "lead").agg(F.min_by("input_tokens", "event_id").alias("input_tokens")))


def stream_totals(lines: DataFrame, path: str, checkpoint: str, delay: str = "1 day", at: str = "called") -> StreamingQuery:
    """Lines are taken once a key within `delay` of event time, which bounds the state, and summed by lead; each batch's sums go to a table at `path`,
    (batch, lead, calls, tokens). Its sums by lead are the totals."""
    once = lines.withWatermark(at, delay).dropDuplicatesWithinWatermark(["key"])

    def add(batch: DataFrame, n: int) -> None:
        # a batch that is repeated after a failure replaces what it wrote
        totals(batch).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return once.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Stopped(RuntimeError):
    """A guard has ended a run."""


def guarded(lines: DataFrame, path: str, checkpoint: str, budget: float, caps: dict[str, float], cap: float = 0.9) -> StreamingQuery:
    """Lines (usd, replayed, windows: share used by window) to a table at `path`, until what live calls cost reaches the budget or the last share of a
    window its cap: the batch in which that happens is written, and the query ends with `Stopped`."""

    def check(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")
        spent = batch.sparkSession.read.parquet(path).where("NOT replayed").agg(F.sum("usd")).first()[0] or 0.0
        if spent >= budget:
            raise Stopped(f"budget: {spent:.2f} of {budget:.2f}")
        used = batch.select("at", F.explode("windows").alias("window", "share")).groupBy("window").agg(F.max_by("share", "at").alias("share"))
        over = used.where(F.col("share") >= F.coalesce(F.create_map(*(F.lit(x) for kv in caps.items() for x in kv))[F.col("window")], F.lit(cap))).first()
        if over:
            raise Stopped(f"window {over['window']}: {over['share']:.0%} used")

    return lines.writeStream.foreachBatch(check).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def to_run(leads: DataFrame, recorded: DataFrame) -> DataFrame:
    """Leads without a recorded answer, in order of pre-score: a run that was stopped goes on with these."""
    return leads.join(recorded.select("gid").distinct(), "gid", "left_anti").orderBy(F.desc("pre_score"), "gid")


def research(leads: DataFrame, answer, schema: str) -> DataFrame:
    """A row for each lead by `answer`, a function of a lead's dictionary, called in parallel; an error fails its lead, not the run. schema: of gid and
    what the function returns; status and reason are added."""
    names = leads.columns

    def run(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for row in batch[names].to_dict("records"):
                try:
                    out.append({"gid": row["gid"], **answer(row), "status": "ok", "reason": None})
                except Exception as e:  # any error of a lead's call is that lead's result
                    out.append({"gid": row["gid"], "status": "failed", "reason": f"{type(e).__name__}: {e}"[:500]})
            yield pd.DataFrame(out, columns=columns)

    columns = [c.split()[0] for c in schema.split(",")] + ["status", "reason"]
    return leads.mapInPandas(run, f"{schema}, status string, reason string")
