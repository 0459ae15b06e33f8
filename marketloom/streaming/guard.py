"""Guards of a run as a stream: what each run has spent and used is state, not a table that is read again."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..stage import new_path

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FIRST = -(1 << 63)  # a share without a time comes before any with one
STATE = "calls long, usd double, used map<string,struct<at:long,tie:long,share:double>>"
OUT = "run string, calls long, usd double, shares map<string,double>, stop string"


class Spending(StatefulProcessor):
    """Per run: calls and cost so far, and the last share of each window. Rows are calls that were not paid for before (usd) and shares (window)."""

    def __init__(self, budget: float, cap: float, caps: dict[str, float]):
        self.budget, self.cap, self.caps = budget, cap, caps

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("spending", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        calls, usd, used = 0, 0.0, {}
        if self.state.exists():
            calls, usd, before = self.state.get()
            used = {w: tuple(last) for w, last in before.items()}
        for _, cost, window, at, tie, share in rows:
            if cost is not None:
                calls, usd = calls + 1, usd + cost
            elif window not in used or used[window][:2] < (at, tie):
                used[window] = (at, tie, share)
        self.state.update((calls, usd, used))
        shares = {w: last[2] for w, last in used.items()}
        over = sorted(w for w, x in shares.items() if x >= self.caps.get(w, self.cap))
        stop = "budget" if usd >= self.budget else f"window {over[0]}" if over else None
        yield Row(run=key[0], calls=calls, usd=usd, shares=shares, stop=stop)

    def close(self) -> None:
        pass


def guard(lines: DataFrame, path: str, checkpoint: str, budget: float, cap: float = 0.9, caps: dict[str, float] | None = None) -> StreamingQuery:
    """A stream of ledger lines (run, key, at, tie, usd, replayed, window, share) to a table at `path`: for each batch, what the runs it touched have
    come to (run, calls, usd, shares by window, stop: the reason to end the run, or null). A key is paid for once, however late it comes
    again; the last share of a window is the one latest by (at, tie), in whatever order lines arrive. A stream that was ended goes on from its state.

    State is kept by RocksDB under the checkpoint: a run's keys and windows, never its lines. Keys are dealt over tasks and met in the JVM, each run's
    calls and shares then are in one task, whose worker asks for its state once a run and batch, however many lines it has."""
    spark, setting = lines.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    none = [F.lit(None).cast(t).alias(c) for c, t in (("window", "string"), ("at", "long"), ("tie", "long"), ("share", "double"))]
    paid = lines.select("run", "key", F.when(F.col("replayed"), 0.0).otherwise(F.coalesce("usd", F.lit(0.0))).alias("usd")).dropDuplicates(["run", "key"]).select("run", "usd", *none)
    shown = lines.where("window IS NOT NULL AND share IS NOT NULL AND NOT isnan(share)").select("run", F.lit(None).cast("double").alias("usd"), "window", F.coalesce(F.unix_micros("at"), F.lit(FIRST)).alias("at"), F.coalesce("tie", F.lit(FIRST)).alias("tie"), "share")
    seen = paid.unionAll(shown).groupBy("run").transformWithState(Spending(budget, cap, dict(caps or {})), OUT, "Update", "None")

    def add(batch: DataFrame, n: int) -> None:
        # a batch that is repeated after a failure replaces what it wrote
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    before = spark.conf.get(setting)
    spark.conf.set(setting, PROVIDER)  # the query keeps what is set when it starts
    try:
        return seen.writeStream.foreachBatch(add).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(setting, before)


def latest(table: DataFrame) -> DataFrame:
    """The last state of each run of a table that `guard` wrote."""
    cols = [c.split()[0] for c in OUT.split(", ")][1:]
    return table.groupBy("run").agg(F.max_by(F.struct(*cols), "batch").alias("s")).select("run", "s.*")


def watched(lines: DataFrame, budget: float, cap: float = 0.9, caps: dict[str, float] | None = None, files: int = 4) -> DataFrame:
    """The end of a run of the guard over stored lines, which are streamed in several batches: of `files` files at least, or as many as there are cores."""
    spark = lines.sparkSession
    files = max(files, spark.sparkContext.defaultParallelism)
    source, path, checkpoint = (new_path(spark, f"guard-{x}") for x in ("lines", "totals", "checkpoint"))
    lines.repartition(files).write.parquet(source)
    stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", max(1, files // 2)).parquet(source)
    guard(stream, path, checkpoint, budget, cap, caps).awaitTermination()
    return latest(spark.read.schema(f"{OUT}, batch int").parquet(path))
