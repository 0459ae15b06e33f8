"""A funnel whose stages are counted by the job that runs through them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class Funnel:
    """Counts rows where they pass: `stage` marks a place of the plan; the job that reads what comes out in the end counts all of them. Rows are
    counted by accumulators of finished tasks: a stage of the job that is run again after executors were lost may be counted twice."""

    def __init__(self):
        self.stages: list[tuple[str, Observation]] = []

    def stage(self, table: DataFrame, name: str, where: Column | None = None) -> DataFrame:
        """where: only such rows are counted; all go on."""
        seen = Observation()
        self.stages.append((name, seen))
        return table.observe(seen, (F.count(F.lit(1)) if where is None else F.count_if(where)).alias("n"))

    def counts(self) -> list[tuple[int, str, int]]:
        """(ord, stage, n); the job has to have run."""
        return [(i, name, seen.get["n"]) for i, (name, seen) in enumerate(self.stages)]
