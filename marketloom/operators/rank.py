"""Positions in an order over a whole table, without one task that has all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..stage import discard, handed_over, stored_bytes

#: Bytes of a stored table up to which it is sorted in one task; cost alone differs.
SMALL = 32 << 20
RANGE = 64 << 20
_AT = "_at"


def numbered(table: DataFrame, order: list[Column], counts: dict[str, Column | None], small: int = SMALL) -> DataFrame:
    """The table with, for each name in counts, how many rows up to and with this one fulfil its condition (None: all), in the order; null where the row
    itself does not.

    Rows are dealt by ranges of the whole order, written down once in it, and numbered within their range; what comes before a range is a sum over the
    ranges, of which there are as many as tasks. However many rows tie in the first columns, later ones part them: the order has to end in
    a column that tells rows apart, else rows equal in all of it share a range."""
    stored = handed_over(table, "ranked")
    size = stored_bytes(stored)
    if size <= small:
        along = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return stored.select("*", *(_shown(c, F.count("*").over(along) if c is None else F.count_if(c).over(along)).alias(n) for n, c in counts.items()))
    parts = max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE))
    ranges = handed_over(stored.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(_AT, F.monotonically_increasing_id()), "ranges")
    discard(stored)
    part = F.shiftright(_AT, 33)
    each = ranges.groupBy(part.alias("_part")).agg(*(F.count("*").alias(f"_{n}") if c is None else F.count_if(c).alias(f"_{n}") for n, c in counts.items()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = handed_over(each.select("_part", *(F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in counts)), "ahead")
    within = Window.partitionBy("_part").orderBy(_AT).rowsBetween(Window.unboundedPreceding, 0)
    own = {n: F.col(_AT).bitwiseAND((1 << 33) - 1) + 1 if c is None else F.count_if(c).over(within) for n, c in counts.items()}
    found = ranges.withColumn("_part", part).join(F.broadcast(ahead), "_part")  # a row a range
    return found.select(*table.columns, *(_shown(counts[n], F.col(f"_{n}") + own[n]).alias(n) for n in counts))


def _shown(condition: Column | None, number: Column) -> Column:
    return number.cast("int") if condition is None else F.when(condition, number.cast("int"))
