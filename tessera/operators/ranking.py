"""Numbers in an order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..store import release, stored


def numbered(rows: DataFrame, *order: str, name: str = "id") -> DataFrame:
    """Adds 1, 2, ... in an order without ties: rows are sorted by range, and each range starts
    where those before it end, so no task sees more than its range.

    Written to the shared folder, because the ranges are read twice and must not be drawn anew
    between, nor when an executor is lost."""
    bits = 33  # of a place within its partition, see monotonically_increasing_id
    # The input too: bounds are drawn from it, and then its rows are dealt out by them.
    given = stored(rows, "numbered-input")
    placed = given.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", bits))
    placed = stored(placed, "numbered")
    release(given)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each partition.
    starts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    out = placed.join(F.broadcast(starts), "__part")
    return out.withColumn(name, F.col("__before") + F.col("__at").bitwiseAND((1 << bits) - 1) + 1).drop("__at", "__part", "__before")


def numbered_within(rows: DataFrame, key: str, *order: str, name: str = "place") -> DataFrame:
    """Adds 1, 2, ... within each key (not null) in an order without ties.  A key of very many rows
    is spread over ranges like all others."""
    ids = numbered(rows, key, *order, name="__id")
    firsts = ids.groupBy(key).agg(F.min("__id").alias("__first"))
    return ids.join(firsts, key).withColumn(name, F.col("__id") - F.col("__first") + 1).drop("__id", "__first")
