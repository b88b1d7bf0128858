"""Places of rows in an order, without a task that sees all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: Rows of a range, about, where their number is known.
LOT = 500_000
#: monotonically_increasing_id: the partition above these bits, the row within it below.
_BITS = 33


def parts_of(rows: DataFrame, n: int) -> int:
    """Ranges for n rows: of ``LOT`` rows, but one for each core at least."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, n // LOT + 1)


def numbered(rows: DataFrame, order: list[str], name: str, keep: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """rows with ``name``: their place from 1 in that order. One shuffle sorts them by ranges (``parts`` of them, else as many as the session has partitions); a range is numbered where it is sorted and begins behind those before it. ``keep``: the columns that go on."""
    ranged = rows.repartitionByRange(*([parts] if parts else []), *order).sortWithinPartitions(*order)
    ranged = written(ranged.select(*(keep or rows.columns), F.monotonically_increasing_id().alias("_id")), "ranged")
    of_range = F.shiftright("_id", _BITS)
    counts = ranged.groupBy(of_range.alias("_range")).agg(F.count("*").alias("_rows"))
    # One row for each range.
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranged.withColumn("_range", of_range).join(F.broadcast(counts.select("_range", before.alias("_before"))), "_range")
    within = F.col("_id").bitwiseAND(F.lit((1 << _BITS) - 1))
    return placed.withColumn(name, (F.col("_before") + within + 1).cast("long")).drop("_range", "_before", "_id")
