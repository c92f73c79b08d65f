"""Places in a global order, and sums over all rows before, without one task that sees every row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trigrove.plans.shared import written

_PART_BITS = 33  # of monotonically_increasing_id: rows of a partition are counted in the lower 33 bits


def numbered(df: DataFrame, order: Sequence[Column], place: str = "place") -> DataFrame:
    """``df`` with the number of rows before each in ``order``, from 0.

    Rows are dealt over range partitions and sorted there, written, and numbered from what each partition holds; only one
    count a partition passes through a single task. The last of ``order`` should tell equal rows apart where many can be equal.
    """
    n_parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n_parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    rows = written(dealt, "order")
    part = F.shiftright("_at", _PART_BITS)
    counts = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    within = F.col("_at").bitwiseAND(F.lit((1 << _PART_BITS) - 1))
    # One row a partition: never more than the session's number of partitions.
    return rows.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(place, F.col("_start") + within).drop("_part", "_start", "_at")
