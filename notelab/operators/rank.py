"""Global ranks without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

_ROW_BITS = 33  # of monotonically_increasing_id: partition above, row below


def global_rank(df: DataFrame, order: Sequence, out: str = "rank") -> DataFrame:
    """Rows with their place 0..n-1 in the total order of ``order`` (columns; ties share no place).

    A range partition sorts the rows; the rows of each partition are numbered, and the totals of
    the partitions before are added (one row per partition).  The same at any partition count.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stage(ranged.withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", _ROW_BITS)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    row = F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (rows.withColumn("_part", part).join(starts, "_part")
            .withColumn(out, F.col("_start") + row).drop("_id", "_part", "_start"))
