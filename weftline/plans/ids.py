"""Consecutive numbers over a table of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.plans.ranges import range_sorted
from weftline.plans.shape import cut


def numbered(df: DataFrame, order: list[str], name: str, first: int = 1) -> DataFrame:
    """``df`` with ``name`` = first, first + 1, ... in the given order.

    Rows are sorted by ranges; each partition numbers its own rows and adds the
    rows of the partitions before it.  No task sees more than its range.
    """
    # Cut before as well: sampling the ranges would compute ``df`` a second time.
    laid = cut(range_sorted(cut(df), order, [])).withColumn("_mono", F.monotonically_increasing_id())
    laid = laid.withColumns({"_part": F.shiftright("_mono", 33), "_pos": F.col("_mono").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = laid.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))  # a row per partition
    return laid.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_pos") + F.lit(first)).drop("_mono", "_part", "_pos", "_before")
