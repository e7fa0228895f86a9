"""Begin and end records of ordered streams, matched by window expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def by_key(records: DataFrame, keys: list[str], order: str, is_begin: Column, payload: list[str], keep_open: bool = False) -> DataFrame:
    """Ends with ``begin``, the payload of the begin right before them under the same key.

    A later begin replaces an open one; an end without an open begin has no row,
    nor has a begin that never ends.  With ``keep_open`` such a begin stands for
    itself, with its payload as ``begin`` and NULL in the payload columns.
    """
    w = W.partitionBy(*keys).orderBy(order)
    own = F.struct(is_begin.alias("is_begin"), *payload)
    marked = records.withColumns({"_b": is_begin, "_own": own, "_before": F.lag(own).over(w), "_ends": ~F.coalesce(F.lead(is_begin).over(w), F.lit(True))})
    closed = ~F.col("_b") & F.col("_before.is_begin")
    opened = F.col("_b") & ~F.col("_ends")
    kept = marked.where(closed | opened if keep_open else closed).withColumn("begin", F.when(F.col("_b"), F.col("_own")).otherwise(F.col("_before")))
    return kept.withColumns({c: F.when(~F.col("_b"), F.col(c)) for c in payload}).drop("_b", "_own", "_before", "_ends")


def toggles(records: DataFrame, keys: list[str], order: str, payload: list[str]) -> DataFrame:
    """Odd occurrences of a key, with ``end``, the payload of the even one that closes it (NULL if none)."""
    w = W.partitionBy(*keys).orderBy(order)
    return records.withColumns({"_n": F.row_number().over(w), "end": F.lead(F.struct(*payload)).over(w)}).where(F.col("_n") % 2 == 1).drop("_n")


def brackets(records: DataFrame, keys: list[str], order: str, is_begin: Column, payload: list[str]) -> DataFrame:
    """Nested begins and ends: each begin with the ``end`` that closes it (NULL if none), and unmatched ends.

    The nesting level is the running sum of begins minus ends above its lowest
    point so far; an end that makes a new lowest point has no begin.  Within one
    level begins and ends alternate.  ``matched`` is false for an end without a
    begin.
    """
    w = W.partitionBy(*keys).orderBy(order)
    running = w.rowsBetween(W.unboundedPreceding, 0)
    marked = records.withColumn("_b", is_begin)
    marked = marked.withColumn("_s", F.sum(F.when(F.col("_b"), 1).otherwise(-1)).over(running))
    marked = marked.withColumn("_m", F.least(F.lit(0), F.min("_s").over(running)))
    marked = marked.withColumn("_lost", ~F.col("_b") & (F.col("_m") < F.coalesce(F.lag("_m").over(w), F.lit(0))))
    marked = marked.withColumn("_level", F.when(F.col("_lost"), F.lit(None)).otherwise(F.col("_s") - F.col("_m") + F.when(F.col("_b"), 0).otherwise(1)))
    level = W.partitionBy(*keys, "_level").orderBy(order)
    following = F.lead(F.struct((~F.col("_b")).alias("is_end"), *payload)).over(level)
    out = marked.withColumn("_next", following).withColumn("end", F.when(F.col("_b") & F.col("_next.is_end"), F.col("_next")))
    return out.where(F.col("_b") | F.col("_lost")).withColumn("matched", F.col("_b")).drop("_b", "_s", "_m", "_lost", "_level", "_next")


def last_seen(records: DataFrame, keys: list[str], order: str, is_begin: Column, value: Column, slice_bits: int = 20) -> DataFrame:
    """Ends with ``begin``, the value of the latest begin before them, used or not (NULL if none).

    The order, a whole number, is cut in slices of ``2 ** slice_bits``; the last
    begin of a slice is carried on by one row for each slice, so that no key is
    one task.
    """
    marked = records.withColumns({"_b": is_begin, "_v": F.when(is_begin, value), "_slice": F.shiftright(order, slice_bits)})
    own = F.last("_v", ignorenulls=True).over(W.partitionBy(*keys, "_slice").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    tails = marked.groupBy(*keys, "_slice").agg(F.max_by("_v", F.when(F.col("_b"), F.col(order))).alias("_tail"))
    carried = tails.withColumn("_carried", F.last("_tail", ignorenulls=True).over(W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1))).drop("_tail")
    ended = marked.withColumn("_own", own).where(~F.col("_b")).join(carried, [*keys, "_slice"])
    return ended.withColumn("begin", F.coalesce("_own", "_carried")).drop("_b", "_v", "_slice", "_own", "_carried")
