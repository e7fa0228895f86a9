"""Continuous periods and gaps of overlapping intervals.

``session_window`` with each row's own length as its timeout merges what
overlaps.  It runs per (entity, slice of time), so no entity's rows meet in one
task, however many they are.  What reaches from one slice into later ones is
carried by a summary of one row per slice: the greatest end so far.  Touching
periods, which leave no time between them, are joined afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.plans.shape import cut

SLICE_US = 10_000_000


def usable(rows: DataFrame, entity: str, start: str, end: str, latest: int | None = None) -> DataFrame:
    """(entity, s, e) of intervals with a positive length that end in time."""
    got = rows.select(F.col(entity).alias("entity"), F.col(start).cast("bigint").alias("s"), F.col(end).cast("bigint").alias("e"))
    got = got.where(F.col("entity").isNotNull() & (F.col("e") > F.col("s")))
    return got if latest is None else got.where(F.col("e") <= F.lit(latest))


def _sessions(spans: DataFrame, slice_us: int) -> DataFrame:
    """Merged periods that begin in a slice: (entity, slice, s, e), and ``reach``, the greatest end of all slices before."""
    length = F.make_interval(secs=((F.col("e") - F.col("s")).cast("decimal(18,0)") / F.lit(1_000_000).cast("decimal(18,0)")).cast("decimal(18,6)"))
    merged = (
        spans.withColumn("slice", F.floor(F.col("s") / slice_us))
        .groupBy("entity", "slice", F.session_window(F.timestamp_micros("s"), length).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("entity", "slice", F.unix_micros("w.start").alias("s"), F.unix_micros("w.end").alias("e"), "n")
    )
    merged = cut(merged)
    before = W.partitionBy("entity").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    reach = merged.groupBy("entity", "slice").agg(F.max("e").alias("top")).select("entity", "slice", F.max("top").over(before).alias("reach"))
    return merged.join(reach, ["entity", "slice"])


def _edges(spans: DataFrame, slice_us: int) -> DataFrame:
    """Merged periods with ``covered``, the greatest end of all that begin earlier."""
    within = W.partitionBy("entity", "slice").orderBy("s")
    return _sessions(spans, slice_us).withColumn("covered", F.greatest(F.lag("e").over(within), F.col("reach")))


def gaps(rows: DataFrame, entity: str, start: str, end: str, *, latest: int | None = None, slice_us: int = SLICE_US) -> DataFrame:
    """(entity, gap_start_us, gap_end_us): stretches no interval covers.

    Gaps lie between the first start and the last end of an entity and have
    their full length, at least 1 us.  Rows are left out whose entity, start or
    end is NULL, whose end is at or before the start, or is later than
    ``latest``.  Repeated rows and ties change nothing.  An entity with one
    covered period has no gap; an empty table gives no rows.
    """
    edges = _edges(usable(rows, entity, start, end, latest), slice_us)
    return edges.where(F.col("s") > F.col("covered")).select(F.col("entity").alias(entity), F.col("covered").alias("gap_start_us"), F.col("s").alias("gap_end_us"))


def periods(rows: DataFrame, entity: str, start: str, end: str, *, latest: int | None = None, slice_us: int = SLICE_US) -> DataFrame:
    """(entity, period_start_us, period_end_us, intervals): continuous covered periods.

    Same rows as :func:`gaps`.  ``intervals`` counts the rows that begin in the
    period, repeated ones too.
    """
    edges = cut(_edges(usable(rows, entity, start, end, latest), slice_us))
    opens = F.col("covered").isNull() | (F.col("s") > F.col("covered"))
    inner = W.partitionBy("entity", "slice").orderBy("s")
    local = edges.withColumn("part", F.sum(opens.cast("int")).over(inner)).groupBy("entity", "slice", "part").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.sum("n").alias("n"))
    # part 0 continues the period that an earlier slice left open.
    whole = W.partitionBy("entity").orderBy("slice")
    of_slice = local.groupBy("entity", "slice").agg(
        F.max("part").alias("parts"), F.max(F.when(F.col("part") == 0, F.col("e"))).alias("e0"), F.max(F.when(F.col("part") == 0, F.col("n"))).alias("n0")
    ).withColumn("before", F.coalesce(F.sum("parts").over(whole.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    numbered = local.join(of_slice.select("entity", "slice", "before"), ["entity", "slice"]).withColumn("part", F.col("before") + F.col("part"))
    return (
        numbered.groupBy("entity", "part").agg(F.min("s").alias("period_start_us"), F.max("e").alias("period_end_us"), F.sum("n").alias("intervals"))
        .select(F.col("entity").alias(entity), "period_start_us", "period_end_us", "intervals")
    )
