"""Irregular readings onto a regular grid.

Readings are first aggregated to cells, combined before the shuffle.  Each
source's cells come from its own first and last cell, in blocks, so that no
source makes one long sequence; the last observation is carried inside a block,
and between blocks through one summary row each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 4096


def to_cells(readings: DataFrame, sources: list[str], time: str, value: str | None, width_us: int) -> DataFrame:
    """One row per source and cell that has a reading: n, value (of the latest reading; on equal times the greatest)."""
    t = F.col(time).cast("bigint")
    keep = [F.col(c) for c in sources]
    rows = readings.select(*keep, t.alias("_t"), (F.lit(None) if value is None else F.col(value)).cast("double").alias("_v")).dropna(subset=[*sources, "_t"])
    latest = F.max(F.when(F.col("_v").isNotNull(), F.struct("_t", "_v")))["_v"]
    return rows.groupBy(*sources, ((F.col("_t") - F.pmod(F.col("_t"), F.lit(width_us))) / width_us).cast("bigint").alias("cell")).agg(F.count(F.lit(1)).alias("n"), latest.alias("value"))


def grid(cells: DataFrame, sources: list[str], block: int = BLOCK, near: int | None = None) -> DataFrame:
    """Every cell between a source's first and last; with ``near`` only blocks of cells up to so many blocks behind one that has a reading."""
    if near is not None:
        held = cells.withColumn("block", F.explode(F.sequence(F.floor(F.col("cell") / block), F.floor(F.col("cell") / block) + near))).select(*sources, "block").distinct()
    ends = cells.groupBy(*sources).agg(F.min("cell").alias("lo"), F.max("cell").alias("hi"))
    blocks = ends.select(*sources, "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor(F.col("hi") / block))).alias("block"))
    if near is not None:
        blocks = ends.join(held, sources).where((F.col("block") >= F.floor(F.col("lo") / block)) & (F.col("block") <= F.floor(F.col("hi") / block)))
    first = F.greatest("lo", F.col("block") * block)
    last = F.least("hi", F.col("block") * block + (block - 1))
    return blocks.repartition(*sources, "block").select(*sources, "block", F.explode(F.sequence(first, last)).alias("cell"))


def regular(
    readings: DataFrame, sources: list[str], time: str, value: str | None = None,
    *, width_us: int = 250_000, carry_cells: int = 4, block: int = BLOCK, near: int | None = None,
) -> DataFrame:
    """(sources, cell_start_us, n, value, status) on a grid of ``width_us``.

    status is 'observed' (n readings), 'carried' (no reading, but the last
    observed value lies at most ``carry_cells`` cells back and is repeated) or
    'missing' (value NULL).  Without ``value``, or where a cell's readings are
    all NULL, a cell is still observed by its n; nothing is carried from it.

    A reading of a far-off time, as a broken clock gives, makes every cell up to
    it.  With ``near``, cells more than that many blocks of ``block`` cells behind
    the last reading are left out, and missing there means that they have no row.
    By default nothing is left out.

    Rows with a NULL source or time are no readings; repeated rows count in n.
    Cells reach from a source's first to its last reading; an empty table gives
    no rows.
    """
    cells = to_cells(readings, sources, time, value, width_us)
    full = grid(cells, sources, block, near).join(cells, [*sources, "cell"], "left")
    here = W.partitionBy(*sources, "block").orderBy("cell").rowsBetween(W.unboundedPreceding, 0)
    known = F.when(F.col("value").isNotNull(), F.struct(F.col("cell").alias("at"), F.col("value").alias("v")))
    of_block = (
        cells.where(F.col("value").isNotNull()).groupBy(*sources, F.floor(F.col("cell") / block).alias("_b"))
        .agg(F.max(F.struct(F.col("cell").alias("at"), F.col("value").alias("v"))).alias("tail"))
    )
    # The block that a summary serves is the next one: older ones are beyond the reach of carry_cells unless it exceeds a block.
    reach = -(-carry_cells // block)
    served = of_block.withColumn("block", F.explode(F.sequence(F.col("_b") + 1, F.col("_b") + reach))).groupBy(*sources, "block").agg(F.max("tail").alias("tail")) if reach else None
    full = full.withColumn("last", F.last(known, ignorenulls=True).over(here))
    if served is not None:
        full = full.join(served, [*sources, "block"], "left").withColumn("last", F.coalesce("last", "tail"))
    near = F.col("n").isNull() & F.col("last").isNotNull() & (F.col("cell") - F.col("last.at") <= carry_cells)
    return full.select(
        *sources, (F.col("cell") * width_us).alias("cell_start_us"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
        F.when(F.col("n").isNotNull(), F.col("value")).when(near, F.col("last.v")).alias("value"),
        F.when(F.col("n").isNotNull(), F.lit("observed")).when(near, F.lit("carried")).otherwise(F.lit("missing")).alias("status"),
    )
