"""Column expressions over intervals [start, end); a NULL end is still open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlaps(start: str, end: str, window: tuple[int, int]) -> Column:
    return (F.col(start) < F.lit(window[1])) & (F.col(end).isNull() | (F.col(end) > F.lit(window[0])))


def begins_in(start: str, window: tuple[int, int]) -> Column:
    return (F.col(start) >= F.lit(window[0])) & (F.col(start) < F.lit(window[1]))


def clip_start(start: str, window: tuple[int, int]) -> Column:
    return F.greatest(F.col(start), F.lit(window[0]).cast("bigint"))


def clip_end(end: str, window: tuple[int, int]) -> Column:
    return F.least(F.coalesce(F.col(end), F.lit(window[1]).cast("bigint")), F.lit(window[1]).cast("bigint"))


def clipped(start: str, end: str, window: tuple[int, int]) -> Column:
    """Length inside the window, at least 0."""
    return F.greatest(F.lit(0).cast("bigint"), clip_end(end, window) - clip_start(start, window))


def whole(value: Column) -> Column:
    """A sum that is 0, not NULL, where nothing was summed."""
    return F.coalesce(value, F.lit(0).cast("bigint"))


def wide(total: Column) -> Column:
    """A sum of whole numbers as decimal(38, 0), which unusable ends don't exceed; 0 where nothing was summed."""
    return F.coalesce(total, F.lit(0)).cast("decimal(38,0)")


def wide_sum(value: str) -> Column:
    return wide(F.sum(F.col(value).cast("decimal(38,0)")))


def imbalance(most: str, mean: str) -> Column:
    """How far the greatest load exceeds the mean, in percent; 0 without load."""
    return F.when(F.col(mean) > 0, (F.col(most) / F.col(mean) - 1) * 100).otherwise(F.lit(0.0))
