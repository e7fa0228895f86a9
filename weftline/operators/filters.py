"""Row filters by processing element and time."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.spans import begins_in, overlaps


def distinct_pes(pes: Iterable[int] | None) -> list[int] | None:
    """The PEs, each once, read once from whatever gives them; None is all."""
    return None if pes is None else sorted({int(p) for p in pes})


def by_pe(df: DataFrame, pes: Iterable[int] | None, column: str = "pe_id") -> DataFrame:
    """Rows of the given PEs; None keeps all, an empty list none."""
    return df if pes is None else df.where(F.col(column).isin(distinct_pes(pes)))


def by_time(df: DataFrame, window: tuple[int, int] | None, start: str = "start_time_us", end: str | None = "end_time_us") -> DataFrame:
    """Intervals that overlap the window, or without ``end`` points that lie in [t0, t1)."""
    if window is None:
        return df
    return df.where(begins_in(start, window) if end is None else overlaps(start, end, window))


def by_sample_time(df: DataFrame, window: tuple[int, int] | None, time: str = "time_us") -> DataFrame:
    """Samples in the closed range [t0, t1]."""
    return df if window is None else df.where(F.col(time).between(*window))


def select_rows(df: DataFrame, pes: Iterable[int] | None = None, window: tuple[int, int] | None = None, pe: str = "pe_id", start: str = "start_time_us", end: str | None = "end_time_us") -> DataFrame:
    return by_time(by_pe(df, pes, pe), window, start, end)
