"""Range layout: composite key and secondary order, heavy keys split.

``repartitionByRange`` samples quantiles of the whole sort key (key columns and
order columns together), so a key with any share of the rows is spread over as
many partitions as its share needs, and each partition holds a contiguous
stretch of the global order.  A streaming function then walks each partition
once; only what lies at the partitions' edges has to be put together again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from weftline.plans.shape import shuffle_partitions


def range_sorted(df: DataFrame, keys: list[str], order: list[str], partitions: int | None = None) -> DataFrame:
    """``df`` in contiguous, sorted stretches of (keys, order)."""
    n = partitions or shuffle_partitions(df.sparkSession)
    return df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order)


def key_runs(columns: list[np.ndarray]) -> list[tuple[int, int]]:
    """Start and end of each run of equal keys in sorted key columns."""
    n = len(columns[0])
    if not n:
        return []
    change = np.zeros(n - 1, dtype=bool)
    for c in columns:
        change |= c[1:] != c[:-1]
    edges = [0, *(np.flatnonzero(change) + 1).tolist(), n]
    return list(zip(edges[:-1], edges[1:], strict=True))


def walk(df: DataFrame, step: Callable[[int, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Runs ``step(partition number, batches)`` over each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from step(TaskContext.get().partitionId(), batches)

    return df.mapInArrow(run, schema)
