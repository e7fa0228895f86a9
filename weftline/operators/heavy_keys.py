"""Per-key results over keys of very uneven size.

Rows are laid out by ranges of (field, key, time, ties) whose bounds are sampled
quantiles of the whole key; a heavy key is split over several partitions and
light keys share one, also where its rows have one time or none.  A streaming pass leaves one partial state per key and
partition, and the partial states of a key are stitched where partitions meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.plans.ranges import key_runs, range_sorted, walk

_PART = pa.schema([(c, pa.int64()) for c in ("field", "key", "part", "n", "timed", "total", "least", "most", "first", "last", "widest")])
_DDL = "field bigint, key bigint, part bigint, n bigint, timed bigint, total bigint, least bigint, most bigint, first bigint, last bigint, widest bigint"
NONE = -(2**63)


class _State:
    """Partial result of one key over one stretch of its time order."""

    def __init__(self, field: int, key: int):
        self.field, self.key = field, key
        self.n = self.timed = self.total = 0
        self.least = self.most = self.first = self.last = self.widest = None

    def add(self, t: np.ndarray, d: np.ndarray) -> None:
        self.n += len(t)
        d = d[d != NONE]
        if len(d):
            self.timed += len(d)
            self.total += int(d.sum())
            low, high = int(d.min()), int(d.max())
            self.least = low if self.least is None else min(self.least, low)
            self.most = high if self.most is None else max(self.most, high)
        t = t[t != NONE]
        if len(t):
            steps = np.diff(t)
            wide = [int(steps.max())] if len(steps) else []
            if self.last is not None:
                wide.append(int(t[0]) - self.last)
            if wide:
                self.widest = max([*wide, *([] if self.widest is None else [self.widest])])
            self.first = int(t[0]) if self.first is None else self.first
            self.last = int(t[-1])

    def row(self, part: int) -> dict:
        return {"part": part, **self.__dict__}


def _fold(part: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state: _State | None = None
    for batch in batches:
        field, key, t, d = (batch.column(c).to_numpy() for c in ("field", "key", "t", "d"))
        done = []
        for a, b in key_runs([field, key]):
            if state is None or (state.field, state.key) != (field[a], key[a]):
                if state is not None:
                    done.append(state.row(part))
                state = _State(int(field[a]), int(key[a]))
            state.add(t[a:b], d[a:b])
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=_PART)
    if state is not None:
        yield pa.RecordBatch.from_pylist([state.row(part)], schema=_PART)


def key_stats(rows: DataFrame, fields: list[str], start: str, end: str, *, ties: list[str] | None = None, heavy_share: float = 0.05, partitions: int | None = None) -> DataFrame:
    """(field_name, key_value, n, timed, total_us, min_us, max_us, first_start_us, last_start_us, widest_step_us, heavy).

    For each integer column in ``fields`` and each of its values: rows as
    stored, rows with an end not before the start and their total, least and
    greatest duration, first and last start, and the widest step from one start
    to the next.  ``heavy`` marks values with at least ``heavy_share`` of all
    rows of the table, rows with a NULL value included in the total.

    ``ties`` are integer columns that tell rows of one start apart, so that a
    key whose rows have the same start, or none, can be split as well; rows that
    agree in all of them stay together.  They do not change the result.

    Rows with a NULL value belong to no key.  NULL starts and ends count as rows
    without a time.  Repeated rows count each time.  An empty table gives no
    rows; other columns are not read.
    """
    one = lambda i, c: F.struct(F.lit(i).cast("bigint").alias("field"), F.col(c).cast("bigint").alias("key"))
    t, e = F.col(start).cast("bigint"), F.col(end).cast("bigint")
    extra = {f"tie_{i}": F.col(c).cast("bigint") for i, c in enumerate(ties or [])}
    long = (
        rows.select(*[c.alias(n) for n, c in extra.items()], F.explode(F.array(*[one(i, c) for i, c in enumerate(fields)])).alias("k"), F.coalesce(t, F.lit(NONE)).alias("t"), F.coalesce(F.when(e >= t, e - t), F.lit(NONE)).alias("d"))
        .select("k.field", "k.key", "t", "d", *extra).where(F.col("key").isNotNull())
    )
    total = rows.count()
    parts = walk(range_sorted(long, ["field", "key"], ["t", *extra], partitions).select("field", "key", "t", "d"), _fold, _DDL)
    # A key has as many partial states as partitions hold it.
    edge = W.partitionBy("field", "key").orderBy("part")
    parts = parts.withColumn("step", F.col("first") - F.max("last").over(edge.rowsBetween(W.unboundedPreceding, -1)))
    merged = parts.groupBy("field", "key").agg(
        F.sum("n").alias("n"), F.sum("timed").alias("timed"), F.sum("total").alias("total_us"), F.min("least").alias("min_us"), F.max("most").alias("max_us"),
        F.min("first").alias("first_start_us"), F.max("last").alias("last_start_us"), F.greatest(F.max("widest"), F.max("step")).alias("widest_step_us"),
    )
    name = F.element_at(F.array(*[F.lit(f) for f in fields]), (F.col("field") + 1).cast("int"))
    return merged.select(
        name.alias("field_name"), F.col("key").alias("key_value"), "n", "timed", "total_us", "min_us", "max_us", "first_start_us", "last_start_us", "widest_step_us",
        (F.col("n") >= F.lit(heavy_share * total)).alias("heavy"),
    )
