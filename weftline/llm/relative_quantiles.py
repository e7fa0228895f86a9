"""Percentiles of very large numeric columns by relative-rank compactors.

A sketch is a stack of compactors; an item at level h stands for 2**h values.
A full compactor is sorted and the part that holds the *lowest* items is halved
(every other item moves up a level), while the part with the greatest items is
kept.  The share that is compacted follows a deterministic schedule, so that
sections near the protected end are touched exponentially less often.  The
rank error is then relative to the number of values *above*: at the 99.9th
percentile it is a small share of the last 0.1 %, whatever the size.

Sketches merge level by level, in any order; those of partitions, of stretches
of time or of days give the sketch of all together.

Stated bound: the standard error of the rank of a value v is at most
``0.1306 / k * (n - rank(v))``; ``rank_error`` is three times that, as a share
of n, and 0 where nothing was compacted (the percentiles are then exact).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.plans.ranges import key_runs, walk
from weftline.plans.shape import shuffle_partitions, tasks_of

SECTION = 50  # k: items of a compactor's section
SECTIONS = 3  # sections that a compactor begins with
#: Error of one standard deviation for k = 1.
FACTOR = 0.1306


class Compactor:
    """One level: a buffer and the state of its schedule."""

    __slots__ = ("buffer", "held", "k", "sections", "size", "state")

    def __init__(self, k: int, sections: int = SECTIONS, state: int = 0, size: float | None = None):
        self.k, self.sections, self.state = k, sections, state
        self.size = float(k) if size is None else size
        self.buffer: list[np.ndarray] = []
        self.held = 0

    @property
    def capacity(self) -> int:
        return 2 * self.sections * int(round(self.size / 2) * 2)

    def add(self, items: np.ndarray) -> None:
        if len(items):
            self.buffer.append(items)
            self.held += len(items)

    def items(self) -> np.ndarray:
        if len(self.buffer) != 1:
            self.buffer = [np.concatenate(self.buffer)] if self.buffer else [np.empty(0, np.int64)]
        return self.buffer[0]

    def compact(self, coin: int) -> np.ndarray:
        """Halves the lowest items; returns those that move up."""
        items = np.sort(self.items())
        section = int(round(self.size / 2) * 2)
        ones = 0
        while (self.state >> ones) & 1:
            ones += 1
        keep = max(0, self.sections - ones - 1) * section + self.sections * section  # the greater half is always kept
        low = max(0, len(items) - keep)
        low -= low % 2
        moved = items[coin:low:2]
        self.buffer, self.held = [items[low:]], len(items) - low
        self.state += 1
        # More sections, each smaller, once the schedule has run through them.
        if self.state >= 1 << (self.sections - 1) and self.size / 2**0.5 >= 4:
            self.size /= 2**0.5
            self.sections *= 2
        return moved


class RelativeSketch:
    """Mergeable quantile sketch of integers with small error at high ranks."""

    def __init__(self, k: int = SECTION, seed: int = 0):
        self.k, self.n, self.coin = k, 0, seed & 0xFFFFFFFF
        self.levels = [Compactor(k)]

    def _flip(self) -> int:
        self.coin = (1664525 * self.coin + 1013904223) & 0xFFFFFFFF
        return self.coin >> 31

    def update(self, values: np.ndarray) -> None:
        self.n += len(values)
        self.levels[0].add(values)
        self._settle()

    def merge(self, other: RelativeSketch) -> None:
        while len(self.levels) < len(other.levels):
            self.levels.append(Compactor(self.k))
        for mine, theirs in zip(self.levels, other.levels, strict=False):
            mine.add(theirs.items())
            mine.state |= theirs.state
            if theirs.sections > mine.sections:
                mine.sections, mine.size = theirs.sections, theirs.size
        self.n += other.n
        self._settle()

    def _settle(self) -> None:
        h = 0
        while h < len(self.levels):
            level = self.levels[h]
            while level.held >= level.capacity:
                before = level.held
                moved = level.compact(self._flip())
                if h + 1 == len(self.levels):
                    self.levels.append(Compactor(self.k))
                self.levels[h + 1].add(moved)
                if level.held == before:
                    break
            h += 1

    def quantiles(self, ranks: list[float]) -> list[int]:
        """Values v with about rank * n values at or below v (the least such)."""
        values = np.concatenate([level.items() for level in self.levels])
        weights = np.concatenate([np.full(level.held, 1 << h, np.int64) for h, level in enumerate(self.levels)])
        order = np.argsort(values, kind="stable")
        total = np.cumsum(weights[order])
        at = [min(int(np.searchsorted(total, max(1, int(np.ceil(r * self.n - 1e-9))))), len(values) - 1) for r in ranks]
        return [int(values[order[i]]) for i in at]

    def error(self, rank: float) -> float:
        """Three standard errors of a rank, as a share of n."""
        return 0.0 if len(self.levels) == 1 else min(1.0, 3 * FACTOR / self.k * (1 - rank))

    def row(self) -> dict:
        return {
            "n": self.n, "items": np.concatenate([level.items() for level in self.levels]), "held": [level.held for level in self.levels],
            "states": [level.state for level in self.levels], "sections": [level.sections for level in self.levels], "sizes": [level.size for level in self.levels],
        }

    @classmethod
    def of(cls, k: int, n: int, items: np.ndarray, held: list[int], states: list[int], sections: list[int], sizes: list[float], seed: int = 0) -> RelativeSketch:
        sketch = cls(k, seed)
        sketch.n, sketch.levels, at = n, [], 0
        for h, state, count, size in zip(held, states, sections, sizes, strict=True):
            level = Compactor(k, count, state, size)
            level.add(items[at : at + h])
            sketch.levels.append(level)
            at += h
        return sketch


_FIELDS = [("n", pa.int64()), ("items", pa.list_(pa.int64())), ("held", pa.list_(pa.int64())), ("states", pa.list_(pa.int64())), ("sections", pa.list_(pa.int64())), ("sizes", pa.list_(pa.float64()))]
_FIELDS_DDL = "n bigint, items array<bigint>, held array<bigint>, states array<bigint>, sections array<bigint>, sizes array<double>"
#: Values that a task holds before it hands its sketches on.
HELD = 4_000_000


def _table(keys: list[str], rows: list[tuple[tuple, RelativeSketch]]) -> pa.RecordBatch:
    schema = pa.schema([*[(k, pa.int64()) for k in keys], *_FIELDS])
    return pa.RecordBatch.from_pylist([dict(zip(keys, key, strict=True)) | s.row() for key, s in rows], schema=schema)


def _build(keys: list[str], k: int):
    def step(partition: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketches: dict[tuple, RelativeSketch] = {}
        taken = 0

        def handed() -> Iterator[pa.RecordBatch]:
            rows = list(sketches.items())
            for i in range(0, len(rows), 2000):
                yield _table(keys, rows[i : i + 2000])

        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in (*keys, "v")]
            order = np.lexsort(columns[:-1][::-1])
            columns = [c[order] for c in columns]
            for a, b in key_runs(columns[:-1]):
                key = tuple(int(c[a]) for c in columns[:-1])
                if key not in sketches:
                    sketches[key] = RelativeSketch(k, hash((partition, *key)))
                sketches[key].update(columns[-1][a:b])
            taken += batch.num_rows
            if taken > HELD and sum(level.held for s in sketches.values() for level in s.levels) > HELD:
                yield from handed()
                sketches.clear()
                taken = 0
        yield from handed()

    return step


def _combine(keys: list[str], k: int):
    """Merges runs of equal keys in sorted partitions of sketches."""

    def step(partition: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        sketch: RelativeSketch | None = None
        done: list = []
        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in keys]
            n, lists = batch.column("n").to_pylist(), batch.column("items")
            offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            small = [batch.column(c).to_pylist() for c in ("held", "states", "sections", "sizes")]
            for i in range(batch.num_rows):
                key = tuple(int(c[i]) for c in columns)
                one = RelativeSketch.of(k, n[i], flat[offsets[i] : offsets[i + 1]], *(s[i] for s in small), seed=hash(key))
                if key == now:
                    sketch.merge(one)
                else:
                    if sketch is not None:
                        done.append((now, sketch))
                    now, sketch = key, one
            if len(done) >= 500:
                yield _table(keys, done)
                done = []
        if sketch is not None:
            done.append((now, sketch))
        if done:
            yield _table(keys, done)

    return step


#: Sketches of one key that a task merges.
FAN_IN = 64


def _levels(sketches: int) -> list[int]:
    """Groups of each level of a tree that merges so many sketches of one key, FAN_IN at a time."""
    levels = []
    while (sketches := -(-sketches // FAN_IN)) > 1:
        levels.append(sketches)
    return levels


def merge_sketches(sketches: DataFrame, keys: list[str], *, k: int = SECTION, salts: int | list[int] = 0) -> DataFrame:
    """One sketch per key.  With ``salts``, a key's sketches are first merged in that many groups, level by level."""
    ddl = ", ".join(f"{c} bigint" for c in keys) + ", " + _FIELDS_DDL
    plain = [*keys, "n", "items", "held", "states", "sections", "sizes"]
    n = shuffle_partitions(sketches.sparkSession)
    for groups in [salts] if isinstance(salts, int) else salts:
        if groups < 2:
            continue
        salted = sketches.withColumn("_salt", F.pmod(F.xxhash64("items", "n"), F.lit(groups)))
        laid = salted.repartition(n, *keys, "_salt").sortWithinPartitions(*keys, "_salt").select("_salt", *plain)
        sketches = walk(laid, _combine([*keys, "_salt"], k), "" + ", ".join(f"{c} bigint" for c in [*keys, "_salt"]) + ", " + _FIELDS_DDL)
    laid = sketches.select(*plain).repartition(n, *keys).sortWithinPartitions(*keys)
    return walk(laid, _combine(keys, k), ddl)


def sketch_by(rows: DataFrame, keys: list[str], value: str, *, k: int = SECTION) -> DataFrame:
    """A sketch of ``value`` per key, built in each scan task and merged in a tree.

    What is shuffled of a key is a sketch per task, of bounded size, however
    many rows it has.  Keys and values are integers; rows with a NULL in either
    are left out, repeated rows count each time, an empty table gives no rows.
    """
    got = rows.select(*[F.col(c).cast("bigint").alias(c) for c in keys], F.col(value).cast("bigint").alias("v")).dropna()
    ddl = ", ".join(f"{c} bigint" for c in keys) + ", " + _FIELDS_DDL
    tasks = tasks_of(got) or shuffle_partitions(rows.sparkSession)
    return merge_sketches(walk(got, _build(keys, k), ddl), keys, k=k, salts=_levels(tasks))


def _read(keys: list[str], ranks: list[float], k: int):
    names = [f"p{str(round(r * 100, 4)).rstrip('0').rstrip('.').replace('.', '_')}" for r in ranks]
    schema = pa.schema([*[(c, pa.int64()) for c in keys], ("n", pa.int64()), *[(c, pa.int64()) for c in names], *[(f"{c}_rank_error", pa.float64()) for c in names], ("greatest", pa.int64())])
    ddl = ", ".join(f"{f.name} {'double' if f.type == pa.float64() else 'bigint'}" for f in schema)

    def step(_: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                items = np.asarray(row["items"], np.int64)
                s = RelativeSketch.of(k, row["n"], items, row["held"], row["states"], row["sections"], row["sizes"])
                out.append({c: row[c] for c in keys} | {"n": s.n, "greatest": int(items.max())} | dict(zip(names, s.quantiles(ranks), strict=True)) | {f"{c}_rank_error": s.error(r) for c, r in zip(names, ranks, strict=True)})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return step, ddl


def quantiles(sketches: DataFrame, keys: list[str], ranks: list[float] | None = None, *, k: int = SECTION) -> DataFrame:
    """(keys, n, p50, p90, p99, p99_9, one rank error each, greatest) read from sketches.

    A percentile is a value of the column: the least whose share of values at
    or below it reaches the rank, up to ``rank_error`` of n.  The greatest value
    is exact.
    """
    step, ddl = _read(keys, ranks or [0.5, 0.9, 0.99, 0.999], k)
    return walk(sketches, step, ddl)
