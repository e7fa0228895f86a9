"""A trace as a set of lazily read tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.sources.schemas import OPTIONAL, REQUIRED, SCHEMAS


class Tables(dict):
    """Tables by name; one given as a function is read when it is first used."""

    def __getitem__(self, name: str) -> DataFrame:
        if callable(got := super().__getitem__(name)) and not isinstance(got, DataFrame):
            self[name] = got = got()
        return got

    def get(self, name: str, default: DataFrame | None = None) -> DataFrame | None:
        return self[name] if name in self else default


class TraceDataset:
    """Tables of one run.

    Required tables are checked when the dataset is opened; optional ones are
    None where the run has none.  Tables are read as stored: older runs with
    fewer or other columns open too.  ``extent`` is the only small query that
    runs on its own.
    """

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame | Callable[[], DataFrame]], *, legacy_time_range: bool = False, where: str = ""):
        if missing := [n for n in REQUIRED if n not in tables]:
            raise FileNotFoundError(f"missing tables in {where or 'the trace'}: {', '.join(missing)}")
        self.spark, self.tables, self.legacy, self.where = spark, Tables(tables), legacy_time_range, where

    @classmethod
    def open(cls, spark: SparkSession, folder: str, *, legacy_time_range: bool = False) -> TraceDataset:
        """Reads ``folder/<table>.parquet`` on any file system that Spark knows."""
        path = spark._jvm.org.apache.hadoop.fs.Path
        files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
        there = [n for n in SCHEMAS if files.exists(path(f"{folder}/{n}.parquet"))]
        if missing := [n for n in REQUIRED if n not in there]:
            raise FileNotFoundError(f"missing tables in {folder}: {', '.join(missing)}")
        return cls(spark, {n: lambda n=n: spark.read.parquet(f"{folder}/{n}.parquet") for n in there}, legacy_time_range=legacy_time_range, where=folder)

    def has_table(self, name: str) -> bool:
        return name in self.tables

    def __getattr__(self, name: str) -> DataFrame | None:
        if name in SCHEMAS:
            tables = self.__dict__.get("tables", {})
            if name in OPTIONAL:
                return tables.get(name)
            return tables[name]
        raise AttributeError(name)

    @cached_property
    def extent(self) -> dict[str, int]:
        row = self.tables["processing_element"].agg(
            F.min("aligned_begin_us").alias("t0"), F.max("end_time_us").alias("t1"), F.min("global_start_us").alias("global_start"), F.max("total_pes").alias("total_pes")
        ).first()
        return {k: row[k] or 0 for k in ("t0", "t1", "global_start", "total_pes")}

    @property
    def num_pes(self) -> int:
        return self.extent["total_pes"]

    @property
    def global_start_us(self) -> int:
        return self.extent["global_start"]

    @property
    def time_range_us(self) -> tuple[int, int]:
        """From the first begin to the last end, both aligned to the run's start.

        ``legacy_time_range`` subtracts the global start from the end once more,
        for results equal to those of tools that expect unaligned ends.
        """
        e = self.extent
        return e["t0"], e["t1"] - (e["global_start"] if self.legacy else 0)

    def window(self, window: tuple[int, int] | None) -> tuple[int, int]:
        return window or self.time_range_us

    def entry_spans(self, pes=None, window: tuple[int, int] | None = None) -> DataFrame:
        from weftline.operators.spans import entry_spans

        return entry_spans(self, pes, window)

    def idle_spans(self, pes=None, window: tuple[int, int] | None = None) -> DataFrame:
        from weftline.operators.spans import idle_spans

        return idle_spans(self, pes, window)

    def message_spans(self, pes=None, window: tuple[int, int] | None = None) -> DataFrame:
        from weftline.operators.spans import message_spans

        return message_spans(self, pes, window)

    @cached_property
    def ep_color_map(self) -> Palette:
        """Colours of the registered entry methods, a symbol table's worth of ids."""
        return palette([r.ep_id for r in self.tables["entry_method"].select("ep_id").distinct().toLocalIterator()])

    def __repr__(self) -> str:
        return f"TraceDataset({self.where!r}, pes={self.num_pes}, tables={sorted(self.tables)})"


# Colours of the first methods, and of what is no method.
COLOURS = [
    "#4e79a7", "#f28e2b", "#e15759", "#76b7b2", "#59a14f", "#edc948", "#b07aa1", "#ff9da7", "#9c755f", "#bab0ac",
    "#af7aa1", "#86bcb6", "#f1ce63", "#d37295", "#8cd17d", "#499894", "#b6992d", "#d4a6c8", "#a0cbe8", "#ffbe7d",
]
IDLE_COLOUR, OVERHEAD_COLOUR, OTHER_COLOUR = "#3a3a3a", "#6b6b6b", "#555555"


class Palette(dict):
    """Colours by method; one that is not known has the colour of others."""

    def __missing__(self, ep_id: int) -> str:
        return OTHER_COLOUR

    def get(self, ep_id: int, default: str | None = None) -> str:
        return self[ep_id] if ep_id in self else default or OTHER_COLOUR

    def to_list(self, ep_ids: list[int]) -> list[str]:
        return [self[ep] for ep in ep_ids]


def palette(ep_ids: list[int]) -> Palette:
    """A colour for each entry method by its id: the listed ones first, then even steps round the hue circle by the golden ratio."""
    import colorsys

    out = Palette()
    for i, ep in enumerate(sorted(set(ep_ids))):
        if i < len(COLOURS):
            out[ep] = COLOURS[i]
            continue
        r, g, b = colorsys.hls_to_rgb((i * 0.618033988749895) % 1.0, 0.55, 0.6)
        out[ep] = f"#{round(r * 255):02x}{round(g * 255):02x}{round(b * 255):02x}"
    return out
