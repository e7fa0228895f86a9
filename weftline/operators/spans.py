"""Spans of a run with their names, and their division into time bins."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.spans import clip_end, clip_start, clipped
from weftline.operators.filters import select_rows
from weftline.sources.dataset import TraceDataset

Pes = Iterable[int] | None
Window = tuple[int, int] | None


def entry_spans(ds: TraceDataset, pes: Pes = None, window: Window = None) -> DataFrame:
    """Executions that overlap the window, with entry method and collection names.

    An ep_id that is registered twice repeats its executions, one that is not
    registered has NULL names.  The planner knows the size of the two name
    tables and broadcasts them while they are small.
    """
    methods = ds.entry_method.select("ep_id", F.col("name").alias("ep_name"), "collection_id")
    collections = ds.chare_collection.select("collection_id", F.col("name").alias("chare_name"))
    return select_rows(ds.execution, pes, window).join(methods, "ep_id", "left").join(collections, "collection_id", "left")


def idle_spans(ds: TraceDataset, pes: Pes = None, window: Window = None) -> DataFrame:
    return select_rows(ds.idle_interval, pes, window)


def message_spans(ds: TraceDataset, pes: Pes = None, window: Window = None) -> DataFrame:
    """Messages sent by the PEs in the window, with the target's name."""
    targets = ds.entry_method.select("ep_id", F.col("name").alias("target_ep_name"))
    return select_rows(ds.message, pes, window, "src_pe", "send_time_us", None).join(targets, "ep_id", "left")


def message_latency(ds: TraceDataset, pes: Pes = None, window: Window = None) -> DataFrame:
    """Messages with their three latencies, computed; NULL where a time is unknown."""
    return message_spans(ds, pes, window).withColumns({
        "send_to_enqueue_us": F.col("enqueue_time_us") - F.col("send_time_us"),
        "enqueue_to_exec_us": F.col("exec_start_time_us") - F.col("enqueue_time_us"),
        "end_to_end_us": F.col("exec_start_time_us") - F.col("send_time_us"),
    })


def clipped_spans(ds: TraceDataset, pes: Pes = None, window: Window = None) -> DataFrame:
    w = ds.window(window)
    return entry_spans(ds, pes, w).withColumn("clipped_us", clipped("start_time_us", "end_time_us", w))


def first_bin(start: Column, width_us: int, window: tuple[int, int]) -> Column:
    return F.floor((start - F.lit(window[0]).cast("bigint")) / F.lit(width_us).cast("bigint"))


def last_bin(end: Column, width_us: int, window: tuple[int, int]) -> Column:
    return F.floor(F.greatest(end - F.lit(window[0]).cast("bigint") - 1, F.lit(0)) / F.lit(width_us).cast("bigint"))


def _ranged(spans: DataFrame, width_us: int, window: tuple[int, int], start: str, end: str) -> DataFrame:
    """Spans that touch a bin, with their clipped ends _s, _e and the bins _first to _last."""
    clip = spans.withColumns({"_s": clip_start(start, window), "_e": clip_end(end, window)})
    # sequence() would count down from _first to a smaller _last.
    return clip.withColumns({"_first": first_bin(F.col("_s"), width_us, window), "_last": last_bin(F.col("_e"), width_us, window)}).where(F.col("_first") <= F.col("_last"))


def bin_spans(spans: DataFrame, width_us: int, window: tuple[int, int], start: str = "start_time_us", end: str = "end_time_us") -> DataFrame:
    """A row per span and time bin it touches: bin_start, bin_contribution_us.

    A span inside one bin contributes its clipped length (below 0 where its end
    lies before its start); a longer one what each bin holds of it.  A span
    without length that lies on a bin's bound has no row.
    """
    if width_us <= 0:
        raise ValueError("width_us must be positive")
    t0 = F.lit(window[0]).cast("bigint")
    width = F.lit(width_us).cast("bigint")
    each = _ranged(spans, width_us, window, start, end).withColumn("_bin", F.explode(F.sequence("_first", "_last"))).withColumn("bin_start", F.col("_bin") * width + t0)
    inside = F.least(F.col("_e"), F.col("bin_start") + width) - F.greatest(F.col("_s"), F.col("bin_start"))
    share = F.when(F.col("_first") == F.col("_last"), F.col("_e") - F.col("_s")).otherwise(F.greatest(F.lit(0), inside))
    return each.withColumn("bin_contribution_us", share).drop("_s", "_e", "_first", "_last", "_bin")


def bin_loads(spans: DataFrame, width_us: int, window: tuple[int, int], keys: list[str], start: str = "start_time_us", end: str = "end_time_us") -> DataFrame:
    """(keys, bin_start, load_us): the sums of :func:`bin_spans`, without a row per span and bin.

    A span has a row for its first and last bin each, and one for each end of
    the stretch between, which it fills; how many spans fill a bin is a running
    sum over these.  So a span open to the end of a long run has four rows, and
    the rest is the size of the result.
    """
    if width_us <= 0:
        raise ValueError("width_us must be positive")
    width = F.lit(width_us).cast("bigint")
    ranged = _ranged(spans, width_us, window, start, end)
    bound = lambda k: F.lit(window[0]).cast("bigint") + k * width
    first, last, one = F.col("_first"), F.col("_last"), F.lit(1).cast("bigint")
    row = lambda b, load, turn: F.struct(b.alias("_bin"), load.alias("_load"), turn.alias("_turn"))
    none = F.lit(0).cast("bigint")
    whole_span = F.array(row(first, F.col("_e") - F.col("_s"), none))
    edges = F.array(row(first, bound(first + 1) - F.col("_s"), none), row(last, F.col("_e") - bound(last), none))
    between = F.array(row(first + 1, none, one), row(last, none, -one))
    parts = F.when(first == last, whole_span).when(first + 1 == last, edges).otherwise(F.concat(edges, between))
    summed = ranged.select(*keys, F.explode(parts).alias("_p")).groupBy(*keys, "_p._bin").agg(F.sum("_p._load").alias("_load"), F.sum("_p._turn").alias("_turn"))
    of_keys = W.partitionBy(*keys).orderBy("_bin")
    filled = summed.withColumns({"_full": F.sum("_turn").over(of_keys.rowsBetween(W.unboundedPreceding, 0)), "_next": F.lead("_bin").over(of_keys)})
    # Each bin with rows is touched by a span; the filled ones up to the next such bin follow it.
    upto = F.when(F.col("_full") > 0, F.col("_next") - 1).otherwise(F.col("_bin"))
    each = filled.withColumn("_b", F.explode(F.sequence("_bin", upto)))
    own = F.when(F.col("_b") == F.col("_bin"), F.col("_load")).otherwise(none)
    return each.select(*keys, bound(F.col("_b")).alias("bin_start"), (own + F.col("_full") * width).alias("load_us"))


def bin_starts(spark, width_us: int, window: tuple[int, int]) -> DataFrame:
    t0, t1 = window
    n = max(1, -(-(t1 - t0) // width_us))
    return spark.range(n).select((F.col("id") * width_us + t0).alias("bin_start"))


def pe_values(ds: TraceDataset, pes: Pes = None) -> DataFrame:
    """The PEs asked for, each once; by default those of the run, as registered."""
    if pes is None:
        return ds.processing_element.select("pe_id")
    return ds.spark.createDataFrame([(int(p),) for p in sorted(set(pes))], "pe_id int")
