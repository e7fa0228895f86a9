"""Profiles, histograms and rankings: the data behind the charts."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.spans import clip_end, clip_start, clipped, whole, wide_sum
from weftline.operators.filters import by_pe, by_sample_time, distinct_pes, select_rows
from weftline.operators.metrics import chare_activity_matrix, chare_duration_totals, chare_frequency_counts, chare_loads, per_pe_utilization, percent_imbalance_by_bin
from weftline.operators.spans import Pes, Window, bin_spans, clipped_spans, entry_spans, first_bin, idle_spans, last_bin
from weftline.plans.shape import narrowed
from weftline.sources.dataset import TraceDataset

OTHER, IDLE = "Other", "Idle"
UNITS = {"b": 1, "kib": 1024, "mib": 1024**2, "gib": 1024**3}
REDUCERS = {"mean": F.avg, "max": F.max, "min": F.min}


def _ranked(totals: DataFrame, by: str, *ties: str) -> DataFrame:
    """Totals numbered from 1, greatest first.  ``totals`` is an aggregate over names, not over rows."""
    order = W.orderBy(F.desc(by), *[F.asc_nulls_first(t) for t in ties])
    return totals.withColumn("_rank", F.row_number().over(order))


def _fold_others(each: DataFrame, keys: list[str], top_n: int) -> DataFrame:
    """Per keys and entry method, with all but the ``top_n`` largest methods summed as OTHER."""
    totals = each.groupBy("ep_id", "ep_name").agg(F.sum("total_us").alias("grand"))
    best = _ranked(totals, "grand", "ep_id", "ep_name").where(F.col("_rank") <= top_n).select("ep_id", F.col("ep_name").alias("_name"))
    # A method registered under two names is one by its id.  At most top_n rows are broadcast.
    best = best.groupBy("ep_id").agg(F.min("_name").alias("_name"), F.lit(True).alias("_top"))
    folded = each.join(F.broadcast(best), "ep_id", "left").withColumns({"_id": F.when(F.col("_top"), F.col("ep_id")), "_label": F.when(F.col("_top"), F.col("_name")).otherwise(OTHER)})
    return folded.groupBy(*keys, F.col("_id").alias("ep_id"), F.col("_label").alias("label")).agg(F.sum("total_us").alias("total_us"))


def _valued(rows: DataFrame, as_percentage: bool, total: Column) -> DataFrame:
    value = F.try_divide(F.col("total_us") * 100.0, total) if as_percentage else F.col("total_us") / 1000.0
    return rows.withColumn("value", value)


def time_profile(ds: TraceDataset, width_us: int = 1_000_000, pes: Pes = None, window: Window = None, *, as_percentage: bool = False, top_n: int = 15, show_idle: bool = True) -> DataFrame:
    """(bin_start, ep_id, label, total_us, value) in ms, or percent of all PEs' time in the bin."""
    w, pes = ds.window(window), distinct_pes(pes)
    each = bin_spans(entry_spans(ds, pes, w), width_us, w).groupBy("bin_start", "ep_id", "ep_name").agg(whole(F.sum("bin_contribution_us")).alias("total_us"))
    rows = _fold_others(each, ["bin_start"], top_n)
    if show_idle:
        idle = bin_spans(idle_spans(ds, pes, w), width_us, w).groupBy("bin_start").agg(whole(F.sum("bin_contribution_us")).alias("total_us"))
        rows = rows.unionByName(idle.select("bin_start", F.lit(None).cast("int").alias("ep_id"), F.lit(IDLE).alias("label"), "total_us"))
    n = ds.num_pes if pes is None else len(pes)
    return _valued(rows, as_percentage, F.lit(float(n * width_us)))


def usage_profile(ds: TraceDataset, pes: Pes = None, window: Window = None, *, top_n: int = 15, show_idle: bool = True, as_percentage: bool = False) -> DataFrame:
    """(pe_id, ep_id, label, total_us, value) in ms, or percent of the PE's accounted time; PEs that executed something."""
    w, pes = ds.window(window), distinct_pes(pes)
    each = clipped_spans(ds, pes, w).groupBy("pe_id", "ep_id", "ep_name").agg(whole(F.sum("clipped_us")).alias("total_us"))
    rows = _fold_others(each, ["pe_id"], top_n)
    if show_idle:
        idle = idle_spans(ds, pes, w).groupBy("pe_id").agg(whole(F.sum(clipped("start_time_us", "end_time_us", w))).alias("total_us"))
        idle = idle.join(each.select("pe_id").distinct(), "pe_id", "left_semi")
        rows = rows.unionByName(idle.select("pe_id", F.lit(None).cast("int").alias("ep_id"), F.lit(IDLE).alias("label"), "total_us"))
    of_pe = F.sum("total_us").over(W.partitionBy("pe_id"))
    return _valued(rows, as_percentage, F.when(of_pe == 0, 1).otherwise(of_pe))


def ep_profile(ds: TraceDataset, pes: Pes = None, window: Window = None, *, top_n: int = 12, threshold_pct: float = 1.0) -> DataFrame:
    """(ep_id, label, total_us, pct): methods with at least ``threshold_pct`` of all wall time, the rest as OTHER.

    total_us is bigint, or decimal(38, 0) where unusable ends take a sum beyond that.
    """
    totals = entry_spans(ds, pes, window or ds.time_range_us).groupBy("ep_id", "ep_name").agg(wide_sum("wall_duration_us").alias("total_us"))
    ranked = _ranked(totals, "total_us", "ep_id", "ep_name").withColumn("_all", F.sum("total_us").over(W.partitionBy()))
    shown = (F.col("total_us") >= F.col("_all") * threshold_pct / 100) & (F.col("_rank") <= top_n)
    folded = ranked.select(F.when(shown, F.col("_rank")).alias("_k"), F.when(shown, F.col("ep_id")).alias("ep_id"), F.when(shown, F.col("ep_name")).otherwise(OTHER).alias("label"), "total_us", "_all")
    out = folded.groupBy("_k", "ep_id", "label").agg(F.sum("total_us").alias("total_us"), F.first("_all").alias("_all"))
    out = out.where(F.col("_k").isNotNull() | (F.col("total_us") > 0)).select("ep_id", "label", "total_us", F.try_divide(F.col("total_us") * 100.0, F.col("_all")).alias("pct"))
    return narrowed(out, "total_us")


def histogram(values: DataFrame, column: str, bins: int, log: bool = False) -> DataFrame:
    """(bin, low, high, count): equal bins from the least to the greatest value, the last one closed.

    With ``log`` the ``bins`` values are edges, evenly spaced in the logarithm
    (so there is a bin less), and values at or below 0 are left out.  Bins
    without values have count 0; no values at all give no rows.
    """
    kept = values.select(F.col(column).cast("double").alias("v")).where(F.col("v").isNotNull())
    if log:
        kept = kept.where(F.col("v") > 0).withColumn("v", F.log10("v"))
    low, high = kept.agg(F.min("v"), F.max("v")).first()
    if low is None:
        return values.sparkSession.createDataFrame([], "bin int, low double, high double, count bigint")
    n = bins - 1 if log else bins
    if low == high and not log:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / n
    slot = F.least(F.floor((F.col("v") - low) / width), F.lit(n - 1)) if width else F.lit(n - 1)
    counted = kept.groupBy(slot.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    edge = lambda k: 10 ** (low + k * width) if log else low + k * width
    frame = values.sparkSession.createDataFrame([(k, float(edge(k)), float(edge(k + 1))) for k in range(n)], "bin int, low double, high double")
    return frame.join(counted, "bin", "left").select("bin", "low", "high", whole(F.col("c")).alias("count"))


def execution_time_histogram(ds: TraceDataset, pes: Pes = None, window: Window = None, *, ep_ids: list[int] | None = None, bins: int = 50, log: bool = False, accumulated: bool = False) -> DataFrame:
    """Histogram of wall durations in ms; ``accumulated`` adds count times bin centre."""
    spans = entry_spans(ds, pes, window or ds.time_range_us)
    if ep_ids is not None:
        spans = spans.where(F.col("ep_id").isin(ep_ids))
    out = histogram(spans.select((F.col("wall_duration_us") / 1000.0).alias("ms")), "ms", bins, log)
    return out.withColumn("accumulated_ms", F.col("count") * (F.col("low") + F.col("high")) / 2) if accumulated else out


def message_size_histogram(ds: TraceDataset, pes: Pes = None, window: Window = None, *, bins: int = 50, log: bool = True) -> DataFrame:
    rows = select_rows(ds.message, pes, window or ds.time_range_us, "src_pe", "send_time_us", None)
    return histogram(rows, "msg_len", bins, log)


def comm_per_pe(ds: TraceDataset, metric: str = "sent_msgs", pes: Pes = None, window: Window = None) -> DataFrame:
    """(pe_id, value): messages or bytes that each PE sent, or received outside broadcasts."""
    if metric not in ("sent_msgs", "sent_bytes", "recv_msgs", "recv_bytes"):
        raise ValueError(f"unknown metric {metric}")
    pe, time = ("src_pe", "send_time_us") if metric.startswith("sent") else ("dst_pe", "exec_start_time_us")
    rows = select_rows(ds.message, pes, ds.window(window), pe, time, None).where(F.col(pe).isNotNull())
    value = F.count(F.lit(1)) if metric.endswith("msgs") else whole(F.sum("msg_len"))
    return rows.groupBy(F.col(pe).alias("pe_id")).agg(value.cast("bigint").alias("value"))


#: Measure of each extrema attribute.
EXTREMA = {"most_idle_time": "idle_fraction", "least_idle_time": "utilization", "overhead": "overhead_us", "active_entry_methods": "n_eps", "avg_grain_size": "avg_dur"}


def extrema_analysis(ds: TraceDataset, attribute: str = "most_idle_time", k: int = 10, pes: Pes = None, window: Window = None) -> DataFrame:
    """(pe_id, value, rank, extreme): PEs by a measure, greatest first; ties by PE."""
    if attribute not in EXTREMA:
        raise ValueError(f"unknown attribute {attribute}")
    column, w = EXTREMA[attribute], ds.window(window)
    if attribute == "active_entry_methods":
        rows = entry_spans(ds, pes, w).groupBy("pe_id").agg(F.countDistinct("ep_id").alias(column))
    elif attribute == "avg_grain_size":
        rows = entry_spans(ds, pes, w).groupBy("pe_id").agg(F.avg("wall_duration_us").alias(column))
    else:
        rows = per_pe_utilization(ds, pes, w)
    ranked = _ranked(rows.select("pe_id", F.col(column).cast("double").alias("value")), "value", "pe_id")
    return ranked.select("pe_id", "value", F.col("_rank").alias("rank"), (F.col("_rank") <= k).alias("extreme"))


def _samples(ds: TraceDataset, name: str, pes: Pes, window: Window) -> DataFrame:
    if not ds.has_table(name):
        raise ValueError(f"this trace has no table {name}")
    return by_sample_time(by_pe(ds.tables[name], pes), window)


def memory_usage(ds: TraceDataset, pes: Pes = None, window: Window = None, *, unit: str = "mib", aggregate: bool = False) -> DataFrame:
    """Memory samples per PE, or per instant the least, mean and greatest over PEs."""
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {sorted(UNITS)}")
    rows = _samples(ds, "memory_sample", pes, window).select("pe_id", "time_us", (F.col("bytes") / F.lit(float(UNITS[unit]))).alias("value"))
    if not aggregate:
        return rows
    return rows.groupBy("time_us").agg(F.min("value").alias("least"), F.avg("value").alias("mean"), F.max("value").alias("most"))


def _stats(ds: TraceDataset, pes: Pes, window: Window, stats: list[int] | None, aggregation: str) -> DataFrame:
    if aggregation not in REDUCERS:
        raise ValueError(f"aggregation must be one of {sorted(REDUCERS)}")
    rows = _samples(ds, "user_stat", pes, window)
    return rows if stats is None else rows.where(F.col("stat_id").isin(stats))


def user_stats_over_time(ds: TraceDataset, pes: Pes = None, window: Window = None, *, stats: list[int] | None = None, aggregation: str = "mean", use_user_time: bool = False) -> DataFrame:
    """(stat_id, name, x, value) over PEs; x is the trace's or the application's time."""
    rows, x = _stats(ds, pes, window, stats, aggregation), "user_time_s" if use_user_time else "time_us"
    return rows.where(F.col(x).isNotNull()).groupBy("stat_id", "name", F.col(x).alias("x")).agg(REDUCERS[aggregation]("stat_value").alias("value"))


def user_stats_per_pe(ds: TraceDataset, pes: Pes = None, window: Window = None, *, stats: list[int] | None = None, aggregation: str = "mean") -> DataFrame:
    return _stats(ds, pes, window, stats, aggregation).groupBy("stat_id", "name", "pe_id").agg(REDUCERS[aggregation]("stat_value").alias("value"))


def run_comparison(runs: Mapping[str, TraceDataset], pes: Pes = None, window: Window = None, *, metric: str = "duration", top_n: int | None = 12) -> DataFrame:
    """(run, chare_name, value, rank): totals of each run for the collections with the longest time over all runs."""
    pes = distinct_pes(pes)
    durations = reduce(DataFrame.unionByName, [chare_duration_totals(ds, pes, window).withColumn("run", F.lit(n)) for n, ds in runs.items()])
    order = _ranked(durations.groupBy("chare_name").agg(F.sum("total_duration_us").alias("t")), "t", "chare_name").select("chare_name", F.col("_rank").alias("rank"))
    if top_n is not None:
        order = order.where(F.col("rank") <= top_n)
    if metric == "duration":
        values = durations.select("run", "chare_name", F.col("total_duration_us").alias("v"))
    else:
        values = reduce(DataFrame.unionByName, [chare_frequency_counts(ds, pes, window).select(F.lit(n).alias("run"), "chare_name", F.col("execution_count").alias("v")) for n, ds in runs.items()])
    frame = order.withColumn("run", F.explode(F.array(*[F.lit(n) for n in runs])))
    same = F.col("f.chare_name").eqNullSafe(F.col("v.chare_name")) & (F.col("f.run") == F.col("v.run"))
    return frame.alias("f").join(values.alias("v"), same, "left").select("f.run", "f.chare_name", whole(F.col("v.v")).alias("value"), "f.rank")


def activity_heatmap(ds: TraceDataset, metric: str = "duration", pes: Pes = None, window: Window = None) -> DataFrame:
    """(pe_id, chare_name, activity, position): the dense matrix in long form, collections by total."""
    each = chare_activity_matrix(ds, pes, window, metric)
    order = _ranked(each.groupBy("chare_name").agg(F.sum("activity").alias("t")), "t", "chare_name").select("chare_name", F.col("_rank").alias("position"))
    # A scaffold of PEs times collections, the result's own size: each collection has a row for every PE of the symbol table's few.
    listed = [r.pe_id for r in each.select("pe_id").distinct().orderBy("pe_id").toLocalIterator()]
    frame = order.select(F.explode(F.lit(listed) if listed else F.array().cast("array<int>")).alias("pe_id"), "chare_name", "position")
    same = (F.col("f.pe_id") == F.col("e.pe_id")) & F.col("f.chare_name").eqNullSafe(F.col("e.chare_name"))
    return frame.alias("f").join(each.alias("e"), same, "left").select("f.pe_id", "f.chare_name", whole(F.col("e.activity")).alias("activity"), "f.position")


def timeline_with_imbalance(ds: TraceDataset, width_us: int = 100_000, pes: Pes = None, window: Window = None, *, chares: list[str] | None = None, top_n: int | None = None) -> DataFrame:
    """(pe_id, bin_start, chare_name, load_us, percent_imbalance, max_load_us): the busiest collection of each cell on one grid with the imbalance of its bin."""
    pes = distinct_pes(pes)
    busiest = dominant_chare(ds, width_us, pes, window, chares=chares, top_n=top_n)
    return busiest.join(percent_imbalance_by_bin(ds, width_us, pes, window).select("bin_start", "percent_imbalance", "max_load_us"), "bin_start").select(
        "pe_id", "bin_start", "chare_name", "load_us", "percent_imbalance", "max_load_us"
    )


def dominant_chare(ds: TraceDataset, width_us: int = 100_000, pes: Pes = None, window: Window = None, *, chares: list[str] | None = None, top_n: int | None = None) -> DataFrame:
    """(pe_id, bin_start, chare_name, load_us): the visible collection with the most load in each cell; ties by name."""
    if top_n is not None and top_n <= 0:
        raise ValueError("top_n must be positive")
    pes, w = distinct_pes(pes), ds.window(window)
    spans = entry_spans(ds, pes, w).where(F.col("chare_name").isNotNull())
    if chares is not None:
        spans = spans.where(F.col("chare_name").isin(chares[:top_n]))
    elif top_n is not None:
        # A collection's bins add up to the lengths of its spans, so they are ranked without bins.
        start, length = clip_start("start_time_us", w), clip_end("end_time_us", w) - clip_start("start_time_us", w)
        binned = spans.where(first_bin(start, width_us, w) <= last_bin(start + length, width_us, w))
        best = _ranked(binned.groupBy("chare_name").agg(F.sum(length).alias("t")), "t", "chare_name").where(F.col("_rank") <= top_n)
        spans = spans.join(F.broadcast(best.select("chare_name")), "chare_name", "left_semi")  # top_n rows
    loads = chare_loads(spans, width_us, w)
    # min of a pair without a window: combined before the shuffle.
    best = F.min(F.struct((-F.col("load_us")).alias("less"), "chare_name"))
    return loads.groupBy("pe_id", "bin_start").agg(best.alias("b")).select("pe_id", "bin_start", "b.chare_name", (-F.col("b.less")).alias("load_us"))

