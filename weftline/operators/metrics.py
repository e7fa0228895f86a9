"""Load, utilisation and imbalance.

Results come sorted; the planner drops the sort where a result is aggregated or
joined further.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.spans import clipped, imbalance, whole, wide, wide_sum
from weftline.operators.filters import distinct_pes
from weftline.operators.spans import Pes, Window, bin_loads, bin_spans, clipped_spans, entry_spans, idle_spans, pe_values
from weftline.plans.shape import narrowed
from weftline.sources.dataset import TraceDataset


def chare_duration_totals(ds: TraceDataset, pes: Pes = None, window: Window = None) -> DataFrame:
    return clipped_spans(ds, pes, window).groupBy("chare_name").agg(whole(F.sum("clipped_us")).alias("total_duration_us")).orderBy(F.desc("total_duration_us"), "chare_name")


def chare_frequency_counts(ds: TraceDataset, pes: Pes = None, window: Window = None) -> DataFrame:
    return entry_spans(ds, pes, window).groupBy("chare_name").agg(F.count(F.lit(1)).alias("execution_count")).orderBy(F.desc("execution_count"), "chare_name")


def chare_activity_matrix(ds: TraceDataset, pes: Pes = None, window: Window = None, metric: str = "duration") -> DataFrame:
    """Activity of each collection on each PE: clipped duration or executions."""
    if metric not in ("duration", "frequency"):
        raise ValueError("metric must be 'duration' or 'frequency'")
    value = whole(F.sum("clipped_us")) if metric == "duration" else F.count(F.lit(1))
    return clipped_spans(ds, pes, window).groupBy("pe_id", "chare_name").agg(value.alias("activity")).orderBy("pe_id", "chare_name")


def pe_load_by_bin(ds: TraceDataset, width_us: int, pes: Pes = None, window: Window = None) -> DataFrame:
    """Busy time of every PE in every bin, 0 where it has none."""
    w, pes = ds.window(window), distinct_pes(pes)
    loads = bin_spans(entry_spans(ds, pes, w), width_us, w).groupBy("pe_id", "bin_start").agg(F.sum("bin_contribution_us").alias("load_us"))
    # Scaffold: PEs times bins, the size of the result itself.
    n = max(1, -(-(w[1] - w[0]) // width_us))
    bins = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    frame = pe_values(ds, pes).select("pe_id", bins.alias("b")).select("pe_id", (F.col("b") * width_us + w[0]).alias("bin_start"))
    return frame.join(loads, ["pe_id", "bin_start"], "left").select("pe_id", "bin_start", whole(F.col("load_us")).alias("load_us")).orderBy("pe_id", "bin_start")


def percent_imbalance_by_bin(ds: TraceDataset, width_us: int, pes: Pes = None, window: Window = None) -> DataFrame:
    loads = pe_load_by_bin(ds, width_us, pes, window).groupBy("bin_start").agg(F.max("load_us").alias("max_load_us"), F.avg("load_us").alias("mean_load_us"))
    return loads.withColumn("percent_imbalance", imbalance("max_load_us", "mean_load_us")).orderBy("bin_start")


def cumulative_imbalance(ds: TraceDataset, pes: Pes = None, window: Window = None, *, points: int = 100, time_points_us: list[float] | None = None, nodes: int = 4) -> DataFrame:
    """Imbalance over nodes of everything begun before each time point.

    A span is put in the bucket of the first point behind its start; a running
    sum over the points then gives each point's load, so that spans and points
    are never paired.  A node counts from its first span on.  max_load_us is bigint,
    or decimal(38, 0) where unusable ends take a node's sum beyond that.
    """
    if nodes <= 0:
        raise ValueError("nodes must be positive")
    if points < 2 and time_points_us is None:
        raise ValueError("points must be at least 2")
    spans = entry_spans(ds, pes, window).select("pe_id", "start_time_us", "wall_duration_us")
    if time_points_us is None:
        low, high = spans.agg(F.min("start_time_us"), F.max("start_time_us")).first()
        if low is None:
            time_points_us = []
        elif low == high:
            time_points_us = [float(high)]
        else:
            time_points_us = [low + i * ((high - low) / (points - 1)) for i in range(1, points)]
    at = [float(p) for p in time_points_us]
    order = sorted(range(len(at)), key=lambda i: at[i])
    listed = ds.spark.createDataFrame([(k, at[i]) for k, i in enumerate(order)], "k int, time_point_us double")
    bounds = F.lit(sorted(at)) if at else F.array().cast("array<double>")
    # How many points lie at or before the start, by halving: from the highest power of two down, a step is taken where the point there is no later.
    halves = F.lit([1 << b for b in reversed(range(len(at).bit_length()))] or [1])
    first = F.aggregate(halves, F.lit(0), lambda k, b: F.when((k + b <= len(at)) & (F.get(bounds, k + b - 1) <= F.col("start_time_us")), k + b).otherwise(k))
    loads = spans.withColumn("node", F.col("pe_id") % nodes).withColumn("k", first).where(F.col("k") < len(at)).groupBy("k", "node").agg(wide_sum("wall_duration_us").alias("load"))
    present = loads.select("node").distinct()
    frame = listed.withColumn("_", F.lit(0)).join(F.broadcast(present.withColumn("_", F.lit(0))), "_").drop("_")
    running = W.partitionBy("node").orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    of_node = frame.join(loads, ["k", "node"], "left").withColumn("load", F.sum("load").over(running))
    of_point = of_node.groupBy("k").agg(F.max("load").alias("max_load_us"), F.try_divide(F.sum("load").cast("double"), F.count("load")).alias("mean_load_us"))
    joined = listed.join(of_point, "k", "left").withColumn("percent_imbalance", imbalance("max_load_us", "mean_load_us"))
    out = joined.select("time_point_us", wide(F.col("max_load_us")).alias("max_load_us"), F.coalesce("mean_load_us", F.lit(0.0)).alias("mean_load_us"), "percent_imbalance").orderBy("time_point_us")
    return narrowed(out, "max_load_us")


def chare_load_by_bin(ds: TraceDataset, width_us: int, pes: Pes = None, window: Window = None) -> DataFrame:
    return chare_loads(entry_spans(ds, pes, w := ds.window(window)), width_us, w).orderBy("pe_id", "bin_start", F.desc("load_us"), "chare_name")


def chare_loads(spans: DataFrame, width_us: int, window: tuple[int, int]) -> DataFrame:
    """Busy time of each PE, bin and collection of spans with names, in no order."""
    return bin_loads(spans, width_us, window, ["pe_id", "chare_name"]).select("pe_id", "bin_start", "chare_name", "load_us")


def per_pe_utilization(ds: TraceDataset, pes: Pes = None, window: Window = None) -> DataFrame:
    """Busy, idle and other time of every PE; the three add up to the window."""
    w, pes = ds.window(window), distinct_pes(pes)
    if w[1] <= w[0]:
        raise ValueError(f"the window {w} is empty")
    length = F.lit(w[1] - w[0]).cast("bigint")
    busy = clipped_spans(ds, pes, w).groupBy("pe_id").agg(F.sum("clipped_us").alias("busy"))
    idle = idle_spans(ds, pes, w).groupBy("pe_id").agg(F.sum(clipped("start_time_us", "end_time_us", w)).alias("idle"))
    rows = pe_values(ds, pes).join(busy, "pe_id", "left").join(idle, "pe_id", "left")
    rows = rows.select("pe_id", whole(F.col("busy")).alias("busy_time_us"), whole(F.col("idle")).alias("idle_time_us"), length.alias("window_us"))
    return rows.withColumns({
        "overhead_us": F.col("window_us") - F.col("busy_time_us") - F.col("idle_time_us"),
        "utilization": F.col("busy_time_us") / F.col("window_us"), "idle_fraction": F.col("idle_time_us") / F.col("window_us"),
    })


def per_interval_utilization(ds: TraceDataset, width_us: int, pes: Pes = None, window: Window = None) -> DataFrame:
    """Busy share of each PE in each bin that it works in; a cut last bin is measured against the full width."""
    w = ds.window(window)
    busy = bin_spans(entry_spans(ds, pes, w), width_us, w).groupBy("pe_id", "bin_start").agg(whole(F.sum("bin_contribution_us")).alias("busy_us"))
    return busy.withColumn("utilization", F.least(F.col("busy_us") / F.lit(width_us), F.lit(1.0)))


def load_imbalance_score(ds: TraceDataset, pes: Pes = None, window: Window = None) -> DataFrame:
    """One row: sample deviation over mean of the PEs' utilisation; 0 without load or with one PE."""
    u = per_pe_utilization(ds, pes, window).agg(F.stddev_samp("utilization").alias("s"), F.avg("utilization").alias("m"))
    return u.select(F.when(F.col("m") > 0, F.coalesce(F.col("s") / F.col("m"), F.lit(0.0))).otherwise(F.lit(0.0)).alias("score"))


