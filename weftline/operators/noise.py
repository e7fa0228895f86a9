"""Recurring disturbances of a run: executions above their kind's median, and time that nothing accounts for."""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.spans import wide, wide_sum
from weftline.operators.filters import distinct_pes
from weftline.operators.spans import Pes, Window, entry_spans, idle_spans
from weftline.plans.shape import broadcast_within, cut, narrowed
from weftline.sources.dataset import TraceDataset

SLICE_US = 10_000_000

# The labels of a cluster's likely source.
PERIODIC, JITTER, INTERFERENCE = "periodic daemon", "sub-millisecond jitter", "system interference"
LONG_GAP, LONG_EXECUTION = "long interruption", "long interruption during execution"


def execution_candidates(ds: TraceDataset, pes: Pes, window: tuple[int, int], width_us: int) -> DataFrame:
    """(kind, pe_id, time_us, noise_us) of executions at least a bin longer than their entry method's median."""
    spans = entry_spans(ds, pes, window).select("pe_id", "ep_id", "start_time_us", "wall_duration_us")
    # Distinct durations with counts, so that the exact median's input is small.
    counts = spans.where(F.col("wall_duration_us").isNotNull()).groupBy("ep_id", "wall_duration_us").agg(F.count(F.lit(1)).alias("c"))
    medians = counts.groupBy("ep_id").agg(F.percentile("wall_duration_us", F.lit(0.5), F.col("c")).alias("m"))
    noise = F.col("wall_duration_us") - F.col("m")
    return spans.join(medians, "ep_id").where(noise >= width_us).select(F.lit("execution").alias("kind"), "pe_id", F.col("start_time_us").alias("time_us"), noise.cast("bigint").alias("noise_us"))


def idle_gap_candidates(ds: TraceDataset, pes: Pes, window: tuple[int, int], width_us: int, slice_us: int = SLICE_US) -> DataFrame:
    """The same of stretches of a PE that neither an execution nor an idle interval covers.

    The greatest end so far is kept per slice of time and carried between slices
    by one row each, so that a PE with many rows is many tasks.
    """
    columns = ["pe_id", "start_time_us", "end_time_us"]
    spans = entry_spans(ds, pes, window).select(*columns).unionByName(idle_spans(ds, pes, window).select(*columns))
    spans = spans.select("pe_id", F.col("start_time_us").alias("s"), F.coalesce("end_time_us", "start_time_us").alias("e")).withColumn("slice", F.floor(F.col("s") / slice_us))
    of_slice = spans.groupBy("pe_id", "slice").agg(F.max("e").alias("top"))
    reach = of_slice.select("pe_id", "slice", F.max("top").over(W.partitionBy("pe_id").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)).alias("reach"))
    inside = W.partitionBy("pe_id", "slice").orderBy("s", "e").rowsBetween(W.unboundedPreceding, -1)
    covered = F.greatest(F.max("e").over(inside), F.col("reach"))
    gaps = spans.join(reach, ["pe_id", "slice"]).withColumn("covered", covered)
    noise = F.col("s") - F.col("covered")
    return gaps.where(noise >= width_us).select(F.lit("idle_gap").alias("kind"), "pe_id", F.col("covered").alias("time_us"), noise.alias("noise_us"))


def assign_clusters(bins: DataFrame, width_us: int, merge_threshold: float) -> DataFrame:
    """(kind, bin_idx, cluster_id) of distinct (kind, bin_idx).

    Bins of a kind are walked upwards; a bin joins the current cluster while its
    middle is at most ``1 + merge_threshold`` times the middle of the cluster's
    first bin.  Ids count on from kind to kind.
    """

    def walk(own: pd.DataFrame) -> pd.DataFrame:
        """The first bins of a kind's clusters: one search each, in the sorted bins."""
        at = np.unique(own["bin_idx"].to_numpy(np.int64))
        middles = (at + 0.5) * float(width_us)
        firsts, k = [], 0
        while k < len(at):
            firsts.append(at[k])
            k = int(np.searchsorted(middles, middles[k] * (1 + merge_threshold), "right"))
        return pd.DataFrame({"kind": own["kind"].iloc[0], "first": np.array(firsts, np.int64)})

    bins = cut(bins)
    # Two kinds, and of each the distinct bins only: no more than the window has widths.
    firsts = bins.groupBy("kind").applyInPandas(walk, "kind string, first bigint")
    # Clusters widen with their distance from 0, so there are few of them whatever the number of bins.
    of_kind = firsts.groupBy("kind").agg(F.array_sort(F.collect_list("first")).alias("firsts"))
    before = F.coalesce(F.sum(F.size("firsts")).over(W.orderBy("kind").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    of_kind = of_kind.withColumn("before", before)  # a row per kind
    place = F.size(F.filter("firsts", lambda f: f <= F.col("bin_idx"))) - 1
    return bins.join(F.broadcast(of_kind), "kind").select("kind", "bin_idx", (place + F.col("before")).cast("bigint").alias("cluster_id"))


def likely_source(quantum_us: int | None, merge_threshold: float) -> Column:
    """A label from kind, median and regularity.  Multiples of a quantum round half to even."""
    median = F.col("noise_us_median").cast("double")
    label = F.when(F.col("period_cv") < 0.25, PERIODIC).when(median < 1_000, JITTER).when(median < 100_000, INTERFERENCE)
    label = label.when(F.col("kind") == "idle_gap", LONG_GAP).otherwise(LONG_EXECUTION)
    if not quantum_us or quantum_us <= 0:
        return label
    times = F.bround(median / quantum_us)
    preempted = (times >= 1) & (F.abs(median - times * quantum_us) <= merge_threshold * quantum_us)
    return F.when(preempted, F.format_string("scheduler preemption (~%dx quantum)", times.cast("bigint"))).otherwise(label)


def _steps(rows: DataFrame, keys: list[str], time: str, slice_us: int = SLICE_US) -> DataFrame:
    """Rows with ``step``, the time since the row before of the same keys; those without one are left out.

    Time is cut in slices, and the last time of a slice is carried on by one row,
    so that keys with many rows are many tasks.
    """
    sliced = rows.select(*keys, F.col(time).alias("_t"), F.floor(F.col(time) / slice_us).alias("_slice"))
    tails = sliced.groupBy(*keys, "_slice").agg(F.max("_t").alias("_tail"))
    carried = tails.withColumn("_carried", F.lag("_tail").over(W.partitionBy(*keys).orderBy("_slice"))).drop("_tail")
    before = F.coalesce(F.lag("_t").over(W.partitionBy(*keys, "_slice").orderBy("_t")), F.col("_carried"))
    return sliced.join(carried, [*keys, "_slice"]).select(*keys, (F.col("_t") - before).alias("step")).where(F.col("step").isNotNull())


class NoiseMiner:
    """Candidates, clusters, summary and occurrences of a run's noise."""

    def __init__(
        self, ds: TraceDataset, pes: Pes = None, window: Window = None,
        *, width_us: int = 100, merge_threshold: float = 0.1, importance_cutoff: float = 0.01, min_pes: int = 2, quantum_us: int | None = None,
    ):
        if width_us <= 0 or merge_threshold < 0 or not 0 <= importance_cutoff <= 1 or min_pes < 1:
            raise ValueError("width_us and min_pes must be positive, merge_threshold at least 0, importance_cutoff between 0 and 1")
        self.window = ds.window(window)
        if self.window[1] <= self.window[0]:
            raise ValueError(f"the window {self.window} is empty")
        self.ds, self.width, self.threshold, self.quantum = ds, width_us, merge_threshold, quantum_us
        self.cutoff, self.min_pes = importance_cutoff, min_pes
        self.runtime = (self.window[1] - self.window[0]) * max(1, ds.num_pes if (pes := distinct_pes(pes)) is None else len(pes))
        both = execution_candidates(ds, pes, self.window, width_us).unionByName(idle_gap_candidates(ds, pes, self.window, width_us))
        #: Computed once: clusters, statistics and occurrences all read them.
        self.candidates = cut(both.withColumn("bin_idx", F.floor(F.col("noise_us") / width_us)))

    @cached_property
    def clusters(self) -> DataFrame:
        return cut(assign_clusters(self.candidates.select("kind", "bin_idx").distinct(), self.width, self.threshold))

    def assigned(self) -> DataFrame:
        return self.candidates.join(broadcast_within(self.clusters), ["kind", "bin_idx"])

    def summary(self) -> DataFrame:
        """A row per cluster.  total_noise_us is bigint, or decimal(38, 0) where unusable ends take a cluster's sum beyond that."""
        return self._summary

    @cached_property
    def _summary(self) -> DataFrame:
        rows = self.assigned()
        # Distinct values with counts: a cluster is a tenth wide, so it has few of them.
        counts = rows.groupBy("cluster_id", "kind", "noise_us").agg(F.count(F.lit(1)).alias("c"))
        stats = counts.groupBy("cluster_id", "kind").agg(
            F.percentile("noise_us", F.lit(0.5), F.col("c")).alias("noise_us_median"), F.min("noise_us").alias("noise_us_min"), F.max("noise_us").alias("noise_us_max"),
            F.sum("c").alias("occurrences"), wide(F.sum(F.col("noise_us").cast("decimal(38,0)") * F.col("c"))).alias("total_noise_us"),
        )
        on = rows.groupBy("cluster_id", "pe_id").agg(F.lit(1).alias("_")).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("pe_count"))
        stats = stats.join(on, "cluster_id").withColumn("runtime_fraction", F.col("total_noise_us") / F.lit(float(self.runtime)))
        stats = stats.where((F.col("pe_count") >= self.min_pes) & (F.col("runtime_fraction") >= self.cutoff))
        steps = _steps(rows, ["cluster_id", "pe_id"], "time_us").groupBy("cluster_id", "step").agg(F.count(F.lit(1)).alias("c"))
        # Mean and deviation from counted moments, in one pass; the label asks for a regularity of a quarter, far above what cancels out.
        x, n = F.col("step").cast("double"), F.sum("c")
        total = F.sum(x * F.col("c"))
        deviation = F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), (F.sum(x * x * F.col("c")) - total * total / n) / (n - 1))))
        periods = steps.groupBy("cluster_id").agg(F.percentile("step", F.lit(0.5), F.col("c")).alias("period_us"), F.try_divide(deviation, total / n).alias("period_cv"))
        return narrowed(stats.join(periods, "cluster_id", "left").withColumn("likely_source", likely_source(self.quantum, self.threshold)).select(
            "cluster_id", "kind", "noise_us_median", "noise_us_min", "noise_us_max", "occurrences", "pe_count", "total_noise_us", "runtime_fraction", "period_us", "period_cv", "likely_source"
        ), "total_noise_us")

    def occurrences(self) -> DataFrame:
        kept = self._summary.select("cluster_id")
        return self.assigned().join(broadcast_within(kept), "cluster_id", "left_semi").select("cluster_id", "kind", "pe_id", "time_us", "noise_us")

    def timeline(self, bins: int = 50, weight: str = "count") -> DataFrame:
        """(cluster_id, time_bin, value): occurrences or their time over the window, the time as wide as in :meth:`summary`."""
        if bins <= 0 or weight not in ("count", "time"):
            raise ValueError("bins must be positive, weight 'count' or 'time'")
        t0, t1 = self.window
        slot = F.greatest(F.lit(0), F.least(F.lit(bins - 1), ((F.col("time_us") - t0) / F.lit((t1 - t0) / bins)).cast("bigint")))
        value = F.count(F.lit(1)) if weight == "count" else wide_sum("noise_us")
        out = self.occurrences().groupBy("cluster_id", slot.cast("int").alias("time_bin")).agg(value.alias("value"))
        return out if weight == "count" else narrowed(out, "value")


def noise_miner(ds: TraceDataset, pes: Pes = None, window: Window = None, **options) -> DataFrame:
    """The summary of a run's noise, most time first; options are those of :class:`NoiseMiner`."""
    return NoiseMiner(ds, pes, window, **options).summary().orderBy(F.desc("total_noise_us"), "cluster_id")


def noise_occurrences(ds: TraceDataset, pes: Pes = None, window: Window = None, **options) -> DataFrame:
    """The occurrences behind :func:`noise_miner`, by cluster and time."""
    return NoiseMiner(ds, pes, window, **options).occurrences().orderBy("cluster_id", "time_us", "pe_id")
