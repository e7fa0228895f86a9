"""Queries of the run-trace operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.catalog import adapter as A
from weftline.catalog.adapter import dataset
from weftline.operators import metrics as M
from weftline.operators import profiles as P
from weftline.operators.filters import by_sample_time, select_rows
from weftline.operators.noise import NoiseMiner, assign_clusters, execution_candidates, idle_gap_candidates
from weftline.operators.rebuild import step_attribution
from weftline.operators.spans import bin_spans, clipped_spans, entry_spans, idle_spans, message_latency, message_spans
from weftline.sources.dataset import TraceDataset
from weftline.sources.schemas import SCHEMAS

BIN = 1_000_000
#: A window inside the run at every test size, for the queries whose feature is the window: filters and clipping.  All others take the whole run.
PART = (500_000, 2_000_000)
Query = Callable[[SparkSession, str], DataFrame]


def on(f: Callable[[TraceDataset], DataFrame]) -> Query:
    return lambda spark, folder: f(dataset(spark, folder))


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def rounded_doubles(df: DataFrame, column: str, digits: int) -> DataFrame:
    """Rounded in doubles as SQL rounds them, for values with more digits than a double holds."""
    by = 10.0 ** abs(digits)
    return df.withColumn(column, F.round(F.col(column) * by) / by if digits > 0 else F.round(F.col(column) / by) * by)


def miner(ds: TraceDataset) -> NoiseMiner:
    return NoiseMiner(ds, width_us=100, importance_cutoff=1e-6, min_pes=2, quantum_us=1000)


def miner_unlabelled(ds: TraceDataset) -> NoiseMiner:
    return NoiseMiner(ds, width_us=100, importance_cutoff=1e-6, min_pes=2)


def _events(method: str, *columns: str) -> Query:
    return lambda s, d: getattr(A.rebuilt_events(s, d), method)().select(*columns)


SPAN = ["pe_id", "event", "ep_id", "start_time_us", "end_time_us", "ep_name", "collection_id", "chare_name"]
EXEC = [f.name for f in SCHEMAS["execution"]]
MIGRATION = ["migration_id", "instance_id", "collection_id", "src_pe", "dst_pe", "last_exec_end_src_us", "first_exec_start_dst_us", "gap_us", "migration_seq"]
MESSAGE = ["message_id", "src_pe", "event", "ep_id", "msg_idx", "msg_len", "send_time_us", "enqueue_time_us", "is_broadcast", "broadcast_fanout", "dst_pe", "recv_time_us", "exec_start_time_us", "end_to_end_us"]

QUERIES: dict[str, Query] = {
    "idle_spans": on(idle_spans),
    "entry_spans": on(lambda ds: entry_spans(ds).select(*SPAN)),
    "message_spans": on(lambda ds: message_spans(ds).select("message_id", "src_pe", "ep_id", "send_time_us", "target_ep_name")),
    "message_latency": on(lambda ds: message_latency(ds).select("message_id", "send_to_enqueue_us", "enqueue_to_exec_us", "end_to_end_us")),
    "span_overlap_filter": on(lambda ds: select_rows(ds.execution, [0, 5, 17], PART).select("pe_id", "event", "start_time_us", "end_time_us")),
    "point_filter": on(lambda ds: select_rows(ds.message, None, PART, "src_pe", "send_time_us", None).select("message_id", "send_time_us")),
    "sample_filter": on(lambda ds: by_sample_time(ds.memory_sample, PART)),
    "clipped_durations": on(lambda ds: clipped_spans(ds, window=PART).select("pe_id", "event", "clipped_us")),
    "clipped_durations_run": on(lambda ds: clipped_spans(ds).select("pe_id", "event", "clipped_us")),
    "bin_spans": on(lambda ds: bin_spans(entry_spans(ds, window=ds.time_range_us), BIN, ds.time_range_us).select("pe_id", "event", "ep_name", "bin_start", "bin_contribution_us")),
    "chare_duration_totals": on(M.chare_duration_totals),
    "chare_frequency_counts": on(M.chare_frequency_counts),
    "chare_activity_duration": on(M.chare_activity_matrix),
    "chare_activity_frequency": on(lambda ds: M.chare_activity_matrix(ds, metric="frequency")),
    "pe_load_by_bin": on(lambda ds: M.pe_load_by_bin(ds, BIN)),
    "percent_imbalance_by_bin": on(lambda ds: rounded(M.percent_imbalance_by_bin(ds, BIN), "mean_load_us", "percent_imbalance")),
    "cumulative_imbalance": on(lambda ds: rounded(rounded_doubles(rounded_doubles(M.cumulative_imbalance(ds), "mean_load_us", -3), "time_point_us", 6), "percent_imbalance")),  # loads of 1e16
    "chare_load_by_bin": on(lambda ds: M.chare_load_by_bin(ds, BIN)),
    "per_pe_utilization": on(lambda ds: rounded(M.per_pe_utilization(ds), "utilization", "idle_fraction")),
    "per_interval_utilization": on(lambda ds: rounded(M.per_interval_utilization(ds, BIN), "utilization")),
    "load_imbalance_score": on(lambda ds: rounded(M.load_imbalance_score(ds), "score")),
    "time_profile": on(lambda ds: rounded(P.time_profile(ds, BIN), "value")),
    "time_profile_pct": on(lambda ds: rounded(P.time_profile(ds, BIN, as_percentage=True, top_n=5), "value", digits=8)),
    "usage_profile": on(lambda ds: rounded(P.usage_profile(ds), "value")),
    "usage_profile_pct": on(lambda ds: rounded(P.usage_profile(ds, as_percentage=True, top_n=5), "value")),
    "ep_profile": on(lambda ds: rounded(P.ep_profile(ds), "pct")),
    "exec_time_histogram": on(lambda ds: rounded(P.execution_time_histogram(ds), "low", "high", digits=2)),
    "exec_time_histogram_log": on(lambda ds: rounded(P.execution_time_histogram(ds, log=True), "low", "high", digits=2)),
    "exec_time_accumulated": on(lambda ds: rounded(rounded(P.execution_time_histogram(ds, accumulated=True), "low", "high", digits=2), "accumulated_ms", digits=-3)),  # sums of 1e15
    "message_size_histogram": on(lambda ds: rounded(P.message_size_histogram(ds), "low", "high")),
    **{f"comm_{m}": on(lambda ds, m=m: P.comm_per_pe(ds, m)) for m in ("sent_msgs", "sent_bytes", "recv_msgs", "recv_bytes")},
    **{f"extrema_{a}": on(lambda ds, a=a: rounded(P.extrema_analysis(ds, a), "value")) for a in P.EXTREMA},
    "memory_series": on(lambda ds: rounded(P.memory_usage(ds), "value")),
    "memory_envelope": on(lambda ds: rounded(P.memory_usage(ds, aggregate=True, unit="kib"), "least", "mean", "most")),
    "user_stats_over_time": on(lambda ds: rounded(P.user_stats_over_time(ds), "value")),
    "user_stats_user_time": on(lambda ds: rounded(P.user_stats_over_time(ds, use_user_time=True, aggregation="max"), "value")),
    "user_stats_per_pe": on(lambda ds: rounded(P.user_stats_per_pe(ds), "value")),
    "noise_exec_candidates": on(lambda ds: execution_candidates(ds, None, ds.time_range_us, 100)),
    "noise_idle_gaps": on(lambda ds: idle_gap_candidates(ds, None, ds.time_range_us, 100)),
    "noise_clusters": on(lambda ds: assign_clusters(miner(ds).candidates.select("kind", "bin_idx").distinct(), 100, 0.1)),
    "noise_summary": on(lambda ds: rounded(miner(ds).summary(), "noise_us_median", "runtime_fraction", "period_us", "period_cv")),
    "noise_summary_no_quantum": on(lambda ds: miner_unlabelled(ds).summary().select("cluster_id", "likely_source")),
    "noise_occurrences": on(lambda ds: miner(ds).occurrences()),
    "noise_timeline": on(lambda ds: miner(ds).timeline()),
    "run_compare_duration": on(lambda ds: P.run_comparison({"even": A.half(ds, 0), "odd": A.half(ds, 1)})),
    "run_compare_frequency": on(lambda ds: P.run_comparison({"even": A.half(ds, 0), "odd": A.half(ds, 1)}, metric="frequency")),
    "activity_heatmap": on(P.activity_heatmap),
    "dominant_chare": on(lambda ds: P.dominant_chare(ds, BIN)),
    "dominant_chare_top": on(lambda ds: P.dominant_chare(ds, BIN, top_n=3)),
    "timeline_with_imbalance": on(lambda ds: rounded(P.timeline_with_imbalance(ds, BIN), "percent_imbalance")),
    "rebuild_processing_element": lambda s, d: A.rebuilt_elements(s, d),
    "convert_execution": lambda s, d: A.converted(s, d).execution.select(*EXEC),
    "rebuild_execution": lambda s, d: A.rebuilt(s, d).execution().select(*EXEC),
    "rebuild_chare_instance": lambda s, d: A.rebuilt(s, d).chare_instance().select(*[f.name for f in SCHEMAS["chare_instance"]]),
    "rebuild_message": lambda s, d: A.rebuilt(s, d).message().select(*MESSAGE),
    "migration_episode": lambda s, d: A.episodes(s, d).select(*MIGRATION),
    "idle_slot": _events("idle_interval", "pe_id", "start_time_us", "end_time_us", "duration_us"),
    "pair_toggle": lambda s, d: A.rebuilt_events(s, d).user_event().where("record_type = 100").select("pe_id", "user_event_id", "name", "event", "nested_id", "start_time_us", "end_time_us", "duration_us"),
    "pair_brackets": lambda s, d: A.rebuilt_events(s, d).user_event().where("record_type IN (98, 99)").select("pe_id", "record_type", "user_event_id", "event", "nested_id", "start_time_us", "end_time_us"),
    "user_event_points": lambda s, d: A.rebuilt_events(s, d).user_event().where("record_type = 13").select("pe_id", "user_event_id", "name", "event", "start_time_us", "end_time_us"),
    "user_event_notes": lambda s, d: A.rebuilt_events(s, d).user_event().where("record_type = 28").select("pe_id", "start_time_us", "note"),
    "user_event_supplied": lambda s, d: A.rebuilt_events(s, d).user_event().where("record_type = 26").select("pe_id", "user_event_id", "name", "event", "start_time_us", "end_time_us", "user_supplied_int", "note"),
    "user_event_bracketed_notes": lambda s, d: A.rebuilt_events(s, d).user_event().where("record_type = 29").select("pe_id", "event", "start_time_us", "end_time_us", "duration_us", "note"),
    "rebuild_user_stat": _events("user_stat", "pe_id", "stat_id", "name", "time_us", "stat_value", "user_time_s"),
    "rebuild_memory_sample": _events("memory_sample", "pe_id", "time_us", "bytes"),
    "rebuild_steps": _events("simulation_step", "step_id", "pe_id", "start_time_us", "end_time_us", "global_start_time_us", "global_end_time_us", "pe_count"),
    "simulation_step": lambda s, d: A.steps(s, d),
    "step_attribution": lambda s, d: step_attribution(A.events(s, d).select("pe_id", "event", F.col("s").alias("start_time_us"), F.col("e").alias("end_time_us")), A.steps(s, d), 3_600_000_000).select("pe_id", "event", "step_id"),
    "ep_totals": on(lambda ds: ds.execution.groupBy("ep_id").agg(F.sum("wall_duration_us").alias("total_us"), F.round(F.avg("wall_duration_us"), 6).alias("mean_us"), F.count(F.lit(1)).alias("n")).join(ds.entry_method.select("ep_id", "name"), "ep_id")),
    "pe_balance": on(lambda ds: ds.execution.groupBy("pe_id").agg(F.sum("wall_duration_us").alias("t")).agg(F.max("t").alias("most_us"), F.round(F.max("t") / F.avg("t"), 6).alias("balance"))),
    "pe_summary": on(lambda ds: ds.execution.groupBy("pe_id").agg(F.sum("wall_duration_us").alias("total_us"), F.count(F.lit(1)).alias("n"), F.round(F.avg("wall_duration_us"), 6).alias("mean_us"))),
}
from weftline.catalog.runs_sql import SQL  # noqa: E402, F401
