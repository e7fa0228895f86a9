"""Analysis operators on a run of twelve executions."""

import pytest
from conftest import make, rows

from weftline.operators import metrics as M
from weftline.operators import profiles as P
from weftline.operators.filters import by_pe, by_time
from weftline.operators.spans import bin_loads, bin_spans, entry_spans, message_latency
from weftline.sources.dataset import TraceDataset, palette


def test_totals_and_counts(tiny):
    assert rows(M.chare_duration_totals(tiny)) == [("Main", 300_000), ("Worker", 5_650_000)]
    assert rows(M.chare_frequency_counts(tiny)) == [("Main", 1), ("Worker", 11)]


def test_imbalance_by_bin(tiny):
    got = rows(M.percent_imbalance_by_bin(tiny, 1_000_000, window=(0, 2_000_000)), "bin_start", "percent_imbalance")
    assert [round(x, 4) for _, x in got] == [6.6667, 75.0]


def test_cumulative_imbalance(tiny):
    got = rows(M.cumulative_imbalance(tiny, time_points_us=[2_000_000, 1_000_000], nodes=4), "time_point_us", "percent_imbalance")
    assert [(t, round(x, 4)) for t, x in got] == [(1_000_000.0, 10.0), (2_000_000.0, 21.2121)]
    assert M.cumulative_imbalance(tiny).count() == 99
    assert M.cumulative_imbalance(tiny, pes=[]).count() == 0


def test_utilization_adds_up(tiny):
    got = M.per_pe_utilization(tiny).collect()
    assert len(got) == 4
    assert all(r.busy_time_us + r.idle_time_us + r.overhead_us == r.window_us and 0 <= r.utilization <= 1 for r in got)
    assert M.per_pe_utilization(tiny, pes=[1, 1, 7]).count() == 2
    with pytest.raises(ValueError, match="empty"):
        M.per_pe_utilization(tiny, window=(5, 5))
    assert M.load_imbalance_score(tiny, pes=[1]).first().score == 0.0


def test_windows(tiny, spark):
    assert tiny.time_range_us == (0, 10_000_200)
    assert TraceDataset(spark, tiny.tables, legacy_time_range=True).time_range_us == (0, 9_999_200)
    assert by_pe(tiny.execution, []).count() == 0
    assert by_time(tiny.execution, (400_000, 500_000)).count() == 3
    assert by_time(tiny.message, (50_000, 400_000), "send_time_us", None).count() == 1


def test_bin_quirks(spark):
    spans = spark.createDataFrame([(1, 100, 100), (2, 150, 150), (3, 180, 170), (4, 90, 210), (5, 950, None)], "k int, start_time_us long, end_time_us long")
    got = rows(bin_spans(spans, 100, (0, 1000)), "k", "bin_start", "bin_contribution_us")
    assert got == [(2, 100, 0), (3, 100, -10), (4, 0, 10), (4, 100, 100), (4, 200, 10), (5, 900, 50)]
    with pytest.raises(ValueError, match="positive"):
        bin_spans(spans, 0, (0, 1))


def test_missing_tables(spark, tiny):
    with pytest.raises(FileNotFoundError, match="execution"):
        TraceDataset(spark, {n: t for n, t in tiny.tables.items() if n != "execution"})
    with pytest.raises(FileNotFoundError, match="message"):
        TraceDataset.open(spark, "/tmp")
    assert tiny.has_table("user_stat") and not tiny.has_table("user_event") and tiny.user_event is None


def test_open_from_files(spark, tiny, tmp_path):
    from weftline.sources.sink import write_tables

    write_tables(dict(tiny.tables.items()), str(tmp_path))
    again = TraceDataset.open(spark, str(tmp_path))
    assert rows(M.chare_duration_totals(again)) == rows(M.chare_duration_totals(tiny)) and "pes=4" in repr(again)


def test_comm_and_latency(tiny):
    assert rows(P.comm_per_pe(tiny)) == [(0, 3), (1, 1), (2, 1), (3, 1)]
    assert rows(P.comm_per_pe(tiny, "recv_bytes")) == [(0, 190), (1, 420), (2, 250), (3, 480)]
    assert rows(message_latency(tiny), "message_id", "end_to_end_us")[0] == (0, 150_000)
    with pytest.raises(ValueError, match="metric"):
        P.comm_per_pe(tiny, "x")


def test_extrema(tiny):
    assert rows(P.extrema_analysis(tiny, "active_entry_methods", 1), "rank", "pe_id", "value", "extreme")[:2] == [(1, 0, 3.0, True), (2, 1, 2.0, False)]
    with pytest.raises(ValueError, match="attribute"):
        P.extrema_analysis(tiny, "x")


def test_memory_and_stats(tiny):
    assert rows(P.memory_usage(tiny, unit="gib"))[0] == (0, 1_000_000, 0.0625)
    assert rows(P.memory_usage(tiny, aggregate=True))[0] == (1_000_000, 64.0, 80.0, 96.0)
    assert [r[0] for r in rows(P.user_stats_over_time(tiny, use_user_time=True), "x")] == [0.5, 1.0, 1.5]
    assert rows(P.user_stats_per_pe(tiny, [0], (0, 1_500_000), stats=[0])) == [(0, "residual", 0, 10.0)]
    with pytest.raises(ValueError, match="aggregation"):
        P.user_stats_per_pe(tiny, aggregation="x")


def test_dominant_and_heatmap(tiny):
    top = {r.chare_name for r in P.dominant_chare(tiny, 100_000, top_n=1).collect()}
    assert top == {"Worker"}
    assert {r.chare_name for r in P.dominant_chare(tiny, 100_000, chares=["Main"]).collect()} == {"Main"}
    assert P.activity_heatmap(tiny).count() == 8
    with pytest.raises(ValueError, match="top_n"):
        P.dominant_chare(tiny, top_n=0)


def test_profiles(tiny):
    assert {r.label for r in P.time_profile(tiny, top_n=1).collect()} == {"Worker::compute", "Other", "Idle"}
    pct = P.usage_profile(tiny, as_percentage=True).groupBy("pe_id").sum("value").collect()
    assert all(abs(r[1] - 100) < 1e-9 for r in pct)
    shown = P.ep_profile(tiny, top_n=1).collect()
    assert {r.label for r in shown} == {"Worker::compute", "Other"} and abs(sum(r.pct for r in shown) - 100) < 1e-9
    assert P.run_comparison({"a": tiny, "b": tiny}, top_n=1).count() == 2


def test_histograms(tiny, spark):
    linear = P.execution_time_histogram(tiny, bins=5).collect()
    assert len(linear) == 5 and sum(r["count"] for r in linear) == 12
    assert P.execution_time_histogram(tiny, bins=5, log=True).count() == 4
    assert P.execution_time_histogram(tiny, ep_ids=[99]).count() == 0
    same = P.histogram(spark.createDataFrame([(5,), (5,), (None,)], "v int"), "v", 4).collect()
    assert sum(r["count"] for r in same) == 2


def test_names_repeat_and_miss(tiny, spark):
    doubled = tiny.entry_method.unionByName(tiny.entry_method.where("ep_id = 1").selectExpr("ep_id", "'again' AS name", "collection_id", "msg_idx")).where("ep_id < 2")
    got = entry_spans(TraceDataset(spark, dict(tiny.tables) | {"entry_method": doubled}))
    assert got.count() == 12 + 7 and got.where("ep_name IS NULL").count() == 4


def test_palette():
    assert palette([3, 1, 3]) == palette([1, 3]) and len(set(palette(list(range(50))).values())) == 50


def test_dataset_methods(tiny):
    assert tiny.entry_spans([0]).count() == 3 and tiny.idle_spans(window=(0, 300_001)).count() == 1 and tiny.message_spans([3]).count() == 1
    assert set(tiny.ep_color_map) == {0, 1, 2}


def endless(spark, tiny, pes):
    """1,200 executions dealt to the PEs, a method to each PE, with ends that are no times: their durations add up to more than bigint holds."""
    ex = [{"pe_id": pes[i % len(pes)], "event": i, "ep_id": pes[i % len(pes)], "start_time_us": i, "end_time_us": i + 9 * 10**15, "wall_duration_us": 9 * 10**15} for i in range(1200)]
    return TraceDataset(spark, dict(tiny.tables) | {"execution": make(spark, "execution", ex)})


def test_cumulative_beyond_bigint(spark, tiny):
    four = M.cumulative_imbalance(endless(spark, tiny, [0, 1, 2, 3]), time_points_us=[2000.0])
    assert dict(four.dtypes)["max_load_us"] == "bigint" and rows(four) == [(2000.0, 300 * 9 * 10**15, 300 * 9e15, 0.0)]
    one = M.cumulative_imbalance(endless(spark, tiny, [0]), time_points_us=[2000.0]).first()
    assert (int(one.max_load_us), one.mean_load_us) == (1200 * 9 * 10**15, 1200 * 9e15)


def test_profile_beyond_bigint(spark, tiny):
    got = P.ep_profile(endless(spark, tiny, [0, 1, 2, 3]))
    assert dict(got.dtypes)["total_us"] == "bigint" and sorted((r.ep_id, r.total_us, r.pct) for r in got.collect()) == [(e, 300 * 9 * 10**15, 25.0) for e in range(4)]
    one = P.ep_profile(endless(spark, tiny, [0])).first()
    assert (one.ep_id, int(one.total_us), one.pct) == (0, 1200 * 9 * 10**15, 100.0)


def test_loads_are_the_sums_of_bins(spark):
    dealt = [(k, s, None if s % 7 == 0 else s + d) for i in range(300) for k, s, d in [((None, "a", "b")[i % 3], i * 37 % 1200 - 100, i * 53 % 400 - 30)]]
    quirks = [("q", 100, 100), ("q", 150, 150), ("q", 180, 170), ("q", 90, 210), ("q", 950, None), ("q", 300, 250), ("r", 90, 210), ("r", 190, 410), ("r", 700, 2000), ("t", -50, 20), ("t", 1000, None)]
    spans = spark.createDataFrame(dealt + quirks, "k string, start_time_us long, end_time_us long").where("start_time_us < 1000 AND (end_time_us IS NULL OR end_time_us > 0)")
    for width in (1, 100, 300, 5000):
        want = bin_spans(spans, width, (0, 1000)).groupBy("k", "bin_start").agg({"bin_contribution_us": "sum"})
        assert rows(bin_loads(spans, width, (0, 1000), ["k"])) == rows(want)


def test_open_spans_over_many_bins(spark, tiny):
    """3,000 executions without an end over a million bins: a row for each would be three thousand million."""
    ex = [{"pe_id": 0, "event": i, "ep_id": 1, "start_time_us": i} for i in range(3000)]
    run = TraceDataset(spark, dict(tiny.tables) | {"execution": make(spark, "execution", ex)})
    got = P.dominant_chare(run, 10_000, window=(0, 10_000_000_000), top_n=3)
    n, least, most = got.selectExpr("count(*)", "min(load_us)", "max(load_us)").first()
    assert (n, least, most) == (1_000_000, sum(10_000 - i for i in range(3000)), 3000 * 10_000)
