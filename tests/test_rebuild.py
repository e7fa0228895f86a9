"""Log text to tables."""

import gzip
import random

import pytest
from conftest import rows

from weftline.operators.pairing import brackets, by_key
from weftline.operators.rebuild import Reconstruction, fold_steps, step_attribution
from weftline.plans.ids import numbered
from weftline.sources.logs import discover, read_lines
from weftline.sources.sink import convert
from weftline.sources.symbols import parse_clock, parse_symbols

STS = """VERSION "11.0"
PROCESSORS 3
TOTAL_PAPI_EVENTS 1
PAPI_EVENT 0 PAPI_TOT_CYC
CHARE 0 "Main" -1
CHARE 1 "One" 1
CHARE 2 "Three" 3
CHARE 3 "Six" 6
ENTRY CHARE 10 "Main::go" 0 0
ENTRY CHARE 11 "One::go" 1 0
ENTRY CHARE 12 "Three::go" 2 0
ENTRY CHARE 13 "Six::go" 3 0
MESSAGE 0 64
TOTAL_EVENTS 3
EVENT 4 SimulationStep
EVENT 9 Inner work
EVENT 9 second name
STAT 0 residual
STAT 1 particle count
"""


def build(spark, logs, start=0, sts=STS, step=4):
    lines = [(pe, i + 2, line) for pe, text in logs.items() for i, line in enumerate(text.split("\n"))]
    return Reconstruction(spark.createDataFrame(lines, "pe int, line_no bigint, value string"), parse_symbols(sts), start, step)


def run(ep, event, s, e, index="", cpu="555"):
    return f"2 0 {ep} {s} {event} 0 64 900 {index} {cpu} 7\n3 0 {ep} {e} {event} 0 64 1500 9"


def test_symbols():
    s = parse_symbols(STS)
    assert s.event_id("SimulationStep") == 4 and s.event_id("none") == -1 and s.events[9] == "Inner work"
    assert s.stats == {0: "residual", 1: "particle count"} and s.papi_names == {0: "PAPI_TOT_CYC"} and s.messages == [(0, 64)]
    for bad in (STS.replace("11.0", "10.0"), "PROCESSORS 1"):
        with pytest.raises(ValueError, match="format"):
            parse_symbols(bad)
    assert parse_clock("RC_GLOBAL_START_TIME 1500\n") == (1500, 0)


def test_index_arity(spark):
    one = build(spark, {0: run(11, 1, 1000, 1200, "7") + "\n" + run(11, 2, 1300, 1400, "7")})
    assert rows(one.chare_instance(), "instance_id", "collection_id", "index_0", "index_1") == [(1, 1, 7, 0)]
    assert rows(one.execution(), "start_cpu_us", "papi_begin_0", "papi_delta_0", "papi_begin_1", "wall_duration_us", "queue_wait_us", "instance_id") == [(555, 7, 2, None, 100, 400, 1), (555, 7, 2, None, 200, 100, 1)]
    three = build(spark, {0: run(12, 1, 1000, 1200, "1 2 3")}).chare_instance().first()
    assert (three.index_0, three.index_1, three.index_2, three.index_3) == (1, 2, 3, 0)
    assert build(spark, {0: run(13, 1, 1000, 1200, "1 2 3 4 5 6")}).chare_instance().first().index_5 == 6
    for ep in (10, 99):  # not an array, unknown: four numbers
        assert rows(build(spark, {0: run(ep, 1, 1000, 1200, "1 2 3 4")}).execution(), "start_cpu_us") == [(555,)]


def test_counter_names(spark):
    fields = {f.name: f.metadata for f in build(spark, {0: run(11, 1, 1, 2, "0")}).execution().schema}
    assert fields["papi_delta_0"] == {"papi_event": "PAPI_TOT_CYC"} and fields["papi_delta_1"] == {}


def test_unpaired_and_unset(spark):
    text = "3 0 11 5 1 0 64 0\n2 0 11 10 2 0 64 18446744073709551615 0 0\n2 0 11 20 2 0 64 -1 0 0\n3 0 11 30 2 0 64 0\n2 0 11 40 3 0 64 1 0 0"
    run_ = build(spark, {0: text})
    assert rows(run_.execution(), "start_time_us", "end_time_us", "recv_time_us") == [(20, 30, None)]
    run_.keep_open = True
    assert rows(run_.execution(), "start_time_us", "end_time_us", "wall_duration_us", "papi_end_0") == [(10, None, None, None), (20, 30, 10, 0), (40, None, None, None)]


def test_migrations(spark):
    there = {0: run(11, 1, 1000, 1200, "7") + "\n" + run(11, 2, 5000, 5100, "7"), 1: run(11, 1, 2000, 2500, "7") + "\n" + run(11, 2, 2600, 2700, "8")}
    r = build(spark, there)
    got = rows(r.migration_episode(r.execution(), r.chare_instance()), "src_pe", "dst_pe", "gap_us", "migration_seq")
    assert got == [(0, 1, 800, 1), (1, 0, 2500, 2)]
    still = build(spark, {0: run(11, 1, 1000, 1200, "7") + "\n" + run(11, 2, 2000, 2200, "7")})
    assert still.migration_episode(still.execution(), still.chare_instance()).count() == 0
    group = build(spark, {0: run(10, 1, 1000, 1200, "0 0 0 0"), 1: run(10, 1, 2000, 2200, "0 0 0 0")})
    assert group.migration_episode(group.execution(), group.chare_instance()).count() == 0


def test_user_events(spark):
    text = "13 9 100 1 0\n26 -42 150\n28 200 12two words é \n29 300 350 5 3abc\n13 77 400 2 0"
    got = rows(build(spark, {2: text}).user_event(), "record_type", "user_event_id", "name", "start_time_us", "end_time_us", "duration_us", "user_supplied_int", "note")
    assert got == [(13, 77, None, 400, None, None, None, None), (13, 9, "Inner work", 100, None, None, None, None), (26, None, None, 150, None, None, -42, None), (28, None, None, 200, None, None, None, "two words é"), (29, None, None, 300, 350, 50, None, "abc")]


def test_nested_brackets(spark):
    text = "98 9 100 1 0 0\n98 9 200 2 0 1\n99 9 300 3 0 0\n99 9 400 4 0 1\n98 9 500 5 0 0\n98 9 600 6 0 0\n99 9 700 7 0 0\n99 9 800 8 0 0\n99 9 900 9 0 0\n98 9 950 10 0 0"
    got = rows(build(spark, {1: text}).user_event(), "pe_id", "record_type", "start_time_us", "end_time_us")
    assert got == [(1, 98, 100, 300), (1, 98, 200, 400), (1, 98, 500, 800), (1, 98, 600, 700), (1, 98, 950, None), (1, 99, 900, None)]
    pairs = build(spark, {0: "100 9 10 5 0 1\n100 9 20 5 0 2\n100 9 30 5 0 3"}).user_event()
    assert rows(pairs, "start_time_us", "end_time_us", "nested_id") == [(10, 20, 1), (30, None, 3)]


def test_brackets_against_a_stack(spark):
    rng, data, want = random.Random(5), [], []
    for key in range(40):
        stack = []
        for i in range(rng.randrange(14)):
            begin = rng.random() < 0.5
            data.append((key, i, begin))
            if begin:
                stack.append(i)
            else:
                want.append((key, stack.pop(), i) if stack else (key, i, "lost"))
        want += [(key, i, None) for i in stack]
    df = spark.createDataFrame(data, "key int, i int, b boolean")
    got = [(r.key, r.i, (r.end.i if r.end else None) if r.matched else "lost") for r in brackets(df, ["key"], "i", df.b, ["i"]).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    last, pairs = {}, []
    for key, i, begin in data:
        if begin:
            last[key] = i
        elif key in last:
            pairs.append((key, last.pop(key), i))
    assert rows(by_key(df, ["key"], "i", df.b, ["i"]), "key", "begin.i", "i") == sorted(pairs, key=repr)


def test_steps(spark):
    logs = {0: "98 4 2000 1 0 1\n99 4 3000 2 0 1", 1: "98 4 2100 1 0 1\n99 4 3200 2 0 1"}
    assert rows(build(spark, logs).simulation_step(), "step_id", "pe_id", "start_time_us", "end_time_us", "global_start_time_us", "global_end_time_us", "pe_count") == [(1, 0, 2000, 3000, 2000, 3200, 2), (1, 1, 2100, 3200, 2000, 3200, 2)]
    assert build(spark, logs, step=-1).simulation_step().count() == 0
    twice = spark.createDataFrame([(1, 0, 1000, 1200), (1, 0, 1500, 1800), (1, 0, 1700, None)], "step_id int, pe_id int, start_time_us long, end_time_us long")
    steps = fold_steps(twice)
    assert rows(steps, "start_time_us", "end_time_us", "duration_us") == [(1000, 1800, 800)]
    ex = spark.createDataFrame([(0, 1100, 1150), (0, 1100, 1900), (1, 1100, 1150)], "pe_id int, start_time_us long, end_time_us long")
    assert step_attribution(ex, steps, 300).count() == 1


def test_mixed_stream(spark):
    r = build(spark, {0: "6 0\n13 6 100 1 0\n14 200 0\n15 300 0\n28 350 3abc\n14 400 0\n15 500 0\n7 600\n\nnonsense"})
    assert rows(r.processing_element(), "pe_id", "end_time_us", "computation_duration_us") == [(0, 600, 600)]
    assert rows(r.idle_interval()) == [(0, 200, 300, 100), (0, 400, 500, 100)]
    assert rows(build(spark, {3: "15 50 3\n14 60 3\n15 70 3\n15 90 3"}).idle_interval()) == [(0, 0, 50, 50), (3, 60, 70, 10), (3, 60, 90, 30)]
    assert rows(build(spark, {0: "6 5"}).processing_element(), "begin_time_us", "end_time_us") == [(5, None)]


def test_stats_memory_messages(spark):
    r = build(spark, {0: "32 5000 -1 2.5 0 0\n32 5000 1.25 3.5 0 1\n27 5368709120 5000", 1: "1 0 11 100 5 1 64 0\n1 0 11 1600 5 1 64 1700\n20 0 11 1800 6 1 64 0 3\n21 0 11 1900 7 1 64 0 2 0 1\n2 0 11 2500 5 1 64 2400 0 0"}, 1500)
    assert rows(r.user_stat(), "name", "time_us", "stat_value", "user_time_s") == [("particle count", 3500, 3.5, 1.25), ("residual", 3500, 2.5, None)]
    assert rows(r.memory_sample()) == [(0, 3500, 5368709120)]
    assert rows(r.message(), "message_id", "send_time_us", "enqueue_time_us", "is_broadcast", "broadcast_fanout", "dst_pe", "exec_start_time_us", "recv_time_us", "end_to_end_us") == [(1, 100, 200, False, 1, 1, 1000, 900, None), (2, 300, None, True, 3, None, None, None, None), (3, 400, None, False, 1, None, None, None, None)]


def test_directory(spark, tmp_path):
    logs, out = tmp_path / "logs", tmp_path / "out"
    logs.mkdir()
    (logs / "run.sts").write_text(STS)
    (logs / "run.projrc").write_text("RC_GLOBAL_START_TIME 500\nRC_GLOBAL_END_TIME 9\n")
    (logs / "run.0.log").write_text("header\n6 500\n" + run(11, 1, 1000, 1200, "7") + "\n7 3000\n")
    with gzip.open(logs / "run.1.log.gz", "wt") as f:
        f.write("header\n6 600\n" + run(11, 1, 2000, 2200, "7") + "\n7 3000\n")
    (logs / "archive.tar.gz").write_bytes(gzip.compress(b"header\n" + run(11, 9, 1, 2, "7").encode()))
    symbols, clock, files = discover(spark, str(logs))
    assert len(files) == 2 and clock == (500, 9) and symbols.processors == 3
    assert rows(read_lines(spark, files), "pe", "line_no", "value")[0] == (0, 2, "6 500")
    convert(spark, str(logs), str(out))
    from weftline.operators.metrics import chare_duration_totals
    from weftline.sources.dataset import TraceDataset

    ds = TraceDataset.open(spark, str(out))
    assert ds.time_range_us == (0, 2500) and rows(chare_duration_totals(ds)) == [("One", 400)]
    assert ds.migration_episode.count() == 1 and len(ds.tables) == 13
    assert read_lines(spark, []).count() == 0


def test_numbers_are_consecutive(spark):
    got = rows(numbered(spark.range(1000).repartition(7), ["id"], "no"), "id", "no")
    assert got == sorted([(i, i + 1) for i in range(1000)], key=repr)
    assert numbered(spark.range(0), ["id"], "no").count() == 0
