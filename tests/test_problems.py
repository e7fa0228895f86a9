"""Operators of the general problems: brute force, and awkward inputs."""

import random
from collections import defaultdict

import pytest
from conftest import rows
from pyspark.sql import functions as F

from weftline.operators.grid import regular
from weftline.operators.heavy_keys import key_stats
from weftline.operators.intervals import gaps, periods
from weftline.operators.spikes import spikes
from weftline.plans.ranges import range_sorted
from weftline.plans.shape import semi_by_keys
from weftline.streaming.orphans import REFERENCE, OrphanTable, parents, references

RUN = "ep int, pe int, ev int, s long, e long, grp string, kind string, level0 double, n string"


def source(rng, ep, pe, n, base, first=0):
    """Executions of one source, with columns that clash with the operators' own."""
    t, out = 0, []
    for i in range(n):
        t += rng.randrange(500, 1500)
        out.append([ep, pe, first + i, t, t + int(base * rng.lognormvariate(0, 0.1)), "x", "y", 0.5, None])
    return out


def run_spikes(spark, data, **options):
    return {(r.pe, r.ev, r.reason) for r in spikes(spark.createDataFrame([tuple(r) for r in data], RUN), "ep", "pe", "ev", "s", "e", **options).collect()}


def test_spikes_find_planted_cases(spark):
    rng = random.Random(3)
    data = source(rng, 1, 1, 900, 2000) + source(rng, 1, 2, 300, 4000) + source(rng, 2, 1, 60, 100, 5000) + source(rng, 2, 3, 5, 100)
    want = set()

    def put(i, length, reason):
        data[i][4] = data[i][3] + length
        want.add((data[i][1], data[i][2], reason))

    put(0, 25_000, "spike")  # the first of a source
    put(450, 150, "spike")
    put(950, 60_000, "spike")
    put(1261, 1400, "spike")  # a source with five rows, judged by its like
    put(10, 0, "impossible")
    put(11, -5, "impossible")
    put(12, 10**12, "impossible")
    for i in range(600, 606):
        put(i, 2222, "stuck")
    for i in range(700, 705):
        data[i][4] = data[i][3] + 1999  # five are too few
    for e in (1205, 1210):
        data[e][4] = None
    dirty = data + data[595:610] + [[None, 1, 1, 1, 5, *data[0][5:]], [1, None, 2, 5, 1, *data[0][5:]], [3, 9, 7, None, 9, *data[0][5:]]]
    rng.shuffle(dirty)
    got = run_spikes(spark, dirty, latest=10**9)
    assert got == want | {(None, 2, "impossible")}
    # Split over many partitions, or none: the edges are put together.
    assert run_spikes(spark, data, latest=10**9, partitions=13) == want
    assert run_spikes(spark, data, latest=10**9, partitions=1) == want


def test_the_innovation_decides(spark):
    """How far a source may stray depends on how much it usually does."""
    rng = random.Random(11)
    data = []
    for ep, width in ((1, 0.05), (2, 0.25), (3, 0.45)):  # decades
        own = source(rng, ep, 1, 800, 10_000, 1000 * ep)
        for r in own:
            r[4] = r[3] + int(10_000 * 10 ** rng.gauss(0, width))
        own[500][4] = own[500][3] + 90_000
        data += own
    found = {t: run_spikes(spark, data, threshold=t) for t in (1.5, 3.0, 4.5)}
    assert found[4.5] < found[3.0] < found[1.5]
    assert {ev for _, ev, _ in found[4.5]} & {1500, 3500} == {1500}  # nine times is much for the first, nothing for the third


def test_runs_over_many_small_partitions(spark):
    rng = random.Random(12)
    data = source(rng, 1, 1, 200, 2000)
    for i in range(90, 97):
        data[i][4] = data[i][3] + 2222
    data[30][4] = data[30][3] + 50_000
    want = {(1, i, "stuck") for i in range(90, 97)} | {(1, 30, "spike")}
    for n in (1, 60, 150):
        assert run_spikes(spark, data, partitions=n) == want


def test_regular_shares_are_normal(spark):
    rng = random.Random(4)
    two = source(rng, 1, 1, 400, 1000)
    for r in two[::7]:
        r[4] = r[3] + int(9000 * rng.lognormvariate(0, 0.1))
    two[200][4] = two[200][3] + 300_000
    steps = source(rng, 5, 1, 300, 1000, 1000)
    for r in steps:
        r[4] = r[3] + rng.choice([1000, 1000, 2000])
    for r in steps[100:108]:
        r[4] = r[3] + 1000  # a source that repeats values anyway
    assert run_spikes(spark, two + steps) == {(1, 200, "spike")}
    assert run_spikes(spark, []) == set()


def test_orphans_by_increments(spark):
    make = lambda *k: spark.createDataFrame([("t", "f", "p", x, i, -1, i // 10) for i, x in enumerate(k)], REFERENCE)
    parent = lambda *k: spark.createDataFrame([("p", x) for x in k], "parent string, ref_key long")
    waiting = lambda t: [r[0] for r in rows(t.orphans(), "ref_key")]
    tracker = OrphanTable(spark).advance(new=make(1, 2, 2, 3, None), arrived=parent(1, None))
    assert waiting(tracker) == [2, 2, 3]
    assert waiting(tracker.advance(arrived=parent(2, 2))) == [3]
    assert waiting(tracker.advance(deleted=parent(1, 77))) == [1, 3]
    assert waiting(tracker.advance(arrived=parent(1), deleted=parent(2))) == [2, 2, 3]
    assert rows(tracker.counts(), "table_name", "period", "orphans", "keys") == [("t", 0, 3, 2)]
    assert OrphanTable(spark).advance(new=make()).orphans().count() == 0


def test_reference_columns(spark):
    df = spark.createDataFrame([(1, 5, 12_000_000, "x"), (1, 5, 12_000_000, "y"), (2, None, 0, "x"), (None, 6, None, "x"), (3, 7, -1, "x")], "id int, k int, t long, ref_key string")
    got = rows(OrphanTable(spark).advance(new=references(df, "tab", "k", "p", "id", None, "t"), arrived=parents(df.where("id = 99"), "p", "k")).orphans())
    assert got == [("tab", "k", "p", 5, 1, -1, 2), ("tab", "k", "p", 6, None, -1, None), ("tab", "k", "p", 7, 3, -1, -1)]


def test_orphans_follow_a_stream(spark, tmp_path):
    """Parents come late and are deleted; a new object goes on where the first one stopped, and a batch that comes again counts once."""
    schema = "kind string, table_name string, field_name string, parent string, ref_key long, key_1 long, key_2 long, period long"
    put = lambda kind, *keys, at: spark.createDataFrame([(kind, "t", "f", "p", k, k, -1, 0) for k in keys], schema).write.parquet(f"{tmp_path}/in/{at}")

    def run():
        table = OrphanTable(spark, f"{tmp_path}/state", buckets=4)
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        query = table.follow(stream).option("checkpointLocation", f"{tmp_path}/c").start()
        query.processAllAvailable()
        query.stop()
        return table

    put("reference", 1, 2, 3, at="a")
    assert rows(run().orphans(), "ref_key") == [(1,), (2,), (3,)]
    put("arrived", 1, 2, at="b")
    assert rows(run().orphans(), "ref_key") == [(3,)]
    put("deleted", 2, at="c")
    table = run()
    assert rows(table.orphans(), "ref_key") == [(2,), (3,)]
    table.advance(new=spark.createDataFrame([("t", "f", "p", 9, 9, -1, 0)], REFERENCE), batch=2)  # once more
    assert rows(table.orphans(), "ref_key") == [(2,), (3,)]
    assert rows(table.snapshots(), "batch", "orphans") == [(0, 3), (1, 1), (2, 2)]
    with pytest.raises(ValueError, match="keep_references"):
        OrphanTable(spark, keep_references=False).advance(deleted=spark.createDataFrame([("p", 1)], "parent string, ref_key long"))


def test_semi_join_salted(spark):
    left = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 0), (3, 0)], "k int, v int")
    keys = spark.createDataFrame([(1,), (3,)], "k int")
    assert rows(semi_by_keys(left, keys, ["k"], bound=1, salts=4), "k", "v") == rows(left.where("k <> 2"), "k", "v") == rows(semi_by_keys(left, keys, ["k"]), "k", "v")


def test_key_stats(spark):
    rng = random.Random(5)
    data = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice([7, 8]), rng.choice([None, *range(100)]), rng.choice([None, *range(0, 130)]), 1) for _ in range(600)]
    df = spark.createDataFrame(data, "a int, b int, s long, e long, field int")
    want = []
    for name, at in (("a", 0), ("b", 1)):
        groups = defaultdict(list)
        for r in data:
            if r[at] is not None:
                groups[r[at]].append(r)
        for key, own in groups.items():
            d = [r[3] - r[2] for r in own if r[2] is not None and r[3] is not None and r[3] >= r[2]]
            t = sorted(r[2] for r in own if r[2] is not None)
            want.append((name, key, len(own), len(d), sum(d), min(d), max(d), t[0], t[-1], max(y - x for x, y in zip(t, t[1:], strict=False)), len(own) >= 0.2 * 600))
    for n in (1, 9):  # one partition, and heavy keys over several
        assert rows(key_stats(df, ["a", "b"], "s", "e", heavy_share=0.2, partitions=n)) == sorted(want, key=repr)
        assert rows(key_stats(df, ["a", "b"], "s", "e", heavy_share=0.2, partitions=n, ties=["e"])) == sorted(want, key=repr)
    same = spark.range(4000).selectExpr("1 AS a", "CAST(NULL AS long) AS s", "id AS e")  # a heavy key without times is split as well
    laid = range_sorted(same, ["a"], ["s", "e"], 8)
    assert laid.groupBy(F.spark_partition_id()).count().count() == 8
    assert rows(key_stats(same, ["a"], "s", "e", ties=["e"], partitions=8), "n", "timed", "last_start_us") == [(4000, 0, None)]
    assert rows(key_stats(df.where("a = 99"), ["a"], "s", "e")) == []
    lone = spark.createDataFrame([(1, None, None)], "a int, s long, e long")
    assert rows(key_stats(lone, ["a"], "s", "e"), "n", "timed", "min_us", "first_start_us", "widest_step_us", "heavy") == [(1, 0, None, None, None, True)]


def test_grid(spark):
    data = [("a", -30, 1.0), ("a", 5, 2.0), ("a", 5, 3.0), ("a", 9, None), ("a", 61, None), ("a", 75, 9.0), ("b", 0, 5.0), (None, 3, 1.0), ("c", None, 1.0)]
    df = spark.createDataFrame(data, "src string, t long, v double").selectExpr("*", "1 AS n", "'z' AS cell", "0 AS block")
    got = rows(regular(df, ["src"], "t", "v", width_us=10, carry_cells=3, block=2))
    want = [("a", -30, 1, 1.0, "observed"), ("a", -20, 0, 1.0, "carried"), ("a", -10, 0, 1.0, "carried"), ("a", 0, 3, 3.0, "observed"), ("a", 10, 0, 3.0, "carried"), ("a", 20, 0, 3.0, "carried"), ("a", 30, 0, 3.0, "carried"), ("a", 40, 0, None, "missing"), ("a", 50, 0, None, "missing"), ("a", 60, 1, None, "observed"), ("a", 70, 1, 9.0, "observed"), ("b", 0, 1, 5.0, "observed")]
    assert got == sorted(want, key=repr)
    assert rows(regular(df.where("t > 1000"), ["src"], "t", width_us=10)) == []
    far = spark.createDataFrame([("a", 0, 1.0), ("a", 10**15, 2.0)], "src string, t long, v double")
    want = [(0, "observed"), (10, "carried"), (20, "missing"), (30, "missing"), (10**15, "observed")]
    assert rows(regular(far, ["src"], "t", "v", width_us=10, carry_cells=1, block=2, near=1), "cell_start_us", "status") == sorted(want, key=repr)
    assert rows(regular(df.where("src = 'b'"), ["src"], "t", width_us=10), "value", "status") == [(None, "observed")]


def brute(data):
    """Gaps and periods, interval by interval."""
    found, whole, by = [], [], defaultdict(list)
    for k, s, e in data:
        if k is not None and s is not None and e is not None and s < e <= 900:
            by[k].append((s, e))
    for k, own in by.items():
        own.sort()
        start, end, n = *own[0], 0
        for s, e in own:
            if s > end:
                found.append((k, end, s))
                whole.append((k, start, end, n))
                start, n = s, 0
            n, end = n + 1, max(end, e)
        whole.append((k, start, end, n))
    return sorted(found, key=repr), sorted(whole, key=repr)


def test_gaps_and_periods(spark):
    rng = random.Random(6)
    data = [(rng.randrange(3), s, s + rng.choice([-3, 0, 2, 9, 9, 200])) for s in (rng.randrange(800) for _ in range(250))]
    data += [(0, 10, None), (None, 1, 5), (1, None, 7), (5, 100, 200), (5, 200, 300), (5, 301, 310), (6, 1, 899), (7, 5, 950), (8, 0, 10), (8, 0, 10)]
    df = spark.createDataFrame(data, "k int, s long, e long").selectExpr("*", "1 AS slice", "'q' AS entity", "0 AS covered")
    found, whole = brute(data)
    for width in (7, 10_000):
        assert rows(gaps(df, "k", "s", "e", latest=900, slice_us=width)) == found
        assert rows(periods(df, "k", "s", "e", latest=900, slice_us=width)) == whole
    assert rows(gaps(df.where("k = 99"), "k", "s", "e")) == []


def test_the_level_keeps_to_its_regime(spark):
    rng = random.Random(8)
    data = source(rng, 1, 1, 6000, 1000)
    for i, r in enumerate(data):
        far = 8.5 if rng.random() < 0.13 else 1.0
        r[4] = r[3] + int(1000 * far * rng.lognormvariate(0.25 * (i // 40 % 2), 0.25))  # wide regimes, and a level that steps
    assert run_spikes(spark, data) == set()
