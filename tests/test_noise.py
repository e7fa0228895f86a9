"""Planted disturbances."""

import pytest
from conftest import make, noisy_run, rows

from weftline.operators.noise import NoiseMiner, assign_clusters
from weftline.sources.dataset import TraceDataset


def by_kind(miner):
    return {r.kind: r for r in miner.summary().collect()}


def test_execution_cluster(noisy):
    got = by_kind(NoiseMiner(noisy))["execution"]
    assert (got.occurrences, got.pe_count, got.total_noise_us) == (30, 3, 150_000)
    assert got.noise_us_median == got.noise_us_min == got.noise_us_max == 5000
    assert abs(got.runtime_fraction - 150_000 / 1_040_000) < 1e-12
    assert (got.period_us, got.period_cv, got.likely_source) == (25_000, 0.0, "periodic daemon")


def test_gap_cluster(noisy, spark):
    got = by_kind(NoiseMiner(noisy))["idle_gap"]
    assert (got.occurrences, got.pe_count, got.noise_us_median, got.period_us) == (3, 3, 10_000, None)
    assert set(by_kind(NoiseMiner(noisy_run(spark, covered=True)))) == {"execution"}


def test_cutoffs(noisy):
    assert set(by_kind(NoiseMiner(noisy, importance_cutoff=0.05))) == {"execution"}
    assert NoiseMiner(noisy, importance_cutoff=0.9).summary().count() == 0
    assert NoiseMiner(noisy, min_pes=3).summary().count() == 2
    assert NoiseMiner(noisy, min_pes=4).summary().count() == 0
    with pytest.raises(ValueError, match="importance_cutoff"):
        NoiseMiner(noisy, importance_cutoff=2)


@pytest.mark.parametrize(("quantum", "label"), [(5000, "scheduler preemption (~1x quantum)"), (2500, "scheduler preemption (~2x quantum)"), (3000, "periodic daemon")])
def test_quantum(noisy, quantum, label):
    assert by_kind(NoiseMiner(noisy, quantum_us=quantum))["execution"].likely_source == label


def test_occurrences_and_timeline(noisy):
    miner = NoiseMiner(noisy)
    assert miner.occurrences().count() == 33
    assert sum(r.value for r in miner.timeline(10).collect()) == 33
    assert sum(r.value for r in miner.timeline(10, "time").collect()) == 180_000


def test_anchored_merge(spark):
    bins = spark.createDataFrame([("execution", b) for b in range(10, 15)] + [("idle_gap", 10)], "kind string, bin_idx long")
    got = rows(assign_clusters(bins, 100, 0.1), "kind", "bin_idx", "cluster_id")
    assert [c for _, _, c in got] == [0, 0, 1, 1, 2, 3]
    assert [c for _, _, c in rows(assign_clusters(bins, 100, 0.0), "kind", "bin_idx", "cluster_id")] == [0, 1, 2, 3, 4, 5]


@pytest.fixture(scope="module")
def unusable(spark):
    """1,200 of 2,600 executions on two PEs have ends that are no times: their sum is beyond bigint."""
    ex = [{"pe_id": i % 2, "event": i, "ep_id": 0, "start_time_us": i // 2 * 1000, "end_time_us": i // 2 * 1000 + d, "wall_duration_us": d} for i, d in enumerate([1000] * 1400 + [9 * 10**15] * 1200)]
    run = noisy_run(spark)
    pes = make(spark, "processing_element", [{"pe_id": p, "total_pes": 2, "begin_time_us": 0, "end_time_us": 2_600_000, "global_start_us": 0, "aligned_begin_us": 0} for p in (0, 1)])
    return TraceDataset(spark, dict(run.tables) | {"execution": make(spark, "execution", ex), "processing_element": pes})


TOTAL = 1200 * (9 * 10**15 - 1000)


def test_total_beyond_bigint(unusable):
    got = by_kind(NoiseMiner(unusable))["execution"]
    assert TOTAL > 2**63 and (int(got.total_noise_us), got.occurrences) == (TOTAL, 1200)
    assert abs(got.runtime_fraction / (TOTAL / 5_200_000) - 1) < 1e-12


def test_total_within_bigint(noisy):
    assert dict(NoiseMiner(noisy).summary().dtypes)["total_noise_us"] == "bigint"


def test_labels_beyond_bigint(unusable):
    got = NoiseMiner(unusable).summary().select("cluster_id", "likely_source").collect()
    assert [tuple(r) for r in got] == [(0, "periodic daemon")]


def test_occurrences_beyond_bigint(unusable):
    got = NoiseMiner(unusable).occurrences()
    assert got.count() == 1200 and sum(r.noise_us for r in got.collect()) == TOTAL


def test_timeline_beyond_bigint(unusable):
    miner = NoiseMiner(unusable)
    assert sum(r.value for r in miner.timeline(10).collect()) == 1200
    assert int(miner.timeline(1, "time").first().value) == TOTAL
