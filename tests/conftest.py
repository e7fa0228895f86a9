"""One small session, and runs to test with."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
from weftline.sources.dataset import TraceDataset  # noqa: E402
from weftline.sources.schemas import SCHEMAS  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def rows(df, *columns):
    """Sorted tuples of a result."""
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def make(spark, name, dicts, only=None):
    """A trace table from partial rows."""
    schema = SCHEMAS[name]
    got = spark.createDataFrame([tuple(d.get(f.name) for f in schema) for d in dicts], "struct<" + ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in schema) + ">")
    return got.select(*only) if only else got


EXECUTIONS = [
    (0, 0, 100_000, 300_000, 0, 100, 0), (0, 1, 500_000, 800_000, 0, 200, 1), (0, 2, 1_500_000, 400_000, 0, 150, 1),
    (1, 1, 200_000, 500_000, 0, 250, 2), (1, 2, 800_000, 600_000, 1, 180, 2), (1, 1, 2_000_000, 700_000, 0, 300, 2),
    (2, 1, 150_000, 450_000, 0, 220, 3), (2, 2, 600_000, 350_000, 2, 160, 3), (2, 1, 1_800_000, 550_000, 1, 280, 3),
    (3, 1, 300_000, 600_000, 0, 240, 1), (3, 1, 900_000, 400_000, 3, 190, 2), (3, 2, 2_500_000, 300_000, 2, 210, 3),
]
IDLE = [(0, 400_000, 500_000), (0, 1_900_000, 2_500_000), (1, 700_000, 800_000), (1, 2_700_000, 3_000_000), (2, 1_000_000, 1_200_000), (2, 2_350_000, 2_500_000), (3, 50_000, 300_000), (3, 2_800_000, 3_200_000)]


def tiny_tables(spark):
    pe = [{"pe_id": i, "total_pes": 4, "begin_time_us": b, "end_time_us": e, "global_start_us": 1000, "computation_duration_us": 9_999_000, "aligned_begin_us": b - 1000} for i, (b, e) in enumerate([(1000, 10_000_000), (1100, 10_000_100), (1200, 10_000_200), (1050, 10_000_050)])]
    ex = [{"pe_id": p, "event": i + 1, "ep_id": ep, "start_time_us": s, "end_time_us": s + d, "wall_duration_us": d, "cpu_duration_us": d, "start_cpu_us": 0, "src_pe": sp, "msg_len": m, "instance_id": k, "msg_idx": 0} for i, (p, ep, s, d, sp, m, k) in enumerate(EXECUTIONS)]
    ms = [(0, 1, 200, 50_000, 1, 200_000), (0, 1, 250, 400_000, 2, 150_000), (1, 2, 180, 700_000, 3, 900_000), (0, 1, 300, 1_400_000, 3, 300_000), (2, 1, 220, 1_700_000, 1, 900_000), (3, 2, 190, 2_400_000, 0, 2_500_000)]
    me = [{"message_id": i, "src_pe": s, "event": i + 1, "ep_id": ep, "msg_idx": ep, "msg_len": n, "send_time_us": t, "is_broadcast": False, "dst_pe": d, "exec_start_time_us": x} for i, (s, ep, n, t, d, x) in enumerate(ms)]
    st = [{"pe_id": p, "stat_id": s, "name": n, "time_us": (i + 1) * 1_000_000, "stat_value": v(i, p), "user_time_s": u(i)} for p in (0, 1) for i in range(3) for s, n, v, u in ((0, "residual", lambda i, p: 10 / (i + 1) + p, lambda i: 0.5 * (i + 1)), (1, "particle count", lambda i, p: 100.0 + 10 * i + p, lambda i: None))]
    return {
        "processing_element": make(spark, "processing_element", pe), "chare_collection": make(spark, "chare_collection", [{"collection_id": 0, "name": "Main", "ndims": -1}, {"collection_id": 1, "name": "Worker", "ndims": 1}]),
        "entry_method": make(spark, "entry_method", [{"ep_id": i, "name": n, "collection_id": c, "msg_idx": i} for i, (n, c) in enumerate([("Main::main", 0), ("Worker::compute", 1), ("Worker::reduce", 1)])]),
        "chare_instance": make(spark, "chare_instance", [{"instance_id": i, "collection_id": int(i > 0)} for i in range(4)], ["instance_id", "collection_id"]),
        "execution": make(spark, "execution", ex), "message": make(spark, "message", me),
        "idle_interval": make(spark, "idle_interval", [{"pe_id": p, "start_time_us": s, "end_time_us": e, "duration_us": e - s} for p, s, e in IDLE]), "migration_episode": make(spark, "migration_episode", []),
        "user_stat": make(spark, "user_stat", st), "memory_sample": make(spark, "memory_sample", [{"pe_id": p, "time_us": (i + 1) * 1_000_000, "bytes": (64 + 16 * i + 32 * p) * 2**20} for p in (0, 1) for i in range(3)]),
    }


@pytest.fixture(scope="session")
def tiny(spark):
    return TraceDataset(spark, tiny_tables(spark))


def noisy_run(spark, covered=False):
    """4 PEs of 200 executions one after another; slow ones at regular places, and one unaccounted stretch each on three PEs."""
    ex, idle = [], []
    for p in range(4):
        t = 0
        for i in range(200):
            if p and i == 190:
                idle.append({"pe_id": p, "start_time_us": t, "end_time_us": t + 10_000, "duration_us": 10_000})
                t += 10_000
            d = 6000 if p < 3 and i % 20 == 0 else 1000
            ex.append({"pe_id": p, "event": i, "ep_id": 0, "instance_id": 0, "start_time_us": t, "end_time_us": t + d, "wall_duration_us": d, "cpu_duration_us": d, "src_pe": p, "msg_len": 8})
            t += d
    only = ["pe_id", "event", "instance_id", "ep_id", "start_time_us", "end_time_us", "wall_duration_us", "cpu_duration_us", "queue_wait_us", "msg_len", "src_pe", "recv_time_us"]
    tables = {
        "processing_element": make(spark, "processing_element", [{"pe_id": p, "total_pes": 4, "begin_time_us": 0, "end_time_us": 260_000, "global_start_us": 0, "aligned_begin_us": 0} for p in range(4)]),
        "chare_collection": make(spark, "chare_collection", [{"collection_id": 0, "name": "Worker", "ndims": 1}]), "entry_method": make(spark, "entry_method", [{"ep_id": 0, "name": "Worker::compute", "collection_id": 0, "msg_idx": 0}]),
        "chare_instance": make(spark, "chare_instance", []), "execution": make(spark, "execution", ex, only), "message": make(spark, "message", []),
        "idle_interval": make(spark, "idle_interval", idle if covered else []), "migration_episode": make(spark, "migration_episode", []),
    }
    return TraceDataset(spark, tables)


@pytest.fixture(scope="session")
def noisy(spark):
    return noisy_run(spark)
