"""The driver's contract."""

import duckdb
import pytest
from conftest import ROOT

import __spark_entry__ as E

DATA = "/root/testdata/sf0.001"
have_data = pytest.mark.skipif(not __import__("os").path.isdir(DATA), reason="no test tables")


def test_names():
    queries, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 70
    assert {f"p{n}_found" for n in (1, 3, 4, 5, 6)} <= set(queries)


def test_core_does_not_need_llm():
    for path in (ROOT / "weftline").rglob("*.py"):
        if "llm" not in path.parts:
            assert "weftline.llm" not in path.read_text().replace("``weftline.llm``", "")


@have_data
def test_entry_runs(spark):
    assert E.entry(spark).count() > 0


@have_data
@pytest.mark.parametrize("name", ["p3_found", "p4_stats", "p5_grid", "p6_found", "percent_imbalance_by_bin", "noise_summary", "rebuild_execution"])
def test_sql_agrees(spark, name):
    db = duckdb.connect()
    for t in ("processing_element", "chare_collection", "entry_method", "chare_instance", "execution", "message", "idle_interval", "memory_sample", "events"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = db.sql(E.oracle_sql()[name])
    columns = sorted(want.columns)
    same = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    mine = sorted([same(v) for v in r] for r in E.queries()[name](spark, DATA).select(*columns).collect())
    theirs = sorted([same(v) for v in r] for r in want.select(*columns).fetchall())
    assert mine == theirs
