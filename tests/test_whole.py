"""Queries that take the whole run, not a part of it."""

import duckdb
import pytest
from test_entry import DATA, E, have_data

from weftline.catalog.adapter import log_lines

TABLES = ("processing_element", "chare_collection", "entry_method", "chare_instance", "execution", "message", "idle_interval")
same = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def db():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return db


def both(spark, db, name):
    """The rows of a query, which its SQL must give too, and their columns."""
    want = db.sql(E.oracle_sql()[name])
    columns = sorted(want.columns)
    got = [tuple(r) for r in E.queries()[name](spark, DATA).select(*columns).collect()]
    assert sorted([same(v) for v in r] for r in got) == sorted([same(v) for v in r] for r in want.select(*columns).fetchall())
    return [dict(zip(columns, r, strict=True)) for r in got]


@have_data
def test_spans_of_the_whole_run(spark, db):
    events = db.sql("SELECT count(DISTINCT (pe_id, event)) FROM execution").fetchall()[0][0]
    for name in ("entry_spans", "clipped_durations_run"):
        assert len({(r["pe_id"], r["event"]) for r in both(spark, db, name)}) == events
    assert len({r["message_id"] for r in both(spark, db, "message_spans")}) == db.sql("SELECT count(DISTINCT message_id) FROM message").fetchall()[0][0]


@have_data
def test_totals_of_the_whole_run(spark, db):
    named = "execution LEFT JOIN entry_method USING (ep_id)"
    n, positive, total = db.sql(f"SELECT count(wall_duration_us), count(*) FILTER (wall_duration_us > 0), sum(wall_duration_us) FROM {named}").fetchall()[0]
    assert sum(r["total_us"] for r in both(spark, db, "ep_profile")) == total
    assert sum(r["count"] for r in both(spark, db, "exec_time_histogram")) == n
    assert sum(r["count"] for r in both(spark, db, "exec_time_histogram_log")) == positive
    points = [r["time_point_us"] for r in both(spark, db, "cumulative_imbalance")]
    assert len(points) == 99 and max(points) == db.sql("SELECT max(start_time_us) FROM execution").fetchall()[0][0]


@have_data
def test_all_methods_and_elements(spark, db):
    idle = both(spark, db, "idle_spans")
    assert (len(idle), len({r["pe_id"] for r in idle})) == db.sql("SELECT count(*), count(DISTINCT pe_id) FROM idle_interval").fetchall()[0]
    n = db.sql("SELECT count(wall_duration_us) FROM execution LEFT JOIN entry_method USING (ep_id)").fetchall()[0][0]
    assert sum(r["count"] for r in both(spark, db, "exec_time_accumulated")) == n


@have_data
def test_executions_without_an_end(spark, db):
    lines = log_lines(spark, DATA)
    begun, ended = db.sql("SELECT count(*), count(e) FROM (SELECT max(end_time_us) AS e FROM execution GROUP BY pe_id, event)").fetchall()[0]
    assert begun > ended and [lines.where(lines.value.startswith(c)).where("line_no < 1L << 40").count() for c in ("2 ", "3 ")] == [begun, ended]
    linked = db.sql("SELECT count(DISTINCT (m.src_pe, m.event)) FROM message m JOIN execution e ON e.src_pe = m.src_pe AND e.event = m.event").fetchall()[0][0]
    assert sum(r["dst_pe"] is not None for r in both(spark, db, "rebuild_message")) == linked
    both(spark, db, "rebuild_chare_instance")
