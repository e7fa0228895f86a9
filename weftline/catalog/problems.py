"""Queries of the general large-table problems (pN_...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.catalog.tables import table
from weftline.operators.grid import regular
from weftline.operators.heavy_keys import key_stats
from weftline.operators.intervals import gaps, periods
from weftline.operators.spikes import spikes
from weftline.streaming.orphans import OrphanTable, parents, references


def latest_end(spark: SparkSession, folder: str) -> int | None:
    """Greatest recorded end of a processing element: one small aggregate."""
    return table(spark, folder, "processing_element").agg(F.max("end_time_us")).first()[0]


def p1_flags(spark: SparkSession, folder: str) -> DataFrame:
    return spikes(table(spark, folder, "execution"), "ep_id", "pe_id", "event", "start_time_us", "end_time_us", latest=latest_end(spark, folder))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_flags(spark, folder).select(F.col("pe_id").cast("int").alias("pe_id"), F.col("event").cast("int").alias("event")).distinct()


def _parents(spark: SparkSession, folder: str) -> DataFrame:
    t = lambda name: table(spark, folder, name)
    return (
        parents(t("entry_method"), "entry_method", "ep_id").unionByName(parents(t("chare_instance"), "chare_instance", "instance_id")).unionByName(parents(t("chare_collection"), "chare_collection", "collection_id"))
    )


def _references(spark: SparkSession, folder: str) -> DataFrame:
    t = lambda name: table(spark, folder, name)
    return (
        references(t("execution"), "execution", "ep_id", "entry_method", "pe_id", "event", "start_time_us")
        .unionByName(references(t("execution"), "execution", "instance_id", "chare_instance", "pe_id", "event", "start_time_us"))
        .unionByName(references(t("message"), "message", "ep_id", "entry_method", "message_id", None, "send_time_us"))
        .unionByName(references(t("entry_method"), "entry_method", "collection_id", "chare_collection", "ep_id"))
    )


def orphan_table(spark: SparkSession, folder: str) -> OrphanTable:
    """The run's references, probed against the parents that have arrived."""
    return OrphanTable(spark, keep_references=False, snapshot_every=0).advance(_references(spark, folder), _parents(spark, folder))


def p3_increments(spark: SparkSession, folder: str) -> DataFrame:
    """(table_name, field_name, period, orphans, keys, batch): counts after each of four increments.

    All references and the parents with even keys come first, then the other
    parents; then keys divisible by 7 are deleted, and half of those come back.
    A second object goes on with the state of the first.
    """
    every = _parents(spark, folder)
    even, seventh = F.col("ref_key") % 2 == 0, F.col("ref_key") % 7 == 0
    first = OrphanTable(spark).advance(_references(spark, folder), every.where(even)).advance(arrived=every.where(~even))
    again = OrphanTable(spark, first.folder.address).advance(deleted=every.where(seventh)).advance(arrived=every.where(seventh & even))
    return again.snapshots()


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_table(spark, folder).orphans().select("table_name", "field_name", "key_1", "key_2", "period")


def p3_counts(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_table(spark, folder).counts()


def p4_stats(spark: SparkSession, folder: str) -> DataFrame:
    return key_stats(table(spark, folder, "execution"), ["ep_id", "pe_id"], "start_time_us", "end_time_us", ties=["event"])


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return p4_stats(spark, folder).where("heavy").select("field_name", "key_value")


def p5_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Starts and memory readings of a PE on a grid of 250 ms."""
    starts = table(spark, folder, "execution").select(F.lit("execution").alias("series"), "pe_id", F.col("start_time_us").alias("time_us"), F.lit(None).cast("bigint").alias("bytes"))
    memory = table(spark, folder, "memory_sample").where(F.col("bytes") > 0).select(F.lit("memory_sample").alias("series"), "pe_id", "time_us", "bytes")
    return regular(starts.unionByName(memory), ["series", "pe_id"], "time_us", "bytes")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_grid(spark, folder).where(F.col("n") == 0).select("series", "pe_id", "cell_start_us")


def _intervals(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["pe_id", "start_time_us", "end_time_us"]
    return table(spark, folder, "execution").select(*columns).unionByName(table(spark, folder, "idle_interval").select(*columns))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return gaps(_intervals(spark, folder), "pe_id", "start_time_us", "end_time_us", latest=latest_end(spark, folder))


def p6_periods(spark: SparkSession, folder: str) -> DataFrame:
    return periods(_intervals(spark, folder), "pe_id", "start_time_us", "end_time_us", latest=latest_end(spark, folder))


QUERIES = {
    "p1_found": p1_found, "p1_flags": p1_flags, "p3_found": p3_found, "p3_counts": p3_counts, "p3_increments": p3_increments, "p4_found": p4_found, "p4_stats": p4_stats,
    "p5_found": p5_found, "p5_grid": p5_grid, "p6_found": p6_found, "p6_periods": p6_periods,
}

_LATEST = "(SELECT max(end_time_us) FROM processing_element)"
_INTERVALS = f"""spans AS (
  SELECT pe_id, start_time_us AS s, end_time_us AS e FROM execution UNION ALL SELECT pe_id, start_time_us, end_time_us FROM idle_interval
), kept AS (SELECT pe_id, s, e FROM spans WHERE e > s AND e <= {_LATEST}),
marked AS (SELECT pe_id, s, e, max(e) OVER (PARTITION BY pe_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS covered FROM kept)"""
_KEY_STATS = """keyed AS (
  SELECT 'ep_id' AS field_name, ep_id::BIGINT AS key_value, start_time_us AS s, end_time_us AS e FROM execution
  UNION ALL SELECT 'pe_id', pe_id::BIGINT, start_time_us, end_time_us FROM execution
), stepped AS (SELECT *, s - lag(s) OVER (PARTITION BY field_name, key_value ORDER BY s) AS step FROM keyed)"""
_GRID = """readings AS (
  SELECT 'execution' AS series, pe_id, start_time_us AS t, NULL::DOUBLE AS v FROM execution
  UNION ALL SELECT 'memory_sample', pe_id, time_us, bytes::DOUBLE FROM memory_sample WHERE bytes > 0
), cells AS (SELECT series, pe_id, floor(t / 250000.0)::BIGINT AS cell, count(*) AS n, max_by(v, (t, v)) AS v FROM readings GROUP BY ALL),
ends AS (SELECT series, pe_id, min(cell) AS lo, max(cell) AS hi FROM cells GROUP BY ALL),
every AS (SELECT series, pe_id, unnest(range(lo, hi + 1)) AS cell FROM ends),
laid AS (
  SELECT g.series, g.pe_id, g.cell, c.n, c.v,
    last_value(c.v IGNORE NULLS) OVER w AS last_v, last_value(CASE WHEN c.v IS NOT NULL THEN g.cell END IGNORE NULLS) OVER w AS last_cell
  FROM every g LEFT JOIN cells c USING (series, pe_id, cell) WINDOW w AS (PARTITION BY g.series, g.pe_id ORDER BY g.cell)
)"""
_ORPHANS = """pending AS (
  SELECT DISTINCT 'execution' AS table_name, 'ep_id' AS field_name, pe_id::BIGINT AS key_1, event::BIGINT AS key_2, (start_time_us // 5000000)::BIGINT AS period, ep_id::BIGINT AS ref_key
  FROM execution WHERE ep_id NOT IN (SELECT ep_id FROM entry_method)
  UNION ALL SELECT DISTINCT 'execution', 'instance_id', pe_id, event, start_time_us // 5000000, instance_id FROM execution WHERE instance_id NOT IN (SELECT instance_id FROM chare_instance)
  UNION ALL SELECT DISTINCT 'message', 'ep_id', message_id, -1, send_time_us // 5000000, ep_id FROM message WHERE ep_id NOT IN (SELECT ep_id FROM entry_method)
  UNION ALL SELECT DISTINCT 'entry_method', 'collection_id', ep_id, -1, -1, collection_id FROM entry_method WHERE collection_id NOT IN (SELECT collection_id FROM chare_collection)
)"""

SQL = {
    "p3_found": f"WITH {_ORPHANS} SELECT DISTINCT table_name, field_name, key_1, key_2, period FROM pending",
    "p3_counts": f"WITH {_ORPHANS} SELECT table_name, field_name, period, count(*) AS orphans, count(DISTINCT ref_key) AS keys FROM pending GROUP BY ALL",
    "p3_increments": """WITH p AS (SELECT 'entry_method' AS parent, ep_id::BIGINT AS k FROM entry_method UNION SELECT 'chare_instance', instance_id FROM chare_instance UNION SELECT 'chare_collection', collection_id FROM chare_collection),
r AS (
  SELECT DISTINCT 'execution' AS table_name, 'ep_id' AS field_name, 'entry_method' AS parent, ep_id::BIGINT AS k, pe_id::BIGINT AS key_1, event::BIGINT AS key_2, (start_time_us // 5000000)::BIGINT AS period FROM execution WHERE ep_id IS NOT NULL
  UNION ALL SELECT DISTINCT 'execution', 'instance_id', 'chare_instance', instance_id, pe_id, event, start_time_us // 5000000 FROM execution WHERE instance_id IS NOT NULL
  UNION ALL SELECT DISTINCT 'message', 'ep_id', 'entry_method', ep_id, message_id, -1, send_time_us // 5000000 FROM message WHERE ep_id IS NOT NULL
  UNION ALL SELECT DISTINCT 'entry_method', 'collection_id', 'chare_collection', collection_id, ep_id, -1, -1 FROM entry_method WHERE collection_id IS NOT NULL
), live AS (
  SELECT 0 AS batch, parent, k FROM p WHERE k % 2 = 0 UNION ALL SELECT 1, parent, k FROM p UNION ALL SELECT 2, parent, k FROM p WHERE k % 7 <> 0 UNION ALL SELECT 3, parent, k FROM p WHERE k % 7 <> 0 OR k % 2 = 0
), waiting AS (SELECT r.*, b.batch FROM r CROSS JOIN (VALUES (0), (1), (2), (3)) b(batch) ANTI JOIN live l ON l.batch = b.batch AND l.parent = r.parent AND l.k = r.k)
SELECT table_name, field_name, period, count(*) AS orphans, count(DISTINCT k) AS keys, batch::BIGINT AS batch FROM waiting GROUP BY ALL""",
    "p4_found": f"WITH {_KEY_STATS} SELECT field_name, key_value FROM stepped GROUP BY ALL HAVING count(*) >= 0.05 * (SELECT count(*) FROM execution)",
    "p4_stats": f"""WITH {_KEY_STATS} SELECT field_name, key_value, count(*) AS n, count(*) FILTER (e >= s) AS timed, (coalesce(sum(e - s) FILTER (e >= s), 0))::BIGINT AS total_us,
  min(e - s) FILTER (e >= s) AS min_us, max(e - s) FILTER (e >= s) AS max_us, min(s) AS first_start_us, max(s) AS last_start_us, max(step) AS widest_step_us,
  count(*) >= 0.05 * (SELECT count(*) FROM execution) AS heavy FROM stepped GROUP BY ALL""",
    "p5_found": f"WITH {_GRID} SELECT series, pe_id, cell * 250000 AS cell_start_us FROM laid WHERE n IS NULL",
    "p5_grid": f"""WITH {_GRID} SELECT series, pe_id, cell * 250000 AS cell_start_us, coalesce(n, 0)::BIGINT AS n,
  CASE WHEN n IS NOT NULL THEN v WHEN cell - last_cell <= 4 THEN last_v END AS value,
  CASE WHEN n IS NOT NULL THEN 'observed' WHEN cell - last_cell <= 4 THEN 'carried' ELSE 'missing' END AS status FROM laid""",
    "p6_found": f"WITH {_INTERVALS} SELECT pe_id, covered AS gap_start_us, s AS gap_end_us FROM marked WHERE s > covered",
    "p6_periods": f"""WITH {_INTERVALS}, numbered AS (SELECT *, sum(CASE WHEN covered IS NULL OR s > covered THEN 1 ELSE 0 END) OVER (PARTITION BY pe_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS part FROM marked)
SELECT pe_id, min(s) AS period_start_us, max(e) AS period_end_us, count(*) AS intervals FROM numbered GROUP BY pe_id, part""",
}
