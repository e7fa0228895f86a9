"""The queries of :mod:`weftline.catalog.runs` in SQL (DuckDB)."""

from __future__ import annotations

BIN = 1_000_000
T0, T1 = 500_000, 2_000_000

_W = "w AS (SELECT min(aligned_begin_us) AS t0, max(end_time_us) AS t1, max(total_pes) AS n FROM processing_element)"
_P = f"w AS (SELECT {T0}::BIGINT AS t0, {T1}::BIGINT AS t1, 48 AS n)"
_NAMED = """named AS (
  SELECT e.*, m.name AS ep_name, m.collection_id, c.name AS chare_name
  FROM execution e LEFT JOIN entry_method m USING (ep_id) LEFT JOIN chare_collection c ON c.collection_id = m.collection_id
), spans AS (
  SELECT s.*, greatest(s.start_time_us, w.t0) AS cs, least(coalesce(s.end_time_us, w.t1), w.t1) AS ce, greatest(0, least(coalesce(s.end_time_us, w.t1), w.t1) - greatest(s.start_time_us, w.t0)) AS clipped_us
  FROM named s, w WHERE s.start_time_us < w.t1 AND (s.end_time_us IS NULL OR s.end_time_us > w.t0)
)"""
_IDLE = """idles AS (
  SELECT i.*, greatest(i.start_time_us, w.t0) AS cs, least(coalesce(i.end_time_us, w.t1), w.t1) AS ce, greatest(0, least(coalesce(i.end_time_us, w.t1), w.t1) - greatest(i.start_time_us, w.t0)) AS clipped_us
  FROM idle_interval i, w WHERE i.start_time_us < w.t1 AND (i.end_time_us IS NULL OR i.end_time_us > w.t0)
)"""


def _binned(of: str, name: str = "binned") -> str:
    """Bins that a span touches: those it overlaps, or the one it lies in."""
    return f"""{name}_bins AS (SELECT unnest(range(0, (SELECT greatest(1, (t1 - t0 + {BIN} - 1) // {BIN}) FROM w))) AS b),
{name} AS (
  SELECT s.*, w.t0 + b * {BIN} AS bin_start,
    CASE WHEN (s.cs - w.t0) // {BIN} = greatest(s.ce - w.t0 - 1, 0) // {BIN} THEN s.ce - s.cs ELSE greatest(0, least(s.ce, w.t0 + (b + 1) * {BIN}) - greatest(s.cs, w.t0 + b * {BIN})) END AS part
  FROM {of} s, w JOIN {name}_bins ON b BETWEEN (s.cs - w.t0) // {BIN} AND greatest(s.ce - w.t0 - 1, 0) // {BIN}
)"""


_SPANS = f"WITH {_W}, {_NAMED}"
_PART = f"WITH {_P}, {_NAMED}"
_BINS = f"{_SPANS}, {_binned('spans')}"
_LOAD = f"""{_BINS}, loads AS (SELECT pe_id, bin_start, sum(part)::BIGINT AS load_us FROM binned GROUP BY ALL),
frame AS (SELECT p.pe_id, w.t0 + b * {BIN} AS bin_start FROM processing_element p, w, binned_bins),
filled AS (SELECT pe_id, bin_start, coalesce(load_us, 0)::BIGINT AS load_us FROM frame LEFT JOIN loads USING (pe_id, bin_start))"""
_UTIL = f"""{_SPANS}, {_IDLE}, busy AS (SELECT pe_id, sum(clipped_us) AS b FROM spans GROUP BY 1), idle AS (SELECT pe_id, sum(clipped_us) AS i FROM idles GROUP BY 1),
util AS (
  SELECT p.pe_id, coalesce(b, 0)::BIGINT AS busy_time_us, coalesce(i, 0)::BIGINT AS idle_time_us, w.t1 - w.t0 AS window_us,
    (w.t1 - w.t0 - coalesce(b, 0) - coalesce(i, 0))::BIGINT AS overhead_us, coalesce(b, 0)::DOUBLE / (w.t1 - w.t0) AS utilization, coalesce(i, 0)::DOUBLE / (w.t1 - w.t0) AS idle_fraction
  FROM processing_element p CROSS JOIN w LEFT JOIN busy USING (pe_id) LEFT JOIN idle USING (pe_id)
)"""


def _top(each: str, keys: str, n: int) -> str:
    return f"""totals AS (SELECT ep_id, ep_name, sum(total_us) AS grand FROM {each} GROUP BY ALL),
best AS (SELECT ep_id, min(ep_name) AS label FROM (SELECT *, row_number() OVER (ORDER BY grand DESC, ep_id, ep_name NULLS FIRST) AS r FROM totals) WHERE r <= {n} GROUP BY ep_id),
folded AS (
  SELECT {keys}, b.ep_id AS ep_id, CASE WHEN b.ep_id IS NULL THEN 'Other' ELSE b.label END AS label, sum(total_us)::BIGINT AS total_us
  FROM {each} e LEFT JOIN best b ON b.ep_id = e.ep_id GROUP BY ALL
)"""


def _time_profile(value: str, n: int, digits: int = 6) -> str:
    return f"""{_BINS}, {_IDLE}, {_binned('idles', 'idle_binned')}, each AS (SELECT bin_start, ep_id, ep_name, sum(part) AS total_us FROM binned GROUP BY ALL), {_top('each', 'bin_start', n)},
rows AS (SELECT * FROM folded UNION ALL SELECT bin_start, NULL, 'Idle', sum(part)::BIGINT FROM idle_binned GROUP BY bin_start)
SELECT *, round({value}, {digits}) AS value FROM rows"""


def _usage(value: str, n: int) -> str:
    return f"""{_SPANS}, {_IDLE}, each AS (SELECT pe_id, ep_id, ep_name, sum(clipped_us) AS total_us FROM spans GROUP BY ALL), {_top('each', 'pe_id', n)},
rows AS (SELECT * FROM folded UNION ALL SELECT pe_id, NULL, 'Idle', sum(clipped_us)::BIGINT FROM idles WHERE pe_id IN (SELECT pe_id FROM each) GROUP BY pe_id)
SELECT *, round({value}, 6) AS value FROM rows"""


def _histogram(values: str, n: int, log: bool = False, extra: str = "", digits: int = 6) -> str:
    v = "log10(v)" if log else "v"
    low, high = ("pow(10, lo + bin * width)", "pow(10, lo + (bin + 1) * width)") if log else ("lo + bin * width", "lo + (bin + 1) * width")
    return f"""vals AS (SELECT {v} AS v FROM ({values}) WHERE v IS NOT NULL {'AND v > 0' if log else ''}),
ends AS (SELECT min(v) AS lo, max(v) AS hi, (max(v) - min(v)) / {n} AS width FROM vals),
slots AS (SELECT least(floor((v - lo) / width), {n - 1})::INTEGER AS bin, count(*) AS c FROM vals, ends GROUP BY 1),
bins AS (SELECT unnest(range(0, {n}))::INTEGER AS bin)
SELECT bin, round({low}, {digits}) AS low, round({high}, {digits}) AS high, coalesce(c, 0)::BIGINT AS count{extra} FROM bins CROSS JOIN ends LEFT JOIN slots USING (bin)"""


_NOISE = f"""{_SPANS}, {_IDLE},
medians AS (SELECT ep_id, median(wall_duration_us) AS m FROM spans GROUP BY 1),
slow AS (SELECT 'execution' AS kind, pe_id, start_time_us AS time_us, trunc(wall_duration_us - m)::BIGINT AS noise_us FROM spans JOIN medians USING (ep_id) WHERE wall_duration_us - m >= 100),
occupied AS (SELECT pe_id, start_time_us AS s, coalesce(end_time_us, start_time_us) AS e FROM spans UNION ALL SELECT pe_id, start_time_us, coalesce(end_time_us, start_time_us) FROM idles),
covered AS (SELECT *, max(e) OVER (PARTITION BY pe_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM occupied),
gaps AS (SELECT 'idle_gap' AS kind, pe_id, c AS time_us, s - c AS noise_us FROM covered WHERE s - c >= 100)"""
_CLUSTERS = f"""{_NOISE.replace('WITH ', 'WITH RECURSIVE ', 1)}, candidates AS (SELECT *, noise_us // 100 AS bin_idx FROM slow UNION ALL SELECT *, noise_us // 100 FROM gaps),
bins AS (SELECT DISTINCT kind, bin_idx FROM candidates),
firsts AS (
  SELECT kind, min(bin_idx) AS f FROM bins GROUP BY kind
  UNION ALL SELECT kind, (SELECT min(b.bin_idx) FROM bins b WHERE b.kind = f.kind AND (b.bin_idx + 0.5) * 100 > (f.f + 0.5) * 100 * 1.1::DOUBLE) FROM firsts f WHERE f.f IS NOT NULL
), numbered AS (SELECT kind, f, row_number() OVER (ORDER BY kind, f) - 1 AS cluster_id FROM firsts WHERE f IS NOT NULL),
clusters AS (SELECT b.kind, b.bin_idx, max(n.cluster_id)::BIGINT AS cluster_id FROM bins b JOIN numbered n ON n.kind = b.kind AND n.f <= b.bin_idx GROUP BY ALL),
assigned AS (SELECT * FROM candidates JOIN clusters USING (kind, bin_idx)),
stats AS (
  SELECT cluster_id, kind, median(noise_us) AS noise_us_median, min(noise_us) AS noise_us_min, max(noise_us) AS noise_us_max, count(*) AS occurrences, count(DISTINCT pe_id) AS pe_count,
    sum(noise_us)::BIGINT AS total_noise_us, sum(noise_us) / ((w.t1 - w.t0) * w.n)::DOUBLE AS runtime_fraction
  FROM assigned, w GROUP BY cluster_id, kind, w.t0, w.t1, w.n
), steps AS (SELECT cluster_id, time_us - lag(time_us) OVER (PARTITION BY cluster_id, pe_id ORDER BY time_us) AS d FROM assigned),
periods AS (SELECT cluster_id, median(d) AS period_us, CASE WHEN avg(d) <> 0 THEN stddev_samp(d) / avg(d) END AS period_cv FROM steps WHERE d IS NOT NULL GROUP BY 1),
kept AS (SELECT * FROM stats LEFT JOIN periods USING (cluster_id) WHERE pe_count >= 2 AND runtime_fraction >= 1e-6)"""
_PLAIN_LABEL = """CASE WHEN period_cv < 0.25 THEN 'periodic daemon' WHEN noise_us_median < 1000 THEN 'sub-millisecond jitter' WHEN noise_us_median < 100000 THEN 'system interference'
  WHEN kind = 'idle_gap' THEN 'long interruption' ELSE 'long interruption during execution' END"""
_LABEL = f"""CASE WHEN round_even(noise_us_median / 1000, 0) >= 1 AND abs(noise_us_median - round_even(noise_us_median / 1000, 0) * 1000) <= 100
  THEN 'scheduler preemption (~' || round_even(noise_us_median / 1000, 0)::BIGINT || 'x quantum)' ELSE {_PLAIN_LABEL} END"""

_EVENTS = """ev AS (
  SELECT (user_id % 16)::INTEGER AS pe_id, event_id::INTEGER AS event, (list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1)::INTEGER AS kind, event_type AS name,
    (props ->> '$.k')::BIGINT AS k, epoch_us(ts) - 1704067200000000 AS s, epoch_us(ts) - 1704067200000000 + round(value * 1e6)::BIGINT AS e, value FROM events
)"""
_STEPS = f"""{_EVENTS}, of_pe AS (SELECT (s // 86400000000)::INTEGER AS step_id, pe_id, min(s) AS start_time_us, max(e) AS end_time_us FROM ev GROUP BY ALL),
steps AS (
  SELECT *, end_time_us - start_time_us AS duration_us, min(start_time_us) OVER (PARTITION BY step_id) AS global_start_time_us, max(end_time_us) OVER (PARTITION BY step_id) AS global_end_time_us,
    (count(*) OVER (PARTITION BY step_id))::INTEGER AS pe_count FROM of_pe
)"""
_BRACKETS = f"""{_EVENTS}, rec AS (SELECT pe_id, event, event % 3 AS id, event % 2 AS nested, s, kind < 3 AS b FROM ev),
run AS (SELECT *, sum(CASE WHEN b THEN 1 ELSE -1 END) OVER (PARTITION BY pe_id, id, nested ORDER BY event) AS d FROM rec),
low AS (SELECT *, least(0, min(d) OVER (PARTITION BY pe_id, id, nested ORDER BY event)) AS m FROM run),
lev AS (SELECT *, NOT b AND m < coalesce(lag(m) OVER (PARTITION BY pe_id, id, nested ORDER BY event), 0) AS lost, d - m + CASE WHEN b THEN 0 ELSE 1 END AS depth FROM low),
ok AS (SELECT *, lead(b) OVER w AS nb, lead(s) OVER w AS ns FROM lev WHERE NOT lost WINDOW w AS (PARTITION BY pe_id, id, nested, depth ORDER BY event)),
bracketed AS (
  SELECT pe_id, 98 AS record_type, id AS user_event_id, event, nested AS nested_id, s AS start_time_us, CASE WHEN NOT nb THEN ns END AS end_time_us FROM ok WHERE b
  UNION ALL SELECT pe_id, 99, id, event, nested, s, NULL FROM lev WHERE lost
)"""
_PAPI = ", ".join(
    f"{f'papi_{part}_{i}' if part != 'delta' else f'papi_end_{i} - papi_begin_{i}'} AS papi_{part}_{i}" if i < 2 else f"NULL::BIGINT AS papi_{part}_{i}" for part in ("begin", "end", "delta") for i in range(6)
)
_RUNS = """runs AS (
  SELECT pe_id, event, max(instance_id) AS instance_id, max(ep_id) AS ep_id, max(src_pe) AS src_pe, max(msg_idx) AS msg_idx, max(msg_len) AS msg_len, max(start_time_us) AS start_time_us,
    CASE WHEN max(recv_time_us) <> -1 THEN max(recv_time_us) END AS recv_time_us, max(start_cpu_us) AS start_cpu_us, max(end_time_us) AS end_time_us, coalesce(max(end_cpu_us), 0) AS end_cpu_us,
    coalesce(max(papi_begin_0), 0) AS papi_begin_0, coalesce(max(papi_end_0), 0) AS papi_end_0, coalesce(max(papi_end_1), 0) AS papi_end_1, coalesce(max(papi_begin_1), 0) AS papi_begin_1
  FROM execution GROUP BY pe_id, event
), methods AS (SELECT ep_id, max(collection_id) AS collection_id FROM entry_method GROUP BY ep_id),
keyed AS (SELECT r.*, m.collection_id AS known, coalesce(m.collection_id, (SELECT collection_id FROM entry_method ORDER BY ep_id, name LIMIT 1)) AS collection_id, coalesce(instance_id, 0)::INTEGER AS index_0 FROM runs r LEFT JOIN methods m USING (ep_id))"""

def _comm(pe: str, time: str, value: str) -> str:
    return f"WITH {_W} SELECT {pe} AS pe_id, {value}::BIGINT AS value FROM message, w WHERE {pe} IS NOT NULL AND {time} >= t0 AND {time} < t1 GROUP BY 1"


def _extrema(source: str, column: str) -> str:
    return f"{source} SELECT pe_id, round(v, 6) AS value, (row_number() OVER (ORDER BY v DESC, pe_id))::INTEGER AS rank, row_number() OVER (ORDER BY v DESC, pe_id) <= 10 AS extreme FROM (SELECT pe_id, {column}::DOUBLE AS v FROM ranked)"


_CHARE = f"""{_SPANS}, halves AS (
  SELECT run, chare_name, coalesce(t, 0) AS t, c FROM (SELECT CASE WHEN pe_id % 2 = 0 THEN 'even' ELSE 'odd' END AS run, chare_name, count(*) AS c FROM named GROUP BY ALL) n
  JOIN (SELECT CASE WHEN pe_id % 2 = 0 THEN 'even' ELSE 'odd' END AS run, coalesce(chare_name, '') AS k, sum(clipped_us) AS t FROM spans GROUP BY ALL) d USING (run) WHERE d.k = coalesce(n.chare_name, '')
), ranked AS (SELECT chare_name, (row_number() OVER (ORDER BY sum(t) DESC, chare_name NULLS FIRST))::INTEGER AS rank FROM halves GROUP BY 1)"""


def _compare(column: str) -> str:
    return f"""{_CHARE} SELECT r.run, k.chare_name, coalesce(h.{column}, 0)::BIGINT AS value, k.rank FROM ranked k CROSS JOIN (VALUES ('even'), ('odd')) r(run)
LEFT JOIN halves h ON h.run = r.run AND h.chare_name IS NOT DISTINCT FROM k.chare_name WHERE k.rank <= 12"""


def _dominant(visible: str) -> str:
    return f"""{_BINS}, loads AS (SELECT pe_id, bin_start, chare_name, sum(part)::BIGINT AS load_us FROM binned WHERE chare_name IS NOT NULL GROUP BY ALL),
best AS (SELECT chare_name, row_number() OVER (ORDER BY sum(load_us) DESC, chare_name) AS r FROM loads GROUP BY 1)
SELECT pe_id, bin_start, chare_name, load_us FROM (SELECT *, row_number() OVER (PARTITION BY pe_id, bin_start ORDER BY load_us DESC, chare_name) AS k FROM loads WHERE {visible}) WHERE k = 1"""


_EP_PROFILE = """totals AS (SELECT ep_id, ep_name, coalesce(sum(wall_duration_us), 0)::BIGINT AS total_us FROM spans GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (ORDER BY total_us DESC, ep_id, ep_name NULLS FIRST) AS r, sum(total_us) OVER () AS everything FROM totals),
shown AS (SELECT *, total_us >= everything * 1.0::DOUBLE / 100 AND r <= 12 AS shown FROM ranked)
SELECT ep_id, ep_name AS label, total_us, round(total_us * 100.0::DOUBLE / everything, 6) AS pct FROM shown WHERE shown
UNION ALL SELECT NULL, 'Other', sum(total_us)::BIGINT, round(sum(total_us) * 100.0::DOUBLE / max(everything), 6) FROM shown WHERE NOT shown HAVING sum(total_us) > 0"""
_IMBALANCE = "CASE WHEN mean > 0 THEN (most / mean - 1) * 100 ELSE 0.0 END"

SQL = {
    "idle_spans": "SELECT * FROM idle_interval",
    "entry_spans": f"{_SPANS} SELECT pe_id, event, ep_id, start_time_us, end_time_us, ep_name, collection_id, chare_name FROM named",
    "message_spans": "SELECT message_id, src_pe, m.ep_id, send_time_us, e.name AS target_ep_name FROM message m LEFT JOIN entry_method e ON e.ep_id = m.ep_id",
    "message_latency": "SELECT message_id, enqueue_time_us - send_time_us AS send_to_enqueue_us, exec_start_time_us - enqueue_time_us AS enqueue_to_exec_us, exec_start_time_us - send_time_us AS end_to_end_us FROM message LEFT JOIN entry_method USING (ep_id)",
    "span_overlap_filter": f"SELECT pe_id, event, start_time_us, end_time_us FROM execution WHERE pe_id IN (0, 5, 17) AND start_time_us < {T1} AND (end_time_us IS NULL OR end_time_us > {T0})",
    "point_filter": f"SELECT message_id, send_time_us FROM message WHERE send_time_us >= {T0} AND send_time_us < {T1}",
    "sample_filter": f"SELECT * FROM memory_sample WHERE time_us BETWEEN {T0} AND {T1}",
    "clipped_durations": f"{_PART} SELECT pe_id, event, clipped_us FROM spans",
    "clipped_durations_run": f"{_SPANS} SELECT pe_id, event, clipped_us FROM spans",
    "bin_spans": f"{_BINS} SELECT pe_id, event, ep_name, bin_start, part AS bin_contribution_us FROM binned",
    "chare_duration_totals": f"{_SPANS} SELECT chare_name, sum(clipped_us)::BIGINT AS total_duration_us FROM spans GROUP BY 1",
    "chare_frequency_counts": f"{_SPANS} SELECT chare_name, count(*) AS execution_count FROM named GROUP BY 1",
    "chare_activity_duration": f"{_SPANS} SELECT pe_id, chare_name, sum(clipped_us)::BIGINT AS activity FROM spans GROUP BY ALL",
    "chare_activity_frequency": f"{_SPANS} SELECT pe_id, chare_name, count(*) AS activity FROM spans GROUP BY ALL",
    "pe_load_by_bin": f"{_LOAD} SELECT * FROM filled",
    "percent_imbalance_by_bin": f"{_LOAD}, m AS (SELECT bin_start, max(load_us) AS most, avg(load_us) AS mean FROM filled GROUP BY 1) SELECT bin_start, most AS max_load_us, round(mean, 6) AS mean_load_us, round({_IMBALANCE}, 6) AS percent_imbalance FROM m",
    "cumulative_imbalance": f"""{_SPANS}, ends AS (SELECT min(start_time_us) AS lo, max(start_time_us) AS hi FROM named),
points AS (SELECT lo + i * ((hi - lo)::DOUBLE / 99) AS p FROM ends, range(1, 100) g(i)),
loads AS (SELECT p, pe_id % 4 AS node, sum(wall_duration_us) AS load FROM points JOIN named ON start_time_us < p GROUP BY ALL),
m AS (SELECT p, max(load)::BIGINT AS most, avg(load) AS mean FROM points LEFT JOIN loads USING (p) GROUP BY p)
SELECT round(p, 6) AS time_point_us, coalesce(most, 0)::BIGINT AS max_load_us, round(coalesce(mean, 0), -3) AS mean_load_us, round({_IMBALANCE}, 6) AS percent_imbalance FROM m""",
    "chare_load_by_bin": f"{_BINS} SELECT pe_id, bin_start, chare_name, sum(part)::BIGINT AS load_us FROM binned GROUP BY ALL",
    "per_pe_utilization": f"{_UTIL} SELECT pe_id, busy_time_us, idle_time_us, window_us, overhead_us, round(utilization, 6) AS utilization, round(idle_fraction, 6) AS idle_fraction FROM util",
    "per_interval_utilization": f"{_BINS} SELECT pe_id, bin_start, sum(part)::BIGINT AS busy_us, round(least(sum(part) / {BIN}.0::DOUBLE, 1.0), 6) AS utilization FROM binned GROUP BY ALL",
    "load_imbalance_score": f"{_UTIL} SELECT round(CASE WHEN avg(utilization) > 0 THEN coalesce(stddev_samp(utilization) / avg(utilization), 0.0) ELSE 0.0 END, 6) AS score FROM util",
    "time_profile": _time_profile("total_us / 1000.0::DOUBLE", 15),
    "time_profile_pct": _time_profile(f"total_us * 100.0::DOUBLE / (48 * {BIN})", 5, 8),
    "usage_profile": _usage("total_us / 1000.0::DOUBLE", 15),
    "usage_profile_pct": _usage("total_us * 100.0::DOUBLE / CASE WHEN sum(total_us) OVER (PARTITION BY pe_id) = 0 THEN 1 ELSE sum(total_us) OVER (PARTITION BY pe_id) END", 5),
    "ep_profile": f"{_SPANS}, {_EP_PROFILE}",
    "exec_time_histogram": f"{_SPANS}, {_histogram('SELECT wall_duration_us / 1000.0::DOUBLE AS v FROM spans', 50, digits=2)}",
    "exec_time_histogram_log": f"{_SPANS}, {_histogram('SELECT wall_duration_us / 1000.0::DOUBLE AS v FROM spans', 49, True, digits=2)}",
    "exec_time_accumulated": f"{_SPANS}, {_histogram('SELECT wall_duration_us / 1000.0::DOUBLE AS v FROM spans', 50, extra=', round(coalesce(c, 0) * (lo + bin * width + lo + (bin + 1) * width) / 2, -3) AS accumulated_ms', digits=2)}",
    "message_size_histogram": f"WITH {_W}, {_histogram('SELECT msg_len::DOUBLE AS v FROM message, w WHERE send_time_us >= t0 AND send_time_us < t1', 49, True)}",
    "comm_sent_msgs": _comm("src_pe", "send_time_us", "count(*)"),
    "comm_sent_bytes": _comm("src_pe", "send_time_us", "sum(msg_len)"),
    "comm_recv_msgs": _comm("dst_pe", "exec_start_time_us", "count(*)"),
    "comm_recv_bytes": _comm("dst_pe", "exec_start_time_us", "sum(msg_len)"),
    "extrema_most_idle_time": _extrema(f"{_UTIL}, ranked AS (FROM util)", "idle_fraction"),
    "extrema_least_idle_time": _extrema(f"{_UTIL}, ranked AS (FROM util)", "utilization"),
    "extrema_overhead": _extrema(f"{_UTIL}, ranked AS (FROM util)", "overhead_us"),
    "extrema_active_entry_methods": _extrema(f"{_SPANS}, ranked AS (SELECT pe_id, count(DISTINCT ep_id) AS n FROM spans GROUP BY 1)", "n"),
    "extrema_avg_grain_size": _extrema(f"{_SPANS}, ranked AS (SELECT pe_id, avg(wall_duration_us) AS n FROM spans GROUP BY 1)", "n"),
    "memory_series": "SELECT pe_id, time_us, round(bytes / 1048576.0::DOUBLE, 6) AS value FROM memory_sample",
    "memory_envelope": "SELECT time_us, round(min(bytes / 1024.0::DOUBLE), 6) AS least, round(avg(bytes / 1024.0::DOUBLE), 6) AS mean, round(max(bytes / 1024.0::DOUBLE), 6) AS most FROM memory_sample GROUP BY 1",
    "user_stats_over_time": f"WITH {_EVENTS} SELECT kind AS stat_id, name, s AS x, round(avg(value), 6) AS value FROM ev GROUP BY ALL",
    "user_stats_user_time": f"WITH {_EVENTS} SELECT kind AS stat_id, name, k::DOUBLE AS x, round(max(value), 6) AS value FROM ev WHERE k % 2 = 0 GROUP BY kind, name, k",
    "user_stats_per_pe": f"WITH {_EVENTS} SELECT kind AS stat_id, name, pe_id, round(avg(value), 6) AS value FROM ev GROUP BY ALL",
    "noise_exec_candidates": f"{_NOISE} SELECT * FROM slow",
    "noise_idle_gaps": f"{_NOISE} SELECT * FROM gaps",
    "noise_clusters": f"{_CLUSTERS} SELECT * FROM clusters",
    "noise_summary": f"""{_CLUSTERS} SELECT cluster_id, kind, round(noise_us_median, 6) AS noise_us_median, noise_us_min, noise_us_max, occurrences, pe_count, total_noise_us,
  round(runtime_fraction, 6) AS runtime_fraction, round(period_us, 6) AS period_us, round(period_cv, 6) AS period_cv, {_LABEL} AS likely_source FROM kept""",
    "noise_summary_no_quantum": f"{_CLUSTERS} SELECT cluster_id, {_PLAIN_LABEL} AS likely_source FROM kept",
    "noise_occurrences": f"{_CLUSTERS} SELECT cluster_id, kind, pe_id, time_us, noise_us FROM assigned WHERE cluster_id IN (SELECT cluster_id FROM kept)",
    "noise_timeline": f"""{_CLUSTERS} SELECT cluster_id, greatest(0, least(49, trunc((time_us - t0) / ((t1 - t0) / 50.0::DOUBLE))))::INTEGER AS time_bin, count(*) AS value
FROM assigned, w WHERE cluster_id IN (SELECT cluster_id FROM kept) GROUP BY ALL""",
    "run_compare_duration": _compare("t"),
    "run_compare_frequency": _compare("c"),
    "activity_heatmap": f"""{_SPANS}, each AS (SELECT pe_id, chare_name, sum(clipped_us) AS a FROM spans GROUP BY ALL), ranked AS (SELECT chare_name, (row_number() OVER (ORDER BY sum(a) DESC, chare_name NULLS FIRST))::INTEGER AS position FROM each GROUP BY 1)
SELECT p.pe_id, r.chare_name, coalesce(e.a, 0)::BIGINT AS activity, r.position FROM (SELECT DISTINCT pe_id FROM each) p CROSS JOIN ranked r LEFT JOIN each e ON e.pe_id = p.pe_id AND e.chare_name IS NOT DISTINCT FROM r.chare_name""",
    "dominant_chare": _dominant("true"),
    "dominant_chare_top": _dominant("chare_name IN (SELECT chare_name FROM best WHERE r <= 3)"),
    "rebuild_execution": f"""WITH {_RUNS}, ids AS (SELECT collection_id, index_0, row_number() OVER (ORDER BY min((pe_id, event))) AS instance_id FROM keyed GROUP BY ALL)
SELECT pe_id, event, i.instance_id, ep_id, src_pe, msg_idx, msg_len, start_time_us, recv_time_us, start_cpu_us, end_time_us, end_cpu_us, {_PAPI}, end_time_us - start_time_us AS wall_duration_us,
  end_cpu_us - start_cpu_us AS cpu_duration_us, start_time_us - recv_time_us AS queue_wait_us
FROM keyed k LEFT JOIN ids i ON i.collection_id = coalesce(k.known, 0) AND i.index_0 = k.index_0 WHERE end_time_us IS NOT NULL""",
    "rebuild_chare_instance": f"""WITH {_RUNS}, firsts AS (SELECT collection_id, index_0, min((pe_id, event)) AS seen FROM keyed GROUP BY ALL)
SELECT row_number() OVER (ORDER BY seen) AS instance_id, collection_id, index_0, 0 AS index_1, 0 AS index_2, 0 AS index_3, 0 AS index_4, 0 AS index_5 FROM firsts""",
    "rebuild_processing_element": """WITH g AS (SELECT coalesce(min(global_start_us), 0) AS g FROM processing_element)
SELECT pe_id, 48 AS total_pes, begin_time_us, end_time_us, g AS global_start_us, end_time_us + g - begin_time_us AS computation_duration_us, begin_time_us - g AS aligned_begin_us FROM processing_element, g""",
    "user_event_supplied": f"WITH {_EVENTS} SELECT pe_id, NULL::INTEGER AS user_event_id, NULL::VARCHAR AS name, NULL::INTEGER AS event, s AS start_time_us, NULL::BIGINT AS end_time_us, k::INTEGER AS user_supplied_int, NULL::VARCHAR AS note FROM ev",
    "user_event_bracketed_notes": f"WITH {_EVENTS} SELECT pe_id, event, s AS start_time_us, e AS end_time_us, e - s AS duration_us, 'ü ' || name AS note FROM ev",
    "rebuild_message": f"""WITH {_RUNS}, one AS (
  SELECT message_id, max(src_pe) AS src_pe, max(event) AS event, max(ep_id) AS ep_id, max(msg_idx) AS msg_idx, max(msg_len) AS msg_len, max(send_time_us) AS send_time_us, max(enqueue_time_us) AS enqueue_time_us,
    max(is_broadcast) AS is_broadcast, max(broadcast_fanout) AS broadcast_fanout FROM message GROUP BY message_id
), last AS (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY src_pe, event ORDER BY message_id DESC) = 1),
begun AS (SELECT src_pe, event, pe_id AS dst_pe, recv_time_us, start_time_us FROM runs QUALIFY row_number() OVER (PARTITION BY src_pe, event ORDER BY pe_id DESC, event DESC) = 1)
SELECT row_number() OVER (ORDER BY src_pe, event) AS message_id, src_pe, event, ep_id, msg_idx, msg_len, send_time_us, CASE WHEN enqueue_time_us > 0 THEN enqueue_time_us END AS enqueue_time_us, is_broadcast,
  CASE WHEN is_broadcast THEN coalesce(broadcast_fanout, 0) ELSE 1 END::INTEGER AS broadcast_fanout, dst_pe, recv_time_us, start_time_us AS exec_start_time_us, NULL::BIGINT AS end_to_end_us
FROM last LEFT JOIN begun USING (src_pe, event)""",
    "migration_episode": """WITH runs AS (SELECT pe_id, event, max(instance_id) AS instance_id, max(start_time_us) AS s, max(end_time_us) AS e FROM execution GROUP BY pe_id, event),
mobile AS (SELECT instance_id, min(collection_id) AS collection_id FROM chare_instance WHERE collection_id IN (SELECT collection_id FROM chare_collection WHERE ndims >= 1) GROUP BY 1),
ordered AS (SELECT instance_id, collection_id, pe_id, event, s, lag(pe_id) OVER w AS src_pe, lag(e) OVER w AS last_end FROM runs JOIN mobile USING (instance_id) WINDOW w AS (PARTITION BY instance_id ORDER BY s, pe_id, event, e)),
moved AS (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY s, pe_id, event) AS q FROM ordered WHERE src_pe <> pe_id)
SELECT row_number() OVER (ORDER BY instance_id, q) AS migration_id, instance_id, collection_id, src_pe, pe_id AS dst_pe, last_end AS last_exec_end_src_us, s AS first_exec_start_dst_us, s - last_end AS gap_us, q::INTEGER AS migration_seq FROM moved""",
    "idle_slot": f"""WITH {_EVENTS}, m AS (SELECT pe_id, event, kind, s, last_value(CASE WHEN kind % 2 = 0 THEN s END IGNORE NULLS) OVER (PARTITION BY pe_id ORDER BY event ROWS UNBOUNDED PRECEDING) AS b FROM ev)
SELECT CASE WHEN b IS NULL THEN 0 ELSE pe_id END AS pe_id, coalesce(b, 0) AS start_time_us, s AS end_time_us, s - coalesce(b, 0) AS duration_us FROM m WHERE kind % 2 = 1""",
    "pair_toggle": f"""WITH {_EVENTS}, m AS (SELECT *, k % 10 AS serial, row_number() OVER w AS n, lead(s) OVER w AS closing FROM ev WINDOW w AS (PARTITION BY pe_id, k % 10 ORDER BY event))
SELECT pe_id, kind AS user_event_id, name, serial::INTEGER AS event, event % 2 AS nested_id, s AS start_time_us, closing AS end_time_us, closing - s AS duration_us FROM m WHERE n % 2 = 1""",
    "pair_brackets": f"WITH {_BRACKETS} SELECT * FROM bracketed",
    "user_event_points": f"WITH {_EVENTS} SELECT pe_id, kind AS user_event_id, name, event, s AS start_time_us, NULL::BIGINT AS end_time_us FROM ev",
    "user_event_notes": f"WITH {_EVENTS} SELECT pe_id, s AS start_time_us, 'ü ' || name AS note FROM ev",
    "rebuild_user_stat": f"WITH {_EVENTS} SELECT pe_id, kind AS stat_id, name, s AS time_us, value AS stat_value, CASE WHEN k % 2 = 0 THEN k::DOUBLE END AS user_time_s FROM ev",
    "rebuild_memory_sample": f"WITH {_EVENTS} SELECT pe_id, s AS time_us, k * 1048576 AS bytes FROM ev",
    "rebuild_steps": f"""WITH {_BRACKETS}, closed AS (
  SELECT * FROM (SELECT pe_id, user_event_id, nested_id, start_time_us, end_time_us FROM bracketed)
  UNION ALL SELECT pe_id, kind, event % 2, s, closing FROM (SELECT *, row_number() OVER w AS n, lead(s) OVER w AS closing FROM ev WINDOW w AS (PARTITION BY pe_id, k % 10 ORDER BY event)) WHERE n % 2 = 1
), of_pe AS (SELECT nested_id AS step_id, pe_id, min(start_time_us) AS start_time_us, max(end_time_us) AS end_time_us FROM closed WHERE user_event_id = 1 GROUP BY ALL)
SELECT *, min(start_time_us) OVER (PARTITION BY step_id) AS global_start_time_us, max(end_time_us) OVER (PARTITION BY step_id) AS global_end_time_us, (count(*) OVER (PARTITION BY step_id))::INTEGER AS pe_count FROM of_pe""",
    "simulation_step": f"WITH {_STEPS} SELECT * FROM steps",
    "step_attribution": f"WITH {_STEPS} SELECT v.pe_id, v.event, t.step_id FROM ev v JOIN steps t ON t.pe_id = v.pe_id AND v.s >= t.start_time_us AND v.e <= t.end_time_us",
    "ep_totals": "SELECT ep_id, total_us, mean_us, n, name FROM (SELECT ep_id, sum(wall_duration_us)::BIGINT AS total_us, round(avg(wall_duration_us), 6) AS mean_us, count(*) AS n FROM execution GROUP BY 1) JOIN entry_method USING (ep_id)",
    "pe_balance": "SELECT max(t)::BIGINT AS most_us, round(max(t) / avg(t), 6) AS balance FROM (SELECT sum(wall_duration_us) AS t FROM execution GROUP BY pe_id)",
    "pe_summary": "SELECT pe_id, sum(wall_duration_us)::BIGINT AS total_us, count(*) AS n, round(avg(wall_duration_us), 6) AS mean_us FROM execution GROUP BY 1",
}
SQL["convert_execution"] = SQL["rebuild_execution"]
SQL["timeline_with_imbalance"] = f"""SELECT d.*, i.percent_imbalance, i.max_load_us FROM ({SQL['dominant_chare']}) d JOIN ({SQL['percent_imbalance_by_bin']}) i USING (bin_start)"""
