"""Queries over windows and their features."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsieve.operators import windows
from flowsieve.plans import tables
from flowsieve.plans.registry import Registry
from flowsieve.plans.tables import WINDOW, oracle, rounded, sql_round

R = Registry()

_FEATURE_SQL = {
    "pkt_rate": "pkt_rate", "byte_rate": "byte_rate", "pkt_sum": "pkt_sum", "src_ip_entropy": "src_ip_entropy",
    "flow_count": "flow_count", "flow_rate": "flow_rate",
}


def _flow_window_sql(source: str, keys: str, seconds: int, file: str) -> str:
    """Oracle for the external window table over twin ``source``."""
    render = lambda e: (
        f"strftime(to_timestamp({e}) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') || "
        "CASE WHEN timestamp_basis = 'unix_utc' THEN 'Z' ELSE '[timezone_unspecified]' END")
    return oracle(f"""SELECT dataset_id, scenario_id, {file} AS source_file, 0 AS segment_id, window_start AS window_start_epoch,
      {render('window_start')} AS window_start_ts, {render(f'window_start + {seconds}')} AS window_end_ts,
      {sql_round({'pkt_rate': f'pk / {seconds}', 'byte_rate': f'byt / {seconds}', 'pkt_sum': 'pk',
                  'src_ip_entropy': 'coalesce(greatest(log2(nn) - wn / nullif(nn, 0), 0), 0)', 'flow_count': 'CAST(rows AS DOUBLE)',
                  'flow_rate': f'rows / {seconds}.0::DOUBLE', 'attack_fraction': 'att / rows::DOUBLE'})},
      CAST(rows AS BIGINT) AS events, uniq AS unique_src, CAST(rows AS BIGINT) AS raw_rows,
      CASE WHEN att > 0 THEN 1 ELSE 0 END AS label, CASE WHEN tgt > 0 THEN 1 ELSE 0 END AS target_label,
      CASE WHEN oth = 0 THEN 1 ELSE 0 END AS target_eligible, label_types, timestamp_basis,
      'offline_flow_derived_diagnostic' AS measurement_type
      FROM joined""",
      per_src=f"""SELECT {keys}, timestamp_basis, window_start, CASE WHEN src IN ('', '-') THEN NULL ELSE src END AS s, count(*) AS n,
        sum(packets) AS pk, sum(bytes) AS byt, sum(is_attack) AS att, sum(is_target) AS tgt, sum(is_other) AS oth FROM {source} GROUP BY ALL""",
      texts=f"""SELECT {keys}, timestamp_basis, window_start, string_agg(DISTINCT label_text, ';' ORDER BY label_text) AS label_types
        FROM {source} GROUP BY ALL""",
      agg=f"""SELECT {keys}, timestamp_basis, window_start, sum(n) AS rows, count(s) AS uniq, sum(CASE WHEN s IS NOT NULL THEN n END) AS nn,
        sum(CASE WHEN s IS NOT NULL THEN n * log2(n) END) AS wn, sum(pk) AS pk, sum(byt) AS byt, sum(att) AS att, sum(tgt) AS tgt,
        sum(oth) AS oth FROM per_src GROUP BY ALL""",
      joined=f"SELECT * FROM agg JOIN texts USING ({keys}, timestamp_basis, window_start)")


@R.add("c1_flow_windows_per_file", _flow_window_sql("lf", "dataset_id, scenario_id, source_file", 604800, "source_file"))
def flow_windows_per_file(spark, folder):
    return rounded(windows.flow_windows(tables.line_flows(spark, folder), 604800))


@R.add("c1_flow_windows_events", _flow_window_sql("fl", "dataset_id, scenario_id, source_file", WINDOW, "source_file"))
def flow_windows_events(spark, folder):
    return rounded(windows.flow_windows(tables.flows(spark, folder), WINDOW))


@R.add("c2_scenario_windows", _flow_window_sql(
    "fl", "dataset_id, scenario_id", WINDOW, "'multiple_scenario_logs; see source_files.csv'"))
def scenario_windows(spark, folder):
    return rounded(windows.flow_windows(tables.flows(spark, folder), WINDOW, merge_files=True))


_EVENT_WINDOWS = """SELECT run_id, topology_id, scenario_id, phase, window_start, window_start + 10800 AS window_end,
      sum(n) AS ev_n, count(*) AS uniq, CAST(sum(pk) AS DOUBLE) AS pk, CAST(sum(byt) AS DOUBLE) AS byt, CAST(sum(fl) AS DOUBLE) AS fl,
      greatest(log2(sum(n)) - sum(n * log2(n)) / sum(n), 0) AS ent, max(label) AS label
    FROM (SELECT run_id, topology_id, scenario_id, phase, window_start, src_ip, count(*) AS n, sum(packet_count) AS pk,
      sum(byte_count) AS byt, sum(flow_count) AS fl, max(label) AS label FROM ev GROUP BY ALL) GROUP BY run_id, topology_id, scenario_id, phase, window_start"""


@R.add("c3_event_windows", oracle(f"""SELECT run_id, topology_id, scenario_id, phase, window_start, window_end, label,
      CAST(ev_n AS BIGINT) AS events, uniq AS unique_src, {sql_round({
          'pkt_rate': 'pk / 10800', 'byte_rate': 'byt / 10800', 'pkt_sum': 'pk', 'src_ip_entropy': 'ent',
          'flow_count': 'fl', 'flow_rate': 'fl / 10800'})} FROM ew""", ew=_EVENT_WINDOWS))
def event_windows(spark, folder):
    return rounded(windows.event_windows(tables.events(spark, folder), WINDOW))


@R.add("c4_switch_windows", oracle(f"""SELECT row_id, run_id, window_start, switch_id, dst_ip, window_end, scenario_id, label,
      events, unique_src, {sql_round(_FEATURE_SQL)} FROM wf"""))
def switch_windows(spark, folder):
    return rounded(windows.switch_windows(tables.events(spark, folder), WINDOW))


@R.add("c5_source_entropy", oracle(f"""SELECT dst_ip, {sql_round({'entropy': 'greatest(log2(sum(n)) - sum(n * log2(n)) / sum(n), 0)'})},
      CAST(sum(n) AS BIGINT) AS events, count(*) AS sources
      FROM (SELECT dst_ip, src_ip, count(*) AS n FROM ev GROUP BY ALL) GROUP BY dst_ip"""))
def source_entropy(spark, folder):
    counts = windows.source_counts(tables.events(spark, folder), ["dst_ip"], "src_ip", {})
    totals = windows.window_totals(counts, ["dst_ip"], [])
    return rounded(totals.select("dst_ip", F.col("_entropy").alias("entropy"), F.col("_events").alias("events"),
                                 F.col("_unique").alias("sources")))


@R.add("c6_distinct_sources", oracle("""SELECT run_id, window_start, count(DISTINCT src_ip) AS unique_src FROM ev GROUP BY ALL"""))
def distinct_sources(spark, folder):
    keys = ["run_id", "window_start"]
    rows = windows.with_window(tables.events(spark, folder), WINDOW)
    totals = windows.window_totals(windows.source_counts(rows, keys, "src_ip", {}), keys, [])
    return totals.select(*keys, F.col("_unique").alias("unique_src"))


@R.add("c7_window_labels", oracle(f"""SELECT dataset_id, scenario_id, window_start AS window_start_epoch,
      CASE WHEN sum(is_attack) > 0 THEN 1 ELSE 0 END AS label, CASE WHEN sum(is_target) > 0 THEN 1 ELSE 0 END AS target_label,
      CASE WHEN sum(is_other) = 0 THEN 1 ELSE 0 END AS target_eligible, count(*) AS raw_rows,
      string_agg(DISTINCT label_text, ';' ORDER BY label_text) AS label_types,
      {sql_round({'attack_fraction': 'sum(is_attack) / count(*)::DOUBLE'})} FROM fl GROUP BY ALL"""))
def window_labels(spark, folder):
    return rounded(windows.flow_window_labels(tables.flows(spark, folder), ["dataset_id", "scenario_id"], WINDOW))


@R.add("c8_window_profile", oracle("""SELECT 'all' AS dimension, 'all' AS value, count(*) AS n, min(window_start) AS "start", max(window_end) AS "end" FROM ew
      UNION ALL SELECT 'label', CAST(label AS VARCHAR), count(*), min(window_start), max(window_end) FROM ew GROUP BY label
      UNION ALL SELECT 'run_id', run_id, count(*), min(window_start), max(window_end) FROM ew GROUP BY run_id
      UNION ALL SELECT 'topology_id', topology_id, count(*), min(window_start), max(window_end) FROM ew GROUP BY topology_id
      UNION ALL SELECT 'scenario_id', scenario_id, count(*), min(window_start), max(window_end) FROM ew GROUP BY scenario_id
      UNION ALL SELECT 'phase', phase, count(*), min(window_start), max(window_end) FROM ew GROUP BY phase""", ew=_EVENT_WINDOWS))
def window_profile(spark, folder):
    return windows.window_profile(windows.event_windows(tables.events(spark, folder), WINDOW))


@R.add("d1_running_features", oracle(f"""SELECT event_id, switch_id, dst_ip, window_start, ev_n AS events, uniq AS unique_src,
      {sql_round({'pkt_rate': 'pk / 10800', 'byte_rate': 'byt / 10800', 'pkt_sum': 'pk',
                  'src_ip_entropy': 'greatest(log2(ev_n) - wn / ev_n, 0)',
                  'flow_count': 'CASE WHEN fl > 0 THEN fl ELSE ev_n END', 'flow_rate': '(CASE WHEN fl > 0 THEN fl ELSE ev_n END) / 10800.0::DOUBLE'})}
      FROM runs""",
      nth="""SELECT *, row_number() OVER (PARTITION BY switch_id, dst_ip, window_start, src_ip ORDER BY event_ts, event_id) AS n FROM ev""",
      runs="""SELECT event_id, switch_id, dst_ip, window_start, count(*) OVER w AS ev_n, CAST(sum(packet_count) OVER w AS DOUBLE) AS pk,
        CAST(sum(byte_count) OVER w AS DOUBLE) AS byt, CAST(sum(flow_count) OVER w AS DOUBLE) AS fl,
        CAST(sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS uniq,
        sum(CASE WHEN n = 1 THEN 0 ELSE n * log2(n) - (n - 1) * log2(n - 1) END) OVER w AS wn
        FROM nth WINDOW w AS (PARTITION BY switch_id, dst_ip, window_start ORDER BY event_ts, event_id ROWS UNBOUNDED PRECEDING)"""))
def running_features(spark, folder):
    return rounded(windows.running_features(tables.events(spark, folder), WINDOW))


@R.add("d2_reversal_segments", oracle("""SELECT source_file, position, CAST(sum(flag) OVER (PARTITION BY source_file ORDER BY position) AS BIGINT) AS segment_id
      FROM flagged""",
      mixed="""SELECT source_file, (position % 7919) * 1000000000000 + position AS position, ts_epoch FROM fl""",
      flagged="""SELECT *, CASE WHEN ts_epoch < lag(ts_epoch) OVER (PARTITION BY source_file ORDER BY position) THEN 1 ELSE 0 END AS flag FROM mixed"""))
def reversal_segments(spark, folder):
    rows = tables.flows(spark, folder).select(
        "source_file", ((F.col("position") % 7919) * 1_000_000_000_000 + F.col("position")).alias("position"), "ts_epoch")
    return windows.reversal_segments(rows).select("source_file", "position", F.col("segment_id").cast("bigint"))


QUERIES, ORACLES = R.queries, R.oracles
