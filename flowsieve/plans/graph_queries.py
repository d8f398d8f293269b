"""Queries over the graph features."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsieve.operators import graph, windows
from flowsieve.plans import tables
from flowsieve.plans.registry import Registry
from flowsieve.plans.tables import DECAY, HISTORY, WINDOW, oracle, rounded, sql_place, sql_round
from flowsieve.schemas import BIPARTITE, CONTEXT, GRAPH_FEATURES, GRAPH_POLICIES, NORMALIZED, OBSERVABLE, SWITCH, TEMPORAL

R = Registry()
RW = graph.RW

_CTE = {
    "ed": "SELECT run_id, window_start, src_ip, dst_ip, CAST(sum(packet_count) AS DOUBLE) AS pk FROM ev GROUP BY ALL",
    "sdeg": """SELECT run_id, window_start, count(*) AS sources, avg(d) AS source_degree_mean FROM
      (SELECT run_id, window_start, src_ip, count(*) AS d FROM ed GROUP BY ALL) GROUP BY ALL""",
    "ddeg": """SELECT run_id, window_start, count(*) AS services, max(d) AS service_degree_max FROM
      (SELECT run_id, window_start, dst_ip, count(*) AS d FROM ed GROUP BY ALL) GROUP BY ALL""",
    "wgt": """SELECT run_id, window_start, count(*) AS ss_edges, avg(pk) AS edge_packets_mean, max(pk) AS edge_packets_max,
      max(pk) / sum(pk) AS edge_weight_share_max, greatest(log2(sum(pk)) - sum(pk * log2(pk)) / sum(pk), 0) AS edge_weight_share_entropy,
      avg(pk) / 10800 AS edge_packet_rate_mean FROM ed GROUP BY ALL""",
    "swd": """SELECT run_id, window_start, switch_id, count(DISTINCT src_ip) AS a, count(DISTINCT dst_ip) AS b FROM ev GROUP BY ALL""",
    "swg": """SELECT run_id, window_start, count(*) AS switch_nodes, CAST(sum(a) AS BIGINT) AS source_switch_edges,
      CAST(sum(b) AS BIGINT) AS switch_service_edges, max(a + b) AS switch_degree_max FROM swd GROUP BY ALL""",
    "pth": """SELECT run_id, window_start, count(*) AS path_count FROM
      (SELECT DISTINCT run_id, window_start, src_ip, switch_id, dst_ip FROM ev) GROUP BY ALL""",
    "gap": """SELECT run_id, window_start, coalesce(avg(g), 0) AS arrival_gap_mean, coalesce(stddev_pop(g), 0) AS arrival_gap_std,
      stddev_pop(flow_count) AS event_flow_std FROM
      (SELECT *, (us - lag(us) OVER (PARTITION BY run_id, window_start ORDER BY us)) / 1e6 AS g FROM ev) GROUP BY ALL""",
    "hist": """SELECT w.run_id, w.window_start, e.src_ip, e.dst_ip, e.packet_count, w.window_start + 10800 - e.us / 1e6 AS age
      FROM (SELECT DISTINCT run_id, window_start FROM ev) w JOIN ev e ON e.run_id = w.run_id AND e.window_start < w.window_start
        AND e.us / 1e6 >= w.window_start + 10800 - 64800""",
    "hp": "SELECT DISTINCT run_id, window_start, src_ip, dst_ip FROM hist",
    "hc": "SELECT run_id, window_start, count(*) AS historical_edges FROM hp GROUP BY ALL",
    "hd": "SELECT run_id, window_start, sum(packet_count * exp(-age / 32400)) AS decayed_packets FROM hist GROUP BY ALL",
    "back": """SELECT ed.run_id, ed.window_start, count(*) AS n, count(hp.src_ip) AS r FROM ed LEFT JOIN hp
      ON ed.run_id = hp.run_id AND ed.window_start = hp.window_start AND ed.src_ip = hp.src_ip AND ed.dst_ip = hp.dst_ip GROUP BY ALL""",
    "shr": """SELECT run_id, window_start, switch_id, p / sum(p) OVER (PARTITION BY run_id, window_start) AS share
      FROM (SELECT run_id, window_start, switch_id, sum(packet_count) AS p FROM ev GROUP BY ALL)""",
    "allf": """SELECT wf.row_id, wf.run_id, wf.window_start, sources, source_degree_mean, services, service_degree_max, ss_edges,
      edge_packets_mean, edge_packets_max, edge_weight_share_max, edge_weight_share_entropy, edge_packet_rate_mean,
      switch_nodes, source_switch_edges, switch_service_edges, switch_degree_max, path_count, arrival_gap_mean, arrival_gap_std,
      event_flow_std, switch_nodes AS active_switches, coalesce(historical_edges, 0) AS historical_edges,
      coalesce(decayed_packets, 0) AS decayed_packets, (n - r) / n::DOUBLE AS new_edge_fraction, r / n::DOUBLE AS returning_edge_fraction,
      share AS local_switch_packet_share
    FROM wf JOIN sdeg USING (run_id, window_start) JOIN ddeg USING (run_id, window_start) JOIN wgt USING (run_id, window_start)
    JOIN swg USING (run_id, window_start) JOIN pth USING (run_id, window_start) JOIN gap USING (run_id, window_start)
    JOIN back USING (run_id, window_start) LEFT JOIN hc USING (run_id, window_start) LEFT JOIN hd USING (run_id, window_start)
    JOIN shr USING (run_id, window_start, switch_id)""",
}
_COUNTS = {"ss_edges", "sources", "services", "service_degree_max", "switch_nodes", "source_switch_edges",
           "switch_service_edges", "switch_degree_max", "path_count", "active_switches", "historical_edges"}


def _pick(names, source, keys):
    exprs = [f"{n}" if n in _COUNTS else f"{sql_place(n)} AS {n}" for n in names]
    return oracle(f"SELECT DISTINCT {keys}, {', '.join(exprs)} FROM {source}", **_CTE)


def _observed(spark, folder):
    return tables.events(spark, folder).select(*OBSERVABLE)


def _paths(spark, folder):
    return graph.path_table(_observed(spark, folder), WINDOW, DECAY)


@R.add("e1_bipartite", _pick(BIPARTITE, "allf", "run_id, window_start"))
def bipartite(spark, folder):
    return rounded(graph.bipartite(graph.edges_of(_paths(spark, folder))).select(*RW, *BIPARTITE))


@R.add("e2_switch_graph", _pick(["switch_nodes", "source_switch_edges", "switch_service_edges", "switch_degree_max", "path_count"],
                                "allf", "run_id, window_start"))
def switch_graph(spark, folder):
    return graph.switch_graph(_paths(spark, folder))


@R.add("e3_arrival_context", _pick(["arrival_gap_mean", "arrival_gap_std", "event_flow_std"], "allf", "run_id, window_start"))
def arrival_context(spark, folder):
    return rounded(graph.arrival_context(_observed(spark, folder), WINDOW))


@R.add("e4_temporal", _pick(["historical_edges", "new_edge_fraction", "decayed_packets", "returning_edge_fraction"], "allf", "run_id, window_start"))
def temporal(spark, folder):
    observed, paths = _observed(spark, folder), _paths(spark, folder)
    return rounded(graph.temporal(observed, paths, graph.edges_of(paths), WINDOW, HISTORY, DECAY))


@R.add("e4_temporal_partial_window", oracle(f"""SELECT w.run_id, w.window_start, coalesce(h.pairs, 0) AS historical_edges,
      {sql_round({'decayed_packets': 'coalesce(h.d, 0)'})} FROM (SELECT DISTINCT run_id, window_start FROM ev) w
      LEFT JOIN agg h USING (run_id, window_start)""",
      near=_CTE["hist"].replace("64800", "40000"),
      agg="""SELECT run_id, window_start, count(DISTINCT src_ip || '>' || dst_ip) AS pairs,
        sum(packet_count * exp(-age / 32400)) AS d FROM near GROUP BY ALL"""))
def temporal_partial_window(spark, folder):
    observed, paths = _observed(spark, folder), _paths(spark, folder)
    t = graph.temporal(observed, paths, graph.edges_of(paths), WINDOW, 40000, DECAY)
    return rounded(t.select(*RW, "historical_edges", "decayed_packets"))


@R.add("e5_normalized_weights", _pick(["edge_weight_share_max", "edge_weight_share_entropy", "edge_packet_rate_mean"], "allf", "run_id, window_start"))
def normalized_weights(spark, folder):
    return rounded(graph.normalized_weights(graph.edges_of(_paths(spark, folder)), WINDOW))


@R.add("e6_switch_share", oracle(f"SELECT run_id, window_start, switch_id, {sql_round({'local_switch_packet_share': 'share'})} FROM shr", **_CTE))
def switch_share(spark, folder):
    return rounded(graph.switch_shares(_paths(spark, folder)))


def _full(spark, folder, wanted=GRAPH_FEATURES):
    e = tables.events(spark, folder)
    query = windows.switch_windows(e, WINDOW).select("row_id", "run_id", "window_start", "switch_id", "dst_ip")
    return graph.graph_features(e.select(*OBSERVABLE), query, WINDOW, HISTORY, DECAY, wanted)


@R.add("e7_graph_features", _pick(list(dict.fromkeys(CONTEXT + TEMPORAL + NORMALIZED)), "allf", "row_id"))
def graph_features(spark, folder):
    return rounded(_full(spark, folder))


for _name, _columns in GRAPH_POLICIES.items():
    if _name in ("imitation_regularized_classifier", "temporal_graph_with_risk_selector"):
        continue  # same columns as the temporal policy

    def _policy(spark, folder, columns=_columns):
        return rounded(_full(spark, folder, columns))

    R.add(f"e8_{_name}", _pick(_columns, "allf", "row_id"))(_policy)


@R.add("d6_arrival_gaps", oracle(f"""SELECT run_id, window_start, {sql_round({'arrival_gap_mean': 'arrival_gap_mean', 'arrival_gap_std': 'arrival_gap_std'})}
      FROM gap""", **_CTE))
def arrival_gaps(spark, folder):
    return rounded(graph.arrival_context(_observed(spark, folder), WINDOW).select(*RW, "arrival_gap_mean", "arrival_gap_std"))


@R.add("f8_history_interval_pairs", oracle("SELECT * FROM hp", **_CTE))
def history_interval_pairs(spark, folder):
    observed, paths = _observed(spark, folder), _paths(spark, folder)
    past, _ = graph.history_edges(observed, paths, WINDOW, HISTORY, DECAY)
    # an edge also reaches windows that saw no event; only queried windows count
    return past.join(paths.select(*RW).distinct(), RW, "left_semi")


@R.add("g6_distinct_edges", oracle("""SELECT run_id, window_start,
      count(DISTINCT src_ip || '>' || dst_ip) AS source_service, count(DISTINCT src_ip || '>' || switch_id) AS source_switch,
      count(DISTINCT switch_id || '>' || dst_ip) AS switch_service, count(DISTINCT src_ip || '>' || switch_id || '>' || dst_ip) AS paths
      FROM ev GROUP BY ALL"""))
def distinct_edges(spark, folder):
    paths = _paths(spark, folder)
    edges = graph.edges_of(paths).groupBy(*RW).agg(F.count(F.lit(1)).alias("source_service"))
    switches = graph.switch_graph(paths).select(
        *RW, F.col("source_switch_edges").alias("source_switch"), F.col("switch_service_edges").alias("switch_service"),
        F.col("path_count").alias("paths"))
    return edges.join(switches, RW)


@R.add("g7_new_and_returning_edges", oracle("""SELECT ed.run_id, ed.window_start, ed.src_ip, ed.dst_ip, hp.src_ip IS NOT NULL AS returning
      FROM ed LEFT JOIN hp ON ed.run_id = hp.run_id AND ed.window_start = hp.window_start AND ed.src_ip = hp.src_ip AND ed.dst_ip = hp.dst_ip""", **_CTE))
def new_and_returning_edges(spark, folder):
    observed, paths = _observed(spark, folder), _paths(spark, folder)
    past, _ = graph.history_edges(observed, paths, WINDOW, HISTORY, DECAY)
    keys = [*RW, "src_ip", "dst_ip"]
    return graph.edges_of(paths).join(past.withColumn("_then", F.lit(True)), keys, "left").select(
        *keys, F.col("_then").isNotNull().alias("returning"))


QUERIES, ORACLES = R.queries, R.oracles
