"""Column contracts shared by sources and operators."""

from __future__ import annotations

from pyspark.sql import types as T

# fixed values: canonical feature order
FEATURES = [
    "pkt_rate", "byte_rate", "pkt_sum", "events",
    "unique_src", "src_ip_entropy", "flow_count", "flow_rate",
]

# fixed values: external window table header
WINDOW_COLUMNS = [
    "dataset_id", "scenario_id", "source_file", "segment_id",
    "window_start_epoch", "window_start_ts", "window_end_ts",
    "pkt_rate", "byte_rate", "pkt_sum", "events",
    "unique_src", "src_ip_entropy", "flow_count", "flow_rate",
    "label", "target_label", "target_eligible", "attack_fraction",
    "raw_rows", "label_types", "timestamp_basis", "measurement_type",
]

# fixed values: columns the graph operators may see, and the feature set of each policy
OBSERVABLE = [
    "event_ts", "run_id", "src_ip", "dst_ip",
    "switch_id", "packet_count", "byte_count", "flow_count",
]
BIPARTITE = [
    "ss_edges", "sources", "services", "source_degree_mean",
    "service_degree_max", "edge_packets_mean", "edge_packets_max",
]
SWITCH = [
    *BIPARTITE, "switch_nodes", "source_switch_edges", "switch_service_edges",
    "switch_degree_max", "path_count", "local_switch_packet_share",
]
CONTEXT = [*SWITCH, "arrival_gap_mean", "arrival_gap_std", "event_flow_std", "active_switches"]
TEMPORAL = [*BIPARTITE, "historical_edges", "new_edge_fraction", "decayed_packets", "returning_edge_fraction"]
NORMALIZED = [
    "ss_edges", "sources", "services", "source_degree_mean", "service_degree_max",
    "edge_weight_share_max", "edge_weight_share_entropy", "edge_packet_rate_mean",
]
GRAPH_POLICIES = {
    "source_service_bipartite_graph": BIPARTITE,
    "source_switch_service_graph": SWITCH,
    "controller_context_graph": CONTEXT,
    "temporal_edge_graph": TEMPORAL,
    "normalized_edge_weight_graph": NORMALIZED,
    "imitation_regularized_classifier": TEMPORAL,
    "temporal_graph_with_risk_selector": TEMPORAL,
}
BASELINE_POLICY = "ml_window_baseline"
GRAPH_FEATURES = [*CONTEXT, *(c for c in TEMPORAL + NORMALIZED if c not in CONTEXT)]
GRAPH_FEATURES = list(dict.fromkeys(GRAPH_FEATURES))

FLOW = T.StructType([
    T.StructField("dataset_id", T.StringType()),
    T.StructField("scenario_id", T.StringType()),
    T.StructField("source_file", T.StringType()),
    T.StructField("ts_epoch", T.DoubleType()),
    T.StructField("packets", T.DoubleType()),
    T.StructField("bytes", T.DoubleType()),
    T.StructField("src", T.StringType()),
    T.StructField("is_attack", T.IntegerType()),
    T.StructField("is_target", T.IntegerType()),
    T.StructField("is_other", T.IntegerType()),
    T.StructField("label_text", T.StringType()),
    T.StructField("timestamp_basis", T.StringType()),
])

OBSERVATION = T.StructType([
    T.StructField("source_ip", T.StringType()),
    T.StructField("packets", T.LongType()),
    T.StructField("bytes", T.LongType()),
    T.StructField("duration_seconds", T.DoubleType()),
])

RECEIVER_REPORT = T.StructType([
    T.StructField("error", T.StringType()),
    T.StructField("end", T.StructType([
        T.StructField("sum_received", T.StructType([
            T.StructField("bits_per_second", T.DoubleType()),
            T.StructField("lost_percent", T.DoubleType()),
        ])),
    ])),
])
