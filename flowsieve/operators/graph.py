"""Causal graph features per (run, window).

Everything derives from one written table of (run, window, source, switch, service)
sums, so raw events are reduced once. History is brought forward by repeating each
reduced edge for the few windows it stays visible in, which makes it an equi-join.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.functions.ordering import SLICE, lagged, sliced
from flowsieve.operators.windows import with_window
from flowsieve.schemas import GRAPH_FEATURES, OBSERVABLE
from flowsieve.session import written

RW = ["run_id", "window_start"]


def check_observable(observations: DataFrame) -> DataFrame:
    """Only the ordered observable columns may reach the graph operators."""
    if observations.columns != OBSERVABLE:
        raise ValueError("graph features accept exactly the ordered observable columns")
    return observations


def path_table(observations: DataFrame, seconds: int, decay: float) -> DataFrame:
    """One row per (run, window, source, switch, service), with packets decayed to the window end."""
    rows = with_window(check_observable(observations), seconds)
    age = F.col("window_start") + seconds - F.unix_micros("event_ts") / F.lit(1e6)
    paths = rows.groupBy(*RW, "src_ip", "switch_id", "dst_ip").agg(
        F.sum("packet_count").alias("packets"),
        F.sum(F.col("packet_count") * F.exp(-age / F.lit(float(decay)))).alias("decayed"),
    )
    return written(paths, "paths")


def edges_of(paths: DataFrame) -> DataFrame:
    return paths.groupBy(*RW, "src_ip", "dst_ip").agg(F.sum("packets").alias("packets"))


def bipartite(edges: DataFrame) -> DataFrame:
    """Degrees and edge weights of the source-service graph."""
    per_source = edges.groupBy(*RW, "src_ip").agg(F.count(F.lit(1)).alias("d")).groupBy(*RW).agg(
        F.count(F.lit(1)).alias("sources"), F.avg("d").alias("source_degree_mean"))
    per_service = edges.groupBy(*RW, "dst_ip").agg(F.count(F.lit(1)).alias("d")).groupBy(*RW).agg(
        F.count(F.lit(1)).alias("services"), F.max("d").alias("service_degree_max"))
    weights = edges.groupBy(*RW).agg(
        F.count(F.lit(1)).alias("ss_edges"), F.avg("packets").alias("edge_packets_mean"),
        F.max("packets").cast("double").alias("edge_packets_max"),
    )
    return weights.join(per_source, RW).join(per_service, RW)


def normalized_weights(edges: DataFrame, seconds: int) -> DataFrame:
    """Packet shares of the edges; undefined (null) as soon as one edge carries nothing."""
    w = F.col("packets").cast("double")
    totals = edges.groupBy(*RW).agg(
        F.sum(w).alias("_t"), F.min(w).alias("_least"), F.max(w).alias("_most"), F.avg(w).alias("_mean"),
        F.sum(F.when(w > 0, w * F.log2(w))).alias("_wlogw"),
    )
    usable = F.col("_least") > 0
    return totals.select(
        *RW,
        F.when(usable, F.col("_most") / F.col("_t")).alias("edge_weight_share_max"),
        F.when(usable, F.greatest(F.log2("_t") - F.col("_wlogw") / F.col("_t"), F.lit(0.0))).alias("edge_weight_share_entropy"),
        (F.col("_mean") / F.lit(float(seconds))).alias("edge_packet_rate_mean"),
    )


def switch_graph(paths: DataFrame) -> DataFrame:
    """Distinct pairs and triples through switches."""
    per_switch = lambda end: (
        paths.select(*RW, "switch_id", end).distinct().groupBy(*RW, "switch_id").agg(F.count(F.lit(1)).alias(f"_{end}")))
    degrees = per_switch("src_ip").join(per_switch("dst_ip"), [*RW, "switch_id"])
    switches = degrees.groupBy(*RW).agg(
        F.count(F.lit(1)).alias("switch_nodes"), F.sum("_src_ip").alias("source_switch_edges"),
        F.sum("_dst_ip").alias("switch_service_edges"), F.max(F.col("_src_ip") + F.col("_dst_ip")).alias("switch_degree_max"),
    )
    triples = paths.groupBy(*RW).agg(F.count(F.lit(1)).alias("path_count"))
    return switches.join(triples, RW)


def arrival_context(observations: DataFrame, seconds: int) -> DataFrame:
    """Arrival gaps and spread of flow counts, over all events of a run window."""
    rows = with_window(observations, seconds).select(
        *RW, F.unix_micros("event_ts").alias("us"), "flow_count", "src_ip", "dst_ip", "switch_id")
    order = ["us", "src_ip", "dst_ip", "switch_id", "flow_count"]
    gaps = lagged(sliced(rows, RW, order), RW, order, "us", "_before").withColumn(
        "gap", (F.col("us") - F.col("_before")) / F.lit(1e6))
    return gaps.drop(SLICE).groupBy(*RW).agg(
        F.coalesce(F.avg("gap"), F.lit(0.0)).alias("arrival_gap_mean"),
        F.coalesce(F.stddev_pop("gap"), F.lit(0.0)).alias("arrival_gap_std"),
        F.stddev_pop("flow_count").alias("event_flow_std"),
        F.count(F.lit(1)).alias("_events"),
    ).drop("_events")


def _forward(df: DataFrame, seconds: int, steps: int) -> DataFrame:
    """Each row once per later window it is history for, with ``_step`` windows in between."""
    ahead = F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("_step")
    return df.select("*", ahead).withColumn("window_start", F.col("window_start") + F.col("_step") * seconds)


def history_edges(observations: DataFrame, paths: DataFrame, seconds: int, history: int, decay: float) -> tuple[DataFrame, DataFrame]:
    """Distinct historical pairs and decayed packets, keyed by the window that sees them.

    A whole window of history is carried by its reduced edges. When the history length is
    not a multiple of the window length, its oldest window is only partly visible; those
    events are filtered by age before they are reduced.
    """
    whole = history // seconds - 1
    pairs, decays = [], []
    if whole > 0:
        reduced = paths.groupBy(*RW, "src_ip", "dst_ip").agg(F.sum("decayed").alias("decayed"))
        moved = _forward(reduced, seconds, whole)
        pairs.append(moved.select(*RW, "src_ip", "dst_ip"))
        per_window = _forward(paths.groupBy(*RW).agg(F.sum("decayed").alias("decayed")), seconds, whole)
        decays.append(per_window.select(*RW, (F.col("decayed") * F.exp(-F.col("_step") * seconds / F.lit(float(decay)))).alias("decayed")))
    if history % seconds:
        step = history // seconds
        end = F.col("window_start") + (step + 1) * seconds
        epoch = F.unix_micros("event_ts") / F.lit(1e6)
        partial = with_window(observations, seconds).filter(epoch >= end - history)
        shifted = partial.select(
            "run_id", (F.col("window_start") + step * seconds).alias("window_start"), "src_ip", "dst_ip",
            (F.col("packet_count") * F.exp(-(end - epoch) / F.lit(float(decay)))).alias("decayed"))
        pairs.append(shifted.select(*RW, "src_ip", "dst_ip"))
        decays.append(shifted.groupBy(*RW).agg(F.sum("decayed").alias("decayed")))
    if not pairs:
        empty = paths.filter(F.lit(False))
        return empty.select(*RW, "src_ip", "dst_ip"), empty.select(*RW, "decayed")
    united_pairs, united_decays = pairs[0], decays[0]
    for p, d in zip(pairs[1:], decays[1:]):
        united_pairs, united_decays = united_pairs.unionByName(p), united_decays.unionByName(d)
    return united_pairs.distinct(), united_decays.groupBy(*RW).agg(F.sum("decayed").alias("decayed"))


def temporal(observations: DataFrame, paths: DataFrame, edges: DataFrame, seconds: int, history: int, decay: float) -> DataFrame:
    """History size, shares of new and returning edges, and time-decayed packets."""
    past, decayed = history_edges(observations, paths, seconds, history, decay)
    present = edges.groupBy(*RW).agg(F.count(F.lit(1)).alias("_edges"))
    # one hash pass over current and past edges instead of two set operations
    both = (
        edges.select(*RW, "src_ip", "dst_ip", F.lit(1).alias("_now"), F.lit(0).alias("_then"))
        .unionByName(past.select(*RW, "src_ip", "dst_ip", F.lit(0).alias("_now"), F.lit(1).alias("_then")))
        .groupBy(*RW, "src_ip", "dst_ip").agg(F.max("_now").alias("_now"), F.max("_then").alias("_then"))
        .groupBy(*RW).agg(F.sum("_then").alias("historical_edges"), F.sum(F.col("_now") * F.col("_then")).alias("_back"))
    )
    return present.join(both, RW).join(decayed, RW, "left").select(
        *RW, "historical_edges",
        ((F.col("_edges") - F.col("_back")) / F.col("_edges")).alias("new_edge_fraction"),
        F.coalesce("decayed", F.lit(0.0)).alias("decayed_packets"),
        (F.col("_back") / F.col("_edges")).alias("returning_edge_fraction"),
    )


def switch_shares(paths: DataFrame) -> DataFrame:
    """Packet share of each switch inside its run window."""
    per_switch = paths.groupBy(*RW, "switch_id").agg(F.sum("packets").alias("_p"))
    totals = per_switch.groupBy(*RW).agg(F.sum("_p").alias("_t"))
    return per_switch.join(totals, RW).select(
        *RW, "switch_id", F.try_divide(F.col("_p").cast("double"), F.col("_t")).alias("local_switch_packet_share"))


def run_window_features(
    observations: DataFrame, seconds: int, history: int, decay: float, paths: DataFrame | None = None, wanted: Sequence[str] = GRAPH_FEATURES,
) -> DataFrame:
    """Graph features shared by the rows of a run window; only the families of ``wanted`` are computed."""
    paths = path_table(observations, seconds, decay) if paths is None else paths
    edges = edges_of(paths)
    need = lambda *names: any(n in wanted for n in names)
    joined = bipartite(edges)
    if need("switch_nodes", "source_switch_edges", "switch_service_edges", "switch_degree_max", "path_count", "active_switches"):
        joined = joined.join(switch_graph(paths), RW).withColumn("active_switches", F.col("switch_nodes"))
    if need("arrival_gap_mean", "arrival_gap_std", "event_flow_std"):
        joined = joined.join(arrival_context(observations, seconds), RW)
    if need("historical_edges", "new_edge_fraction", "decayed_packets", "returning_edge_fraction"):
        joined = joined.join(temporal(observations, paths, edges, seconds, history, decay), RW)
    if need("edge_weight_share_max", "edge_weight_share_entropy", "edge_packet_rate_mean"):
        joined = joined.join(normalized_weights(edges, seconds), RW)
    return joined


def graph_features(
    observations: DataFrame, windows: DataFrame, seconds: int = 5, history: int = 30, decay: float = 15.0, wanted: Sequence[str] = GRAPH_FEATURES,
) -> DataFrame:
    """One row of the wanted graph features per queried window row."""
    if windows.columns != ["row_id", "run_id", "window_start", "switch_id", "dst_ip"]:
        raise ValueError("window queries must not carry labels or outcomes")
    if seconds <= 0 or history < 0 or not math.isfinite(decay) or decay <= 0:
        raise ValueError("window, history and decay must be positive")
    paths = path_table(observations, seconds, decay)
    rows = windows.join(run_window_features(observations, seconds, history, decay, paths, wanted), RW)
    if "local_switch_packet_share" in wanted:
        rows = rows.join(switch_shares(paths), [*RW, "switch_id"], "left")
    return rows.select("row_id", *wanted)
