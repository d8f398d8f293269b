"""Streams with timers and state of their own, stopped and started again between arrivals."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from flowsieve.operators import gate
from flowsieve.session import scratch_path
from flowsieve.streaming import flows, stateful


def arriving(spark, parts, build):
    """Each part is one run of the stream; the state lives on between them."""
    source, place = scratch_path(spark, "arriving"), scratch_path(spark, "out")
    out = None
    for part in parts:
        part.write.mode("append").parquet(source)
        out = flows.run_available(build(spark.readStream.schema(part.schema).parquet(source)), place)
    return out


def windows(spark, items):
    return spark.createDataFrame([(r, i, t) for r, i, t in items], "run_id string, window_index int, t bigint").select(
        "run_id", "window_index", F.timestamp_seconds("t").alias("window_ts"))


def test_window_order(spark, rows):
    parts = [
        # out of order within the delay, a gap, and the mark of another run
        windows(spark, [("a", 1, 1010), ("a", 0, 1000), ("a", 3, 1030), ("b", 0, 1040)]),
        # a repeated index at a later time, a late row, and a window that stays open
        windows(spark, [("a", 3, 1060), ("a", 4, 1070), ("a", 9, 1001), ("b", 2, 1100), ("c", 0, 5000)]),
    ]
    found = rows(arriving(spark, parts, lambda s: stateful.window_order(s, 10, 20)))
    assert sorted((r["run_id"], r["window_index"], r["expected"], r["status"]) for r in found) == [
        ("a", 0, 0, "ok"), ("a", 1, 1, "ok"), ("a", 3, 2, "gap"), ("a", 3, 4, "step_back"), ("a", 4, 4, "ok"), ("b", 0, 0, "ok"), ("b", 2, 1, "gap")]


def test_rules_end_at_their_limit_or_with_the_next_decision(spark, rows):
    rule, none = ("RATE_LIMIT", "10.0.0.1"), ("NONE", None)
    def decisions(items):
        return spark.createDataFrame([(r, i, 1000 + 10 * i, *d, ttl) for r, i, d, ttl in items], "run_id string, window_index int, t bigint, action string, target_source string, rule_ttl_seconds int").select(
            "*", F.timestamp_seconds("t").alias("window_ts")).drop("t")
    first = [("a", 1, rule, 15), ("a", 0, rule, 15), ("b", 0, rule, 5), ("c", 0, rule, 30), ("d", 2, none, 15)]
    second = [("a", 2, none, 15), ("b", 1, none, 15), ("c", 2, none, 15), ("a", 4, rule, 15), ("z", 20, rule, 15)]
    out = arriving(spark, [decisions(first), decisions(second)], lambda s: stateful.rule_lives(s, 10, 5))
    found = {(r["run_id"], r["window_index"]): (r["target_source"], r["active_from"], r["active_until"]) for r in rows(out)}
    batch = rows(gate.rule_lifetimes(decisions(first + second), 10))
    want = {(r["run_id"], r["window_index"]): (r["target_source"], r["active_from"], r["active_until"]) for r in batch if r["run_id"] != "z"}
    assert found == want and want["a", 1] == ("10.0.0.1", 20, 30) and want["c", 0] == ("10.0.0.1", 10, 40) and want["b", 0][2] == 15


def test_running_features(spark, rows, monkeypatch):
    monkeypatch.setattr(spark, "_restore", spark.conf.get("spark.sql.streaming.stateStore.providerClass"), raising=False)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.ROCKS)
    def events(items):
        return spark.createDataFrame([("r", "s", "d", src, t, 2, 20, fl) for src, t, fl in items], "run_id string, switch_id string, dst_ip string, src_ip string, t bigint, packet_count bigint, byte_count bigint, flow_count bigint").select(
            "*", F.timestamp_seconds("t").alias("event_ts")).drop("t")
    parts = [events([("a", 1, 0), ("a", 2, 0), ("b", 3, 0)]), events([("a", 4, 0), ("c", 5, 3), (None, 6, 0)]), events([("x", 200, 0)]), events([("late", 7, 0), ("x", 201, 0)])]
    try:
        out = arriving(spark, parts, lambda s: stateful.running_windows(s, 10, 60))
        found = {(r["window_start"], r["change"]): r for r in rows(out)}
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", spark._restore)
    assert set(found) == {(0, 1), (0, 2), (200, 1), (200, 2)}
    entropy = lambda *counts: -sum(c / sum(counts) * math.log2(c / sum(counts)) for c in counts)
    one, two = found[0, 1], found[0, 2]
    assert (one["events"], one["unique_src"], one["pkt_sum"], one["flow_count"]) == (3, 2, 6, 3) and one["src_ip_entropy"] == pytest.approx(entropy(2, 1))
    # a missing source has a share of the events but is no address; the row behind the watermark changes nothing
    assert (two["events"], two["unique_src"], two["pkt_rate"], two["flow_count"]) == (6, 3, 1.2, 3) and two["src_ip_entropy"] == pytest.approx(entropy(3, 1, 1, 1))
    assert found[200, 2]["events"] == 2 and found[200, 2]["src_ip_entropy"] == 0
