from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from flowsieve.operators import decide, gate

OBS = "run_id string, window_index int, source_ip string, packets bigint, bytes bigint, duration_seconds double"


def observe(spark, data):
    return spark.createDataFrame([("r", w, ip, 1, b, 1.0) for w, ip, b in data], OBS)


def decide_all(spark, data, policy, predictions):
    w = spark.createDataFrame([("r", i, p) for i, p in enumerate(predictions)], "run_id string, window_index int, prediction int")
    out = gate.select_sources(w, gate.checked_observations(observe(spark, data)), policy).collect()
    return {r.window_index: (r.action, r.target_source, r.safety_reason) for r in out}


A, B = "10.0.0.1", "10.0.0.2"


def test_persistence_of_two(spark):
    out = decide_all(spark, [(0, A, 200), (1, A, 200)], gate.GatePolicy(100, 2), [1, 1])
    assert out[0] == ("NONE", None, "insufficient_source_evidence") and out[1] == ("RATE_LIMIT", A, "unique_persistent_rate_exceedance")


def test_below_threshold_ambiguous_and_negative(spark):
    assert decide_all(spark, [(0, A, 900), (0, B, 10)], gate.GatePolicy(1000, 1), [1])[0][0] == "NONE"
    assert decide_all(spark, [(0, A, 200), (0, B, 300)], gate.GatePolicy(100, 1), [1])[0][2] == "ambiguous_sources"
    assert decide_all(spark, [(0, A, 200)], gate.GatePolicy(100, 1), [0])[0][2] == "negative_window_prediction"
    assert decide_all(spark, [(0, A, 200)], gate.GatePolicy(None, 2), [1])[0][2] == "policy_abstains"


def test_absence_breaks_a_streak_and_empty_windows_stay(spark):
    out = decide_all(spark, [(0, A, 200), (1, B, 5), (2, A, 200)], gate.GatePolicy(100, 2), [1, 1, 1, 1])
    assert out[2][1] is None and out[3][2] == "insufficient_source_evidence" and len(out) == 4


def test_streaks_advance_without_prediction(spark):
    assert decide_all(spark, [(0, A, 200), (1, A, 200)], gate.GatePolicy(100, 2), [0, 1])[1][1] == A


def test_streak_lengths(spark):
    data = [(0, A, 200), (1, A, 200), (2, A, 50), (3, A, 200), (5, A, 200), (0, B, 1)]
    out = {(r.source_ip, r.window_index): r.streak for r in gate.streaks(observe(spark, data), 100).collect()}
    assert out == {(A, 0): 1, (A, 1): 2, (A, 2): 0, (A, 3): 1, (A, 5): 1, (B, 0): 0}


def test_contract(spark):
    for bad in ([(0, "10.0.0.256", 1)], [(0, A, -1)], [(0, A, 1), (0, A, 2)]):
        with pytest.raises(Exception, match="telemetry|duplicate"):
            gate.checked_observations(observe(spark, bad)).collect()
    with pytest.raises(ValueError):
        gate.checked_observations(observe(spark, [(0, A, 1)]).withColumn("label", F.lit(1)))
    report = gate.index_report(spark.createDataFrame([("r", 1), ("r", 2), ("s", 0), ("s", 1)], "run_id string, window_index int"), ["run_id"])
    assert {r.run_id: r.consecutive for r in report.collect()} == {"r": False, "s": True}


def test_policy_limits():
    for kw in ({"byte_rate_threshold": -1}, {"byte_rate_threshold": float("inf")}, {"byte_rate_threshold": 1, "consecutive_windows": 4}, {"byte_rate_threshold": 1, "rule_ttl_seconds": 31}):
        with pytest.raises(ValueError):
            gate.GatePolicy(**kw)


def test_fit_prefers_the_larger_threshold(spark):
    rows = [(w, A, 50) for w in range(3)] + [(0, B, 0), (1, B, 500), (2, B, 0)]
    obs = observe(spark, rows)
    early = obs.withColumn("run_id", F.lit("q"))
    roles = spark.createDataFrame([(A, 0), (B, 1)], "source_ip string, is_attacker int")
    w = spark.createDataFrame([("r", 0, 0), ("r", 1, 1), ("r", 2, 0)], "run_id string, window_index int, prediction int")
    policy, table = gate.fit_policy(early, roles, w, obs, roles, [1, 1.25, 1.5, 2], [1, 2], 0.01)
    assert (policy.byte_rate_threshold, policy.consecutive_windows) == (100.0, 1)
    chosen = table.filter("selected").collect()
    assert len(chosen) == 1 and (chosen[0].attack_targets, chosen[0].benign_targets, chosen[0].benign_opportunities) == (1, 0, 3)
    none, _ = gate.fit_policy(early, roles, w, obs, roles, [20], [1], 0.01)
    assert none.byte_rate_threshold is None and none.consecutive_windows == 2
    with pytest.raises(ValueError, match="without truth"):
        gate.fit_policy(early, roles, w, obs, roles.filter("is_attacker = 1"), [1], [1], 0.01)
    with pytest.raises(ValueError, match="no benign validation traffic"):
        gate.fit_policy(early, roles, w, obs, roles.withColumn("is_attacker", F.lit(1)), [1], [1], 0.01)
    with pytest.raises(ValueError, match="development and validation"):
        gate.require_separate_runs(obs, obs)
    gate.require_separate_runs(obs, obs.withColumn("run_id", F.lit("other")))


def test_published_grid_selects_its_row(spark):
    # fixed values: rows of a published candidate grid (threshold, persistence, benign targets, attack targets, multiplier)
    top = 2565933.0
    rows = [(m, p, top * m, b, a) for m, p, b, a in [
        (1.0, 1, 0, 13), (1.0, 2, 0, 11), (1.25, 1, 0, 16), (1.25, 2, 0, 13), (1.5, 1, 0, 17), (1.5, 2, 0, 13), (2.0, 1, 0, 15), (2.0, 2, 0, 11)]]
    table = spark.createDataFrame(rows, "multiplier double, persistence int, threshold double, benign_targets bigint, attack_targets bigint").withColumn("benign_target_rate", F.lit(0.0))
    chosen = gate.choose_policy(table, 0.01).filter("selected").collect()
    assert [(r.threshold, r.persistence) for r in chosen] == [(3848899.5, 1)]


def test_counter_deltas(spark):
    polls = [(0, A, 10, 100), (1, A, 15, 150), (3, A, 20, 160), (4, A, 5, 170), (1, B, 7, 70)]
    df = spark.createDataFrame([("r", 0, ip, i, p, b) for i, ip, p, b in polls], "run_id string, window_index int, source_ip string, poll_index int, packets bigint, bytes bigint")
    out = {(r.source_ip, r.poll_index): (r.packets, r.bytes) for r in gate.counter_deltas(df).collect()}
    assert out == {(A, 1): (5, 50), (A, 3): (20, 160), (A, 4): (0, 10), (B, 1): (7, 70)}
    w = gate.poll_windows(gate.counter_deltas(df), 5).first()
    assert (w.events, w.flow_count, w.pkt_sum, w.unique_src) == (3, 4.0, 32.0, 2)


def test_dominant_source_ties(spark):
    df = spark.createDataFrame([("r", 0, B, 5, 1, 1.0), ("r", 0, A, 5, 1, 1.0), ("r", 0, "10.0.0.9", 1, 1, 1.0)], OBS)
    assert gate.dominant_source(df).first().dominant_source == A


def test_severities(spark):
    df = spark.createDataFrame([(50, 100), (100, 100), (101, 100), (350, 100), (5000, 100), (3, 0)], "p int, t int")
    assert [r[0] for r in df.select(decide.threshold_severity(F.col("p"), F.col("t"))).collect()] == [0, 0, 1, 3, 10, 3]
    df = spark.createDataFrame([(0.25, True), (0.35, True), (0.04, True), (0.99, True), (0.99, False)], "p double, d boolean")
    assert [r[0] for r in df.select(decide.probability_severity(F.col("p"), F.col("d"))).collect()] == [2, 4, 1, 10, 0]


def test_window_scores_never_block(spark):
    df = spark.createDataFrame([(None, 0.99, 1), (0.99, 0.99, 1), (0.6, None, 1), (None, None, 1000)], "flow_score double, window_score double, packet_count int")
    out = [(r.method, r.action) for r in decide.routed(df).collect()]
    assert out == [("ml_window", "RATE_LIMIT"), ("ml_flow", "BLOCK"), ("ml_flow", "RATE_LIMIT"), ("threshold", "BLOCK")]
    assert {r.method for r in decide.routed(df, "threshold").collect()} == {"threshold"}
    with pytest.raises(ValueError):
        decide.routed(df, "other")


def test_disabled_enforcement_keeps_the_proposal(spark):
    d = spark.createDataFrame([("RATE_LIMIT", A)], "action string, target_source string")
    r = gate.enforced(d, F.lit(False)).first()
    assert (r.action, r.target_source, r.proposed_action, r.proposed_target) == ("NONE", None, "RATE_LIMIT", A)
