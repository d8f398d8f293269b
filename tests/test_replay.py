"""Replay of decisions, audit records, enforcement evidence and the guards of the gate fit."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from flowsieve.operators import gate, integrity, replay

FEATURES = ["byte_rate", "pkt_rate"]
POLICY = gate.GatePolicy(100.0, 1)
OBS = "run_id string, window_index int, source_ip string, packets bigint, bytes bigint, duration_seconds double"


@pytest.fixture(scope="module")
def made(spark):
    w = spark.createDataFrame([("r", k, 1e16 * (k + 1), None if k == 3 else 0.1 * k, k / 10) for k in range(11)], "run_id string, window_index int, byte_rate double, pkt_rate double, p double")
    obs = spark.createDataFrame([("r", k, f"10.0.0.{s}", 1, 900 if s == 1 else 10, 5.0) for k in range(10) for s in (1, 2)], OBS)
    return replay.replayed(w.drop("p"), obs, POLICY, F.col("byte_rate") / 1.1e17, 0.45, FEATURES).cache(), obs


def test_hashes(spark, made, rows):
    found = {r["window_index"]: r for r in rows(made[0])}
    for k, r in found.items():
        text = json.dumps({"byte_rate": 1e16 * (k + 1), "pkt_rate": None if k == 3 else 0.1 * k}, sort_keys=True, separators=(",", ":"))
        assert r["input_feature_hash"] == hashlib.sha256(text.encode()).hexdigest()
    policy = {"version": POLICY.version, "byte_rate_threshold": 100.0, "consecutive_windows": 1, "rule_ttl_seconds": 15}
    assert {r["source_policy_hash"] for r in found.values()} == {hashlib.sha256(json.dumps(policy, sort_keys=True, separators=(",", ":")).encode()).hexdigest()}
    # the order of observations does not matter, a changed or repeated one does; a window without any has a hash too
    obs = made[1]
    read = lambda df: {r["window_index"]: r["source_observations_hash"] for r in df.collect()}
    base = read(replay.observation_hashes(obs))
    assert read(replay.observation_hashes(obs.orderBy(F.desc("source_ip")))) == base and len(set(base.values())) == 1
    assert read(replay.observation_hashes(obs.union(obs.limit(1))))[0] != base[0]
    assert found[10]["source_observations_hash"] == "0:0:0:0:0" != base[0]
    assert found[10]["action"] == "NONE" and found[9]["action"] == "RATE_LIMIT" and found[0]["safety_reason"] == "negative_window_prediction"


FORGED = {
    "score": ("probability", "probability + 1e-12"), "threshold": ("threshold", "0.4D"), "prediction": ("prediction", "1 - prediction"),
    "action": ("action", "string(null)"), "target": ("target_source", "'10.0.0.9'"), "reason": ("safety_reason", "'x'"),
    "features": ("input_feature_hash", "string(null)"), "observations": ("source_observations_hash", "''"), "policy": ("source_policy_hash", "string(null)"),
}


def test_every_forgery_is_found_by_name(made, rows):
    saved = made[0]
    for k, (column, value) in enumerate(FORGED.values()):
        saved = saved.withColumn(column, F.when(F.col("window_index") == k, F.expr(value)).otherwise(F.col(column)))
    report = {r["window_index"]: r["cause"] for r in rows(replay.replay_report(saved, made[0]))}
    assert report == {**dict(enumerate(FORGED)), 9: None, 10: None}
    # of several differences the first counts
    both = saved.withColumn("source_policy_hash", F.lit("z"))
    assert {r["window_index"]: r["cause"] for r in rows(replay.replay_report(both, made[0]))} == {**report, 9: "policy", 10: "policy"}
    odd = made[0].filter("window_index <> 4").union(made[0].filter("window_index = 5")).union(made[0].filter("window_index = 6").withColumn("window_index", F.lit(70)))
    report = {r["window_index"]: r["cause"] for r in rows(replay.replay_report(odd, made[0]))}
    assert report == {**dict.fromkeys(range(11)), 4: "missing", 5: "repeated", 70: "extra"}


def test_audit_records(made, rows):
    records = made[0].filter("window_index <> 2").withColumn("action", F.when(F.col("window_index") == 3, "RATE_LIMIT").otherwise(F.col("action")))
    records = records.union(records.filter("window_index = 5"))
    found = rows(replay.audit_differences(made[0], records, ["action", "safety_reason"], F.col("window_index") < 8))
    assert sorted((r["window_index"], r["field"]) for r in found) == [(2, "record"), (3, "action"), (5, "record"), (8, "unexpected"), (9, "unexpected"), (10, "unexpected")]


def test_evidence_of_all_decisions(spark, rows):
    decisions = spark.createDataFrame([("r", k, "RATE_LIMIT" if k < 6 else "NONE", "10.0.0.1" if k < 6 else None, 15) for k in range(9)],
                                      "run_id string, window_index int, action string, target_source string, rule_ttl_seconds int")
    rule = lambda source="10.0.0.1", ttl=15, act="meter:1,NORMAL", cookie="0x475402": f"cookie={cookie}, hard_timeout={ttl},ip,nw_src={source},nw_dst=10.0.0.3 actions={act}"
    lines = [(0, rule()), (1, rule("10.0.0.10")), (2, rule(ttl=0)), (3, rule(act="NORMAL")), (4, rule()), (4, rule()), (6, rule(cookie="0x1")), (7, rule()), (8, None), (40, rule())]
    flows = spark.createDataFrame([("r", k + 1, line) for k, line in lines], "run_id string, applies_to_window int, flow string")
    found = {r["window_index"]: (r["rules"], r["evidence"]) for r in rows(gate.enforcement_evidence(decisions, flows))}
    assert found == {0: (1, "ok"), 1: (1, "wrong_source"), 2: (1, "wrong_lifetime"), 3: (1, "not_metered"), 4: (2, "rule_repeated"), 5: (0, "rule_missing"),
                     6: (0, "ok"), 7: (1, "rule_without_decision"), 8: (0, "ok"), 40: (1, "rule_without_decision")}


def test_guards_of_the_fit(spark, made):
    truth = spark.createDataFrame([("10.0.0.1", 1), ("10.0.0.2", 0)], "source_ip string, is_attacker int")
    obs = lambda run: made[1].withColumn("run_id", F.lit(run))
    windows = lambda run, d: made[0].select(F.lit(run).alias("run_id"), "window_index", "prediction", F.lit(d).alias("detector_hash"))
    def fit(a, b, da="d", db="d"):
        return gate.fit_policy(obs(a), truth, windows(b, db), obs(b), truth, [2.0], [1], 0.5, detectors=(windows(a, da), windows(b, db)))
    policy, _ = fit("r1", "r2")
    assert policy.byte_rate_threshold == 4.0
    for args, text in ((("r1", "r1"), "development and validation: r1"), (("r2", "r1"), "does not come before"), (("r1", "r2", "d", "e"), "different detectors"), (("r1", "r2", None, "d"), "different detectors")):
        with pytest.raises(ValueError, match=text):
            fit(*args)


def test_categories(spark, rows):
    paths = ["a/b.py", "data/x.py", "data/x.csv", "m/checkpoints/w.pt", "m/w.pt", "models/w.txt", "results/a.png", "outputs/a.md", "tests/a.PNG", "tests/readme", "requirements-dev", "a/b.MD", ".zip",
             "checkpoints/.zip", "tests", None, "x", "a/data_prepared/b.zip"]
    files = spark.createDataFrame([(p, 1) for p in paths], "path string, bytes int")
    got = {r["path"]: r["category"] for r in rows(integrity.categorized(files))}
    assert got == dict(zip(paths, ["source_code", "source_code", "dataset", "trained_model", "other", "trained_model", "result", "output", "figure", "test", "dependency_or_config", "documentation", "other",
                                   "other", "test", "other", "other", "dataset"]))
