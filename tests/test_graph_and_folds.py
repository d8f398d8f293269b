from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from flowsieve.operators import folds, graph, windows
from flowsieve.schemas import GRAPH_FEATURES, OBSERVABLE

SCHEMA = "event_ts double, run_id string, src_ip string, dst_ip string, switch_id string, packet_count bigint, byte_count bigint, flow_count bigint"
# window [100,105): a>s1 twice, b>s2; [105,110): a>s1, c>s1; [130,135): a>s1 (100.0 is 35 s, 105.0 exactly 30 s before its end)
DATA = [
    (100.0, "r", "a", "s1", "w1", 2, 1, 1), (101.0, "r", "a", "s1", "w2", 4, 1, 3), (103.0, "r", "b", "s2", "w1", 2, 1, 0),
    (105.0, "r", "a", "s1", "w1", 5, 1, 1), (109.0, "r", "c", "s1", "w2", 5, 1, 1), (130.0, "r", "a", "s1", "w1", 3, 1, 0),
    (131.0, "q", "a", "s1", "w1", 3, 1, 0),
]


def observed(spark, data=DATA):
    return spark.createDataFrame(data, SCHEMA).withColumn("event_ts", F.timestamp_micros((F.col("event_ts") * 1_000_000).cast("bigint"))).select(*OBSERVABLE)


def features(spark, data=DATA):
    o = observed(spark, data)
    query = windows.with_window(o, 5).select("run_id", "window_start", "switch_id", "dst_ip").distinct().withColumn(
        "row_id", F.concat_ws("|", "run_id", "window_start", "switch_id", "dst_ip")).select("row_id", "run_id", "window_start", "switch_id", "dst_ip")
    return {r["row_id"]: r.asDict() for r in graph.graph_features(o, query).collect()}


def test_hand_derived_window(spark):
    row = features(spark)["r|100|w1|s1"]
    assert (row["ss_edges"], row["sources"], row["services"], row["source_degree_mean"], row["service_degree_max"]) == (2, 2, 2, 1.0, 1)
    assert (row["edge_packets_mean"], row["edge_packets_max"], row["switch_nodes"], row["path_count"]) == (4.0, 6.0, 2, 3)
    assert (row["source_switch_edges"], row["switch_service_edges"], row["switch_degree_max"]) == (3, 3, 4)
    assert row["arrival_gap_mean"] == pytest.approx(1.5) and row["arrival_gap_std"] == pytest.approx(0.5)
    assert row["event_flow_std"] == pytest.approx(math.sqrt(14 / 9))
    assert row["edge_weight_share_max"] == pytest.approx(0.75) and row["edge_weight_share_entropy"] == pytest.approx(-(0.75 * math.log2(0.75) + 0.25 * math.log2(0.25)))
    assert row["local_switch_packet_share"] == pytest.approx(0.5) and row["historical_edges"] == 0 and row["decayed_packets"] == 0
    assert list(row) == ["row_id", *GRAPH_FEATURES]


def test_history_reaches_exactly_thirty_seconds(spark):
    row = features(spark)["r|130|w1|s1"]
    # 105.0 and 109.0 are visible from the window that ends at 135, the window at 100 is not
    assert (row["historical_edges"], row["new_edge_fraction"], row["returning_edge_fraction"]) == (2, 0.0, 1.0)
    assert row["decayed_packets"] == pytest.approx(5 * math.exp(-30 / 15) + 5 * math.exp(-26 / 15))


def test_runs_do_not_share_history(spark):
    assert features(spark)["q|130|w1|s1"]["historical_edges"] == 0


def test_past_only_equals_full_run(spark):
    full, past = features(spark), features(spark, [d for d in DATA if d[0] < 110])
    assert {k: full[k] for k in past} == past


def test_changing_services_changes_features(spark):
    moved = [(*d[:3], f"t{i}", *d[4:]) if i % 2 else d for i, d in enumerate(DATA)]
    assert {r["services"] for r in features(spark, moved).values()} != {r["services"] for r in features(spark).values()}


def test_zero_weight_shares_are_undefined(spark):
    row = features(spark, [(100.0, "r", "a", "s1", "w1", 0, 1, 1), (101.0, "r", "b", "s1", "w1", 4, 1, 1)])["r|100|w1|s1"]
    assert row["edge_weight_share_max"] is None and row["edge_weight_share_entropy"] is None and row["edge_packet_rate_mean"] == pytest.approx(0.4)


def test_labels_are_refused(spark):
    with pytest.raises(ValueError):
        graph.check_observable(observed(spark).withColumn("label", F.lit(1)))


def run_windows(spark, runs=8, overlap=0):
    data = [(f"row{r}-{w}", f"run{r}", r * 1000 + w * 5, r * 1000 + w * 5 + 5 + overlap, w % 2, f"sc{w % 3}") for r in range(runs) for w in range(4)]
    return spark.createDataFrame(data, "row_id string, run_id string, window_start bigint, window_end bigint, label int, scenario_id string")


def assigned(spark, **kw):
    options = {"first": 4, "validation": 2, "size": 1, **kw}
    return folds.fold_runs(folds.ranked_runs(folds.run_bounds(run_windows(spark))), options["first"], options["validation"], options["size"], options.get("folds"))


def test_two_expanding_folds(spark):
    out = {}
    for r in assigned(spark).collect():
        out.setdefault((r.fold, r.role), set()).add(r.run_id)
    assert {k: len(v) for k, v in out.items()} == {(0, "train"): 4, (0, "validation"): 2, (0, "test"): 1, (1, "train"): 5, (1, "validation"): 2, (1, "test"): 1}
    assert out[0, "test"] == {"run6"} and out[1, "test"] == {"run7"}
    a = assigned(spark)
    assert folds.shared_runs(a).count() == 0
    plan, ranked = folds.FoldPlan(4, 2, 1), folds.ranked_runs(folds.run_bounds(run_windows(spark)))
    report = folds.governance(folds.fold_summary(run_windows(spark), ranked, plan), folds.overlapping_parts(folds.fold_ranges(ranked, plan))).collect()
    assert len(report) == 2 and all(all(v for k, v in r.asDict().items() if k != "fold") for r in report)


@pytest.mark.parametrize(("first", "validation", "size"), [(4, 2, 1), (3, 5, 2), (1, 1, 3), (2, 1, 1)])
def test_fold_summaries_equal_their_members(spark, first, validation, size):
    w = run_windows(spark, 17).filter("row_id <> 'row5-1'")
    ranked = folds.ranked_runs(folds.run_bounds(w))
    plan = folds.FoldPlan(first, validation, size)
    ranks = {r.run_id: r.run_rank for r in ranked.collect()}
    members: dict = {}
    for r in folds.fold_runs(ranked, first, validation, size).collect():
        members.setdefault((r.fold, r.role), set()).add(ranks[r.run_id])
    ranges = {(r.fold, r.role): set(range(r.low, r.high)) for r in folds.fold_ranges(ranked, plan).collect()}
    assert members == ranges and len(ranges) == 3 * ((17 - first - validation) // size)
    rows, named = [r.asDict() for r in w.collect()], {v: k for k, v in ranks.items()}
    inside = lambda part: [r for r in rows if r["run_id"] in {named[k] for k in ranges[part]}]
    for r in folds.fold_summary(w, ranked, plan).collect():
        held = inside((r.fold, r.role))
        assert (r.n, r.benign, r.attack, r.start, r.end, r.runs) == (
            len(held), sum(1 - x["label"] for x in held), sum(x["label"] for x in held), min(x["window_start"] for x in held), max(x["window_end"] for x in held), len(ranges[r.fold, r.role]))
    found = {(r.fold, r.role, r.scenario_id): r.n for r in folds.fold_scenario_counts(w, ranked, plan).collect()}
    assert found == {(*part, s): n for part in ranges for s in ("sc0", "sc1", "sc2") if (n := sum(x["scenario_id"] == s for x in inside(part)))}


def test_overlapping_parts_are_found(spark):
    ranges = spark.createDataFrame([(0, "train", 0, 4), (0, "validation", 4, 6), (0, "test", 6, 7), (1, "train", 0, 5), (1, "validation", 4, 6), (1, "test", 6, 7)], "fold int, role string, low bigint, high bigint")
    assert [r.fold for r in folds.overlapping_parts(ranges).collect()] == [1]


def test_too_many_folds_fail(spark):
    with pytest.raises(Exception, match="two folds"):
        assigned(spark, folds=100).collect()
    with pytest.raises(Exception, match="two folds"):
        assigned(spark, first=6).collect()


def test_overlapping_runs_are_reported(spark):
    fine = folds.ranked_runs(folds.run_bounds(run_windows(spark)))
    assert folds.run_overlaps(fine).count() == 0
    late = folds.ranked_runs(folds.run_bounds(run_windows(spark, overlap=2000)))
    assert folds.run_overlaps(late).count() == 7


def test_chronological_cut(spark):
    out = folds.chronological_split(run_windows(spark), ["window_start", "row_id"]).groupBy("role").count().collect()
    assert {r.role: r["count"] for r in out} == {"train": 19, "validation": 6, "test": 7}


def test_fit_rules(spark):
    w = run_windows(spark)
    early, late = w.filter("window_start < 4000"), w.filter("window_start >= 4000")
    folds.check_fit(early, late)
    with pytest.raises(ValueError, match="extends"):
        folds.check_fit(late, early)
    with pytest.raises(ValueError, match="classes"):
        folds.check_fit(early.filter("label = 0"), late)
    with pytest.raises(ValueError, match="both training"):
        folds.check_fit(early, late.unionByName(early.filter("run_id = 'run3'").withColumns({"window_start": F.col("window_start") + 90000, "window_end": F.col("window_end") + 90000})))


def test_leaky_columns(spark):
    names = [" Status ", "post_action_rate", "p_attack", "pkt_rate"]
    assert [r["leaky"] for r in folds.column_report(spark, names).collect()] == [True, True, True, False]
    with pytest.raises(ValueError, match="leaky"):
        folds.runtime_features(run_windows(spark), ["pkt_rate", "detected_at"])
