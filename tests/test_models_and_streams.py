from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from flowsieve.operators import folds, gate, models, windows
from flowsieve.plans import tables
from flowsieve.schemas import FEATURES
from flowsieve.session import scratch_path
from flowsieve.streaming import flows

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def separable(spark):
    data = []
    for i in range(240):
        y = i % 2
        data.append((f"w{i}", f"run{i // 24}", i * 5, i * 5 + 5, y, *[float(y * 10 + (i * 7 % 5) + j) for j in range(len(FEATURES))]))
    names = ", ".join(f"{f} double" for f in FEATURES)
    return spark.createDataFrame(data, f"row_id string, run_id string, window_start bigint, window_end bigint, label int, {names}").cache()


def test_forest_separates_and_keeps_its_threshold(spark, separable):
    train, validation, test = (separable.filter(c) for c in ("window_start < 600", "window_start >= 600 AND window_start < 840", "window_start >= 840"))
    detector, curve = models.fit_detector(train, validation, trees=10)
    scored = detector.predict(test)
    assert scored.filter("prediction <> label").count() == 0 and curve.filter("selected").count() == 1
    path = scratch_path(spark, "model")
    models.save_detector(detector, path)
    again = models.load_detector(path)
    assert again.threshold == detector.threshold and again.features == FEATURES
    assert again.predict(test).agg(F.sum("probability")).first()[0] == pytest.approx(scored.agg(F.sum("probability")).first()[0])
    with pytest.raises(ValueError, match="extends"):
        models.fit_detector(test, train, trees=2)
    # another model in the folder, another schema, an edited row
    other, _ = models.fit_detector(train, validation, trees=3)
    swapped = scratch_path(spark, "model")
    models.save_detector(other, swapped)
    other.model.write().overwrite().save(f"{path}/model")
    with pytest.raises(ValueError, match="model files"):
        models.load_detector(path)
    assert models.load_detector(swapped, FEATURES).threshold == other.threshold
    with pytest.raises(ValueError, match="feature schema"):
        models.load_detector(swapped, FEATURES[::-1])
    row = spark.read.parquet(f"{swapped}/registry").withColumn("metadata", F.regexp_replace("metadata", '"threshold":', '"threshold":1')).cache()
    row.count()
    row.write.mode("overwrite").parquet(f"{swapped}/registry")
    with pytest.raises(ValueError, match="does not match its hash"):
        models.load_detector(swapped)


def test_forest_of_one_class(spark, separable):
    """Windows of many events are all attack: every row weighs 1 and has the only class; the guard of a threshold still refuses them."""
    for label in (0, 1):
        rows = separable.filter(F.col("label") == label)
        assert {r.w for r in rows.select(models.balanced_weight(rows).alias("w")).collect()} == {1.0}
        scored = models.Detector("scores", models.fit_forest(rows, FEATURES, 3), FEATURES, 0.5).score(separable)
        assert scored.count() == 240 and {r.probability for r in scored.collect()} == {float(label)}
    assert {r.w for r in separable.filter("label = 0 or window_start < 50").select(
        models.balanced_weight(separable.filter("label = 0 or window_start < 50")).alias("w")).collect()} == {125 / 240, 125 / 10}
    attack = separable.filter("label = 1")
    with pytest.raises(ValueError, match="both classes"):
        models.fit_detector(attack.filter("window_start < 600"), attack.filter("window_start >= 600"), trees=2)


def test_folds_share_checks_and_curves(spark, separable, monkeypatch):
    """Three policies of a fold need few more jobs than one: its rows, checks and thresholds are made once, its predictions written."""
    monkeypatch.setattr(models, "GRAPH_POLICIES", {"a": FEATURES[:2], "b": FEATURES[2:4]})
    assignment = folds.fold_runs(folds.ranked_runs(folds.run_bounds(separable)), 4, 1, 2)
    spark.sparkContext.setJobGroup("folds", "jobs of two folds")
    try:
        pooled, last = models.fold_predictions(separable, assignment, policies=["a", "b"], trees=2, graph_trees=2)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("folds")) < 130
    tests = {(r.fold, r.run_id) for r in assignment.filter("role = 'test'").collect()}
    rows = pooled.collect()
    assert {(r.fold, r.run_id) for r in rows} == tests and len(rows) == len({(r.policy, r.row_id) for r in rows}) == 3 * 24 * len(tests)
    assert all(r.prediction == r.label for r in rows) and {r.policy for r in rows} == {"ml_window_baseline", "a", "b"}
    assert {r.threshold for r in rows if r.fold == 1 and r.policy == last.name} == {last.threshold} and "UDF" not in pooled._jdf.queryExecution().toString()
    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    with pytest.raises(ValueError, match="both classes"):
        models.fold_predictions(separable.filter("label = 1"), assignment, trees=2)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == held


def test_thresholds_of_one_curve_are_those_of_each_policy(spark, separable):
    noisy = separable.withColumn("label", F.when(F.hash("row_id") % 5 == 0, 1 - F.col("label")).otherwise(F.col("label")))
    train, validation = noisy.filter("window_start < 600"), noisy.filter("window_start >= 600")
    drafts = [models.Detector(f"d{n}", models.fit_forest(train, FEATURES[:n], 5), FEATURES[:n], 0.0) for n in (1, 3)]
    single = [models.curves.select_threshold(models.curves.threshold_curve(d.score(validation), []), [], 0.4).first()["threshold"] for d in drafts]
    together = models.select_thresholds(drafts, validation, 0.4)
    assert [d.threshold for d in together] == single and [d.name for d in together] == ["d1", "d3"]


def test_soft_logistic_minimizes_its_objective(spark):
    data = [(i % 2 if i % 7 else 1 - i % 2, ((i * 37) % 101) / 100.0, float((i * 13) % 17) + 4 * (i % 2), float((i * 5) % 11)) for i in range(150)]
    df = spark.createDataFrame(data, "label int, teacher double, a double, b double")
    model = models.fit_soft_logistic(df, ["a", "b"], 0.25)
    w = [model.stages[-1].intercept, *model.stages[-1].coefficients]
    n = len(data)
    mean = [sum(r[2 + j] for r in data) / n for j in range(2)]
    sd = [math.sqrt(sum((r[2 + j] - mean[j]) ** 2 for r in data) / n) for j in range(2)]
    gradient = [0.0, 0.002 * w[1], 0.002 * w[2]]
    for y, teacher, *x in data:
        z = [1.0, *[(x[j] - mean[j]) / sd[j] for j in range(2)]]
        gap = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, z)))) - (y + 0.25 * teacher) / 1.25
        gradient = [g + gap * v / n for g, v in zip(gradient, z)]
    assert max(abs(g) for g in gradient) < 1e-6


def test_risk_selector_abstains(spark, separable):
    fitted = models.fit_forest(separable, FEATURES, 5)
    detector = models.Detector("temporal_graph_with_risk_selector", fitted, FEATURES, 0.0)
    out = detector.predict(separable).agg(F.sum("abstained").alias("a"), F.count_if(F.col("probability") < 0.9).alias("n")).first()
    assert out.a == out.n > 0


def test_stream_equals_batch_on_closed_windows(spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    e = tables.events(spark, SMALL)
    path = scratch_path(spark, "in")
    e.coalesce(1).write.parquet(path)
    out = flows.run_available(flows.completed_windows(spark.readStream.schema(e.schema).parquet(path), 3600, 60), scratch_path(spark, "out"))
    keys = ["run_id", "window_start", "switch_id", "dst_ip"]
    batch = windows.switch_windows(e, 3600).select(*keys, *FEATURES)
    rounded = lambda df: tables.rounded(df.select(*keys, *FEATURES), 9)
    missing = rounded(batch).exceptAll(rounded(out))
    last = e.agg(F.max(F.unix_micros("event_ts"))).first()[0] / 1e6
    assert rounded(out).exceptAll(rounded(batch)).count() == 0
    assert all(r.window_start + 3600 > last - 60.001 for r in missing.collect()) and out.count() > 100


def test_late_rows_are_dropped(spark):
    schema = "event_ts timestamp, run_id string, switch_id string, src_ip string, dst_ip string, packet_count bigint, byte_count bigint, flow_count bigint"
    def batch(*seconds):
        return spark.createDataFrame([(s, "r", "w", "a", "d", 1, 1, 1) for s in seconds], schema.replace("timestamp", "double")).withColumn(
            "event_ts", F.timestamp_seconds("event_ts"))
    path, target = scratch_path(spark, "late"), scratch_path(spark, "late-out")
    for seconds in ((1.0, 2.0), (20.0,), (3.0, 21.0), (40.0,)):
        batch(*seconds).coalesce(1).write.mode("append").parquet(path)
        out = flows.run_available(flows.completed_windows(spark.readStream.schema(schema).parquet(path), 5, 2), target)
    assert {(r.window_start, r.events) for r in out.collect()} == {(0, 2), (20, 2)}


def test_live_windows_follow_batches_and_expire(spark):
    schema = "event_ts timestamp, run_id string, switch_id string, src_ip string, dst_ip string, packet_count bigint, byte_count bigint, flow_count bigint"
    path, sink, seen = scratch_path(spark, "live-input"), flows.BatchSink(scratch_path(spark, "live")), []
    for rows in ([(1, "a"), (2, "b")], [(3, "a"), (40, "c")], [(4, "a"), (41, "c")]):
        frame = spark.createDataFrame([(float(t), "r", "w", s, "d", 1, 1, 0) for t, s in rows], schema.replace("timestamp", "double"))
        frame.withColumn("event_ts", F.timestamp_seconds("event_ts")).select(*[c.split()[0] for c in schema.split(", ")]).write.mode("append").parquet(path)
        changes = sink.run(flows.live_counts(spark.readStream.schema(schema).parquet(path), 5, 10), "update")
        seen.append({(r.window_start, r.events, r.unique_src) for r in flows.live_windows(changes, 5).collect()})
    # the last row of the first window comes behind the watermark
    assert seen == [{(0, 2, 2)}, {(0, 3, 2), (40, 1, 1)}, {(0, 3, 2), (40, 2, 1)}]


def test_rows_behind_the_watermark_are_counted(spark):
    rows = spark.createDataFrame([("r", float(t)) for t in (1, 4, 6, 11)], "run_id string, t double").withColumn("event_ts", F.timestamp_seconds("t"))
    found = flows.behind_watermark(rows, F.lit(10.0), 5).collect()
    assert {(r.window_start, r.dropped) for r in found} == {(0, 2), (5, 1)}


def test_streaming_gate_equals_batch(spark):
    data = [(0, "10.0.0.1", 200), (1, "10.0.0.1", 200), (2, "10.0.0.2", 300), (3, "10.0.0.1", 200), (3, "10.0.0.2", 300), (4, "10.0.0.1", 9), (4, "10.0.0.2", 300)]
    obs = spark.createDataFrame([("r", w, ip, 1, b, 1.0) for w, ip, b in data], "run_id string, window_index int, source_ip string, packets bigint, bytes bigint, duration_seconds double")
    marks = spark.createDataFrame([("r", w, 1) for w in range(40)], "run_id string, window_index int, prediction int")
    stamp = lambda df: df.withColumn("window_ts", F.timestamp_seconds(F.col("window_index") * 5))
    policy = gate.GatePolicy(100, 2)
    inputs = []
    for df in (stamp(obs), stamp(marks)):
        path = scratch_path(spark, "gate")
        df.coalesce(1).write.parquet(path)
        inputs.append(spark.readStream.schema(df.schema).parquet(path))
    out = flows.run_available(flows.gate_decisions(*inputs, policy, 5, 5), scratch_path(spark, "gate-out"))
    columns = ["window_index", "action", "target_source", "safety_reason", "candidate_count"]
    batch = {r.window_index: tuple(r) for r in gate.select_sources(marks, obs, policy).select(*columns).collect()}
    streamed = {r.window_index: tuple(r) for r in out.select(*columns).collect()}
    assert len(streamed) > 30 and all(batch[k] == v for k, v in streamed.items())
    assert streamed[1][2] == "10.0.0.1" and streamed[3][2] == "10.0.0.2"


def test_alert_batches_are_replaced_on_retry(spark):
    sink = flows.BatchSink(scratch_path(spark, "alerts"))
    df = spark.createDataFrame([("a",), ("b",)], "alert_id string")
    for _ in range(2):
        sink(df, 0)
    sink(df, 1)
    assert spark.read.parquet(f"{sink.path}/rows").count() == 4


@pytest.mark.parametrize("name, trees", [("i4_batch_scores", {240}), ("i8_fold_predictions", {240, 120}), ("i9_model_registry", {240})])
def test_registered_fits_grow_all_trees(spark, monkeypatch, name, trees):
    from flowsieve.plans.model_queries import QUERIES

    asked, fit = set(), models.fit_forest

    def small(train, features, trees=None, **settings):
        asked.add(trees or models.FOREST["numTrees"])
        return fit(train, features, 2, **settings)
    monkeypatch.setattr(models, "fit_forest", small)
    QUERIES[name](spark, SMALL)
    assert asked == trees
