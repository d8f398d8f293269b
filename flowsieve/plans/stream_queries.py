"""Streaming queries: each runs a stream over the given tables to completion and reads its sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsieve.operators import decide, gate, models, windows
from flowsieve.plans import tables
from flowsieve.plans.decision_queries import _DEC, _DELTA, _GATE, _POLLS, _gated, _threshold, polls
from flowsieve.plans.registry import Registry
from flowsieve.plans.tables import WINDOW, oracle, rounded, sql_round
from flowsieve.plans.window_queries import _FEATURE_SQL
from flowsieve.schemas import FEATURES
from flowsieve.session import scratch_path, written
from flowsieve.streaming import flows, stateful

R = Registry()
DELAY = 600


def _event_stream(spark, folder):
    tables.utc(spark)
    raw = spark.read.parquet(f"{folder}/events.parquet")
    stream = spark.readStream.schema(raw.schema).parquet(f"{folder}/events*.parquet")
    return tables.shape_events(stream)


def _replayed(df, label):
    """A stream over files written from ``df``; what is there comes in one trigger, whatever the number of files."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).parquet(path)


def _arriving(parts, label, run):
    """``run`` over a stream of each part in turn, with the state of the parts before: event time decides, not arrival."""
    spark, path, out = parts[0].sparkSession, scratch_path(parts[0].sparkSession, label), None
    for part in parts:
        part.write.mode("append").parquet(path)
        out = run(spark.readStream.schema(part.schema).parquet(path))
    return out


# a window comes out once the watermark, the latest event time in milliseconds less the delay, has passed its end
_CLOSED = {"wm": f"SELECT (max(us) // 1000) / 1000.0::DOUBLE - {DELAY} AS t FROM ev"}


@R.add("k2_completed_windows", oracle(f"""SELECT run_id, window_start, switch_id, dst_ip, events, unique_src, {sql_round(_FEATURE_SQL)} FROM wf, wm WHERE window_end <= t""", **_CLOSED))
def completed_windows(spark, folder):
    out = flows.completed_windows(_event_stream(spark, folder), WINDOW, DELAY)
    return rounded(flows.run_available(out, scratch_path(spark, "completed")))


_LATE = {
    "w1": f"SELECT (max(us) // 1000) / 1000.0::DOUBLE - {DELAY} AS t1 FROM ev WHERE event_id % 7 <> 0", **_CLOSED,
    "pl": "SELECT run_id, window_start, event_id % 7 = 0 AND window_start + 10800 <= t1 AS late FROM ev, w1",
}


@R.add("k3_late_rows", oracle("""SELECT run_id, window_start, count(*) FILTER (NOT late) AS events, count(*) FILTER (late) AS dropped FROM pl, wm
      WHERE window_start + 10800 <= t GROUP BY ALL""", **_LATE))
def late_rows(spark, folder):
    # a seventh of the rows comes after the watermark of the others
    e = tables.events(spark, folder)
    first, second = e.filter("event_id % 7 <> 0"), e.filter("event_id % 7 = 0")
    place = scratch_path(spark, "late")
    out = _arriving([first, second], "late-input", lambda s: flows.run_available(flows.completed_windows(s, WINDOW, DELAY), place))
    found = out.groupBy("run_id", "window_start").agg(F.sum("events").alias("events"))
    passed = first.agg(F.max("event_ts").alias("m")).select(F.unix_millis("m") / 1000 - DELAY).first()[0]
    dropped = flows.behind_watermark(second, F.lit(passed), WINDOW)
    zero = F.lit(0).cast("bigint")
    return found.join(dropped, ["run_id", "window_start"], "full").select(
        "run_id", "window_start", F.coalesce("events", zero).alias("events"), F.coalesce("dropped", zero).alias("dropped"))


@R.add("k1_live_windows", oracle(f"SELECT run_id, window_start, switch_id, dst_ip, events, unique_src, {sql_round(_FEATURE_SQL)} FROM wf"))
def live_windows(spark, folder):
    # two arrivals in time order: windows of the first are closed when the second comes
    e, day = tables.events(spark, folder), F.dayofmonth("event_ts")
    sink = flows.BatchSink(scratch_path(spark, "live"))
    changes = _arriving(
        [e.filter(day <= 15), e.filter(day > 15)], "live-input", lambda s: sink.run(flows.live_counts(s, WINDOW, DELAY), "update"))
    return rounded(flows.live_windows(changes, WINDOW))


@R.add("k1_running_features", oracle(f"""SELECT run_id, window_start, switch_id, dst_ip, change, CAST(events AS DOUBLE) AS events, CAST(unique_src AS DOUBLE) AS unique_src, {sql_round(_FEATURE_SQL)} FROM wf
      JOIN (SELECT run_id, window_start, switch_id, dst_ip, count(DISTINCT event_id % 2) AS change FROM ev GROUP BY ALL) USING (run_id, window_start, switch_id, dst_ip)"""))
def running_features(spark, folder):
    """The last row that the stream has given out for each window, and how often the window has changed."""
    e, place = tables.events(spark, folder), scratch_path(spark, "running")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.ROCKS)
    try:
        # half of each window's events at a time, within the watermark's delay
        changes = _arriving([e.filter(F.col("event_id") % 2 == k) for k in range(2)], "running-input",
                            lambda s: flows.run_available(stateful.running_windows(s, WINDOW, 60 * 86_400, spread=3), place))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    keys = ["run_id", "window_start", "switch_id", "dst_ip"]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct("change", *FEATURES), "change").alias("l")).select(*keys, "l.*")
    return rounded(last)


@R.add("k4_streaming_decisions", oracle(f"""SELECT run_id, window_start, switch_id, dst_ip, {sql_round({'probability': 'p'})}, CASE WHEN p >= 0.3::DOUBLE THEN 1 ELSE 0 END AS prediction,
      CASE WHEN p >= 0.3::DOUBLE THEN 'RATE_LIMIT' ELSE 'NONE' END AS action, CASE WHEN p >= 0.3::DOUBLE THEN greatest(1, least(10, CAST(round_even(p * 10, 0) AS INTEGER))) ELSE 0 END AS severity
      FROM (SELECT *, least(pkt_sum / 1000, 1.0::DOUBLE) AS p FROM wf, wm WHERE window_end <= t)""", **_CLOSED))
def streaming_decisions(spark, folder):
    out = flows.completed_windows(_event_stream(spark, folder), WINDOW, DELAY)
    decided = flows.rule_decisions(out, F.least(F.col("pkt_sum") / 1000, F.lit(1.0)), 0.3).select(
        "run_id", "window_start", "switch_id", "dst_ip", "probability", "prediction", "action", "severity")
    return rounded(flows.run_available(decided, scratch_path(spark, "decided")))


@R.add("k4_streaming_model", oracle("""SELECT run_id, window_start, switch_id, dst_ip, true AS same_probability, true AS same_action, true AS in_range FROM wf, wm WHERE window_end <= t""", **_CLOSED))
def streaming_model(spark, folder):
    """A fitted detector on closed windows of the stream gives what it gives in batch."""
    w = windows.switch_windows(tables.events(spark, folder), WINDOW)
    taught = w.filter(F.dayofmonth(F.to_date("run_id")) <= 20).withColumn("teacher", F.least(F.col("pkt_sum") / 1000, F.lit(1.0)))
    detector = models.Detector("imitation_regularized_classifier", models.fit_soft_logistic(taught, FEATURES), FEATURES, 0.5)
    closed = flows.completed_windows(_event_stream(spark, folder), WINDOW, DELAY)
    keys = ["run_id", "window_start", "switch_id", "dst_ip"]
    live = flows.run_available(flows.scored_windows(closed, detector).select(*keys, "probability", "action"), scratch_path(spark, "scored"))
    batch = detector.predict(w).select(*keys, F.col("probability").alias("p"), F.col("action").alias("a"))
    p = F.col("probability")
    return live.join(batch, keys, "left").select(
        *keys, F.coalesce(F.abs(p - F.col("p")) < 1e-9, F.lit(False)).alias("same_probability"),
        F.col("action").eqNullSafe(F.col("a")).alias("same_action"), p.between(0, 1).alias("in_range"))


def _stamped(df, index="window_index", step=WINDOW):
    start = F.to_timestamp("run_id", "yyyy-MM-dd")
    return df.withColumn("window_ts", start + F.make_dt_interval(secs=(F.col(index) * step).cast("decimal(18,6)")))


@R.add("k5_streaming_gate", oracle("""SELECT *, 15 AS rule_ttl_seconds FROM sel WHERE epoch(CAST(run_id AS TIMESTAMP)) + (window_index + 1) * 10800
      <= (SELECT max(epoch(CAST(run_id AS TIMESTAMP)) + window_index * 10800) + 10800 * (SELECT CASE WHEN count(*) > 0 THEN 1 ELSE 0 END FROM lastx) - 11400 FROM gw)""", **_GATE,
      lastx="""SELECT 1 FROM ex WHERE run_id || '/' || window_index = (SELECT max(run_id || '/' || window_index) FROM gw)"""))
def streaming_gate(spark, folder):
    observed = tables.observations(spark, folder)
    policy = gate.GatePolicy(_threshold(observed), 2)
    obs = _replayed(_stamped(observed), "observations")
    marks = _replayed(_stamped(tables.gate_windows(spark, folder).drop("label")), "predictions")
    return flows.run_available(flows.gate_decisions(obs, marks, policy, WINDOW, DELAY), scratch_path(spark, "gate"))


# windows left out, and windows that carry the number before their own
_TURNED = {
    "tw": """SELECT run_id, epoch(CAST(run_id AS TIMESTAMP)) + window_index * 10800 AS ts, window_index - CASE WHEN (CAST(right(run_id, 2) AS INTEGER) * 8 + window_index) % 13 = 4 THEN 1 ELSE 0 END AS window_index
      FROM gw WHERE (CAST(right(run_id, 2) AS INTEGER) * 8 + window_index) % 11 <> 5""",
    "td": "SELECT *, CAST(coalesce(lag(window_index) OVER (PARTITION BY run_id ORDER BY ts), -1) + 1 AS INTEGER) AS expected FROM tw",
}


@R.add("k5_window_order", oracle(f"""SELECT run_id, CAST(window_index AS INTEGER) AS window_index, expected, CASE WHEN window_index = expected THEN 'ok' WHEN window_index > expected THEN 'gap' ELSE 'step_back' END AS status
      FROM td WHERE ts + 10800 <= (SELECT max(ts) - {DELAY} FROM tw)""", **_TURNED))
def window_order(spark, folder):
    at = F.dayofmonth(F.to_date("run_id")) * 8 + F.col("window_index")
    w = _stamped(tables.gate_windows(spark, folder).select("run_id", "window_index")).filter(at % 11 != 5).withColumn(
        "window_index", F.when(at % 13 == 4, F.col("window_index") - 1).otherwise(F.col("window_index")))
    place, part = scratch_path(spark, "order"), F.dayofmonth("window_ts")
    # three arrivals, the stream stopped and started again between them
    return _arriving([w.filter(part <= 9), w.filter(part.between(10, 17)), w.filter(part > 17)], "order-input",
                     lambda s: flows.run_available(stateful.window_order(s, WINDOW, DELAY), place))


@R.add("k7_rules_in_stream", oracle(f"""SELECT run_id, window_index, target_source, CAST((window_index + 1) * 10 AS BIGINT) AS active_from, CAST((window_index + 1) * 10 + CASE WHEN nx THEN 10 ELSE 15 END AS BIGINT) AS active_until FROM rl
      WHERE action = 'RATE_LIMIT' AND ((nx AND ts + 20 <= wm) OR ts + 25 <= wm)""", **_GATE,
      rl=f"""SELECT *, lead(window_index) OVER w IS NOT DISTINCT FROM window_index + 1 AS nx, max(ts) OVER () - {DELAY} AS wm FROM (SELECT *, epoch(CAST(run_id AS TIMESTAMP)) + window_index * 10 AS ts FROM sel)
        WINDOW w AS (PARTITION BY run_id ORDER BY window_index)"""))
def rules_in_stream(spark, folder):
    d = _stamped(written(_gated(spark, folder), "decisions"), step=10)
    place, part = scratch_path(spark, "lives"), F.dayofmonth("window_ts")
    # runs and windows arrive out of order within a part
    parts = [d.filter(part <= 7), d.filter(part.between(8, 20)), d.filter(part > 20)]
    return _arriving([p.orderBy(F.xxhash64("run_id", "window_index")) for p in parts], "lives-input",
                     lambda s: flows.run_available(stateful.rule_lives(s, 10, DELAY), place))


@R.add("k6_streaming_counter_deltas", oracle("""SELECT * FROM dl WHERE epoch(CAST(run_id AS TIMESTAMP)) + window_index * 10800 + (poll_index + 1) * 1800
      <= (SELECT max(epoch(CAST(run_id AS TIMESTAMP)) + window_index * 10800 + (poll_index + 1) * 1800) - 2400 FROM pl)""", pl=_POLLS, dl=_DELTA))
def streaming_counter_deltas(spark, folder):
    start = F.to_timestamp("run_id", "yyyy-MM-dd")
    second = (F.col("window_index") * WINDOW + F.col("poll_index") * 1800).cast("decimal(18,6)")
    p = polls(spark, folder).withColumn("poll_ts", start + F.make_dt_interval(secs=second))
    return flows.run_available(flows.counter_deltas(_replayed(p, "polls"), 1800, DELAY), scratch_path(spark, "deltas"))


def _alert_stream(spark, folder):
    e = _event_stream(spark, folder)
    routed = decide.routed(e.withColumns({
        "flow_score": F.when(F.col("k") % 3 == 0, F.col("probability")), "window_score": F.when(F.col("k") % 3 <= 1, F.sqrt("probability")),
        "epoch": F.floor(F.unix_micros("event_ts") / 1_000_000).cast("bigint"), "controller_id": F.col("switch_id")}),
        threshold=20, detect=0.1, block=0.25, window_threshold=0.4)
    return decide.alerts(routed, ["event_id"])


@R.add("k8_alert_stream", oracle("SELECT * FROM al", **_DEC))
def alert_stream(spark, folder):
    return flows.BatchSink(scratch_path(spark, "alerts")).run(_alert_stream(spark, folder)).drop("batch")


QUERIES, ORACLES = R.queries, R.oracles
