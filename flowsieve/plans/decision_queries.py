"""Queries over decisions, the source gate, folds and governance."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsieve.operators import decide, folds, gate, summaries, windows
from flowsieve.plans import tables
from flowsieve.plans.registry import Registry
from flowsieve.plans.tables import WINDOW, oracle, rounded, sql_round

R = Registry()

# ---- decision rules ---------------------------------------------------------------------------

_DEC = {
    "sv": """SELECT *, CASE WHEN packet_count <= 20 THEN 0 ELSE greatest(1, least(10, CAST(floor(least(packet_count / 20.0::DOUBLE, 10)) AS INTEGER))) END AS ts,
      CASE WHEN probability >= 0.1::DOUBLE THEN greatest(1, least(10, CAST(round_even(probability * 10, 0) AS INTEGER))) ELSE 0 END AS ps FROM ev""",
    "rt": """SELECT *, CASE WHEN k % 3 = 0 THEN probability END AS flow_score, CASE WHEN k % 3 <= 1 THEN sqrt(probability) END AS window_score FROM ev""",
    "md": """SELECT *, CASE WHEN flow_score IS NOT NULL THEN 'ml_flow' WHEN window_score IS NOT NULL THEN 'ml_window' ELSE 'threshold' END AS method,
      coalesce(flow_score, window_score) AS p_attack FROM rt""",
    "dt": """SELECT *, CASE method WHEN 'threshold' THEN packet_count > 20 WHEN 'ml_flow' THEN p_attack >= 0.1::DOUBLE ELSE p_attack >= 0.4::DOUBLE END AS detected FROM md""",
    "sd": """SELECT *, CASE WHEN method = 'threshold' THEN CASE WHEN packet_count <= 20 THEN 0 ELSE greatest(1, least(10, CAST(floor(least(packet_count / 20.0::DOUBLE, 10)) AS INTEGER))) END
      WHEN detected THEN greatest(1, least(10, CAST(round_even(p_attack * 10, 0) AS INTEGER))) ELSE 0 END AS severity FROM dt""",
    "ac": """SELECT *, CASE WHEN method = 'threshold' THEN CASE WHEN severity >= 7 THEN 'BLOCK' WHEN severity >= 1 THEN 'RATE_LIMIT' ELSE 'NONE' END
      WHEN method = 'ml_flow' AND detected AND p_attack >= 0.25::DOUBLE THEN 'BLOCK' WHEN detected THEN 'RATE_LIMIT' ELSE 'NONE' END AS action,
      CAST(floor(us / 1000000) AS BIGINT) AS epoch FROM sd""",
    "al": """SELECT 'alert_' || sha256(CAST(event_id AS VARCHAR)) AS alert_id, event_id, switch_id AS controller_id, epoch, switch_id, src_ip, dst_ip, packet_count,
      severity, action, method, 150 + severity AS priority, epoch + 3600 AS expiry, action <> 'NONE' AS mitigated,
      CASE WHEN action <> 'NONE' THEN 'rule_' || sha256(CAST(event_id AS VARCHAR)) END AS mitigation_rule_id,
      CASE WHEN action <> 'NONE' THEN 'mitigated' ELSE 'detection_only' END AS status FROM ac WHERE detected""",
}


def _routed(spark, folder, mode="auto"):
    e = tables.events(spark, folder).withColumns({
        "flow_score": F.when(F.col("k") % 3 == 0, F.col("probability")),
        "window_score": F.when(F.col("k") % 3 <= 1, F.sqrt("probability")),
        "epoch": F.floor(F.unix_micros("event_ts") / 1_000_000).cast("bigint"), "controller_id": F.col("switch_id"),
    })
    return decide.routed(e, mode, threshold=20, detect=0.1, block=0.25, window_threshold=0.4)


def _alerts(spark, folder):
    return decide.alerts(_routed(spark, folder), ["event_id"])


@R.add("j1_j2_severity", oracle("SELECT event_id, ts AS threshold_severity, ps AS probability_severity FROM sv", **_DEC))
def severity(spark, folder):
    e = tables.events(spark, folder)
    return e.select("event_id", decide.threshold_severity(F.col("packet_count"), F.lit(20)).alias("threshold_severity"),
                    decide.probability_severity(F.col("probability"), F.col("probability") >= 0.1).alias("probability_severity"))


@R.add("j3_action_ladder", oracle("""SELECT event_id, CASE WHEN ts >= 7 THEN 'BLOCK' WHEN ts >= 1 THEN 'RATE_LIMIT' ELSE 'NONE' END AS by_count,
      CASE WHEN probability >= 0.25::DOUBLE THEN 'BLOCK' WHEN probability >= 0.1::DOUBLE THEN 'RATE_LIMIT' ELSE 'NONE' END AS by_flow_score,
      CASE WHEN probability >= 0.1::DOUBLE THEN 'RATE_LIMIT' ELSE 'NONE' END AS by_window_score FROM sv""", **_DEC))
def action_ladder(spark, folder):
    p = F.col("probability")
    return tables.events(spark, folder).select(
        "event_id", decide.severity_action(decide.threshold_severity(F.col("packet_count"), F.lit(20))).alias("by_count"),
        decide.model_action(p, F.lit(0.1), F.lit(0.25), F.lit(False)).alias("by_flow_score"),
        decide.model_action(p, F.lit(0.1), F.lit(0.25), F.lit(True)).alias("by_window_score"))


@R.add("j4_mode_routing", oracle("SELECT event_id, method, detected, severity, action FROM ac", **_DEC))
def mode_routing(spark, folder):
    return _routed(spark, folder).select("event_id", "method", "detected", "severity", "action")


@R.add("j9_alerts", oracle("SELECT * FROM al", **_DEC))
def alerts(spark, folder):
    return _alerts(spark, folder)


@R.add("c15_alert_totals", oracle("""SELECT controller_id, count(*) AS total_alerts, count(*) FILTER (mitigated) AS mitigated_attacks FROM al GROUP BY controller_id""", **_DEC))
def alert_totals(spark, folder):
    return decide.alert_totals(_alerts(spark, folder))


@R.add("g4_recent_alerts", oracle("SELECT alert_id, epoch, src_ip, dst_ip, severity, mitigated FROM al ORDER BY epoch DESC, alert_id LIMIT 10", **_DEC))
def recent_alerts(spark, folder):
    return summaries.recent(_alerts(spark, folder), [F.col("epoch").desc(), F.col("alert_id")]).select(
        "alert_id", "epoch", "src_ip", "dst_ip", "severity", "mitigated")


@R.add("i5_window_decision", oracle("""SELECT row_id, prediction, CASE WHEN probability >= 0.1::DOUBLE THEN 'RATE_LIMIT' ELSE 'NONE' END AS action FROM sc"""))
def window_decision(spark, folder):
    return tables.scores(spark, folder).select("row_id", "prediction", decide.window_action(F.col("probability"), F.lit(0.1)).alias("action"))


@R.add("i6_risk_gate", oracle("""SELECT row_id, CASE WHEN probability >= 0.1::DOUBLE AND 1 - probability <= 0.8::DOUBLE THEN 1 ELSE 0 END AS prediction,
      CASE WHEN probability >= 0.1::DOUBLE AND 1 - probability > 0.8::DOUBLE THEN 1 ELSE 0 END AS abstained FROM sc"""))
def risk_gate(spark, folder):
    p, t = F.col("probability"), F.lit(0.1)
    gated = decide.risk_gated(p, t, 0.8)
    return tables.scores(spark, folder).select("row_id", gated.alias("prediction"), ((p >= t) & (gated == 0)).cast("int").alias("abstained"))


# ---- source gate ------------------------------------------------------------------------------

_GATE = {
    "th": "SELECT CAST(floor(sum(bytes) * 17 / (count(*) * 10)) AS BIGINT) / 10800.0::DOUBLE AS t FROM ob",
    "ex": "SELECT run_id, window_index, source_ip FROM ob, th WHERE bytes / duration_seconds > t",
    "isl": "SELECT *, window_index - row_number() OVER (PARTITION BY run_id, source_ip ORDER BY window_index) AS g FROM ex",
    "stk": "SELECT *, row_number() OVER (PARTITION BY run_id, source_ip, g ORDER BY window_index) AS streak FROM isl",
    "cd": "SELECT run_id, window_index, source_ip FROM stk WHERE streak >= 2",
    "cc": "SELECT run_id, window_index, count(*) AS c, min(source_ip) AS s FROM cd GROUP BY ALL",
    "sel": """SELECT gw.run_id, gw.window_index, prediction, coalesce(c, 0) AS candidate_count, CASE WHEN prediction = 1 AND c = 1 THEN s END AS target_source,
      CASE WHEN prediction = 1 AND c = 1 THEN 'RATE_LIMIT' ELSE 'NONE' END AS action,
      CASE WHEN prediction = 1 AND c = 1 THEN 'unique_persistent_rate_exceedance' WHEN prediction = 0 THEN 'negative_window_prediction'
        WHEN c > 1 THEN 'ambiguous_sources' ELSE 'insufficient_source_evidence' END AS safety_reason
      FROM gw LEFT JOIN cc USING (run_id, window_index)""",
}


def _threshold(observed) -> float:
    total = observed.agg((F.floor(F.sum("bytes") * 17 / (F.count(F.lit(1)) * 10))).alias("t")).first()["t"]
    return total / float(WINDOW)


def _gated(spark, folder):
    observed = tables.observations(spark, folder)
    policy = gate.GatePolicy(_threshold(observed), 2)
    return gate.select_sources(tables.gate_windows(spark, folder).drop("label"), gate.checked_observations(observed), policy)


@R.add("j6_source_selection", oracle("SELECT *, 15 AS rule_ttl_seconds FROM sel", **_GATE))
def source_selection(spark, folder):
    return _gated(spark, folder)


@R.add("j6_candidate_sources", oracle("SELECT * FROM cd", **_GATE))
def candidate_sources(spark, folder):
    observed = tables.observations(spark, folder)
    return gate.candidates(observed, gate.GatePolicy(_threshold(observed), 2))


@R.add("d4_exceedance_streak", oracle("""SELECT ob.run_id, ob.window_index, ob.source_ip, coalesce(streak, 0) AS streak FROM ob LEFT JOIN stk USING (run_id, window_index, source_ip)""", **_GATE))
def exceedance_streak(spark, folder):
    observed = tables.observations(spark, folder)
    return gate.streaks(observed, _threshold(observed))


@R.add("j8_enforcement", oracle("""SELECT run_id, window_index, action AS proposed_action, target_source AS proposed_target, CAST(right(run_id, 2) AS INTEGER) % 2 = 0 AS enforcement_enabled,
      CASE WHEN CAST(right(run_id, 2) AS INTEGER) % 2 = 0 THEN action ELSE 'NONE' END AS action,
      CASE WHEN CAST(right(run_id, 2) AS INTEGER) % 2 = 0 THEN target_source END AS target_source FROM sel""", **_GATE))
def enforcement(spark, folder):
    enabled = F.dayofmonth(F.to_date("run_id")) % 2 == 0
    return gate.enforced(_gated(spark, folder), enabled).select(
        "run_id", "window_index", "proposed_action", "proposed_target", "enforcement_enabled", "action", "target_source")


@R.add("k7_rule_lifetimes", oracle("""SELECT a.run_id, a.window_index, a.target_source, (CAST(a.window_index AS BIGINT) + 1) * 10 AS active_from,
      (CAST(a.window_index AS BIGINT) + 1) * 10 + CASE WHEN b.run_id IS NULL THEN 15 ELSE 10 END AS active_until
      FROM sel a LEFT JOIN sel b ON a.run_id = b.run_id AND b.window_index = a.window_index + 1 WHERE a.action = 'RATE_LIMIT'""", **_GATE))
def rule_lifetimes(spark, folder):
    return gate.rule_lifetimes(_gated(spark, folder), 10)


_BAD = """SELECT run_id, window_index, CASE WHEN packets % 13 = 0 THEN '10.0.0.256' ELSE source_ip END AS source_ip, CASE WHEN packets % 17 = 0 THEN -1 ELSE packets END AS packets, bytes,
      CASE WHEN packets % 19 = 0 THEN 0.0::DOUBLE ELSE duration_seconds END AS duration_seconds FROM ob"""


@R.add("j7_observation_contract", oracle("""SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(a) AS BIGINT) AS bad_address, CAST(sum(m) AS BIGINT) AS bad_measure, CAST(sum(d) AS BIGINT) AS bad_duration,
      count(*) FILTER (n > 1) AS duplicate_sources FROM (SELECT count(*) AS n, count(*) FILTER (source_ip = '10.0.0.256') AS a, count(*) FILTER (packets < 0) AS m,
      count(*) FILTER (duration_seconds <= 0) AS d FROM bad GROUP BY run_id, window_index, source_ip)""", bad=_BAD))
def observation_contract(spark, folder):
    p = F.col("packets")
    bad = tables.observations(spark, folder).select(
        "run_id", "window_index", F.when(p % 13 == 0, "10.0.0.256").otherwise(F.col("source_ip")).alias("source_ip"),
        F.when(p % 17 == 0, -1).otherwise(p).alias("packets"), "bytes", F.when(p % 19 == 0, 0.0).otherwise(F.col("duration_seconds")).alias("duration_seconds"))
    return gate.contract_report(bad)


_MULTIPLIERS, _PERSISTENCE = [0.4, 0.5, 0.75, 1.0], [1, 2]
_FIT = {
    "dv": "SELECT * FROM ob WHERE CAST(right(run_id, 2) AS INTEGER) <= 20",
    "vl": "SELECT * FROM ob WHERE CAST(right(run_id, 2) AS INTEGER) > 20",
    "mx": "SELECT max(bytes / duration_seconds) AS m FROM dv JOIN tr USING (source_ip) WHERE is_attacker = 0",
    "gr": "SELECT a AS multiplier, p AS persistence, m * a AS threshold FROM mx, (VALUES (0.4::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE), (1.0::DOUBLE)) x(a), (VALUES (1), (2)) y(p)",
    "ge": "SELECT run_id, window_index, source_ip, multiplier, persistence, threshold FROM vl, gr WHERE bytes / duration_seconds > threshold",
    "gi": "SELECT *, window_index - row_number() OVER (PARTITION BY run_id, source_ip, multiplier, persistence ORDER BY window_index) AS g FROM ge",
    "gs": "SELECT *, row_number() OVER (PARTITION BY run_id, source_ip, multiplier, persistence, g ORDER BY window_index) AS streak FROM gi",
    "gc": "SELECT run_id, window_index, multiplier, persistence, count(*) AS c, min(source_ip) AS source_ip FROM gs WHERE streak >= persistence GROUP BY ALL",
    "gt": """SELECT multiplier, persistence, count(*) FILTER (is_attacker = 0) AS bt, count(*) FILTER (is_attacker = 1) AS att FROM gc JOIN gw USING (run_id, window_index)
      JOIN tr ON tr.source_ip = gc.source_ip WHERE c = 1 AND prediction = 1 GROUP BY ALL""",
    "op": """SELECT CAST(sum(b) AS BIGINT) AS bo, CAST(sum(a) AS BIGINT) AS ao FROM (SELECT max(1 - is_attacker) AS b, max(is_attacker) AS a FROM vl JOIN tr USING (source_ip)
      WHERE bytes > 0 GROUP BY run_id, window_index)""",
    "ft": """SELECT multiplier, persistence, threshold, coalesce(bt, 0) AS benign_targets, coalesce(att, 0) AS attack_targets, bo AS benign_opportunities, ao AS attack_opportunities,
      coalesce(bt, 0) / bo::DOUBLE AS rate FROM gr LEFT JOIN gt USING (multiplier, persistence), op""",
    "fb": """SELECT threshold, persistence FROM ft WHERE rate <= 0.2::DOUBLE AND attack_targets > 0 ORDER BY attack_targets DESC, benign_targets, threshold DESC, persistence DESC LIMIT 1""",
}


@R.add("j5_source_envelope_fit", oracle(f"""SELECT multiplier, ft.persistence, {sql_round({'threshold': 'ft.threshold', 'benign_target_rate': 'rate'})}, benign_targets, attack_targets,
      benign_opportunities, attack_opportunities, coalesce(fb.threshold = ft.threshold AND fb.persistence = ft.persistence, false) AS selected FROM ft LEFT JOIN fb ON true""", **_FIT))
def source_envelope_fit(spark, folder):
    observed, roles = tables.observations(spark, folder), tables.truth(spark, folder)
    early = F.dayofmonth(F.to_date("run_id")) <= 20
    made = tables.gate_windows(spark, folder).withColumn("detector_hash", F.lit("sum of labels above 2"))
    _, table = gate.fit_policy(
        observed.filter(early), roles, made.filter(~early), observed.filter(~early), roles,
        _MULTIPLIERS, _PERSISTENCE, 0.2, detectors=(made.filter(early), made.filter(~early)))
    return rounded(table)


@R.add("f9_candidate_grid", oracle("""SELECT run_id, window_index, source_ip, multiplier, persistence FROM ge""", **_FIT))
def candidate_grid(spark, folder):
    observed, roles = tables.observations(spark, folder), tables.truth(spark, folder)
    early = F.dayofmonth(F.to_date("run_id")) <= 20
    grid = gate.candidate_grid(gate.benign_envelope(observed.filter(early), roles), _MULTIPLIERS, _PERSISTENCE)
    entries = F.array(*[F.struct(F.lit(m).alias("multiplier"), F.lit(p).alias("persistence"), F.lit(t).alias("threshold")) for m, p, t in grid])
    return observed.filter(~early).select("run_id", "window_index", "source_ip", F.explode(
        F.filter(entries, lambda e: F.col("bytes") / F.col("duration_seconds") > e["threshold"])).alias("g")).select(
        "run_id", "window_index", "source_ip", "g.multiplier", "g.persistence")


@R.add("f1_truth_lookup", oracle("SELECT run_id, window_index, ob.source_ip, bytes, is_attacker FROM ob LEFT JOIN tr ON ob.source_ip = tr.source_ip"))
def truth_lookup(spark, folder):
    return tables.observations(spark, folder).join(tables.truth(spark, folder), "source_ip", "left").select(
        "run_id", "window_index", "source_ip", "bytes", "is_attacker")


@R.add("d8_consecutive_index", oracle("""SELECT run_id, count(*) AS windows, min(window_index) = 0 AND max(window_index) = count(DISTINCT window_index) - 1 AND count(*) = count(DISTINCT window_index) AS consecutive
      FROM (SELECT run_id, window_index FROM gw WHERE NOT (CAST(right(run_id, 2) AS INTEGER) % 7 = 0 AND window_index = 4)) GROUP BY run_id"""))
def consecutive_index(spark, folder):
    w = tables.gate_windows(spark, folder).filter(~((F.dayofmonth(F.to_date("run_id")) % 7 == 0) & (F.col("window_index") == 4)))
    return gate.index_report(w, ["run_id"])


@R.add("g10_dominant_source", oracle("""SELECT run_id, window_index, min(source_ip) AS dominant_source FROM ob JOIN
      (SELECT run_id, window_index, max(packets) AS packets FROM ob GROUP BY ALL) m USING (run_id, window_index, packets) GROUP BY run_id, window_index"""))
def dominant_source(spark, folder):
    return gate.dominant_source(tables.observations(spark, folder))


@R.add("g11_first_of_group", oracle("""SELECT run_id, arg_min(switch_id, event_id) AS switch_id, min(event_id) AS event_id FROM ev GROUP BY run_id"""))
def first_of_group(spark, folder):
    return tables.events(spark, folder).groupBy("run_id").agg(F.min_by("switch_id", "event_id").alias("switch_id"), F.min("event_id").alias("event_id"))


_POLLS = """SELECT run_id, window_index, src_ip AS source_ip, CAST(floor((us // 1000000 - window_start) / 1800) AS INTEGER) AS poll_index, CAST(sum(packet_count) AS BIGINT) AS packets,
      CAST(sum(byte_count) AS BIGINT) AS bytes FROM ev GROUP BY ALL"""
_DELTA = """SELECT a.run_id, a.window_index, a.source_ip, a.poll_index, greatest(a.packets - coalesce(b.packets, 0), 0) AS packets, greatest(a.bytes - coalesce(b.bytes, 0), 0) AS bytes
      FROM pl a LEFT JOIN pl b ON a.run_id = b.run_id AND a.window_index = b.window_index AND a.source_ip = b.source_ip AND b.poll_index = a.poll_index - 1 WHERE a.poll_index > 0"""


def polls(spark, folder):
    e = windows.with_window(tables.events(spark, folder), WINDOW)
    second = F.floor(F.unix_micros("event_ts") / 1_000_000)
    return e.groupBy("run_id", F.floor(F.hour("event_ts") / 3).cast("int").alias("window_index"), F.col("src_ip").alias("source_ip"),
                     F.floor((second - F.col("window_start")) / 1800).cast("int").alias("poll_index")).agg(
        F.sum("packet_count").alias("packets"), F.sum("byte_count").alias("bytes"))


@R.add("d5_counter_deltas", oracle("SELECT * FROM dl", pl=_POLLS, dl=_DELTA))
def counter_deltas(spark, folder):
    return gate.counter_deltas(polls(spark, folder))


@R.add("d5_poll_windows", oracle(f"""SELECT run_id, window_index, CAST(e AS BIGINT) AS events, CAST(u AS BIGINT) AS unique_src, {sql_round({'pkt_rate': 'p / 10800.0::DOUBLE', 'byte_rate': 'b / 10800.0::DOUBLE',
      'pkt_sum': 'CAST(p AS DOUBLE)', 'src_ip_entropy': 'greatest(ent, 0)', 'flow_count': 'CAST(f AS DOUBLE)', 'flow_rate': 'f / 10800.0::DOUBLE'})} FROM pwa JOIN pwb USING (run_id, window_index)""",
      pl=_POLLS, dl=_DELTA, mv="SELECT * FROM dl WHERE packets > 0 OR bytes > 0",
      pwb="SELECT run_id, window_index, count(DISTINCT poll_index) AS e FROM mv GROUP BY ALL",
      ps="SELECT run_id, window_index, source_ip, count(*) AS n, sum(packets) AS p, sum(bytes) AS b FROM mv GROUP BY ALL",
      pwa="SELECT run_id, window_index, sum(p) AS p, sum(b) AS b, sum(n) AS f, count(*) AS u, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS ent FROM ps GROUP BY ALL"))
def poll_windows(spark, folder):
    return rounded(gate.poll_windows(gate.counter_deltas(polls(spark, folder)), WINDOW))


# ---- folds and governance ---------------------------------------------------------------------

_FOLD = {
    "rb": "SELECT run_id, min(window_start) AS s, max(window_end) AS e FROM wf GROUP BY run_id",
    "rk": "SELECT *, row_number() OVER (ORDER BY s, run_id) - 1 AS k, count(*) OVER () AS n FROM rb",
    "fa": """SELECT CAST(f AS INTEGER) AS fold, run_id, CASE WHEN k < 10 + f * 4 THEN 'train' WHEN k < 13 + f * 4 THEN 'validation' ELSE 'test' END AS role
      FROM rk, (SELECT unnest(range(0, greatest(max(n) // 4, 0))) AS f FROM rk) WHERE f < (n - 13) // 4 AND k < 17 + f * 4""",
    "fd": """SELECT fold, role, count(*) AS n, count(*) FILTER (label = 0) AS benign, count(*) FILTER (label = 1) AS attack, min(window_start) AS s, max(window_end) AS e,
      count(DISTINCT run_id) AS runs FROM fa JOIN wf USING (run_id) GROUP BY fold, role""",
}


def _switch(spark, folder):
    return windows.switch_windows(tables.events(spark, folder), WINDOW)


_PLAN = folds.FoldPlan(10, 3, 4)


def _ranked(spark, folder):
    return folds.ranked_runs(folds.run_bounds(_switch(spark, folder)))


def _assigned(spark, folder):
    return folds.fold_runs(_ranked(spark, folder), _PLAN.first, _PLAN.validation, _PLAN.size)


@R.add("c11_run_bounds", oracle('SELECT run_id, s AS "start", e AS "end" FROM rb', **_FOLD))
def run_bounds(spark, folder):
    return folds.run_bounds(_switch(spark, folder))


@R.add("d9_chronological_split", oracle("""SELECT row_id, CASE WHEN k < floor(n * 0.6::DOUBLE) THEN 'train' WHEN k < floor(n * 0.8::DOUBLE) THEN 'validation' ELSE 'test' END AS role
      FROM (SELECT row_id, row_number() OVER (ORDER BY window_start, window_end, row_id) - 1 AS k, count(*) OVER () AS n FROM wf)"""))
def chronological_split(spark, folder):
    return folds.chronological_split(_switch(spark, folder), ["window_start", "window_end", "row_id"]).select("row_id", "role")


@R.add("d10_expanding_folds", oracle("SELECT fold, role, wf.row_id FROM fa JOIN wf USING (run_id)", **_FOLD))
def expanding_folds(spark, folder):
    return folds.fold_rows(_switch(spark, folder), _assigned(spark, folder)).select("fold", "role", "row_id")


@R.add("d12_run_overlaps", oracle("""SELECT run_id, e AS "end", nr AS next_run, ns AS next_start FROM (SELECT *, lead(run_id) OVER (ORDER BY s, run_id) AS nr, lead(s) OVER (ORDER BY s, run_id) AS ns FROM late) WHERE e > ns""",
      late="SELECT run_id, min(window_start) AS s, max(window_end) + CASE WHEN run_id LIKE '%5' THEN 20000 ELSE 0 END AS e FROM wf GROUP BY run_id"))
def run_overlaps(spark, folder):
    late = folds.run_bounds(_switch(spark, folder)).withColumn("end", F.col("end") + F.when(F.col("run_id").endswith("5"), 20000).otherwise(0))
    return folds.run_overlaps(folds.ranked_runs(late))


@R.add("c12_fold_definitions", oracle('SELECT fold, role, n, benign, attack, s AS "start", e AS "end", runs FROM fd', **_FOLD))
def fold_definitions(spark, folder):
    return folds.fold_summary(_switch(spark, folder), _ranked(spark, folder), _PLAN)


@R.add("c12_fold_scenarios", oracle("SELECT fold, role, scenario_id, count(*) AS n FROM fa JOIN wf USING (run_id) GROUP BY fold, role, scenario_id", **_FOLD))
def fold_scenarios(spark, folder):
    return folds.fold_scenario_counts(_switch(spark, folder), _ranked(spark, folder), _PLAN)


@R.add("f10_shared_runs", oracle("""SELECT fold, run_id, count(DISTINCT role) AS roles FROM (SELECT * FROM fa UNION ALL SELECT fold, run_id, 'test' FROM fa WHERE run_id LIKE '%-12') GROUP BY fold, run_id HAVING count(DISTINCT role) > 1""", **_FOLD))
def shared_runs(spark, folder):
    a = _assigned(spark, folder)
    leaked = a.filter(F.col("run_id").endswith("-12")).withColumn("role", F.lit("test"))
    return folds.shared_runs(a.unionByName(leaked))


@R.add("l11_governance", oracle("""SELECT fold, tr.e <= va.s AS train_before_validation, va.e <= te.s AS validation_before_test, true AS runs_disjoint, tr.benign > 0 AND tr.attack > 0 AS train_has_both_classes,
      va.benign > 0 AND va.attack > 0 AS validation_has_both_classes, te.benign > 0 AND te.attack > 0 AS test_has_both_classes
      FROM (SELECT * FROM fd WHERE role = 'train') tr JOIN (SELECT * FROM fd WHERE role = 'validation') va USING (fold) JOIN (SELECT * FROM fd WHERE role = 'test') te USING (fold)""", **_FOLD))
def governance(spark, folder):
    w, ranked = _switch(spark, folder), _ranked(spark, folder)
    return folds.governance(folds.fold_summary(w, ranked, _PLAN), folds.overlapping_parts(folds.fold_ranges(ranked, _PLAN)))


@R.add("b11_leakage_filter", oracle("""SELECT * FROM (VALUES ('event_id', false, (SELECT count(*) FROM events)), ('event_type', false, 0::BIGINT), ('value', false, (SELECT count(*) FROM events)),
      ('user_id', false, (SELECT count(*) FROM events)), ('detected_score', true, (SELECT count(*) FROM events)), ('Status', true, 0::BIGINT), ('p_attack', true, (SELECT count(*) FROM events))) t("column", leaky, numbers),
      LATERAL (SELECT NOT leaky AND numbers > 0 AS feature)"""))
def leakage_filter(spark, folder):
    raw = tables.table(spark, folder, "events")
    return folds.numeric_report(raw.select("event_id", "event_type", "value", "user_id", F.col("value").alias("detected_score"),
                                           F.lit("ok").alias("Status"), F.col("value").alias("p_attack")))


QUERIES, ORACLES = R.queries, R.oracles
