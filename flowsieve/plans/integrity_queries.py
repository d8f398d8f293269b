"""Queries over hash chains, fingerprints, manifests, reconciliation and replay."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsieve.operators import gate, integrity, metrics, replay, windows
from flowsieve.plans import tables
from flowsieve.plans.decision_queries import _GATE, _threshold
from flowsieve.plans.metric_queries import COUNTS_SQL, RATIO_SQL
from flowsieve.plans.registry import Registry
from flowsieve.plans.tables import WINDOW, oracle, rounded, sql_round
from flowsieve.schemas import FEATURES
from flowsieve.session import scratch_path, written
from flowsieve.sources import records

R = Registry()

# ---- hash chains ------------------------------------------------------------------------------

_BODY = """'{"idx":' || event_id || ',"switch":"' || switch_id || '"}'"""
_CHAIN = {
    "rn": f"SELECT run_id || '/' || src_ip AS run_id, event_id, switch_id, row_number() OVER (PARTITION BY ev.run_id, src_ip ORDER BY event_id) AS n, {_BODY} AS body FROM ev",
    "ch": """SELECT run_id, event_id, switch_id, n, repeat('0', 64) AS prev, sha256('{"prev_hash":"' || repeat('0', 64) || '","record":' || body || '}') AS h FROM rn WHERE n = 1
      UNION ALL SELECT rn.run_id, rn.event_id, rn.switch_id, rn.n, ch.h, sha256('{"prev_hash":"' || ch.h || '","record":' || rn.body || '}') FROM ch JOIN rn ON rn.run_id = ch.run_id AND rn.n = ch.n + 1""",
    "ln": """SELECT run_id AS chain_id, event_id AS seq, '{"idx":' || event_id || ',"prev_hash":"' || prev || '","record_hash":"' || h || '","switch":"' || switch_id || '"}' AS raw, prev, h FROM ch""",
}
# one chain a run, as a controller writes it
_RUN_CHAIN = {
    **_CHAIN,
    "rn": f"SELECT run_id, event_id, switch_id, row_number() OVER (PARTITION BY run_id ORDER BY event_id) AS n, {_BODY} AS body FROM ev",
}


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def _chains(spark, folder, *parts):
    """One chain for each run, or for each run and value of ``parts``."""
    body = F.concat(F.lit('{"idx": '), F.col("event_id").cast("string"), F.lit(', "switch": "'), F.col("switch_id"), F.lit('"}'))
    return integrity.build_chains(tables.events(spark, folder).select(
        F.concat("run_id", *[x for c in parts for x in (F.lit("/"), c)]).alias("chain_id"), F.col("event_id").alias("seq"), body.alias("record")))


@R.add("l2_chain_build", _recursive(oracle("SELECT chain_id, seq, raw FROM ln", **_RUN_CHAIN)))
def chain_build(spark, folder):
    return _chains(spark, folder)


def _tampered(spark, folder):
    """Every 97th record altered, every 101st unlinked, the chains of one run cut short by broken lines, those of another with unhashed lines."""
    c, s = written(_chains(spark, folder, "src_ip"), "audit"), F.col("seq")
    raw = (F.when(F.col("chain_id").contains("-05/") & (s % 50 == 0), F.lit('{"idx":'))
           .when(F.col("chain_id").contains("-06/") & (s % 60 == 0), F.lit('{"idx":0}'))
           .when(s % 97 == 0, F.regexp_replace("raw", '"switch":"sw', '"switch":"xx'))
           .when(s % 101 == 0, F.regexp_replace("raw", '"prev_hash":"..', '"prev_hash":"zz')).otherwise(F.col("raw")))
    return c.withColumn("raw", raw)


_VERIFY = {
    **_CHAIN,
    "tm": """SELECT *, chain_id LIKE '%-05/%' AND seq % 50 = 0 AS mal, chain_id LIKE '%-06/%' AND seq % 60 = 0 AS unh FROM ln""",
    "ct": "SELECT chain_id, min(seq) AS cut FROM tm WHERE mal GROUP BY chain_id",
    "kp": "SELECT tm.*, NOT mal AND NOT unh AND seq % 97 = 0 AS alt, NOT mal AND NOT unh AND seq % 97 <> 0 AND seq % 101 = 0 AS unl FROM tm LEFT JOIN ct USING (chain_id) WHERE cut IS NULL OR seq < cut",
    "lk": "SELECT *, CASE WHEN unl THEN 'zz' || substr(prev, 3) ELSE prev END <> coalesce(lag(h) OVER (PARTITION BY chain_id ORDER BY seq), repeat('0', 64)) AS lb FROM kp WHERE NOT unh",
    "vr": """SELECT chain_id, count(*) AS emb, count(*) FILTER (lb) AS lbc, count(*) FILTER (alt OR unl) AS cc, max_by(h, seq) AS tip FROM lk GROUP BY chain_id""",
    "rp": """SELECT tm.chain_id, count(*) AS records, coalesce(any_value(emb), 0) AS embedded_hash_records, (SELECT count(*) FROM kp WHERE kp.chain_id = tm.chain_id AND unh) AS legacy_unhashed_records,
      bool_or(mal) AS malformed_json, coalesce(any_value(lbc), 0) AS prev_hash_mismatch, coalesce(any_value(cc), 0) AS record_hash_mismatch, coalesce(any_value(tip), repeat('0', 64)) AS chain_tip
      FROM tm LEFT JOIN vr ON vr.chain_id = tm.chain_id GROUP BY tm.chain_id""",
}


@R.add("l1_chain_verification", _recursive(oracle("""SELECT *, embedded_hash_records > 0 AND NOT malformed_json AND prev_hash_mismatch = 0 AND record_hash_mismatch = 0 AND legacy_unhashed_records = 0 AS valid_embedded_hash_chain,
      embedded_hash_records > 0 AND NOT malformed_json AND prev_hash_mismatch = 0 AND record_hash_mismatch = 0 AS valid_with_legacy_prefix FROM rp""", **_VERIFY)))
def chain_verification(spark, folder):
    return integrity.chain_report(_tampered(spark, folder))


@R.add("d7_previous_hash", _recursive(oracle("SELECT chain_id, seq, prev AS expected_prev FROM ln", **_CHAIN)))
def previous_hash(spark, folder):
    return integrity.chain_checks(written(_chains(spark, folder, "src_ip"), "audit")).select("chain_id", "seq", "expected_prev")


@R.add("l3_recovery", _recursive(oracle("SELECT chain_id, count(*) FILTER (NOT mal) AS recovered_records, count(*) FILTER (mal) AS dropped_records FROM tm GROUP BY chain_id", **_VERIFY)))
def recovery(spark, folder):
    return integrity.recovery_report(_tampered(spark, folder))


@R.add("l4_canonical_hash", oracle("""SELECT event_id, sha256('{"a":' || packet_count || ',"b":"' || src_ip || '","c":[1,null]}') AS compact, sha256('{"a": ' || packet_count || ', "b": "' || src_ip || '", "c": [1, null]}') AS spaced FROM ev"""))
def canonical_hash(spark, folder):
    text = F.concat(F.lit('{ "b":"'), F.col("src_ip"), F.lit('", "c" : [1,null], "a": '), F.col("packet_count").cast("string"), F.lit("}"))
    return tables.events(spark, folder).select(
        "event_id", integrity.canonical_hash(text).alias("compact"), integrity.spaced_hash(text).alias("spaced"))


_DIGESTS = "SELECT sha256(" + " || ".join(
    f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("event_id", "src_ip", "packet_count")) + ") AS d FROM ev"
_SUMS = " || ':' || ".join(
    f"CAST(CAST(coalesce(sum(CAST(CAST('0x' || substr(d, {1 + 16 * k}, 16) AS UBIGINT) AS HUGEINT)), 0) AS HUGEINT) AS VARCHAR)" for k in range(4))


@R.add("l5_table_hash", oracle(f"SELECT count(*) AS rows, {_SUMS} AS digest_sum FROM ({_DIGESTS})"))
def table_hash(spark, folder):
    return integrity.table_hash(tables.events(spark, folder), ["event_id", "src_ip", "packet_count"])


# ---- files ------------------------------------------------------------------------------------

def _item_files(spark, folder):
    """One text file per benchmark item, as a release folder would hold."""
    root = scratch_path(spark, "items")
    tables.table(spark, folder, "benchmark").select("item_id", "text").write.partitionBy("item_id").text(root)
    listed = records.inventory(spark, root, "*.txt")
    name = F.concat(F.lit("item_"), F.regexp_extract("path", r"item_id=(\d+)", 1), F.lit(".txt"))
    return integrity.fingerprints(listed).withColumn("name", name)


@R.add("l6_file_fingerprints", oracle("""SELECT 'item_' || item_id || '.txt' AS name, strlen(text) + 1 AS bytes, sha256(text || chr(10)) AS sha256 FROM benchmark"""))
def file_fingerprints(spark, folder):
    return _item_files(spark, folder).select("name", "bytes", "sha256")


@R.add("l7_manifest_verification", oracle("""SELECT CASE WHEN item_id % 11 = 0 THEN '../item_' || item_id || '.txt' ELSE 'item_' || item_id || '.txt' END AS name,
      CASE WHEN item_id % 11 = 0 THEN 'unsafe' WHEN item_id % 7 = 0 THEN 'changed' ELSE 'ok' END AS status FROM benchmark WHERE item_id % 5 <> 0
      UNION ALL SELECT 'item_' || item_id || '.txt', 'extra' FROM benchmark WHERE item_id % 5 = 0 OR item_id % 11 = 0
      UNION ALL SELECT 'gone_' || item_id || '.txt', 'missing' FROM benchmark WHERE item_id % 13 = 0"""))
def manifest_verification(spark, folder):
    i = F.col("item_id")
    items = tables.table(spark, folder, "benchmark")
    digest = F.when(i % 7 == 0, F.sha2(F.lit("other"), 256)).when(
        i % 3 == 0, F.sha2(F.regexp_replace(F.concat("text", F.lit("\n")), "\n", "\r\n"), 256)).otherwise(F.sha2(F.concat("text", F.lit("\n")), 256))
    name = F.concat(F.when(i % 11 == 0, "../item_").otherwise("item_"), i.cast("string"), F.lit(".txt"))
    lines = items.filter(i % 5 != 0).select(F.concat(digest, F.lit("  "), name).alias("line")).unionByName(
        items.filter(i % 13 == 0).select(F.concat(F.sha2(F.lit("x"), 256), F.lit("  gone_"), i.cast("string"), F.lit(".txt")).alias("line")))
    return integrity.manifest_check(integrity.manifest_lines(lines), _item_files(spark, folder).select("name", "sha256", "sha256_lf", "sha256_crlf"))


@R.add("f7_manifest_reconciliation", oracle("""SELECT coalesce(e.name, a.name) AS name, CASE WHEN e.name IS NULL THEN 'extra' WHEN a.name IS NULL THEN 'missing' WHEN e.d = a.d THEN 'ok' ELSE 'changed' END AS status
      FROM (SELECT 'doc/' || doc_id AS name, md5(text) AS d FROM documents WHERE doc_id % 5 <> 0) e
      FULL JOIN (SELECT 'doc/' || doc_id AS name, CASE WHEN doc_id % 7 = 0 THEN md5(text || ' ') ELSE md5(text) END AS d FROM documents WHERE doc_id % 3 <> 0) a ON a.name = e.name"""))
def manifest_reconciliation(spark, folder):
    docs, i = tables.table(spark, folder, "documents"), F.col("doc_id")
    name = F.concat(F.lit("doc/"), i.cast("string")).alias("name")
    listed = docs.filter(i % 5 != 0).select(name, F.sha2("text", 256).alias("expected"))
    text = F.when(i % 7 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text"))
    found = docs.filter(i % 3 != 0).select(name, F.sha2(text, 256).alias("sha256")).withColumns({"sha256_lf": F.col("sha256"), "sha256_crlf": F.col("sha256")})
    return integrity.manifest_check(listed, found)


@R.add("f6_fingerprint_match", oracle("SELECT 'doc/' || doc_id AS name, doc_id % 7 <> 0 AND doc_id % 4 <> 0 AS matches FROM documents"))
def fingerprint_match(spark, folder):
    docs, i = tables.table(spark, folder, "documents"), F.col("doc_id")
    name = F.concat(F.lit("doc/"), i.cast("string")).alias("name")
    known = docs.filter(i % 4 != 0).select(name, F.when(i % 7 == 0, F.sha2(F.concat("text", F.lit(" ")), 256)).otherwise(F.sha2("text", 256)).alias("sha256"))
    return integrity.fingerprint_matches(docs.select(name, F.sha2("text", 256).alias("sha256")), known)


@R.add("f6_sources_in_two_datasets", oracle("SELECT 'doc/' || doc_id % 97 AS name, count(DISTINCT source) AS datasets FROM documents GROUP BY doc_id % 97 HAVING count(DISTINCT source) > 1"))
def sources_in_two_datasets(spark, folder):
    docs = tables.table(spark, folder, "documents")
    return integrity.sources_in_two_datasets(docs.select(
        F.concat(F.lit("doc/"), (F.col("doc_id") % 97).cast("string")).alias("name"), F.col("source").alias("dataset")))


_EXT = "(['.py', '.csv', '.joblib', '.png', '.md', '.txt', '.json'])[doc_id % 7 + 1]"
_DIR = "(['src', 'data', 'models', 'results', 'outputs', 'tests', 'docs', 'checkpoints'])[doc_id % 8 + 1]"


@R.add("c19_file_categories", oracle(f"""SELECT CASE WHEN ext = '.py' THEN 'source_code' WHEN dir = 'data' THEN 'dataset' WHEN (ext = '.joblib' AND dir = 'checkpoints') OR dir = 'models' THEN 'trained_model'
      WHEN dir = 'results' THEN 'result' WHEN dir = 'outputs' THEN 'output' WHEN ext = '.png' THEN 'figure' WHEN dir = 'tests' THEN 'test' WHEN ext = '.txt' THEN 'dependency_or_config'
      WHEN ext = '.md' THEN 'documentation' ELSE 'other' END AS category, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes FROM (SELECT *, {_EXT} AS ext, {_DIR} AS dir FROM documents) GROUP BY 1"""))
def file_categories(spark, folder):
    pick = lambda names: F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("doc_id") % len(names) + 1).cast("int"))
    path = F.concat(F.lit("root/"), pick(["src", "data", "models", "results", "outputs", "tests", "docs", "checkpoints"]), F.lit("/d"), F.col("doc_id").cast("string"),
                    pick([".py", ".csv", ".joblib", ".png", ".md", ".txt", ".json"]))
    return integrity.category_rollup(tables.table(spark, folder, "documents").select(path.alias("path"), F.col("n_chars").alias("bytes")))


@R.add("b18_record_locations", oracle("SELECT seed, setting, 'seed_' || lpad(CAST(seed AS VARCHAR), 8, '0') || '_' || setting || '/window_results.csv' AS location FROM (SELECT DISTINCT seed, setting FROM ti)"))
def record_locations(spark, folder):
    t = tables.trials(spark, folder).select("seed", "setting").distinct()
    folder_name = F.concat(F.lit("seed_"), F.lpad(F.col("seed").cast("string"), 8, "0"), F.lit("_"), F.col("setting"))
    path = F.when(F.col("seed") % 2 == 0, F.concat(F.lit("C:\\lab\\"), folder_name, F.lit("\\window_results.csv"))).otherwise(F.concat(F.lit("/mnt/lab/"), folder_name, F.lit("/window_results.csv")))
    return t.select("seed", "setting", integrity.identity_of(path, F.col("seed"), F.col("setting")).alias("location"))


@R.add("b18_relocated_fingerprints", oracle("SELECT 'run/' || doc_id || '.json' AS relative, md5(text) AS digest FROM documents"))
def relocated_fingerprints(spark, folder):
    i = F.col("doc_id").cast("string")
    path = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("D:\\x\\collection_v3\\run\\"), i, F.lit(".json"))).otherwise(F.concat(F.lit("/a/b/collection_v3/run/"), i, F.lit(".json")))
    return integrity.relocated(tables.table(spark, folder, "documents").select(path.alias("path"), F.md5("text").alias("digest")), "collection_v3")


# ---- quality, repair and replay ----------------------------------------------------------------

@R.add("l8_window_quality", oracle("""SELECT switch_id, count(*) AS rows, CAST(count(*) FILTER (events % 4 = 0) AS BIGINT) AS nonfinite, CAST(count(*) FILTER (events % 5 = 0) AS BIGINT) AS materially_negative,
      CAST(count(*) FILTER (events % 3 = 0) AS BIGINT) AS roundoff_negative, count(*) FILTER (events = 7) AS bad_labels, count(*) FILTER (label = 0 AND events <> 7) AS label_0, count(*) FILTER (label = 1 AND events <> 7) AS label_1 FROM wf GROUP BY switch_id"""))
def window_quality(spark, folder):
    n = F.col("events")
    w = windows.switch_windows(tables.events(spark, folder), WINDOW).withColumns({
        "pkt_rate": F.when(n % 4 == 0, F.lit(float("inf"))).otherwise(F.col("pkt_rate")), "byte_rate": F.when(n % 5 == 0, -1.0).otherwise(F.col("byte_rate")),
        "flow_rate": F.when(n % 3 == 0, -1e-13).otherwise(F.col("flow_rate")), "label": F.when(n == 7, 2).otherwise(F.col("label"))})
    q = integrity.quality_report(w, ["switch_id"], FEATURES)
    return q.select(*[F.col(c).cast("bigint").alias(c) if c in ("nonfinite", "materially_negative", "roundoff_negative") else F.col(c) for c in q.columns])


@R.add("f5_repaired_sources", oracle("""SELECT source_file, window_start AS window_start_epoch, count(*) AS raw_rows, 0 AS repaired FROM fl WHERE source_file NOT LIKE 'error%' GROUP BY ALL
      UNION ALL SELECT source_file, window_start, count(*), 1 FROM fl WHERE source_file LIKE 'error%' GROUP BY ALL"""))
def repaired_sources(spark, folder):
    f = tables.flows(spark, folder)
    build = lambda rows: windows.flow_window_labels(rows, ["source_file"], WINDOW).select("source_file", "window_start_epoch", "raw_rows")
    broken = build(f.filter((F.col("packets") > 30) | ~F.col("source_file").startswith("error"))).withColumn("repaired", F.lit(0))
    fresh = build(f.filter(F.col("source_file").startswith("error"))).withColumn("repaired", F.lit(1))
    return integrity.repaired(broken, fresh)


@R.add("l9_reconciliation", oracle("""SELECT dataset_id, true AS raw_rows_kept, true AS pkt_sum_kept, false AS byte_rate_kept FROM fl GROUP BY dataset_id"""))
def reconciliation(spark, folder):
    f = tables.flows(spark, folder)
    per_file, merged = windows.flow_windows(f, WINDOW), windows.flow_windows(f, 2 * WINDOW, merge_files=True)
    return integrity.reconciliation(per_file, merged, ["dataset_id"], ["raw_rows"], ["pkt_sum", "byte_rate"])


# windows with a score from their features, and what a trial saved of their decisions: some rows forged, one way each
_ALARMS = ["alarms", "byte_sum", "events", "pkt_sum"]
_POLICY_TEXT = """'{"byte_rate_threshold":' || CAST(t AS VARCHAR) || ',"consecutive_windows":2,"rule_ttl_seconds":15,"version":"source_rate_envelope_v3"}'"""
_OBS_DIGEST = "sha256(" + " || ".join(f"length({c}) || ':' || {c}" for c in ("source_ip", "CAST(packets AS VARCHAR)", "CAST(bytes AS VARCHAR)", "CAST(duration_seconds AS VARCHAR)")) + ")"
_FORGED = ["score", "threshold", "prediction", "action", "target", "reason", "features", "observations", "policy"]
_REPLAY = {
    **_GATE,
    "wl": """SELECT run_id, window_index, CAST(sum(label) AS DOUBLE) AS alarms, CAST(sum(byte_count) AS DOUBLE) AS byte_sum, CAST(count(*) AS DOUBLE) AS events, CAST(sum(packet_count) AS DOUBLE) AS pkt_sum
      FROM ev GROUP BY ALL""",
    "oh": f"SELECT run_id, window_index, count(*) || ':' || {_SUMS} AS oh FROM (SELECT run_id, window_index, {_OBS_DIGEST} AS d FROM ob) GROUP BY ALL",
    "rp": f"""SELECT sel.*, least(alarms / 6, 1.0::DOUBLE) AS probability, 0.5::DOUBLE AS threshold, oh, sha256({_POLICY_TEXT}) AS ph,
      sha256('{{"alarms":' || CAST(alarms AS VARCHAR) || ',"byte_sum":' || CAST(byte_sum AS VARCHAR) || ',"events":' || CAST(events AS VARCHAR) || ',"pkt_sum":' || CAST(pkt_sum AS VARCHAR) || '}}') AS fh,
      (CAST(right(sel.run_id, 2) AS INTEGER) * 8 + sel.window_index) % 16 AS z FROM sel JOIN wl USING (run_id, window_index) JOIN oh USING (run_id, window_index), th""",
    "sv": """SELECT run_id, window_index, z, CASE WHEN z = 0 THEN probability + 0.125::DOUBLE ELSE probability END AS probability, CASE WHEN z = 1 THEN 0.25::DOUBLE ELSE threshold END AS threshold,
      CASE WHEN z = 2 THEN 1 - prediction ELSE prediction END AS prediction, CASE WHEN z IN (3, 4) THEN CASE WHEN action = 'NONE' THEN 'RATE_LIMIT' ELSE 'NONE' END ELSE action END AS action,
      CASE WHEN z = 5 THEN '10.0.0.99' ELSE target_source END AS target_source, CASE WHEN z = 6 THEN 'policy_abstains' ELSE safety_reason END AS safety_reason,
      CASE WHEN z = 7 THEN upper(fh) ELSE fh END AS fh, CASE WHEN z = 8 THEN '0:' || oh ELSE oh END AS oh, CASE WHEN z = 9 THEN '' ELSE ph END AS ph FROM rp WHERE z <> 10
      UNION ALL SELECT run_id, 90, z, probability, threshold, prediction, action, target_source, safety_reason, fh, oh, ph FROM rp WHERE z = 11
      UNION ALL SELECT run_id, window_index, z, probability, threshold, prediction, action, target_source, safety_reason, fh, oh, ph FROM rp WHERE z = 12""",
    "sn": "SELECT run_id, window_index, count(*) AS n, min(action) AS saved_action, any_value(COLUMNS(['probability', 'threshold', 'prediction', 'target_source', 'safety_reason', 'fh', 'oh', 'ph'])) FROM sv GROUP BY run_id, window_index",
}


def _decided(spark, folder):
    """Features, observations, policy and the replay of all windows."""
    observed, e = tables.observations(spark, folder), tables.events(spark, folder)
    policy = gate.GatePolicy(_threshold(observed), 2)
    w = e.groupBy("run_id", F.floor(F.hour("event_ts") / 3).cast("int").alias("window_index")).agg(
        F.sum("label").cast("double").alias("alarms"), F.sum("byte_count").cast("double").alias("byte_sum"), F.count(F.lit(1)).cast("double").alias("events"),
        F.sum("packet_count").cast("double").alias("pkt_sum"))
    return written(replay.replayed(w, observed, policy, F.least(F.col("alarms") / 6, F.lit(1.0)), 0.5, _ALARMS), "replay")


def _place16():
    return (F.substring("run_id", -2, 2).cast("int") * 8 + F.col("window_index")) % 16


def _saved(made):
    """What a trial would have saved, with one forgery a row in most rows of each sixteen."""
    z, other = F.col("_z"), F.when(F.col("action") == "NONE", "RATE_LIMIT").otherwise("NONE")
    forged = made.withColumn("_z", _place16()).withColumns({
        "probability": F.when(z == 0, F.col("probability") + 0.125).otherwise(F.col("probability")), "threshold": F.when(z == 1, F.lit(0.25)).otherwise(F.col("threshold")),
        "prediction": F.when(z == 2, 1 - F.col("prediction")).otherwise(F.col("prediction")), "action": F.when(z.isin(3, 4), other).otherwise(F.col("action")),
        "target_source": F.when(z == 5, F.lit("10.0.0.99")).otherwise(F.col("target_source")), "safety_reason": F.when(z == 6, F.lit("policy_abstains")).otherwise(F.col("safety_reason")),
        "input_feature_hash": F.when(z == 7, F.upper("input_feature_hash")).otherwise(F.col("input_feature_hash")),
        "source_observations_hash": F.when(z == 8, F.concat(F.lit("0:"), "source_observations_hash")).otherwise(F.col("source_observations_hash")),
        "source_policy_hash": F.when(z == 9, F.lit("")).otherwise(F.col("source_policy_hash"))})
    whole = forged.filter(z != 10)
    return whole.unionByName(whole.filter(z == 11).withColumn("window_index", F.lit(90))).unionByName(whole.filter(z == 12))


_CAUSE_SQL = """CASE WHEN sn.n IS NULL THEN 'missing' WHEN rp.run_id IS NULL THEN 'extra' WHEN sn.n > 1 THEN 'repeated' WHEN sn.probability IS DISTINCT FROM rp.probability THEN 'score'
      WHEN sn.threshold IS DISTINCT FROM rp.threshold THEN 'threshold' WHEN sn.prediction IS DISTINCT FROM rp.prediction THEN 'prediction' WHEN sn.saved_action IS DISTINCT FROM rp.action THEN 'action'
      WHEN sn.target_source IS DISTINCT FROM rp.target_source THEN 'target' WHEN sn.safety_reason IS DISTINCT FROM rp.safety_reason THEN 'reason' WHEN sn.fh IS DISTINCT FROM rp.fh THEN 'features'
      WHEN sn.oh IS DISTINCT FROM rp.oh THEN 'observations' WHEN sn.ph IS DISTINCT FROM rp.ph THEN 'policy' END"""


@R.add("l10_decision_replay", oracle(f"""SELECT coalesce(rp.run_id, sn.run_id) AS run_id, coalesce(rp.window_index, sn.window_index) AS window_index, saved_action, action, rp.safety_reason AS safety_reason, {_CAUSE_SQL} AS cause
      FROM rp FULL JOIN sn ON sn.run_id = rp.run_id AND sn.window_index = rp.window_index""", **_REPLAY))
def decision_replay(spark, folder):
    made = _decided(spark, folder)
    return replay.replay_report(_saved(made), made)


@R.add("l10_audit_records", oracle("""SELECT run_id, window_index, field FROM (SELECT run_id, window_index, unnest(CASE
      WHEN window_index >= 6 THEN CASE WHEN z IN (4, 5) THEN ['unexpected'] END WHEN z IN (10, 12) THEN ['record']
      ELSE list_filter([CASE WHEN z IN (3, 4) THEN 'action' END, CASE WHEN z = 5 THEN 'target_source' END, CASE WHEN z = 7 THEN 'input_feature_hash' END], lambda f: f IS NOT NULL) END) AS field FROM rp)
      UNION ALL SELECT run_id, 90, 'unexpected' FROM rp WHERE z = 11""", **_REPLAY))
def audit_records(spark, folder):
    # windows from the seventh on are not audited, yet some have a record
    made = _decided(spark, folder)
    kept = _saved(made).filter((F.col("window_index") < 6) | _place16().isin(4, 5) | (F.col("window_index") == 90))
    return replay.audit_differences(made, kept, ["action", "target_source", "input_feature_hash"], F.col("window_index") < 6)


# what a flow dump shows after each decision: wrong source, lifetime or action, a second rule, none, one left by a NONE
_DUMPED = {
    **_GATE,
    "y": "SELECT *, (CAST(right(run_id, 2) AS INTEGER) + window_index) % 8 AS y FROM sel",
    "vw": """SELECT *, CASE WHEN action = 'RATE_LIMIT' THEN CASE y WHEN 0 THEN 'wrong_source' WHEN 1 THEN 'wrong_lifetime' WHEN 2 THEN 'not_metered' WHEN 3 THEN 'rule_repeated' WHEN 4 THEN 'rule_missing' ELSE 'ok' END
      ELSE CASE WHEN y = 5 THEN 'rule_without_decision' ELSE 'ok' END END AS evidence FROM y""",
}


@R.add("f11_enforcement_evidence", oracle("""SELECT run_id, window_index, action, target_source, CAST(CASE evidence WHEN 'rule_repeated' THEN 2 WHEN 'rule_missing' THEN 0 ELSE CASE WHEN action = 'NONE' AND evidence = 'ok' THEN 0 ELSE 1 END END AS BIGINT) AS rules, evidence FROM vw""", **_DUMPED))
def enforcement_evidence(spark, folder):
    observed, w = tables.observations(spark, folder), tables.gate_windows(spark, folder).drop("label")
    made = written(gate.select_sources(w, observed, gate.GatePolicy(_threshold(observed), 2)), "decisions")
    y = (F.substring("run_id", -2, 2).cast("int") + F.col("window_index")) % 8
    limits = F.col("action") == "RATE_LIMIT"
    source = F.when(limits & (y != 0), F.col("target_source")).otherwise("10.0.0.77")
    rule = F.concat(
        F.lit(gate.COOKIE + ", hard_timeout="), F.when(limits & (y == 1), "30").otherwise("15"), F.lit(",priority=300,ip,nw_src="), source, F.lit(",nw_dst=10.253.0.3 actions="),
        F.when(limits & (y == 2), "NORMAL").otherwise("meter:1,NORMAL"))
    rules = F.when(limits & (y == 3), 2).when(F.when(limits, y != 4).otherwise(y == 5), 1).otherwise(0)
    # every dump also holds a rule that is not the gate's
    lines = F.concat(F.array(F.lit("cookie=0x1, priority=0 actions=NORMAL")), F.array_repeat(rule, rules))
    flows = made.select("run_id", (F.col("window_index") + 1).alias("applies_to_window"), F.explode(lines).alias("flow"))
    return gate.enforcement_evidence(made, flows)


@R.add("f12_predictions_on_windows", oracle("SELECT row_id, label = 0 OR events % 6 <> 0 AS labels_agree FROM wf"))
def predictions_on_windows(spark, folder):
    w = windows.switch_windows(tables.events(spark, folder), WINDOW).select("row_id", "label", "events")
    saved = w.select("row_id", F.when(F.col("events") % 6 == 0, 0).otherwise(F.col("label")).alias("saved_label"))
    return w.join(saved, "row_id").select("row_id", F.col("label").eqNullSafe(F.col("saved_label")).alias("labels_agree"))


@R.add("l12_metric_recompute", oracle(f"""SELECT dataset, metric, {sql_round({'stored': 'stored', 'computed': 'computed'})} FROM (SELECT dataset, 'f1' AS metric, {RATIO_SQL['f1']} + 0.25::DOUBLE AS stored, {RATIO_SQL['f1']} AS computed
      FROM (SELECT dataset, {COUNTS_SQL} FROM sc GROUP BY dataset)) WHERE dataset IN ('error', 'click')  AND computed IS NOT NULL"""))
def metric_recompute(spark, folder):
    computed = metrics.strict_metrics(metrics.confusion(tables.scores(spark, folder), ["dataset"]))
    stored = computed.withColumn("f1", F.when(F.col("dataset").isin("error", "click"), F.col("f1") + 0.25).otherwise(F.col("f1")))
    return rounded(integrity.summary_mismatches(stored, computed, ["dataset"], ["precision", "recall", "f1"]))


@R.add("l13_setting_pairing", oracle("""SELECT seed, window_index, 'changed' AS status FROM (SELECT a.seed, a.window_index, a.prediction AS p, b.prediction AS q FROM ti a JOIN ti b ON a.seed = b.seed AND a.window_index = b.window_index
      WHERE a.setting = 'audit_enabled' AND b.setting = 'audit_disabled') WHERE p <> q"""))
def setting_pairing(spark, folder):
    t = tables.trials(spark, folder)
    return integrity.row_differences(t.filter("setting = 'audit_enabled'"), t.filter("setting = 'audit_disabled'"), ["seed", "window_index"], ["label", "prediction"])


@R.add("l14_trial_coverage", oracle("""SELECT seed, setting, CASE WHEN seed > 30 THEN 'missing' ELSE 'extra' END AS status FROM (SELECT CAST(s AS INTEGER) AS seed, setting FROM range(31, 33) t(s), (VALUES ('audit_enabled'), ('audit_disabled')) v(setting)
      UNION ALL SELECT DISTINCT seed, setting FROM ti WHERE setting = 'mitigation_disabled')"""))
def trial_coverage(spark, folder):
    found = tables.trials(spark, folder)
    wanted = spark.range(1, 33).select(F.col("id").cast("int").alias("seed"), F.explode(F.array(F.lit("audit_enabled"), F.lit("audit_disabled"))).alias("setting"))
    return integrity.coverage(wanted, found, ["seed", "setting"])


QUERIES, ORACLES = R.queries, R.oracles
