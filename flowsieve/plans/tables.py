"""Views of the given tables that stand for the library's inputs, in Spark and as oracle SQL.

Each Spark view has a SQL twin of the same name; an oracle query is the twins it
needs plus the statement itself.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WINDOW = 3 * 3600
HISTORY = 18 * 3600
DECAY = 9 * 3600


def utc(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return utc(spark).read.parquet(f"{folder}/{name}.parquet")


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Controller events: one run per day, two switches, three services, twelve sources."""
    return shape_events(table(spark, folder, "events"))


def shape_events(raw: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    packets = F.floor("value").cast("bigint") + 1
    return raw.select(
        "event_id", F.col("ts").cast("timestamp").alias("event_ts"),
        F.date_format("ts", "yyyy-MM-dd").alias("run_id"),
        F.concat(F.lit("topo"), (k % 2).cast("string")).alias("topology_id"),
        F.col("event_type").alias("scenario_id"),
        F.when(F.hour("ts") < 8, "benign").when(F.hour("ts") < 16, "attack").otherwise("recovery").alias("phase"),
        F.concat(F.lit("sw"), (k % 2).cast("string")).alias("switch_id"),
        F.concat(F.lit("10.0.0."), (F.col("user_id") % 12).cast("string")).alias("src_ip"),
        F.concat(F.lit("s"), (k % 3).cast("string")).alias("dst_ip"),
        packets.alias("packet_count"), (packets * (k + 40)).alias("byte_count"), (k % 7).alias("flow_count"),
        ((F.col("event_type") == "error") & (F.col("value") > 40)).cast("int").alias("label"),
        F.least(F.col("value") / 500, F.lit(1.0)).alias("probability"), k.alias("k"),
    )


def flows(spark: SparkSession, folder: str) -> DataFrame:
    """Normalized flow rows read from the event table."""
    e = events(spark, folder)
    attack = e.label
    target = F.when((attack == 1) & (F.col("k") % 2 == 0), 1).otherwise(0)
    return e.select(
        F.lit("events").alias("dataset_id"), F.col("scenario_id"),
        F.concat(F.col("scenario_id"), F.lit("/"), F.col("topology_id"), F.lit(".csv")).alias("source_file"),
        (F.unix_micros("event_ts") / F.lit(1e6)).alias("ts_epoch"),
        F.col("packet_count").cast("double").alias("packets"), F.col("byte_count").cast("double").alias("bytes"),
        F.when(F.col("k") % 17 == 0, "-").when(F.col("k") % 19 == 0, "").otherwise(F.col("src_ip")).alias("src"),
        attack.alias("is_attack"), target.alias("is_target"), (attack - target).alias("is_other"),
        F.when(attack == 0, "benign").when(target == 1, "ddos").otherwise("scan").alias("label_text"),
        F.when(F.col("scenario_id") == "error", "local_time_timezone_unspecified").otherwise("unix_utc").alias("timestamp_basis"),
        F.col("event_id").alias("position"),
    )


def line_flows(spark: SparkSession, folder: str) -> DataFrame:
    """Flow rows from the largest table, for weekly windows."""
    l = table(spark, folder, "lineitem")
    attack = (F.col("l_returnflag") == "R").cast("int")
    target = F.when((attack == 1) & (F.col("l_linestatus") == "F"), 1).otherwise(0)
    return l.select(
        F.lit("lineitem").alias("dataset_id"),
        F.concat(F.lit("line"), F.col("l_linenumber").cast("string")).alias("scenario_id"),
        F.concat(F.lit("line"), F.col("l_linenumber").cast("string"), F.lit("/"), F.col("l_linestatus"), F.lit(".csv")).alias("source_file"),
        (F.unix_micros(F.col("l_shipdate").cast("timestamp")) / F.lit(1e6)).alias("ts_epoch"),
        F.col("l_quantity").alias("packets"), F.floor("l_extendedprice").cast("double").alias("bytes"),
        F.col("l_suppkey").cast("string").alias("src"),
        attack.alias("is_attack"), target.alias("is_target"), (attack - target).alias("is_other"),
        F.concat(F.lit("flag_"), F.col("l_returnflag")).alias("label_text"),
        F.lit("unix_utc").alias("timestamp_basis"),
    )


def scores(spark: SparkSession, folder: str) -> DataFrame:
    """Scored rows: fold, block, label, probability, prediction at 0.1."""
    e = events(spark, folder)
    return e.select(
        F.col("scenario_id").alias("dataset"), (F.col("k") % 4).cast("int").alias("fold"), "run_id",
        F.col("event_id").cast("string").alias("row_id"), "label", "probability",
        (F.col("probability") >= 0.1).cast("int").alias("prediction"), "k",
    )


def policies(spark: SparkSession, folder: str) -> DataFrame:
    """Three policies scoring the same rows; the baseline is one of them."""
    s = scores(spark, folder).select("fold", "run_id", "row_id", "label", "k", F.col("probability").alias("p"))
    names = F.array(
        F.struct(F.lit("ml_window_baseline").alias("policy"), F.col("p").alias("probability")),
        F.struct(F.lit("bipartite").alias("policy"), F.least(F.col("p") * (F.col("k") % 5 + 3) / 5, F.lit(1.0)).alias("probability")),
        F.struct(F.lit("selector").alias("policy"), F.when(F.col("label") == 1, F.sqrt("p")).otherwise(F.col("p") * 0.9).alias("probability")),
    )
    long = s.select("fold", "run_id", "row_id", "label", F.explode(names).alias("s")).select(
        "fold", "run_id", "row_id", "label", "s.policy", "s.probability",
    )
    proposed = (F.col("probability") >= 0.1)
    gate = F.when(F.col("policy") == "selector", proposed & (1 - F.col("probability") <= 0.8)).otherwise(proposed)
    return long.select(
        "*", F.lit(0.1).alias("threshold"), gate.cast("int").alias("prediction"),
        F.when(gate, "RATE_LIMIT").otherwise("NONE").alias("action"), (proposed & ~gate).cast("int").alias("abstained"),
    )


def observations(spark: SparkSession, folder: str) -> DataFrame:
    """Per (run, window, source) telemetry of three-hour windows."""
    e = events(spark, folder)
    return e.groupBy("run_id", F.floor(F.hour("event_ts") / 3).cast("int").alias("window_index"), F.col("src_ip").alias("source_ip")).agg(
        F.sum("packet_count").alias("packets"), F.sum("byte_count").alias("bytes"),
    ).withColumn("duration_seconds", F.lit(float(WINDOW)))


def gate_windows(spark: SparkSession, folder: str) -> DataFrame:
    """One row per (run, window) with the window prediction."""
    e = events(spark, folder)
    return e.groupBy("run_id", F.floor(F.hour("event_ts") / 3).cast("int").alias("window_index")).agg(
        (F.sum("label") > 2).cast("int").alias("prediction"), F.max("label").alias("label"),
    )


def truth(spark: SparkSession, folder: str) -> DataFrame:
    """Which sources are attackers: those whose share of attack events is above the mean."""
    e = events(spark, folder)
    return e.groupBy(F.col("src_ip").alias("source_ip")).agg(
        (F.sum("label") * 20 > F.count(F.lit(1)) * 2).cast("int").alias("is_attacker"),
    )


def trials(spark: SparkSession, folder: str) -> DataFrame:
    """Trial windows of three settings over the same schedule."""
    e = events(spark, folder)
    base = e.groupBy("run_id", F.floor(F.hour("event_ts") / 3).cast("int").alias("window_index")).agg(
        F.max("label").alias("label"), F.sum("packet_count").alias("pk"), F.sum("byte_count").alias("by"),
        F.count(F.lit(1)).alias("n"), F.sum("flow_count").alias("fl"),
    )
    setting = F.explode(F.array(F.lit("audit_disabled"), F.lit("audit_enabled"), F.lit("mitigation_disabled"))).alias("setting")
    t = base.select("*", setting).withColumn(
        "s", F.when(F.col("setting") == "audit_enabled", 1).when(F.col("setting") == "audit_disabled", 2).otherwise(3))
    attack = (F.col("n") % 4 == 0).cast("int")
    target = F.when((F.col("setting") != "mitigation_disabled") & ((F.col("pk") + F.col("s")) % 3 == 0),
                    F.concat(F.lit("10.0.0."), (F.col("pk") % 12).cast("string"))).otherwise(F.lit(""))
    return t.select(
        F.when(F.dayofmonth(F.to_date("run_id")) % 2 == 0, "host_a").otherwise("host_b").alias("dataset"),
        F.dayofmonth(F.to_date("run_id")).cast("int").alias("seed"), "setting", "window_index",
        F.when(F.col("window_index") < 2, "benign").when(F.col("window_index") < 6, "attack").otherwise("recovery").alias("phase"),
        attack.alias("label"), ((F.col("pk") * F.col("s")) % 5 < 2).cast("int").alias("prediction"),
        F.when(target != "", "RATE_LIMIT").otherwise("NONE").alias("action"), target.alias("next_target"),
        F.lit(2.0).alias("scheduled_benign_mbps"), (attack * 10).cast("double").alias("scheduled_attack_mbps"),
        attack.alias("scheduled_attackers"),
        F.when(F.col("fl") % 6 != 0, F.col("pk") / 100.0).alias("benign_receiver_mbps"),
        F.when(F.col("fl") % 6 != 0, (F.col("pk") % 40).cast("double")).alias("benign_loss_percent"),
        F.when((attack == 0), F.lit(0.0)).when(F.col("fl") % 5 != 0, F.col("by") / 1000.0).alias("attack_receiver_mbps"),
        (F.col("pk") / 64.0).alias("inference_latency_ms"),
    )


# ---- SQL twins -------------------------------------------------------------------------------

TWINS: dict[str, str] = {
    "ev": """SELECT event_id, ts AS event_ts, epoch_us(ts) AS us, strftime(ts, '%Y-%m-%d') AS run_id,
      'topo' || (k % 2) AS topology_id, event_type AS scenario_id,
      CASE WHEN hour(ts) < 8 THEN 'benign' WHEN hour(ts) < 16 THEN 'attack' ELSE 'recovery' END AS phase,
      'sw' || (k % 2) AS switch_id, '10.0.0.' || (user_id % 12) AS src_ip, 's' || (k % 3) AS dst_ip,
      CAST(floor(value) AS BIGINT) + 1 AS packet_count, (CAST(floor(value) AS BIGINT) + 1) * (k + 40) AS byte_count,
      k % 7 AS flow_count, CASE WHEN event_type = 'error' AND value > 40 THEN 1 ELSE 0 END AS label,
      least(value / 500, 1.0) AS probability, k,
      CAST(floor(epoch_us(ts) / 10800000000) AS BIGINT) * 10800 AS window_start,
      CAST(floor(hour(ts) / 3) AS INTEGER) AS window_index
    FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events)""",
    "fl": """SELECT 'events' AS dataset_id, scenario_id, scenario_id || '/' || topology_id || '.csv' AS source_file,
      us / 1e6 AS ts_epoch, CAST(packet_count AS DOUBLE) AS packets, CAST(byte_count AS DOUBLE) AS bytes,
      CASE WHEN k % 17 = 0 THEN '-' WHEN k % 19 = 0 THEN '' ELSE src_ip END AS src, label AS is_attack,
      CASE WHEN label = 1 AND k % 2 = 0 THEN 1 ELSE 0 END AS is_target,
      label - CASE WHEN label = 1 AND k % 2 = 0 THEN 1 ELSE 0 END AS is_other,
      CASE WHEN label = 0 THEN 'benign' WHEN k % 2 = 0 THEN 'ddos' ELSE 'scan' END AS label_text,
      CASE WHEN scenario_id = 'error' THEN 'local_time_timezone_unspecified' ELSE 'unix_utc' END AS timestamp_basis,
      event_id AS position, window_start
    FROM ev""",
    "lf": """SELECT 'lineitem' AS dataset_id, 'line' || l_linenumber AS scenario_id,
      'line' || l_linenumber || '/' || l_linestatus || '.csv' AS source_file,
      epoch_us(l_shipdate) / 1e6 AS ts_epoch, l_quantity AS packets, floor(l_extendedprice) AS bytes,
      CAST(l_suppkey AS VARCHAR) AS src, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS is_attack,
      CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 1 ELSE 0 END AS is_target,
      CASE WHEN l_returnflag = 'R' AND l_linestatus <> 'F' THEN 1 ELSE 0 END AS is_other,
      'flag_' || l_returnflag AS label_text, 'unix_utc' AS timestamp_basis,
      CAST(floor(epoch_us(l_shipdate) / 604800000000) AS BIGINT) * 604800 AS window_start
    FROM lineitem""",
    "sc": """SELECT scenario_id AS dataset, CAST(k % 4 AS INTEGER) AS fold, run_id, CAST(event_id AS VARCHAR) AS row_id,
      label, probability, CASE WHEN probability >= 0.1::DOUBLE THEN 1 ELSE 0 END AS prediction, k FROM ev""",
    "po": """SELECT *, CASE WHEN probability >= 0.1::DOUBLE AND prediction = 0 THEN 1 ELSE 0 END AS abstained,
      CASE WHEN prediction = 1 THEN 'RATE_LIMIT' ELSE 'NONE' END AS action, 0.1::DOUBLE AS threshold FROM (
      SELECT *, CASE WHEN probability >= 0.1::DOUBLE AND (policy <> 'selector' OR 1 - probability <= 0.8::DOUBLE) THEN 1 ELSE 0 END AS prediction FROM (
        SELECT fold, run_id, row_id, label, 'ml_window_baseline' AS policy, probability FROM sc
        UNION ALL SELECT fold, run_id, row_id, label, 'bipartite', least(probability * (k % 5 + 3) / 5, 1.0) FROM sc
        UNION ALL SELECT fold, run_id, row_id, label, 'selector', CASE WHEN label = 1 THEN sqrt(probability) ELSE probability * 0.9::DOUBLE END FROM sc))""",
    "ob": """SELECT run_id, window_index, src_ip AS source_ip, CAST(sum(packet_count) AS BIGINT) AS packets,
      CAST(sum(byte_count) AS BIGINT) AS bytes, 10800.0::DOUBLE AS duration_seconds FROM ev GROUP BY ALL""",
    "gw": """SELECT run_id, window_index, CASE WHEN sum(label) > 2 THEN 1 ELSE 0 END AS prediction, max(label) AS label
      FROM ev GROUP BY ALL""",
    "tr": """SELECT src_ip AS source_ip, CASE WHEN sum(label) * 20 > count(*) * 2 THEN 1 ELSE 0 END AS is_attacker
      FROM ev GROUP BY ALL""",
    "ti": """SELECT CASE WHEN CAST(right(run_id, 2) AS INTEGER) % 2 = 0 THEN 'host_a' ELSE 'host_b' END AS dataset,
      CAST(right(run_id, 2) AS INTEGER) AS seed, setting, window_index,
      CASE WHEN window_index < 2 THEN 'benign' WHEN window_index < 6 THEN 'attack' ELSE 'recovery' END AS phase,
      CASE WHEN n % 4 = 0 THEN 1 ELSE 0 END AS label, CASE WHEN (pk * s) % 5 < 2 THEN 1 ELSE 0 END AS prediction,
      CASE WHEN tgt <> '' THEN 'RATE_LIMIT' ELSE 'NONE' END AS action, tgt AS next_target,
      2.0::DOUBLE AS scheduled_benign_mbps, CASE WHEN n % 4 = 0 THEN 10.0::DOUBLE ELSE 0.0::DOUBLE END AS scheduled_attack_mbps,
      CASE WHEN n % 4 = 0 THEN 1 ELSE 0 END AS scheduled_attackers,
      CASE WHEN fl % 6 <> 0 THEN pk / 100.0::DOUBLE END AS benign_receiver_mbps,
      CASE WHEN fl % 6 <> 0 THEN CAST(pk % 40 AS DOUBLE) END AS benign_loss_percent,
      CASE WHEN n % 4 <> 0 THEN 0.0::DOUBLE WHEN fl % 5 <> 0 THEN byt / 1000.0::DOUBLE END AS attack_receiver_mbps,
      pk / 64.0::DOUBLE AS inference_latency_ms
    FROM (SELECT *, CASE WHEN setting <> 'mitigation_disabled' AND (pk + s) % 3 = 0 THEN '10.0.0.' || (pk % 12) ELSE '' END AS tgt
      FROM (SELECT run_id, window_index, CAST(sum(packet_count) AS BIGINT) AS pk, CAST(sum(byte_count) AS BIGINT) AS byt,
              count(*) AS n, CAST(sum(flow_count) AS BIGINT) AS fl FROM ev GROUP BY ALL),
           (VALUES ('audit_enabled', 1), ('audit_disabled', 2), ('mitigation_disabled', 3)) AS v(setting, s))""",
    "win": """SELECT run_id, window_start, switch_id, dst_ip, strftime(to_timestamp(window_start) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S+00:00') AS iso,
      sum(n) AS ev_n, count(*) AS uniq, CAST(sum(pk) AS DOUBLE) AS pk, CAST(sum(byt) AS DOUBLE) AS byt, CAST(sum(fl) AS DOUBLE) AS fl,
      greatest(log2(sum(n)) - sum(n * log2(n)) / sum(n), 0) AS ent, max(label) AS label,
      (SELECT string_agg(DISTINCT e2.scenario_id, '|' ORDER BY e2.scenario_id) FROM ev e2 WHERE e2.run_id = g.run_id
        AND e2.window_start = g.window_start AND e2.switch_id = g.switch_id AND e2.dst_ip = g.dst_ip) AS scenario_id
    FROM (SELECT run_id, window_start, switch_id, dst_ip, src_ip, count(*) AS n, sum(packet_count) AS pk, sum(byte_count) AS byt,
            sum(flow_count) AS fl, max(label) AS label FROM ev GROUP BY ALL) g
    GROUP BY run_id, window_start, switch_id, dst_ip""",
    "wf": """SELECT run_id || '|' || iso || '|' || switch_id || '|' || dst_ip AS row_id, run_id, window_start, switch_id, dst_ip,
      window_start + 10800 AS window_end, scenario_id, label, pk / 10800 AS pkt_rate, byt / 10800 AS byte_rate, pk AS pkt_sum,
      CAST(ev_n AS BIGINT) AS events, uniq AS unique_src, ent AS src_ip_entropy,
      CASE WHEN fl > 0 THEN fl ELSE CAST(ev_n AS DOUBLE) END AS flow_count,
      (CASE WHEN fl > 0 THEN fl ELSE ev_n END) / 10800.0::DOUBLE AS flow_rate
    FROM win""",
}


def oracle(statement: str, **extra: str) -> str:
    """``statement`` preceded by every twin (and extra CTE) it refers to."""
    known = {**TWINS, **extra}
    wanted: list[str] = []
    open_names: set[str] = set()

    def visit(text: str) -> None:
        for name in re.findall(r"(?:FROM|JOIN|,)\s+([a-z_][a-z0-9_]*)", text):
            if name in known and name not in open_names:
                open_names.add(name)
                visit(known[name])
                wanted.append(name)

    visit(statement)
    head = ",\n".join(f"{n} AS (\n{known[n]})" for n in wanted)
    return f"WITH {head}\n{statement}" if head else statement


def place(value: Column, digits: int = 6) -> Column:
    """``value`` at a fixed number of places. A nudge far below them settles exact ties the same way in every engine."""
    return F.round(value + F.lit(10.0 ** -(digits + 3)), digits) + F.lit(0.0)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles at a fixed number of places so results compare across engines."""
    types = dict(df.dtypes)
    return df.select(*[
        place(F.col(c), digits).alias(c) if types[c] == "double" else F.col(c) for c in df.columns
    ])


def sql_round(columns: dict[str, str], digits: int = 6) -> str:
    return ", ".join(f"{sql_place(e, digits)} AS {n}" for n, e in columns.items())


def sql_place(expression: str, digits: int = 6) -> str:
    return f"round({expression} + 1e-{digits + 3}, {digits}) + 0.0"
