"""Severity, actions, routing and alert records as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def threshold_severity(packets: Column, threshold: Column) -> Column:
    ratio = F.least(packets / F.greatest(threshold, F.lit(1)), F.lit(10.0))
    graded = F.greatest(F.lit(1), F.least(F.lit(10), F.floor(ratio).cast("int")))
    return F.when(packets <= threshold, 0).otherwise(graded)


def probability_severity(probability: Column, detected: Column) -> Column:
    graded = F.greatest(F.lit(1), F.least(F.lit(10), F.rint(probability * 10).cast("int")))
    return F.when(detected, graded).otherwise(0)


def severity_action(severity: Column) -> Column:
    return F.when(severity >= 7, "BLOCK").when(severity >= 1, "RATE_LIMIT").otherwise("NONE")


def model_action(probability: Column, detect: Column, block: Column, window_mode: Column) -> Column:
    """Window scores never block."""
    hit = probability >= detect
    return F.when(hit & ~window_mode & (probability >= block), "BLOCK").when(hit, "RATE_LIMIT").otherwise("NONE")


def window_action(probability: Column, threshold: Column) -> Column:
    return F.when(probability >= threshold, "RATE_LIMIT").otherwise("NONE")


def risk_gated(probability: Column, threshold: Column, max_benign: float) -> Column:
    return ((probability >= threshold) & (1 - probability <= max_benign)).cast("int")


def routed(
    df: DataFrame, mode: str = "auto", *, flow_score: str = "flow_score", window_score: str = "window_score",
    packets: str = "packet_count", threshold: float = 100, detect: float = 0.5, block: float = 0.9, window_threshold: float = 0.5,
) -> DataFrame:
    """Method, detection, severity and action per row; a missing score falls back to the next method."""
    if mode not in ("auto", "threshold", "ml_flow", "ml_window"):
        raise ValueError(f"unknown decision mode {mode}")
    nothing = F.lit(None).cast("double")
    flow = F.col(flow_score) if mode in ("auto", "ml_flow") else nothing
    window = F.col(window_score) if mode in ("auto", "ml_window") else nothing
    method = F.when(flow.isNotNull(), "ml_flow").when(window.isNotNull(), "ml_window").otherwise("threshold")
    staged = df.withColumns({"method": method, "p_attack": F.coalesce(flow, window)})
    windowed = F.col("method") == "ml_window"
    limit = F.when(windowed, F.lit(window_threshold)).otherwise(F.lit(detect))
    by_count = F.col("method") == "threshold"
    t, n, p = F.lit(threshold), F.col(packets), F.col("p_attack")
    staged = staged.withColumn("detected", F.when(by_count, n > t).otherwise(p >= limit))
    return staged.withColumn(
        "severity", F.when(by_count, threshold_severity(n, t)).otherwise(probability_severity(p, F.col("detected")))
    ).withColumn(
        "action", F.when(by_count, severity_action(F.col("severity"))).otherwise(model_action(p, limit, F.lit(block), windowed)))


def alerts(decisions: DataFrame, key: list[str], controller: str = "controller_id", lifetime: int = 3600) -> DataFrame:
    """One record per detection; ids are hashes of the key, so a replay writes the same ids."""
    mark = F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in key]), 256)
    acted = F.col("action") != "NONE"
    return decisions.filter("detected").select(
        F.concat(F.lit("alert_"), mark).alias("alert_id"),
        *key, controller, "epoch", "switch_id", "src_ip", "dst_ip", "packet_count", "severity", "action", "method",
        (F.lit(150) + F.col("severity")).alias("priority"), (F.col("epoch") + lifetime).alias("expiry"),
        acted.alias("mitigated"), F.when(acted, F.concat(F.lit("rule_"), mark)).alias("mitigation_rule_id"),
        F.when(acted, "mitigated").otherwise("detection_only").alias("status"))


def alert_totals(alert_rows: DataFrame, controller: str = "controller_id") -> DataFrame:
    return alert_rows.groupBy(controller).agg(
        F.count(F.lit(1)).alias("total_alerts"), F.count_if("mitigated").alias("mitigated_attacks"))
