"""Structured Streaming twins of the window, gate and counter operators.

All state lives in Spark's own keyed aggregations with a watermark. They combine on
the map side, so one hot destination or run does not pin a stateful task, and no
Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.operators import decide
from flowsieve.operators.gate import GatePolicy, _verdict
from flowsieve.operators.windows import _features, source_counts, window_totals
from flowsieve.schemas import FEATURES


def _seconds(n: int) -> str:
    return f"{n} seconds"


def completed_windows(events: DataFrame, seconds: int, delay: int) -> DataFrame:
    """Switch-destination features of closed windows; rows behind the watermark are dropped by Spark."""
    keys = ["run_id", "window", "switch_id", "dst_ip"]
    rows = events.withWatermark("event_ts", _seconds(delay)).withColumn("window", F.window("event_ts", _seconds(seconds)))
    counts = source_counts(rows, keys, "src_ip", {
        "_pkt": F.col("packet_count"), "_byte": F.col("byte_count"), "_flow": F.col("flow_count")})
    totals = window_totals(counts, keys, ["_pkt", "_byte", "_flow"])
    flows = F.when(F.col("_flow") > 0, F.col("_flow")).otherwise(F.col("_events"))
    return _features(totals, keys, seconds, flows).select(
        "run_id", F.unix_seconds(F.col("window.start")).alias("window_start"), "switch_id", "dst_ip", *FEATURES)


def scored_windows(windows: DataFrame, detector) -> DataFrame:
    """Closed windows with probability, decision and action of a fitted detector."""
    return detector.predict(windows)


def rule_decisions(windows: DataFrame, score: Column, threshold: float) -> DataFrame:
    """Closed windows with a score expression in place of a model."""
    scored = windows.withColumn("probability", score)
    p, t = F.col("probability"), F.lit(threshold)
    return scored.withColumns({
        "prediction": (p >= t).cast("int"), "action": decide.window_action(p, t), "severity": decide.probability_severity(p, p >= t)})


def gate_decisions(observations: DataFrame, predictions: DataFrame, policy: GatePolicy, seconds: int, delay: int) -> DataFrame:
    """The source gate over two streams keyed by (run_id, window_index).

    Both carry ``window_ts``, the start of their window. Exceedances are repeated for the
    windows they count towards and counted per source, then per window, exactly as in
    batch; a prediction row marks that the window exists.
    """
    limit, need = policy.byte_rate_threshold, policy.consecutive_windows
    over = observations.filter(F.lit(False) if limit is None else F.col("bytes") / F.col("duration_seconds") > limit)
    ahead = F.explode(F.sequence(F.lit(0), F.lit(need - 1))).alias("_ahead")
    hits = over.select("run_id", "window_index", "source_ip", "window_ts", ahead).select(
        "run_id", (F.col("window_index") + F.col("_ahead")).cast("int").alias("window_index"), "source_ip",
        (F.col("window_ts") + F.make_dt_interval(secs=(F.col("_ahead") * seconds).cast("decimal(18,6)"))).alias("window_ts"),
        F.lit(None).cast("int").alias("prediction"))
    marks = predictions.select("run_id", "window_index", F.lit(None).cast("string").alias("source_ip"), "window_ts", "prediction")
    keys = ["run_id", "window_index", F.window("window_ts", _seconds(seconds)).alias("window")]
    # repeats lie ahead of their row; the watermark must not run ahead with them
    slack = delay + (need - 1) * seconds
    per_source = hits.unionByName(marks).withWatermark("window_ts", _seconds(slack)).groupBy(*keys, "source_ip").agg(
        F.count(F.lit(1)).alias("_hits"), F.max("prediction").alias("prediction"))
    standing = per_source.filter(F.col("source_ip").isNull() | (F.col("_hits") == need))
    merged = standing.groupBy("run_id", "window_index", "window").agg(
        F.max("prediction").alias("prediction"), F.count("source_ip").alias("candidate_count"), F.min("source_ip").alias("_only"))
    decided = merged.filter(F.col("prediction").isNotNull()).withColumns(_verdict(F.lit(limit).cast("double")))
    return decided.select(
        "run_id", "window_index", "prediction", "candidate_count", "target_source", "action", "safety_reason",
        F.lit(policy.rule_ttl_seconds).alias("rule_ttl_seconds"))


def counter_deltas(polls: DataFrame, poll_seconds: int, delay: int) -> DataFrame:
    """Counter growth between adjacent polls; needs ``poll_ts`` besides the batch columns."""
    now = polls.select("*", F.lit(0).alias("_shift"))
    before = polls.select("*", F.lit(1).alias("_shift"))
    step = F.make_dt_interval(secs=(F.col("_shift") * poll_seconds).cast("decimal(18,6)"))
    both = now.unionByName(before).select(
        "run_id", "window_index", "source_ip", (F.col("poll_index") + F.col("_shift")).cast("int").alias("poll_index"), (F.col("poll_ts") + step).alias("poll_ts"),
        *[F.when(F.col("_shift") == s, F.col(c)).alias(f"_{c}{s}") for c in ("packets", "bytes") for s in (0, 1)])
    keys = ["run_id", "window_index", "source_ip", "poll_index"]
    merged = both.withWatermark("poll_ts", _seconds(delay + poll_seconds)).groupBy(*keys, F.window("poll_ts", _seconds(poll_seconds))).agg(
        *[F.max(f"_{c}{s}").alias(f"_{c}{s}") for c in ("packets", "bytes") for s in (0, 1)])
    zero = F.lit(0).cast("bigint")
    return merged.filter(F.col("_packets0").isNotNull() & (F.col("poll_index") > 0)).select(
        *keys, *[F.greatest(F.col(f"_{c}0") - F.coalesce(f"_{c}1", zero), zero).alias(c) for c in ("packets", "bytes")])


def run_available(stream: DataFrame, path: str) -> DataFrame:
    """Process what is available, append to parquet under ``path`` and read it back."""
    query = (stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/data")
             .option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start())
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/data")


def live_counts(events: DataFrame, seconds: int, delay: int) -> DataFrame:
    """Per-source sums of open windows, for update mode: a batch gives out the sums it changed.

    State and eviction are Spark's: a window leaves the state once the watermark is past its end, and later rows for it are dropped.
    """
    keys = ["run_id", "window", "switch_id", "dst_ip"]
    rows = events.withWatermark("event_ts", _seconds(delay)).withColumn("window", F.window("event_ts", _seconds(seconds)))
    return source_counts(rows, keys, "src_ip", {
        "_pkt": F.col("packet_count"), "_byte": F.col("byte_count"), "_flow": F.col("flow_count")})


def live_windows(changes: DataFrame, seconds: int) -> DataFrame:
    """Features of every window as of the last batch in ``changes``, the sink of ``live_counts``."""
    keys = ["run_id", "window", "switch_id", "dst_ip"]
    sums = [c for c in changes.columns if c not in (*keys, "_src", "batch")]
    latest = changes.groupBy(*keys, "_src").agg(F.max_by(F.struct(*sums), "batch").alias("_last")).select(*keys, "_src", "_last.*")
    flows = F.when(F.col("_flow") > 0, F.col("_flow")).otherwise(F.col("_events"))
    return _features(window_totals(latest, keys, ["_pkt", "_byte", "_flow"]), keys, seconds, flows).select(
        "run_id", F.unix_seconds(F.col("window.start")).alias("window_start"), "switch_id", "dst_ip", *FEATURES)


def behind_watermark(events: DataFrame, watermark: Column, seconds: int) -> DataFrame:
    """Rows whose window had ended at ``watermark`` (epoch seconds): those a stream with that watermark drops, per window."""
    start = F.unix_seconds(F.window("event_ts", _seconds(seconds))["start"])
    late = events.withColumn("window_start", start).filter(F.col("window_start") + seconds <= watermark)
    return late.groupBy("run_id", "window_start").agg(F.count(F.lit(1)).alias("dropped"))


class BatchSink:
    """Rows of each batch in a folder of its own; a retried batch replaces that folder."""

    def __init__(self, path: str) -> None:
        self.path = path

    def __call__(self, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/rows/batch={batch}")

    def run(self, stream: DataFrame, mode: str = "append") -> DataFrame:
        query = (stream.writeStream.foreachBatch(self).outputMode(mode).option("checkpointLocation", f"{self.path}/progress").trigger(availableNow=True).start())
        query.awaitTermination()
        return stream.sparkSession.read.option("basePath", f"{self.path}/rows").parquet(f"{self.path}/rows")
