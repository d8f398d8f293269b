"""Replay of gate decisions: what a saved decision should have been, and the first thing in it that differs.

Hashes travel with the rows. The hash of a window's observations does not depend on their order: it is the sum of the row
digests, so a window with millions of sources is reduced on the map side and never listed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.operators.gate import RUN, GatePolicy, enforcement_evidence, select_sources
from flowsieve.operators.integrity import canonical_hash, compact_json, digest_sum, row_digest

OBSERVED = ("source_ip", "packets", "bytes", "duration_seconds")
#: What is compared, in this order; the first that differs names the cause.
CHECKS = {
    "score": "probability", "threshold": "threshold", "prediction": "prediction", "action": "action", "target": "target_source", "reason": "safety_reason",
    "features": "input_feature_hash", "observations": "source_observations_hash", "policy": "source_policy_hash",
}


def policy_hash(policy: GatePolicy) -> str:
    """sha256 of the policy's four fields in canonical form."""
    fields = {name: getattr(policy, name) for name in ("version", "byte_rate_threshold", "consecutive_windows", "rule_ttl_seconds")}
    return hashlib.sha256(compact_json(fields).encode()).hexdigest()


def feature_hash(features: Sequence[str]) -> Column:
    """sha256 of the features as one canonical object of doubles; a null feature is part of it."""
    fields = F.struct(*[F.col(c).cast("double").alias(c) for c in features])
    return canonical_hash(F.to_json(fields, {"ignoreNullFields": "false"}))


def observation_hashes(observations: DataFrame) -> DataFrame:
    """(run, window) with the number of observations and the order-free sum of their digests."""
    digests = observations.select(*RUN, row_digest(OBSERVED).alias("_d"))
    return digests.groupBy(*RUN).agg(F.concat_ws(":", F.count(F.lit(1)).cast("string"), digest_sum(F.col("_d"))).alias("source_observations_hash"))


def replayed(windows: DataFrame, observations: DataFrame, policy: GatePolicy, score: Column, threshold: float, features: Sequence[str]) -> DataFrame:
    """Every window decided anew from its features and observations, with the hashes of all that the decision rests on.

    A window without observations has the hash of none. Columns of ``windows`` with the names of results are not read.
    """
    own = windows.select(*RUN, *features)
    scored = own.withColumns({"probability": score, "threshold": F.lit(float(threshold))}).withColumn(
        "prediction", (F.col("probability") >= F.col("threshold")).cast("int"))
    decided = select_sources(scored, observations, policy).withColumns({
        "input_feature_hash": feature_hash(features), "source_policy_hash": F.lit(policy_hash(policy))})
    return decided.join(observation_hashes(observations), RUN, "left").withColumn(
        "source_observations_hash", F.coalesce("source_observations_hash", F.concat_ws(":", F.lit("0"), *[F.lit("0")] * 4)))


def replay_report(saved: DataFrame, replay: DataFrame) -> DataFrame:
    """Each (run, window) of either side with ``cause``: null if the saved decision holds in all of ``CHECKS``, else the first that differs.

    ``missing``: nothing saved for a window; ``extra``: a saved row without a window; ``repeated``: several rows saved for one. Numbers are
    compared exactly; a null equals a null only.
    """
    columns = list(CHECKS.values())
    kept = saved.groupBy(*RUN).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*columns)).alias("_saved"))
    both = replay.select(*RUN, F.struct(*columns).alias("_replay")).join(kept, RUN, "full")
    cause = F.when(F.col("_n").isNull(), "missing").when(F.col("_replay").isNull(), "extra").when(F.col("_n") > 1, "repeated")
    for name, column in CHECKS.items():
        cause = cause.when(~F.col(f"_saved.{column}").eqNullSafe(F.col(f"_replay.{column}")), name)
    return both.select(
        *RUN, F.col("_saved.action").alias("saved_action"), F.col("_replay.action").alias("action"), F.col("_replay.safety_reason").alias("safety_reason"),
        cause.alias("cause"))


def audit_differences(replay: DataFrame, records: DataFrame, fields: Sequence[str], enabled: Column) -> DataFrame:
    """(run, window, field) where the audit record of a window says something else than its replay.

    Windows for which ``enabled`` holds must have one record each (field ``record``: none, or several); others must have none (field ``unexpected``).
    """
    kept = records.groupBy(*RUN).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*fields)).alias("_audit"))
    both = replay.select(*RUN, enabled.alias("_enabled"), F.struct(*fields).alias("_replay")).join(kept, RUN, "full")
    due, n = F.coalesce(F.col("_enabled"), F.lit(False)), F.coalesce(F.col("_n"), F.lit(0))
    wrong = [F.when(due & (n == 1) & ~F.col(f"_audit.{c}").eqNullSafe(F.col(f"_replay.{c}")), c) for c in fields]
    wrong += [F.when(due & (n != 1), "record"), F.when(~due & (n > 0), "unexpected")]
    return both.select(*RUN, F.explode(F.array_compact(F.array(*wrong))).alias("field"))


def verified(saved: DataFrame, replay: DataFrame, flows: DataFrame) -> DataFrame:
    """One row per window: cause of the decision's difference and state of its enforcement, both null if nothing is wrong."""
    rules = enforcement_evidence(replay, flows).select(*RUN, "evidence")
    found = replay_report(saved, replay).join(rules, RUN, "left")
    return found.withColumn("evidence", F.nullif("evidence", F.lit("ok")))
