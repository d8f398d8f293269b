"""Source-rate gate: at most one rate-limit target per window, abstaining when unsure.

The decision only needs how many sources exceeded the threshold in each of the last
``persistence`` windows. Every exceedance is repeated for the few windows it counts
towards and the repeats are counted, so a window with millions of candidates is
reduced by a hash aggregate and never listed.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.functions.ordering import SLICE, running, sliced

RUN = ["run_id", "window_index"]
# four decimal parts of 0..255 without leading zeros
_IPV4 = r"^((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$"
_FIELDS = {"source_ip", "packets", "bytes", "duration_seconds"}


@dataclass(frozen=True)
class GatePolicy:
    byte_rate_threshold: float | None
    consecutive_windows: int = 1
    rule_ttl_seconds: int = 15
    version: str = "source_rate_envelope_v3"

    def __post_init__(self) -> None:
        t = self.byte_rate_threshold
        if t is not None and not (math.isfinite(t) and t >= 0):
            raise ValueError("threshold must be null or a finite non-negative rate")
        if self.consecutive_windows not in (1, 2, 3):
            raise ValueError("persistence must be 1, 2 or 3")
        if not 1 <= self.rule_ttl_seconds <= 30:
            raise ValueError("rule lifetime must be 1 to 30 seconds")


def contract_flags(observations: DataFrame) -> DataFrame:
    """One flag per rule an observation row breaks."""
    bad = lambda c: F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf")) | (F.col(c) < 0)
    return observations.withColumns({
        "bad_address": ~F.coalesce(F.col("source_ip").rlike(_IPV4), F.lit(False)),
        "bad_measure": bad("packets") | bad("bytes") | bad("duration_seconds"),
        "bad_duration": F.coalesce(F.col("duration_seconds") <= 0, F.lit(True)),
    })


def contract_report(observations: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Violations per rule; duplicates are sources seen twice in one window."""
    flagged = contract_flags(observations)
    per_source = flagged.groupBy(*keys, "source_ip").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(c).alias(c) for c in ("bad_address", "bad_measure", "bad_duration")])
    return per_source.agg(
        F.sum("_n").alias("rows"), F.sum("bad_address").alias("bad_address"), F.sum("bad_measure").alias("bad_measure"),
        F.sum("bad_duration").alias("bad_duration"), F.count_if(F.col("_n") > 1).alias("duplicate_sources"))


def checked_observations(observations: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Rows that fail the job on a broken rule; extra columns are refused up front."""
    if set(observations.columns) != _FIELDS | set(keys):
        raise ValueError("only source telemetry may enter the gate")
    flagged = contract_flags(observations)
    broken = F.col("bad_address") | F.col("bad_measure") | F.col("bad_duration")
    ok = F.when(broken, F.raise_error(F.lit("invalid source telemetry")).cast("string")).otherwise(F.col("source_ip"))
    # one row per source after the aggregate, and a repeated source is an error
    merged = flagged.withColumn("source_ip", ok).groupBy(*keys, "source_ip").agg(
        F.max("packets").alias("packets"), F.max("bytes").alias("bytes"),
        F.max("duration_seconds").alias("duration_seconds"), F.count(F.lit(1)).alias("_n"))
    single = F.when(F.col("_n") == 1, F.col("bytes")).otherwise(F.raise_error(F.lit("duplicate source")).cast("bigint"))
    return merged.withColumn("bytes", single).drop("_n")


def rate() -> Column:
    return F.col("bytes") / F.col("duration_seconds")


def streaks(observations: DataFrame, threshold: float | None) -> DataFrame:
    """Length of the exceedance run ending at each observation; absence breaks a run."""
    keys = ["run_id", "source_ip"]
    if threshold is None:
        return observations.select("run_id", "window_index", "source_ip", F.lit(0).cast("bigint").alias("streak"))
    over = observations.filter(rate() > threshold).select(*keys, "window_index")
    nth = running(sliced(over, keys, ["window_index"]), keys, ["window_index"], {"_nth": F.lit(1).cast("bigint")}).drop(SLICE)
    island = nth.withColumn("_island", F.col("window_index") - F.col("_nth"))
    starts = island.groupBy(*keys, "_island").agg(F.min("window_index").alias("_start"))
    runs = island.join(starts, [*keys, "_island"]).select(
        *keys, "window_index", (F.col("window_index") - F.col("_start") + 1).cast("bigint").alias("streak"))
    return observations.select(*keys, "window_index").join(runs, [*keys, "window_index"], "left").withColumn(
        "streak", F.coalesce("streak", F.lit(0).cast("bigint")))


def persistent(exceeding: DataFrame, keys: Sequence[str], persistence: Column, longest: int) -> DataFrame:
    """(keys, source, window) whose last ``persistence`` windows all exceeded."""
    steps = F.explode(F.sequence(F.lit(0), F.lit(longest - 1))).alias("_ahead")
    moved = exceeding.select(*keys, "window_index", "source_ip", persistence.alias("_need"), steps).filter(
        F.col("_ahead") < F.col("_need")).withColumn("window_index", (F.col("window_index") + F.col("_ahead")).cast("int"))
    return moved.groupBy(*keys, "window_index", "source_ip", "_need").agg(F.count(F.lit(1)).alias("_hits")).filter(
        F.col("_hits") == F.col("_need")).drop("_hits", "_need")


def candidates(observations: DataFrame, policy: GatePolicy) -> DataFrame:
    """Candidate sources in long form; a window may have any number of them."""
    limit = policy.byte_rate_threshold
    over = observations.filter(F.lit(False) if limit is None else rate() > limit)
    return persistent(over, ["run_id"], F.lit(policy.consecutive_windows), policy.consecutive_windows)


def _verdict(threshold: Column) -> dict[str, Column]:
    positive, single = F.col("prediction") == 1, F.col("candidate_count") == 1
    target = F.when(positive & single, F.col("_only"))
    return {
        "target_source": target,
        "action": F.when(target.isNotNull(), "RATE_LIMIT").otherwise("NONE"),
        "safety_reason": (
            F.when(target.isNotNull(), "unique_persistent_rate_exceedance")
            .when(~positive, "negative_window_prediction").when(threshold.isNull(), "policy_abstains")
            .when(F.col("candidate_count") > 1, "ambiguous_sources").otherwise("insufficient_source_evidence")),
    }


def select_sources(windows: DataFrame, observations: DataFrame, policy: GatePolicy) -> DataFrame:
    """Decision per window; windows without observations are kept."""
    found = candidates(observations, policy).groupBy(*RUN).agg(
        F.count(F.lit(1)).alias("candidate_count"), F.min("source_ip").alias("_only"))
    joined = windows.join(found, RUN, "left").withColumn("candidate_count", F.coalesce("candidate_count", F.lit(0)))
    limit = F.lit(policy.byte_rate_threshold).cast("double")
    return joined.withColumns(_verdict(limit)).withColumn("rule_ttl_seconds", F.lit(policy.rule_ttl_seconds)).drop("_only")


def enforced(decisions: DataFrame, enabled: Column) -> DataFrame:
    """Keep the proposal; act only where enforcement is enabled."""
    return decisions.withColumns({
        "proposed_action": F.col("action"), "proposed_target": F.col("target_source"), "enforcement_enabled": enabled,
        "action": F.when(enabled, F.col("action")).otherwise("NONE"), "target_source": F.when(enabled, F.col("target_source")),
    })


def rule_lifetimes(decisions: DataFrame, window_seconds: int) -> DataFrame:
    """When each rule starts and ends: at its hard limit or at the next window's decision."""
    following = decisions.select("run_id", (F.col("window_index") - 1).alias("window_index"), F.lit(True).alias("_next"))
    start = (F.col("window_index") + 1) * window_seconds
    end = F.when(F.col("_next"), F.least(start + F.col("rule_ttl_seconds"), start + window_seconds)).otherwise(start + F.col("rule_ttl_seconds"))
    return decisions.filter(F.col("action") == "RATE_LIMIT").join(following, RUN, "left").select(
        *RUN, "target_source", start.cast("bigint").alias("active_from"), end.cast("bigint").alias("active_until"))


def index_report(windows: DataFrame, keys: Sequence[str], index: str = "window_index") -> DataFrame:
    """Whether window numbers are exactly 0..n-1 per group."""
    single = windows.groupBy(*keys, index).agg(F.count(F.lit(1)).alias("_n"))
    return single.groupBy(*keys).agg(
        F.sum("_n").alias("windows"),
        ((F.min(index) == 0) & (F.max(index) == F.count(F.lit(1)) - 1) & (F.max("_n") == 1)).alias("consecutive"))


def require_truth(observations: DataFrame, truth: DataFrame) -> None:
    """Every observed source must have a role; one source without is an error that names it."""
    unknown = observations.join(truth, "source_ip", "left_anti").select("source_ip").first()
    if unknown is not None:
        raise ValueError(f"source without truth: {unknown['source_ip']}")


def require_separate_runs(train: DataFrame, validation: DataFrame) -> None:
    """Development and validation may not share a run."""
    shared = validation.join(train.select("run_id"), "run_id", "left_semi").select("run_id").first()
    if shared is not None:
        raise ValueError(f"run in development and validation: {shared['run_id']}")


def benign_envelope(observations: DataFrame, truth: DataFrame) -> float:
    """Largest benign byte rate of the development rows; one number reaches the driver."""
    joined = observations.join(truth.filter(F.col("is_attacker") == 0), "source_ip", "left_semi")
    top = joined.agg(F.max(rate()).alias("m")).first()["m"]
    if top is None or top <= 0:
        raise ValueError("no benign calibration observations")
    return float(top)


def candidate_grid(top: float, multipliers: Sequence[float], persistences: Sequence[int]) -> list[tuple[float, int, float]]:
    return [(float(m), int(p), top * m) for m in multipliers for p in persistences]


def evaluate_grid(windows: DataFrame, observations: DataFrame, truth: DataFrame, grid: Sequence[tuple[float, int, float]]) -> DataFrame:
    """Targets and opportunities of every grid entry on the validation rows."""
    entries = F.array(*[
        F.struct(F.lit(m).alias("multiplier"), F.lit(p).alias("persistence"), F.lit(t).alias("threshold")) for m, p, t in grid])
    names = ["multiplier", "persistence", "threshold"]
    # only exceeded entries are kept, so a quiet row yields nothing
    over = observations.select(
        "run_id", "window_index", "source_ip",
        F.explode(F.filter(entries, lambda e: F.col("bytes") / F.col("duration_seconds") > e["threshold"])).alias("_g"),
    ).select("run_id", "window_index", "source_ip", "_g.*")
    found = persistent(over, ["run_id", *names], F.col("persistence"), max(p for _, p, _ in grid))
    single = found.groupBy("run_id", "window_index", *names).agg(
        F.count(F.lit(1)).alias("_c"), F.min("source_ip").alias("source_ip")).filter("_c = 1")
    positive = windows.filter(F.col("prediction") == 1).select(*RUN)
    targets = single.join(positive, RUN, "left_semi").join(truth, "source_ip").groupBy(*names).agg(
        F.count_if(F.col("is_attacker") == 0).alias("benign_targets"), F.count_if(F.col("is_attacker") == 1).alias("attack_targets"))
    active = observations.filter(F.col("bytes") > 0).join(truth, "source_ip").groupBy(*RUN).agg(
        F.max(1 - F.col("is_attacker")).alias("_b"), F.max("is_attacker").alias("_a"))
    chances = active.agg(F.sum("_b").alias("benign_opportunities"), F.sum("_a").alias("attack_opportunities"))
    listed = chances.select("*", F.explode(entries).alias("_g")).select("_g.*", "benign_opportunities", "attack_opportunities")
    zero = F.lit(0).cast("bigint")
    return listed.join(targets, names, "left").withColumns({
        "benign_targets": F.coalesce("benign_targets", zero), "attack_targets": F.coalesce("attack_targets", zero),
    }).withColumn("benign_target_rate", F.try_divide(F.col("benign_targets").cast("double"), F.col("benign_opportunities")))


def choose_policy(table: DataFrame, max_benign_rate: float) -> DataFrame:
    """Flag the feasible entry with most attack targets, fewest benign, highest threshold, longest persistence."""
    feasible = table.filter((F.col("benign_target_rate") <= max_benign_rate) & (F.col("attack_targets") > 0))
    order = F.struct(F.col("attack_targets"), -F.col("benign_targets"), F.col("threshold"), F.col("persistence"))
    best = feasible.agg(F.max_by(F.struct("threshold", "persistence"), order).alias("best")).first()["best"]
    if best is None:
        return table.withColumn("selected", F.lit(False))
    return table.withColumn("selected", (F.col("threshold") == best["threshold"]) & (F.col("persistence") == best["persistence"]))


def require_order(train: DataFrame, validation: DataFrame, order: str = "run_id") -> None:
    """All development comes before all validation in the order of the runs; two single values reach the driver."""
    last, first = train.agg(F.max(order).alias("m")).first()["m"], validation.agg(F.min(order).alias("m")).first()["m"]
    if last is not None and first is not None and last >= first:
        raise ValueError(f"development up to {last} does not come before validation from {first}")


def require_detector(train: DataFrame, validation: DataFrame, column: str = "detector_hash") -> str:
    """The one detector whose predictions both sides hold; several, or a row without one, are an error."""
    hashes = train.select(column).unionByName(validation.select(column)).agg(
        F.min(column).alias("lo"), F.max(column).alias("hi"), F.count_if(F.col(column).isNull()).alias("none")).first()
    if hashes["lo"] is None or hashes["lo"] != hashes["hi"] or hashes["none"]:
        raise ValueError(f"predictions of different detectors: {hashes['lo']}, {hashes['hi']}, {hashes['none']} rows without one")
    return hashes["lo"]


def fit_policy(
    train: DataFrame, train_truth: DataFrame, windows: DataFrame, observations: DataFrame, truth: DataFrame,
    multipliers: Sequence[float], persistences: Sequence[int], max_benign_rate: float, ttl: int = 15,
    detectors: tuple[DataFrame, DataFrame] | None = None,
) -> tuple[GatePolicy, DataFrame]:
    """Envelope from development rows, grid entry from validation rows; abstains if none is feasible.

    Errors: a run on both sides, validation that does not come after development, a source without truth, and validation
    rows without benign traffic; with ``detectors``, the windows of development and of validation with their ``detector_hash``, also
    predictions of different detectors.
    """
    require_separate_runs(train, observations)
    require_order(train, observations)
    if detectors is not None:
        require_detector(*detectors)
    require_truth(train, train_truth)
    require_truth(observations, truth)
    grid = candidate_grid(benign_envelope(train, train_truth), multipliers, persistences)
    table = choose_policy(evaluate_grid(windows, observations, truth, grid), max_benign_rate)
    if table.filter("benign_opportunities > 0").isEmpty():
        raise ValueError("no benign validation traffic")
    # at most one selected row per distinct grid entry
    chosen = table.filter("selected").select("threshold", "persistence").first()
    if chosen is None:
        return GatePolicy(None, 2, ttl), table
    return GatePolicy(chosen["threshold"], chosen["persistence"], ttl), table


def counter_deltas(polls: DataFrame) -> DataFrame:
    """Counter growth between adjacent polls, never negative; a source absent before counts from 0."""
    keys = ["run_id", "window_index", "source_ip"]
    before = polls.select(
        *keys, (F.col("poll_index") + 1).alias("poll_index"), F.col("packets").alias("_p"), F.col("bytes").alias("_b"))
    zero = F.lit(0).cast("bigint")
    grown = lambda now, then: F.greatest(F.col(now) - F.coalesce(then, zero), zero)
    return polls.filter(F.col("poll_index") > 0).join(before, [*keys, "poll_index"], "left").select(
        *keys, "poll_index", grown("packets", "_p").alias("packets"), grown("bytes", "_b").alias("bytes"))


def poll_windows(deltas: DataFrame, seconds: int) -> DataFrame:
    """Window features from counter growth: events are polls with traffic, flows are active (source, poll) pairs."""
    from flowsieve.operators.windows import _features, entropy_of

    moving = deltas.filter((F.col("packets") > 0) | (F.col("bytes") > 0))
    n = F.col("_n").cast("double")
    per_source = moving.groupBy(*RUN, "source_ip").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("packets").alias("_p"), F.sum("bytes").alias("_b"))
    polls = moving.select(*RUN, "poll_index").distinct().groupBy(*RUN).agg(F.count(F.lit(1)).alias("_events"))
    totals = per_source.groupBy(*RUN).agg(
        F.sum("_p").alias("_pkt"), F.sum("_b").alias("_byte"), F.sum("_n").alias("_flow"), F.count(F.lit(1)).alias("_unique"),
        entropy_of(F.sum(n), F.sum(n * F.log2(n))).alias("_entropy"))
    return _features(totals.join(polls, RUN), RUN, seconds, F.col("_flow"))


def dominant_source(observations: DataFrame) -> DataFrame:
    """Source with most packets per window; equal counts go to the smaller address."""
    best = observations.groupBy(*RUN).agg(F.max("packets").alias("packets"))
    return observations.join(best, [*RUN, "packets"]).groupBy(*RUN).agg(F.min("source_ip").alias("dominant_source"))


#: The mark of the gate's own rules in a flow dump.
COOKIE = "cookie=0x475402"


def enforcement_evidence(decisions: DataFrame, flows: DataFrame) -> DataFrame:
    """Every decision next to the rules seen for the following window, with ``evidence``: ``ok`` or the first thing that is wrong.

    ``flows`` has a row per dumped line (run_id, applies_to_window, flow); lines without the gate's cookie are other rules. A limit
    needs one rule of its own that names its source, meters and then forwards, and ends after the decided lifetime; a
    decision of NONE, or a window that nothing was decided for, needs none. A null line is no rule.
    """
    line = F.col("flow")
    own = flows.filter(line.contains(COOKIE)).select(
        "run_id", (F.col("applies_to_window") - 1).alias("window_index"), F.regexp_extract(line, r"nw_src=([0-9.]+),", 1).alias("source"),
        line.contains("actions=meter:1,NORMAL").alias("metered"), F.regexp_extract(line, r"hard_timeout=(\d+)", 1).try_cast("int").alias("ttl"))
    # one row a window however many rules it has; a second rule is counted, not joined
    seen = own.groupBy(*RUN).agg(F.count(F.lit(1)).alias("rules"), F.min(F.struct("source", "metered", "ttl")).alias("_rule"))
    both = decisions.select(*RUN, "action", "target_source", "rule_ttl_seconds").join(seen, RUN, "full").withColumn(
        "rules", F.coalesce("rules", F.lit(0).cast("bigint")))
    limits, rule = F.coalesce(F.col("action") == "RATE_LIMIT", F.lit(False)), F.col("_rule")
    evidence = (
        F.when(~limits & (F.col("rules") > 0), "rule_without_decision").when(~limits, "ok").when(F.col("rules") == 0, "rule_missing")
        .when(F.col("rules") > 1, "rule_repeated").when(~rule["source"].eqNullSafe(F.col("target_source")), "wrong_source")
        .when(~rule["metered"], "not_metered").when(~rule["ttl"].eqNullSafe(F.col("rule_ttl_seconds")), "wrong_lifetime").otherwise("ok"))
    return both.select(*RUN, "action", "target_source", "rules", evidence.alias("evidence"))
