"""Confusion counts and the metrics derived from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.functions.quantiles import exact_quantiles

COUNTS = ["tn", "fp", "fn", "tp"]
RATIO_METRICS = ["accuracy", "precision", "recall", "f1", "fpr", "fnr", "benign_damage"]
# fixed values: utility of each outcome
UTILITY = {"tp": 2.0, "fn": -2.0, "fp": -1.25, "tn": 0.2}


def outcome(label: Column, prediction: Column) -> dict[str, Column]:
    return {
        "tn": (label == 0) & (prediction == 0), "fp": (label == 0) & (prediction == 1),
        "fn": (label == 1) & (prediction == 0), "tp": (label == 1) & (prediction == 1),
    }


def utility(label: Column, action: Column) -> Column:
    case = outcome(label, action)
    value = F.lit(None).cast("double")
    for name, gain in UTILITY.items():
        value = F.when(case[name], F.lit(gain)).otherwise(value)
    return value


def confusion(df: DataFrame, by: Sequence[str], label: str = "label", prediction: str = "prediction") -> DataFrame:
    """tn, fp, fn, tp per group in one pass."""
    case = outcome(F.col(label), F.col(prediction))
    return df.groupBy(*by).agg(*[F.count_if(case[c]).alias(c) for c in COUNTS])


def check_binary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fail the job on a value outside {0, 1}; costs no extra pass."""
    checked = {}
    for c in columns:
        ok = F.coalesce(F.col(c).isin(0, 1), F.lit(False))
        checked[c] = F.when(ok, F.col(c)).otherwise(F.raise_error(F.lit(f"{c} must be 0 or 1")).cast("int"))
    return df.withColumns(checked)


def binary_report(df: DataFrame, column: str) -> DataFrame:
    """Row count and whether the column is a non-empty binary vector."""
    inside = F.coalesce(F.col(column).isin(0, 1), F.lit(False))
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(~inside).alias("outside")).withColumn(
        "valid", (F.col("n") > 0) & (F.col("outside") == 0))


def _parts() -> dict[str, tuple[Column, Column]]:
    tn, fp, fn, tp = (F.col(c).cast("double") for c in COUNTS)
    return {
        "accuracy": (tn + tp, tn + fp + fn + tp),
        "precision": (tp, tp + fp), "recall": (tp, tp + fn),
        "f1": (2 * tp, 2 * tp + fp + fn),
        "fpr": (fp, fp + tn), "fnr": (fn, fn + tp), "benign_damage": (fp, fp + tn),
    }


def strict_metrics(counts: DataFrame, reasons: dict[str, str] | None = None) -> DataFrame:
    """Ratios that stay null on a zero denominator, with the reasons as text."""
    parts = _parts()
    why = reasons or {m: f"{m}: zero denominator" for m in RATIO_METRICS if m != "accuracy"}
    notes = F.concat_ws("; ", *[F.when(parts[m][1] == 0, F.lit(text)) for m, text in why.items()])
    return counts.withColumn("n", sum((F.col(c) for c in COUNTS), F.lit(0))).withColumns(
        {m: F.try_divide(a, b) for m, (a, b) in parts.items()}
    ).withColumn("undefined_metrics", notes)


def trial_metrics(counts: DataFrame) -> DataFrame:
    """The shorter reason texts used for live trials."""
    return strict_metrics(counts, {
        "precision": "precision: zero predicted positives", "recall": "recall: zero actual positives",
        "f1": "f1: zero denominator",
    })


def zero_metrics(counts: DataFrame) -> DataFrame:
    """Ratios with 0/0 taken as 0; F1 from precision and recall."""
    parts = _parts()
    plain = counts.withColumn("n", sum((F.col(c) for c in COUNTS), F.lit(0))).withColumns({
        m: F.coalesce(F.try_divide(a, b), F.lit(0.0)) for m, (a, b) in parts.items() if m != "f1"})
    p, r = F.col("precision"), F.col("recall")
    return plain.withColumn("f1", F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)))


def utility_from_counts() -> Column:
    """Total utility of the four counts; exact whatever the row order."""
    return sum((F.col(c) * F.lit(gain) for c, gain in UTILITY.items()), F.lit(0.0))


def utility_totals(df: DataFrame, by: Sequence[str], label: str = "label", action: str = "prediction") -> DataFrame:
    counts = confusion(df, by, label, action).withColumn("reward", utility_from_counts())
    tn, fp, fn, tp = (F.col(c) for c in COUNTS)
    return counts.select(
        *by, "reward", F.try_divide(F.col("reward"), tn + fp + fn + tp).alias("reward_mean"),
        (tp + fp).alias("mitigation_count"), (tn + fn).alias("no_action_count"))


def brier(df: DataFrame, by: Sequence[str], label: str = "label", score: str = "probability") -> DataFrame:
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(score)))
    return df.groupBy(*by).agg(F.avg(F.pow(clipped - F.col(label), F.lit(2.0))).alias("brier"))


def action_level(score: Column, threshold: Column | float) -> Column:
    """0 none, 1 limit, 2 block at ``max(0.9, threshold + 0.25)``."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return F.when(score >= F.greatest(F.lit(0.9), t + 0.25), 2).when(score >= t, 1).otherwise(0)


def action_metrics(df: DataFrame, by: Sequence[str], threshold: float, score: str = "probability", baseline: str = "baseline") -> DataFrame:
    """Three-level action rates of a policy next to the baseline's actions."""
    rows = df.withColumns({
        "_a": action_level(F.col(score), threshold), "_b": action_level(F.col(baseline), threshold),
        "_p": (F.col(score) >= threshold).cast("int"), "_q": (F.col(baseline) >= threshold).cast("int"),
    })
    benign = F.col("label") == 0
    gain = (F.when(~benign & (F.col("_a") > 0), UTILITY["tp"]).when(~benign, UTILITY["fn"])
            .when(F.col("_a") > 0, UTILITY["fp"]).otherwise(UTILITY["tn"]))
    case = outcome(F.col("label"), F.col("_p"))
    quiet = F.greatest(F.count_if(benign), F.lit(1))
    counted = rows.groupBy(*by).agg(
        *[F.count_if(case[c]).alias(c) for c in COUNTS],
        F.sum(gain).alias("reward"),
        (F.count_if(benign & (F.col("_a") >= 2)) / quiet).alias("unsafe_action_rate"),
        (F.count_if(benign & (F.col("_a") > 0)) / quiet).alias("_damage"),
        F.avg((F.col("_a") != F.col("_b")).cast("double")).alias("selector_override_rate"),
        F.avg((F.col("_p") == F.col("_q")).cast("double")).alias("policy_agreement_with_baseline"),
        *[F.count_if(F.col("_a") == level).alias(f"actions_{level}") for level in (0, 1, 2)],
    )
    return zero_metrics(counted).withColumn("benign_damage", F.col("_damage")).drop("_damage", "fpr", "fnr", "n")


def stress_table(df: DataFrame, by: Sequence[str], latency: Column) -> DataFrame:
    """False mitigations, damage rate, latency p90, recovery p90 and throughput per scenario."""
    benign, flagged = F.col("label") == 0, F.col("prediction") == 1
    rows = df.withColumn("_l", latency).withColumn("_r", F.when(~flagged, F.col("_l")))
    tails = exact_quantiles(rows, by, "_l", {"latency": 0.9}).join(
        exact_quantiles(rows, by, "_r", {"recovery_time": 0.9}), list(by), "left")
    return rows.groupBy(*by).agg(
        F.count_if(benign & flagged).alias("false_mitigation_count"),
        (F.count_if(benign & flagged) / F.greatest(F.count_if(benign), F.lit(1))).alias("benign_damage_rate"),
        F.avg(F.col("byte_rate") * 8.0 / 1_000_000.0).alias("throughput"),
    ).join(tails, list(by))
