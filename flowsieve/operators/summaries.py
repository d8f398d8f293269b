"""Summary tables: policies, trials, distributions and paired settings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.functions.quantiles import exact_quantiles
from flowsieve.operators import curves, metrics

# fixed values: metrics summarized over trials, and the columns two settings must share
TRIAL_METRICS = [
    "accuracy", "precision", "recall", "f1", "window_false_positive_rate", "benign_target_selection_rate",
    "mean_benign_receiver_mbps", "mean_benign_loss_percent", "mean_attack_receiver_mbps", "recovery_benign_loss_percent",
]
SCHEDULE = ["phase", "label", "scheduled_benign_mbps", "scheduled_attack_mbps", "scheduled_attackers"]
# fixed values: settings compared as left minus right
COMPARISONS = [
    ("audit_enabled", "audit_disabled"), ("audit_disabled", "mitigation_disabled"), ("audit_enabled", "mitigation_disabled"),
]


def unpivot(df: DataFrame, keys: Sequence[str], names: Sequence[str], variable: str = "metric", value: str = "value") -> DataFrame:
    return df.select(*keys, *[F.col(n).cast("double").alias(n) for n in names]).unpivot(list(keys), list(names), variable, value)


def feature_profile(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """n, minimum, median and maximum of every feature per key."""
    long, by = unpivot(df, keys, features, "feature"), [*keys, "feature"]
    ends = long.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("minimum"), F.max("value").alias("maximum"))
    return ends.join(exact_quantiles(long, by, "value", {"median": 0.5}), by)


def feature_shift(left: DataFrame, right: DataFrame, features: Sequence[str]) -> DataFrame:
    """Means, population deviations and the standardized mean difference of two tables."""
    side = lambda df, name: unpivot(df, [], features, "feature").filter(~F.isnan("value")).groupBy("feature").agg(
        F.avg("value").alias(f"{name}_mean"), F.stddev_pop("value").alias(f"{name}_std"))
    both = side(left, "offline").join(side(right, "live"), "feature")
    delta = F.col("live_mean") - F.col("offline_mean")
    pooled = F.sqrt((F.pow("offline_std", F.lit(2.0)) + F.pow("live_std", F.lit(2.0))) / 2)
    return both.withColumns({
        "mean_delta": delta, "standardized_mean_delta": F.coalesce(F.try_divide(delta, pooled), F.lit(0.0))})


def policy_summary(predictions: DataFrame, baseline: str) -> DataFrame:
    """Metrics, areas, agreement with the baseline, abstentions and actions per policy."""
    counted = metrics.strict_metrics(metrics.confusion(predictions, ["policy"]))
    ranked = curves.ranking(predictions, ["policy"]).select("policy", "roc_auc", "pr_auc")
    gains = metrics.utility_totals(predictions, ["policy"])
    base = predictions.filter(F.col("policy") == baseline).select("fold", "row_id", F.col("prediction").alias("_b"))
    last = predictions.agg(F.max("fold")).first()[0]
    same = (F.col("prediction") == F.col("_b"))
    agree = predictions.join(base, ["fold", "row_id"]).groupBy("policy").agg(
        F.avg(same.cast("double")).alias("policy_agreement_with_baseline"),
        F.count_if(~same).alias("disagreement_count"),
        F.avg(F.when(F.col("fold") == last, same.cast("double"))).alias("agreement_final_fold"),
        F.sum("abstained").alias("abstention_count"))
    return counted.join(ranked, "policy").join(gains, "policy").join(agree, "policy")


def action_distribution(predictions: DataFrame, actions: Sequence[str]) -> DataFrame:
    pivoted = predictions.groupBy("policy").pivot("action", list(actions)).count()
    abstained = predictions.groupBy("policy").agg(F.sum("abstained").alias("abstention_count"))
    return pivoted.select("policy", *[F.coalesce(a, F.lit(0)).alias(f"action_{a.lower()}") for a in actions]).join(abstained, "policy")


def trial_table(windows: DataFrame) -> DataFrame:
    """One row per (dataset, seed, setting): classification, targeting and service measurements."""
    case = metrics.outcome(F.col("label"), F.col("prediction"))
    targeted = F.col("follows_benign_target_selection") == 1
    counted = windows.groupBy("dataset", "seed", "setting").agg(
        *[F.count_if(case[c]).alias(c) for c in metrics.COUNTS],
        F.sum("benign_target_selected").alias("benign_target_selections"),
        F.avg("benign_target_selected").alias("benign_target_selection_rate"),
        F.count_if(targeted).alias("following_windows"),
        F.count_if(targeted & (F.col("benign_loss_percent") > 0)).alias("following_windows_with_measured_loss"),
        F.count_if(F.col("benign_receiver_mbps").isNull()).alias("missing_benign_measurements"),
        F.avg("benign_receiver_mbps").alias("mean_benign_receiver_mbps"),
        F.avg("benign_loss_percent").alias("mean_benign_loss_percent"),
        F.avg(F.when(F.col("label") == 1, F.col("attack_receiver_mbps"))).alias("mean_attack_receiver_mbps"),
        F.avg(F.when(F.col("phase") == "recovery", F.col("benign_loss_percent"))).alias("recovery_benign_loss_percent"))
    return metrics.strict_metrics(counted).withColumnRenamed("n", "windows").withColumn(
        "window_false_positive_rate", F.col("fpr")).drop("fpr", "fnr", "benign_damage", "undefined_metrics")


def previous_target(windows: DataFrame) -> DataFrame:
    """Target chosen one window earlier, by an equi-join on the next index."""
    keys = ["dataset", "seed", "setting"]
    earlier = windows.select(*keys, (F.col("window_index") + 1).alias("window_index"), F.col("next_target").alias("preceding_target"))
    return windows.join(earlier, [*keys, "window_index"], "left").withColumn(
        "preceding_target", F.coalesce("preceding_target", F.lit("")))


def with_target_roles(windows: DataFrame, truth: DataFrame) -> DataFrame:
    """Whether the chosen and the preceding target are benign sources; truth enters evaluation only."""
    benign = truth.filter(F.col("is_attacker") == 0).select(F.col("source_ip"), F.lit(1).alias("_benign"))
    now = benign.withColumnsRenamed({"source_ip": "next_target", "_benign": "benign_target_selected"})
    then = benign.withColumnsRenamed({"source_ip": "preceding_target", "_benign": "follows_benign_target_selection"})
    joined = previous_target(windows).join(now, ["next_target"], "left").join(then, ["preceding_target"], "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("benign_target_selected", "follows_benign_target_selection")})


def dataset_totals(windows: DataFrame, reference: str = "mitigation_disabled") -> DataFrame:
    hit = (F.col("follows_benign_target_selection") == 1) & (F.col("benign_loss_percent") > 0)
    return windows.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("windows"), F.sum("benign_target_selected").alias("benign_target_selections"),
        F.count_if(hit).alias("subsequent_windows_with_loss"),
        F.count_if(F.col("benign_receiver_mbps").isNull()).alias("unavailable_benign_measurements"),
        F.bool_or(F.col("setting") == reference).alias("has_no_mitigation_reference"))


def schedule_mismatches(windows: DataFrame, left: str, right: str) -> DataFrame:
    """Windows whose schedule differs, or is missing, between two settings of a dataset."""
    keys = ["dataset", "seed", "window_index"]
    side = lambda setting, tag: windows.filter(F.col("setting") == setting).select(
        *keys, F.struct(*SCHEDULE).alias(tag))
    both = side(left, "_l").join(side(right, "_r"), keys, "full")
    return both.filter(~F.col("_l").eqNullSafe(F.col("_r"))).select(
        *keys, F.when(F.col("_l").isNull(), "missing_left").when(F.col("_r").isNull(), "missing_right").otherwise("changed").alias("status"))


def setting_differences(trials: DataFrame, names: Sequence[str]) -> DataFrame:
    """left minus right per (dataset, seed, metric) for every comparison present."""
    settings = sorted({s for pair in COMPARISONS for s in pair})
    wide = unpivot(trials, ["dataset", "seed", "setting"], names).groupBy("dataset", "seed", "metric").pivot("setting", settings).agg(F.first("value"))
    pairs = F.explode(F.array(*[
        F.struct(F.lit(f"{a} minus {b}").alias("comparison"), (F.col(a) - F.col(b)).alias("difference")) for a, b in COMPARISONS])).alias("_p")
    return wide.select("dataset", "seed", "metric", pairs).select("dataset", "seed", "metric", "_p.*")


def student_summary(values: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """Mean, deviation, median, range and 95 % Student-t interval over trials."""
    from flowsieve.functions.special import t_975

    stats = values.groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"),
        F.when(F.count(value) > 1, F.stddev_samp(value)).alias("std"),
        F.min(value).alias("minimum"), F.max(value).alias("maximum"), F.count_if(F.col(value).isNull()).alias("undefined_trials"))
    stats = stats.join(exact_quantiles(values, by, value, {"median": 0.5}), list(by), "left")
    # quantiles are looked up once per distinct trial count
    wanted = stats.filter(F.col("n") > 1).select("n").distinct()
    quantiles = wanted.withColumn("_t", t_975((F.col("n") - 1).cast("double")))
    half = F.col("_t") * F.col("std") / F.sqrt("n")
    return stats.join(quantiles, ["n"], "left").withColumns({"ci_lower": F.col("mean") - half, "ci_upper": F.col("mean") + half}).drop("_t")


def normal_interval(values: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """Mean, deviation and 1.96 standard errors; 0 with a single value."""
    many = F.count(value) > 1
    return values.groupBy(*by).agg(
        F.avg(value).alias("mean"), F.when(many, F.stddev_samp(value)).otherwise(F.lit(0.0)).alias("std"),
        F.when(many, F.lit(1.96) * F.stddev_samp(value) / F.sqrt(F.count(value))).otherwise(F.lit(0.0)).alias("ci95"))


def latency_percentiles(df: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    exact = exact_quantiles(df, by, column, {"p50_ms": 0.5, "p90_ms": 0.9, "p99_ms": 0.99})
    return df.groupBy(*by).agg(F.count(column).alias("n")).join(exact, list(by))


def latency_percentiles_approx(df: DataFrame, by: Sequence[str], column: str, accuracy: int = 10000) -> DataFrame:
    """Mergeable sketch for groups too large for exact percentiles."""
    q = F.percentile_approx(column, [0.5, 0.9, 0.99], accuracy)
    return df.groupBy(*by).agg(F.count(column).alias("n"), q.alias("_q")).select(
        *by, "n", *[F.col("_q")[i].alias(f"p{p}_ms") for i, p in enumerate((50, 90, 99))])


def block_map(df: DataFrame, by: Sequence[str], block: str, label: str, source: str) -> DataFrame:
    """Rows, positives, negatives and number of member sources per block; ``block_sources`` lists them."""
    per_source = df.groupBy(*by, block, source).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q"))
    return per_source.groupBy(*by, block).agg(
        F.count(F.lit(1)).alias("sources"), F.sum("n").alias("n"),
        F.sum("p").alias("positive_windows"), F.sum("q").alias("negative_windows"))


def block_sources(df: DataFrame, by: Sequence[str], block: str, source: str) -> DataFrame:
    return df.select(*by, block, source).distinct()


def block_support(blocks: DataFrame, by: Sequence[str]) -> DataFrame:
    return blocks.groupBy(*by).agg(
        F.count(F.lit(1)).alias("blocks"), F.count_if(F.col("positive_windows") > 0).alias("positive_blocks"), F.sum("n").alias("n"))


def with_intervals(table: DataFrame, bounds: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Metrics joined with interval columns pivoted out of long form; keys must be unique on both sides."""
    wide = bounds.groupBy(*keys).pivot("metric", list(names)).agg(
        F.first("lower_95").alias("lower"), F.first("upper_95").alias("upper"), F.count(F.lit(1)).alias("rows"))
    single = F.lit(True)
    for name in names:
        single = single & (F.coalesce(F.col(f"{name}_rows"), F.lit(1)) == 1)
    guard = F.when(single, F.lit(True)).otherwise(F.raise_error(F.lit("interval keys are not unique")).cast("boolean"))
    wide = wide.filter(guard).select(*keys, *[
        F.col(f"{n}_{side}").alias(f"{n}_ci_{side}") for n in names for side in ("lower", "upper")])
    return table.join(wide, list(keys), "left")


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)


def recent(df: DataFrame, order: Sequence[Column], n: int = 10) -> DataFrame:
    """Top-n report; each task keeps n rows and only those are merged."""
    return df.orderBy(*order).limit(n)
