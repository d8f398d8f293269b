"""Score curves, areas and threshold selection from distinct-score histograms.

Rows are reduced to one row per (group, score) first; cumulative counts over that
histogram use slices, so neither a hot group nor millions of distinct scores end up
in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.functions.ordering import SLICE, running, sliced

# fixed value: the first double above one
ABOVE_ONE = 1.0000000000000002


def score_histogram(df: DataFrame, by: Sequence[str], label: str = "label", score: str = "probability", weight: Column | None = None) -> DataFrame:
    w = F.lit(1).cast("bigint") if weight is None else weight
    bad = F.col(score).isNull() | F.isnan(score) | (F.col(score) < 0) | (F.col(score) > 1)
    checked = F.when(bad, F.raise_error(F.lit("scores must be finite and within 0..1")).cast("double")).otherwise(F.col(score))
    return df.select(*by, checked.alias("score"), F.col(label).alias("_y"), w.alias("_w")).groupBy(*by, "score").agg(
        F.sum(F.when(F.col("_y") == 1, F.col("_w")).otherwise(F.lit(0))).alias("pos"),
        F.sum(F.when(F.col("_y") == 0, F.col("_w")).otherwise(F.lit(0))).alias("neg"),
    )


def cumulative(histogram: DataFrame, by: Sequence[str]) -> DataFrame:
    """tp and fp when predicting ``score >= this score``, with the class totals."""
    parts = sliced(histogram, by, [F.col("score").desc()])
    return running(parts, by, [F.col("score").desc()], {"tp": F.col("pos"), "fp": F.col("neg")}, totals=True).drop(SLICE)


def areas(cumulated: DataFrame, by: Sequence[str]) -> DataFrame:
    """ROC area (ties as half) and average precision; null where a class is missing."""
    tp, fp = F.col("tp").cast("double"), F.col("fp").cast("double")
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    merged = cumulated.groupBy(*by).agg(
        F.max("tp_total").alias("positives"), F.max("fp_total").alias("negatives"),
        F.sum(neg * (tp - pos / 2)).alias("_wins"),
        F.sum(F.try_divide(pos * tp, tp + fp)).alias("_steps"),
    )
    p, n = F.col("positives"), F.col("negatives")
    return merged.select(
        *by, "positives", "negatives",
        F.try_divide(F.col("_wins"), p.cast("double") * n).alias("roc_auc"),
        F.when(p > 0, F.col("_steps") / p).alias("pr_auc"),
    )


def ranking(df: DataFrame, by: Sequence[str], label: str = "label", score: str = "probability") -> DataFrame:
    return areas(cumulative(score_histogram(df, by, label, score), by), by)


def _with_rates(curve: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    return curve.withColumns({
        "f1": F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)),
        "recall": F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0)),
        "fpr": F.coalesce(F.try_divide(fp, fp + tn), F.lit(0.0)),
    })


def _counts(at: DataFrame, by: Sequence[str]) -> DataFrame:
    return at.select(
        *by, "threshold",
        (F.col("fp_total") - F.col("fp")).alias("tn"), "fp", (F.col("tp_total") - F.col("tp")).alias("fn"), "tp",
    )


def threshold_curve(df: DataFrame, by: Sequence[str], label: str = "label", score: str = "probability") -> DataFrame:
    """Confusion at 0, every distinct score and just above 1."""
    histogram = score_histogram(df, by, label, score)
    ends = F.explode(F.array(F.lit(0.0), F.lit(ABOVE_ONE))).alias("score")
    sentinels = histogram.select(*by).distinct().select(*by, ends, F.lit(0).cast("bigint").alias("pos"), F.lit(0).cast("bigint").alias("neg"))
    candidates = histogram.unionByName(sentinels).groupBy(*by, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return _with_rates(_counts(cumulative(candidates, by).withColumnRenamed("score", "threshold"), by))


def best_row(candidates: DataFrame, by: Sequence[str], order: Sequence[Column], keep: Sequence[str]) -> DataFrame:
    """The single best candidate per group; later ``order`` entries break ties. Map-side combined."""
    payload = F.struct(*[F.col(c).alias(c) for c in keep])
    return candidates.groupBy(*by).agg(F.max_by(payload, F.struct(*order)).alias("_best")).select(*by, "_best.*")


def select_threshold(curve: DataFrame, by: Sequence[str], max_fpr: float) -> DataFrame:
    """Highest F1, then recall, then lower fpr, then higher threshold, under the fpr cap."""
    allowed = curve.filter(F.col("fpr") <= max_fpr)
    order = [F.col("f1"), F.col("recall"), -F.col("fpr"), F.col("threshold")]
    return best_row(allowed, by, order, ["threshold", "tn", "fp", "fn", "tp", "f1", "recall", "fpr"])


def with_selected(curve: DataFrame, by: Sequence[str], max_fpr: float) -> DataFrame:
    """The whole curve with the chosen threshold flagged."""
    chosen = select_threshold(curve, by, max_fpr).select(*by, F.col("threshold").alias("_chosen"))
    if not by:
        row = chosen.first()
        return curve.withColumn("selected", F.col("threshold") == row["_chosen"] if row else F.lit(False))
    joined = curve.join(chosen, list(by), "left")
    return joined.withColumn("selected", F.coalesce(F.col("threshold") == F.col("_chosen"), F.lit(False))).drop("_chosen")


def grid_curve(df: DataFrame, by: Sequence[str], label: str = "label", score: str = "probability") -> DataFrame:
    """Confusion at 0.01..0.99 and at every score rounded to four places.

    Candidates and scores share one ordering, so counting scores at or above each
    candidate is a running sum and not a join of all pairs.
    """
    histogram = score_histogram(df, by, label, score)
    zero = F.lit(0).cast("bigint")
    steps = F.explode(F.transform(F.sequence(F.lit(1), F.lit(99)), lambda i: i / 100.0)).alias("score")
    fixed = histogram.select(*by).distinct().select(*by, steps)
    near = histogram.select(*by, (F.rint(F.col("score") * 10000) / 10000).alias("score"))
    marks = fixed.unionByName(near).distinct().select(*by, "score", zero.alias("pos"), zero.alias("neg"), F.lit(1).alias("mark"))
    mixed = histogram.withColumn("mark", F.lit(0)).unionByName(marks)
    order = [F.col("score").desc(), F.col("mark").asc()]
    run = running(sliced(mixed, by, order), by, order, {"tp": F.col("pos"), "fp": F.col("neg")}, totals=True)
    return _with_rates(_counts(run.filter("mark = 1").withColumnRenamed("score", "threshold"), by))


def choose_grid_threshold(curve: DataFrame, by: Sequence[str]) -> DataFrame:
    """Highest F1, then recall, then lower fpr; the lowest threshold among equals."""
    order = [F.col("f1"), F.col("recall"), -F.col("fpr"), -F.col("threshold")]
    return best_row(curve, by, order, ["threshold", "tn", "fp", "fn", "tp", "f1", "recall", "fpr"])


def sweep(df: DataFrame, by: Sequence[str], thresholds: Sequence[float], label: str = "label", score: str = "probability") -> DataFrame:
    """Confusion at a fixed list of thresholds: one bucket per row, then at most len+1 buckets per group."""
    grid = sorted(thresholds)
    cleared = sum((F.col(score) >= F.lit(t)).cast("int") for t in grid)
    buckets = df.select(*by, F.col(label).alias("_y"), cleared.alias("_bucket")).groupBy(*by, "_bucket").agg(
        F.count_if(F.col("_y") == 1).alias("pos"), F.count_if(F.col("_y") == 0).alias("neg"))
    marks = F.explode(F.array(*[
        F.struct(F.lit(i + 1).alias("_mark"), F.lit(t).alias("threshold")) for i, t in enumerate(grid)])).alias("_m")
    spread = buckets.select(*by, "_bucket", "pos", "neg", marks).select("*", "_m.*")
    hit = F.col("_bucket") >= F.col("_mark")
    counted = spread.groupBy(*by, "threshold").agg(
        F.sum(F.when(~hit, F.col("neg")).otherwise(F.lit(0))).alias("tn"), F.sum(F.when(hit, F.col("neg")).otherwise(F.lit(0))).alias("fp"),
        F.sum(F.when(~hit, F.col("pos")).otherwise(F.lit(0))).alias("fn"), F.sum(F.when(hit, F.col("pos")).otherwise(F.lit(0))).alias("tp"))
    return counted


def curve_points(df: DataFrame, by: Sequence[str], label: str = "label", score: str = "probability") -> DataFrame:
    """False and true positive rate, precision and recall at every distinct score."""
    c = cumulative(score_histogram(df, by, label, score), by)
    tp, fp = F.col("tp").cast("double"), F.col("fp").cast("double")
    return c.select(
        *by, F.col("score").alias("threshold"),
        F.try_divide(fp, F.col("fp_total")).alias("fpr"), F.try_divide(tp, F.col("tp_total")).alias("tpr"),
        F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, F.col("tp_total")).alias("recall"),
    )
