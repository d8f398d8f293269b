"""Block, cluster and trial bootstrap on sufficient statistics.

Rows are reduced to one row of counts per block before anything is resampled. The
draws come from a hash of (seed, replicate, draw), so they are the same in every
run, on every executor and in any other engine.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.functions.ordering import SLICE, running, sliced
from flowsieve.functions.quantiles import exact_quantiles
from flowsieve.operators import curves, metrics
from flowsieve.session import written

#: Histogram rows of one slice, about; draws are dealt out by ranges of SPAN.
HEAVY, SPAN = 20_000, 1 << 20
#: A task multiplies a slice by at most WIDTH replicates and holds at most CELLS of blocks by replicates, BATCH rows at a time.
WIDTH, CELLS, BATCH = 500, 10_000_000, 2_000
CLUSTER_METRICS = ["accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc", "fpr", "fnr", "benign_damage", "reward_mean"]


def draw(seed: int, replicate: Column, position: Column, count: Column) -> Column:
    """Block number of one draw, uniform on 0..count-1: 60 bits, so no block is favoured by more than count / 2 ** 60."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), replicate.cast("string"), position.cast("string")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint") % count


def counted_out(df: DataFrame, count: str, name: str, spread: Sequence[str] = ()) -> DataFrame:
    """Each row ``count`` times, numbered 0, 1, ... in ``name``; by digits of 1024, so no row ever holds the numbers in an array.

    Rows are dealt out anew by ``spread`` and range of SPAN numbers, which spreads a few rows with large counts over all tasks.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = df.withColumn(name, F.lit(0).cast("bigint"))
    for width in (SPAN << 20, SPAN << 10, SPAN, 1 << 10, 1):
        # an explicit number of tasks keeps adaptive coalescing from undoing the spread
        out = out.repartition(tasks, *spread, name) if width == 1 << 10 else out
        digits = F.sequence(F.lit(0).cast("bigint"), F.least(F.expr(f"({count} - 1 - {name}) div {width}"), F.lit(1023)))
        out = out.withColumn("_digit", F.explode(digits)).withColumn(name, F.col(name) + F.col("_digit") * width).drop("_digit")
    return out


def numbered_blocks(blocks: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``block`` 0..B-1 in sort order and ``blocks`` = B per group."""
    run = running(sliced(blocks, by, order), by, order, {"block": F.lit(1).cast("bigint")}, totals=True).drop(SLICE)
    return run.withColumn("block", F.col("block") - 1).withColumnRenamed("block_total", "blocks")


def multiplicities(numbered: DataFrame, replicates: int, seed: int) -> DataFrame:
    """How often each block is drawn per replicate: (blocks, replicate, block, times).

    Draws depend on the number of blocks only, so groups of equal size share them.
    """
    sizes = numbered.select("blocks").distinct()
    spread = sizes.select("blocks", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    drawn = counted_out(spread, "blocks", "_j", ["blocks", "replicate"])
    picked = drawn.select("replicate", "blocks", draw(seed, F.col("replicate"), F.col("_j"), F.col("blocks")).alias("block"))
    return picked.groupBy("blocks", "replicate", "block").agg(F.count(F.lit(1)).alias("times"))


def resampled(numbered: DataFrame, by: Sequence[str], values: Sequence[str], replicates: int, seed: int) -> DataFrame:
    """Sum of ``values`` over the drawn blocks of every replicate.

    With few blocks the draws are small and Spark broadcasts them; with many blocks
    the join key has many values and shuffles evenly.
    """
    return _weighted(numbered, by, values, multiplicities(numbered, replicates, seed))


def _weighted(blocks: DataFrame, by: Sequence[str], values: Sequence[str], times: DataFrame) -> DataFrame:
    return blocks.join(times, ["blocks", "block"]).groupBy(*by, "replicate").agg(
        *[F.sum(F.col(v) * F.col("times")).alias(v) for v in values])


def intervals(replicated: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Percentile bounds per metric in long form; null replicates are counted, not used."""
    long = replicated.select(*by, F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in names])).alias("_m")).select(*by, "_m.*")
    return long.groupBy(*by, "metric").agg(
        F.percentile("v", F.lit(0.025)).alias("lower_95"), F.percentile("v", F.lit(0.975)).alias("upper_95"),
        F.count("v").alias("valid_replicates"), F.count_if(F.col("v").isNull()).alias("undefined_replicates"))


def block_intervals(
    df: DataFrame, by: Sequence[str], block: Sequence[str], replicates: int = 2000, seed: int = 20260928,
    label: str = "label", prediction: str = "prediction",
) -> DataFrame:
    """Zero-convention metrics of resampled blocks."""
    counts = metrics.confusion(df, [*by, *block], label, prediction)
    numbered = numbered_blocks(counts, by, block)
    total = metrics.zero_metrics(resampled(numbered, by, metrics.COUNTS, replicates, seed))
    found = intervals(total, by, metrics.RATIO_METRICS).drop("valid_replicates", "undefined_replicates")
    sizes = numbered.groupBy(*by).agg(F.max("blocks").alias("blocks"))
    return found.join(sizes, list(by)) if by else found.withColumn("blocks", F.lit(sizes.first()["blocks"]))


def cluster_intervals(
    df: DataFrame, by: Sequence[str], cluster: Sequence[str], replicates: int = 2000, seed: int = 9127,
) -> DataFrame:
    """Strict metrics, both areas and the mean utility of resampled clusters."""
    numbered = numbered_blocks(metrics.confusion(df, [*by, *cluster]), by, cluster)
    times = written(multiplicities(numbered, replicates, seed), "times")
    merged = _weighted(numbered, by, metrics.COUNTS, times)
    plain = metrics.strict_metrics(merged).withColumn("reward_mean", F.try_divide(metrics.utility_from_counts(), F.col("n")))
    ranked = _resampled_areas(df, by, cluster, numbered, times, replicates)
    return intervals(plain.join(ranked, [*by, "replicate"]), by, CLUSTER_METRICS)


def _resampled_areas(df: DataFrame, by: Sequence[str], cluster: Sequence[str], numbered: DataFrame, times: DataFrame, replicates: int) -> DataFrame:
    """Both areas of every replicate.

    A task takes one slice of the scores and some replicates, the counts before that slice and how often each of its blocks is
    drawn; scores are multiplied out by replicates in its memory only, a few at a time, and two sums a replicate leave it.
    """
    histogram = written(curves.score_histogram(df, [*by, *cluster]).join(
        numbered.select(*by, *cluster, "block", "blocks"), [*by, *cluster]).drop(*cluster), "histogram")
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # slices follow the score only, so they stay valid inside every replicate
    parts = sliced(histogram, by, [F.col("score").desc()], max(tasks, histogram.count() // HEAVY + 1))
    # equal scores share a slice; a slice that is large by them takes fewer replicates at once
    most = parts.groupBy(*by, SLICE).count().agg(F.max("count")).first()[0] or 1
    width = max(1, min(WIDTH, replicates, CELLS // most))
    chunk, at = F.expr(f"replicate div {width}").alias("_chunk"), F.expr(f"cast(replicate % {width} as int)").alias("at")

    held = parts.groupBy(*by, SLICE, "blocks", "block").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    sums = _weighted(held, [*by, SLICE], ["pos", "neg"], times)
    earlier = Window.partitionBy(*by, "replicate").orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*by, SLICE, chunk, at, *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("pos", "neg")])
    carried = before.groupBy(*by, SLICE, "_chunk").agg(F.collect_list(F.struct("at", "pos", "neg")).alias("_l")).select(
        *by, SLICE, "_chunk", F.lit(None).cast("bigint").alias("block"), "_l.at", F.col("_l.pos").alias("a"), F.col("_l.neg").alias("b"))
    packed = times.select("blocks", "block", chunk, at, "times").groupBy("blocks", "block", "_chunk").agg(
        F.collect_list(F.struct("at", "times")).alias("_l"))
    drawn = held.join(packed, ["blocks", "block"]).select(
        *by, SLICE, "_chunk", "block", "_l.at", F.col("_l.times").alias("a"), F.lit(None).cast("array<bigint>").alias("b"))

    keys = [*by, SLICE, "_chunk"]
    spread = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit((replicates - 1) // width).cast("bigint"))).alias("_chunk")
    # columns named anew, for both sides come from the same slices
    scores = parts.select(*by, SLICE, spread, "score", "block", "pos", "neg").toDF(*by, SLICE, "_chunk", "score", "block", "pos", "neg")
    types = dict(parts.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in by), "replicate bigint", "wins double", "steps double"])

    def areas(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        wins, steps = _slice_areas(left, right, width)
        found = [pa.array([k.as_py()] * width, k.type) for k in key[:len(by)]]
        return pa.table([*found, pa.array(key[-1].as_py() * width + np.arange(width)), pa.array(wins), pa.array(steps)], [*by, "replicate", "wins", "steps"])

    # an explicit number of tasks keeps adaptive coalescing from merging small inputs of long tasks
    sides = [side.repartition(tasks, *keys).groupBy(*keys) for side in (scores, drawn.unionByName(carried))]
    merged = sides[0].cogroup(sides[1]).applyInArrow(areas, schema).groupBy(*by, "replicate").agg(F.sum("wins").alias("wins"), F.sum("steps").alias("steps"))
    totals = sums.groupBy(*by, "replicate").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    p, n = F.col("p"), F.col("n")
    return totals.join(merged, [*by, "replicate"]).select(
        *by, "replicate", F.when((p > 0) & (n > 0), F.try_divide(F.col("wins"), p.cast("double") * n)).alias("roc_auc"),
        F.when(p > 0, F.col("steps") / p).alias("pr_auc"))


def _slice_areas(scores: pa.Table, drawn: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Per replicate the parts of both areas that the scores of one slice add: wins of positives, and steps of precision."""
    wins, steps, tp, fp = (np.zeros(width) for _ in range(4))
    score = scores["score"].to_numpy()
    order = np.argsort(-score, kind="stable")
    score, pos, neg = score[order], scores["pos"].to_numpy()[order].astype(float), scores["neg"].to_numpy()[order].astype(float)
    blocks, row = np.unique(scores["block"].to_numpy()[order], return_inverse=True)
    first = drawn.filter(pc.is_null(drawn["block"]))
    for side, column in ((tp, "a"), (fp, "b")):
        side[pc.list_flatten(first["at"]).to_numpy()] = pc.list_flatten(first[column]).to_numpy()
    own = drawn.filter(pc.is_valid(drawn["block"]))
    times = np.zeros((len(blocks), width))
    at_block = np.repeat(np.searchsorted(blocks, own["block"].to_numpy()), pc.list_value_length(own["at"]).to_numpy())
    times[at_block, pc.list_flatten(own["at"]).to_numpy()] = pc.list_flatten(own["a"]).to_numpy()
    starts = np.flatnonzero(np.r_[True, score[1:] != score[:-1]])
    ends = np.r_[starts[1:], len(score)]
    low = 0
    while low < len(starts):
        # as many whole scores as fit into a small batch, one at least
        high = max(low + 1, int(np.searchsorted(ends, starts[low] + BATCH, "right")))
        lines = slice(starts[low], ends[high - 1])
        much, at = times[row[lines]], starts[low:high] - starts[low]
        up, down = (np.add.reduceat(much * side[lines, None], at, axis=0) for side in (pos, neg))
        over, under = tp + np.cumsum(up, axis=0), fp + np.cumsum(down, axis=0)
        wins += (down * (over - up / 2)).sum(axis=0)
        steps += np.divide(up * over, over + under, out=np.zeros_like(over), where=over + under > 0).sum(axis=0)
        tp, fp, low = over[-1], under[-1], high
    return wins, steps


def paired_rows(predictions: DataFrame, baseline: str) -> DataFrame:
    """Every other policy next to the baseline on (fold, row_id).

    A row that a policy lacks or repeats, or that is labelled differently, is an error. The rows of a policy are counted at
    once, so that a later filter cannot hide a missing one.
    """
    policies = predictions.select("policy").distinct().count()
    scored = predictions.groupBy("fold", "row_id").agg(F.count(F.lit(1)).alias("n"), F.size(F.collect_set("policy")).alias("p"))
    if not scored.filter((F.col("n") != policies) | (F.col("p") != policies)).isEmpty():
        raise ValueError("policies scored different test rows")
    base = predictions.filter(F.col("policy") == baseline).select(
        "fold", "row_id", F.col("label").alias("_label"), F.col("prediction").alias("base_prediction"),
        F.col("probability").alias("base_probability"))
    other = predictions.filter(F.col("policy") != baseline)
    joined = other.join(base, ["fold", "row_id"], "left")
    same = F.coalesce(F.col("label") == F.col("_label"), F.lit(False))
    checked = F.when(same, F.col("label")).otherwise(F.raise_error(F.lit("policies scored different test rows")).cast("int"))
    return joined.withColumn("label", checked).drop("_label")


def paired_differences(predictions: DataFrame, baseline: str, cluster: Sequence[str], replicates: int = 2000, seed: int = 9127) -> DataFrame:
    """F1 and mean-utility differences with shared draws, and disagreement counts."""
    rows = paired_rows(predictions, baseline)
    y, a, b = F.col("label"), F.col("prediction"), F.col("base_prediction")
    gap = metrics.utility(y, a) - metrics.utility(y, b)
    per_cluster = rows.groupBy("policy", *cluster).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((y == 1) & (a == 1)).alias("tp_a"), (F.count_if(y == 1) + F.count_if(a == 1)).alias("den_a"),
        F.count_if((y == 1) & (b == 1)).alias("tp_b"), (F.count_if(y == 1) + F.count_if(b == 1)).alias("den_b"),
        F.sum(gap).alias("gain"), F.count_if(a != b).alias("disagree"),
        F.count_if((a == y) & (b != y)).alias("policy_only"), F.count_if((b == y) & (a != y)).alias("baseline_only"),
        F.max(F.abs(F.col("probability") - F.col("base_probability"))).alias("far"),
    )
    f1_gap = (F.try_divide(2.0 * F.col("tp_a"), F.col("den_a")) - F.try_divide(2.0 * F.col("tp_b"), F.col("den_b")))
    numbered = numbered_blocks(per_cluster, ["policy"], cluster)
    boot = resampled(numbered, ["policy"], ["n", "tp_a", "den_a", "tp_b", "den_b", "gain"], replicates, seed).select(
        "policy", f1_gap.alias("f1"), (F.col("gain") / F.col("n")).alias("reward"))
    bounds = boot.groupBy("policy").agg(
        F.percentile("f1", F.lit(0.025)).alias("f1_diff_ci_lower"), F.percentile("f1", F.lit(0.975)).alias("f1_diff_ci_upper"),
        F.percentile("reward", F.lit(0.025)).alias("reward_diff_ci_lower"), F.percentile("reward", F.lit(0.975)).alias("reward_diff_ci_upper"),
        F.count("f1").alias("f1_valid_replicates"))
    point = per_cluster.groupBy("policy").agg(
        *[F.sum(c).alias(c) for c in ("n", "tp_a", "den_a", "tp_b", "den_b", "gain", "disagree", "policy_only", "baseline_only")],
        F.max("far").alias("max_probability_difference"),
    ).select(
        "policy", F.lit(baseline).alias("baseline"), "n", F.col("disagree").alias("disagreement_count"),
        (F.col("disagree") == 0).alias("identical_predictions"), (F.col("max_probability_difference") == 0).alias("identical_probabilities"),
        "max_probability_difference", f1_gap.alias("f1_difference"), (F.col("gain") / F.col("n")).alias("reward_mean_difference"),
        F.col("baseline_only").alias("baseline_only_correct"), F.col("policy_only").alias("policy_only_correct"))
    return point.join(bounds, ["policy"])


def with_mcnemar(paired: DataFrame) -> DataFrame:
    """Exact two-sided p of the discordant counts; one row per policy reaches Python."""
    from flowsieve.functions.special import mcnemar_p

    return paired.withColumn("mcnemar_exact_p", mcnemar_p(F.col("policy_only_correct"), F.col("baseline_only_correct")))


def mean_summary(values: DataFrame, by: Sequence[str], unit: Sequence[str], value: str, replicates: int = 2000, seed: int = 20261002,
                 single_interval: bool = False) -> DataFrame:
    """Mean, spread and bootstrap bounds of complete-trial values; undefined trials are counted."""
    found = values.filter(F.col(value).isNotNull()).select(*by, *unit, F.col(value).cast("double").alias("v"))
    stats = values.groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"),
        F.when(F.count(value) > 1, F.stddev_samp(value)).alias("std"),
        F.min(value).cast("double").alias("minimum"), F.max(value).cast("double").alias("maximum"),
        F.count_if(F.col(value).isNull()).alias("undefined_trials"))
    numbered = numbered_blocks(found.withColumn("one", F.lit(1).cast("bigint")), by, unit)
    boot = resampled(numbered, by, ["v", "one"], replicates, seed).select(*by, (F.col("v") / F.col("one")).alias("m"))
    bounds = boot.groupBy(*by).agg(
        F.percentile("m", F.lit(0.025)).alias("ci_lower_95"), F.percentile("m", F.lit(0.975)).alias("ci_upper_95"))
    middle = exact_quantiles(values, by, value, {"median": 0.5})
    joined = stats.join(middle, list(by), "left").join(bounds, list(by), "left")
    if single_interval:
        return joined
    enough = F.col("n") > 1
    return joined.withColumns({c: F.when(enough, F.col(c)) for c in ("ci_lower_95", "ci_upper_95")})
