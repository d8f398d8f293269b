from __future__ import annotations

import hashlib
import itertools
import math
import statistics

import pytest
from pyspark.sql import functions as F

from flowsieve.functions.quantiles import exact_quantiles
from flowsieve.functions.special import binomial_half, t_quantile
from flowsieve.operators import bootstrap, curves, metrics, summaries


def scored(spark, y, p, a=None, group="g"):
    a = a or [int(v >= 0.5) for v in p]
    return spark.createDataFrame([(group, int(i), float(q), int(b)) for i, q, b in zip(y, p, a)], "g string, label int, probability double, prediction int")


def strict(spark, y, a):
    return metrics.strict_metrics(metrics.confusion(scored(spark, y, [0.1] * len(y), a), ["g"])).first()


def test_counts_and_undefined(spark):
    r = strict(spark, [0, 0, 1, 1], [0, 1, 0, 1])
    assert (r.tn, r.fp, r.fn, r.tp, r.f1) == (1, 1, 1, 1, 0.5)
    r = strict(spark, [0, 1], [0, 0])
    assert r.precision is None and r.f1 == 0 and "precision: zero denominator" in r.undefined_metrics
    r = strict(spark, [0, 0], [0, 0])
    assert r.f1 is None and r.recall is None and "f1: zero denominator" in r.undefined_metrics
    zero = metrics.zero_metrics(metrics.confusion(scored(spark, [0, 0], [0.1, 0.2], [0, 0]), ["g"])).first()
    assert (zero.precision, zero.recall, zero.f1, zero.accuracy) == (0.0, 0.0, 0.0, 1.0)


def brute_auc(y, p):
    pos, neg = [q for i, q in zip(y, p) if i], [q for i, q in zip(y, p) if not i]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def brute_ap(y, p):
    total, out, last = sum(y), 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        tp = sum(1 for i, q in zip(y, p) if q >= t and i)
        out += (tp / total - last) * tp / sum(1 for q in p if q >= t)
        last = tp / total
    return out


Y, P = [0, 1, 1, 0, 1, 0, 0, 1, 1, 0], [0.1, 0.4, 0.35, 0.4, 0.8, 0.8, 0.2, 0.9, 0.4, 0.05]


def test_areas_with_ties(spark):
    r = curves.ranking(scored(spark, Y, P), ["g"]).first()
    assert r.roc_auc == pytest.approx(brute_auc(Y, P)) and r.pr_auc == pytest.approx(brute_ap(Y, P))
    r = curves.ranking(scored(spark, [0, 0], [0.1, 0.2]), ["g"]).first()
    assert r.roc_auc is None and r.pr_auc is None
    with pytest.raises(Exception, match="finite"):
        curves.ranking(scored(spark, [0, 1], [float("nan"), 0.2], [0, 0]), ["g"]).collect()


def test_threshold_curve_against_brute_force(spark):
    curve = {r.threshold: r for r in curves.threshold_curve(scored(spark, Y, P), ["g"]).collect()}
    assert set(curve) == {0.0, math.nextafter(1.0, 2.0), *P}
    for t, r in curve.items():
        assert r.tp == sum(1 for y, p in zip(Y, P) if p >= t and y) and r.fp == sum(1 for y, p in zip(Y, P) if p >= t and not y)
    best = curves.select_threshold(curves.threshold_curve(scored(spark, Y, P), ["g"]), ["g"], 0.2).first()
    allowed = [r for r in curve.values() if r.fpr <= 0.2]
    assert best.threshold == max(allowed, key=lambda r: (r.f1, r.recall, -r.fpr, r.threshold)).threshold


def test_published_curve_selects_its_row(spark):
    # fixed values: part of a published validation curve (threshold, tn, fp, fn, tp)
    published = [(0.0, 0, 120, 0, 120), (0.9285714285714286, 119, 1, 0, 120), (0.9639583333333334, 120, 0, 0, 120), (1.0, 120, 0, 30, 90), (1.0000000000000002, 120, 0, 120, 0)]
    df = curves._with_rates(spark.createDataFrame(published, "threshold double, tn int, fp int, fn int, tp int").withColumn("g", F.lit("x")))
    assert curves.select_threshold(df, ["g"], 0.05).first().threshold == 0.9639583333333334


def test_grid_threshold_takes_the_lowest_of_equals(spark):
    best = curves.choose_grid_threshold(curves.grid_curve(scored(spark, [0, 1], [0.2, 0.7]), ["g"]), ["g"]).first()
    assert best.f1 == 1.0 and best.threshold == 0.21


def test_sweep(spark):
    out = {round(r.threshold, 3): r for r in curves.sweep(scored(spark, Y, P), ["g"], [0.05, 0.4, 0.95]).collect()}
    assert (out[0.05].tp, out[0.05].fp) == (5, 5) and (out[0.4].tp, out[0.4].fp) == (4, 2) and (out[0.95].tp, out[0.95].tn) == (0, 5)


def draws(seed, replicates, blocks):
    return [[int(hashlib.md5(f"{seed}|{r}|{j}".encode()).hexdigest()[:15], 16) % blocks for j in range(blocks)] for r in range(replicates)]


def test_block_bootstrap_by_hand(spark):
    data = [("d", f"b{i}", y, a) for i, rows in enumerate([[(1, 1), (0, 0)], [(1, 0), (0, 1), (1, 1)], [(0, 0)]]) for y, a in rows]
    df = spark.createDataFrame(data, "d string, b string, label int, prediction int")
    counts = [(1, 0, 0, 1), (0, 1, 1, 1), (1, 0, 0, 0)]
    accuracy = []
    for sample in draws(7, 5, 3):
        tn, fp, fn, tp = (sum(c[i] for c in (counts[s] for s in sample)) for i in range(4))
        accuracy.append((tn + tp) / (tn + fp + fn + tp))
    out = {r.metric: r for r in bootstrap.block_intervals(df, ["d"], ["b"], 5, 7).collect()}
    ordered = sorted(accuracy)
    expect = lambda q: ordered[int(q * 4)] + (ordered[min(int(q * 4) + 1, 4)] - ordered[int(q * 4)]) * (q * 4 - int(q * 4))
    assert out["accuracy"].lower_95 == pytest.approx(expect(0.025)) and out["accuracy"].upper_95 == pytest.approx(expect(0.975)) and out["accuracy"].blocks == 3


def test_cluster_bootstrap_counts_undefined(spark):
    df = spark.createDataFrame([("d", "a", 0, 0.1, 0), ("d", "b", 1, 0.9, 1)], "d string, c string, label int, probability double, prediction int")
    out = {r.metric: r for r in bootstrap.cluster_intervals(df, ["d"], ["c"], 8, 3).collect()}
    single = sum(1 for s in draws(3, 8, 2) if len(set(s)) == 1)
    assert out["roc_auc"].undefined_replicates == single and out["roc_auc"].valid_replicates == 8 - single and out["accuracy"].valid_replicates == 8


def predictions(spark):
    rows = []
    for i, (y, base, other) in enumerate([(1, 1, 0), (1, 0, 1), (0, 0, 0), (1, 1, 1)]):
        rows += [("base", 0, f"r{i}", f"run{i % 3}", y, 0.5, base), ("new", 0, f"r{i}", f"run{i % 3}", y, 0.6, other)]
    return spark.createDataFrame(rows, "policy string, fold int, row_id string, run_id string, label int, probability double, prediction int")


def test_paired_policies(spark):
    r = bootstrap.with_mcnemar(bootstrap.paired_differences(predictions(spark), "base", ["fold", "run_id"], 20)).first()
    assert (r.disagreement_count, r.policy_only_correct, r.baseline_only_correct, r.mcnemar_exact_p) == (2, 1, 1, 1.0)
    broken = predictions(spark).withColumn("label", F.when((F.col("policy") == "new") & (F.col("row_id") == "r0"), 0).otherwise(F.col("label")))
    with pytest.raises(Exception, match="different test rows"):
        bootstrap.paired_rows(broken, "base").collect()
    base_row = (F.col("policy") == "base") & (F.col("row_id") == "r0")
    for wrong in (predictions(spark).filter(~base_row), predictions(spark).filter("policy = 'base' or row_id <> 'r0'"), predictions(spark).union(predictions(spark).filter(base_row))):
        with pytest.raises(ValueError, match="different test rows"):
            bootstrap.paired_rows(wrong, "base")


def test_special_functions():
    # fixed values: published 97.5 % points of the t distribution
    for dof, q in {1: 12.706204736, 4: 2.776445105, 29: 2.045229642, 120: 1.979930405}.items():
        assert t_quantile(0.975, dof) == pytest.approx(q, abs=1e-8)
    for a, b in itertools.product(range(6), repeat=2):
        n, k = a + b, min(a, b)
        exact = 1.0 if a == b else min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2 ** n)
        assert binomial_half(a, b) == pytest.approx(exact)


def test_student_summary(spark):
    values = [1.0, 2.0, 4.0, 7.0]
    df = spark.createDataFrame([("a", v) for v in values] + [("a", None), ("b", 3.0)], "k string, value double")
    out = {r.k: r for r in summaries.student_summary(df, ["k"]).collect()}
    half = t_quantile(0.975, 3) * statistics.stdev(values) / 2
    assert out["a"].ci_upper == pytest.approx(3.5 + half) and out["a"].undefined_trials == 1 and out["a"].median == 3.0
    assert out["b"].ci_lower is None and out["b"].std is None


def test_exact_quantiles(spark):
    values = [5.0, 1.0, 1.0, 9.0, 3.0, 2.0]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 4.0), ("a", None)], "k string, v double")
    out = {r.k: r for r in exact_quantiles(df, ["k"], "v", {"lo": 0.1, "mid": 0.5, "hi": 0.9}).collect()}
    assert (out["a"].lo, out["a"].mid, out["a"].hi) == (pytest.approx(1.0), pytest.approx(2.5), pytest.approx(7.0)) and out["b"].hi == 4.0


def test_action_levels(spark):
    df = spark.createDataFrame([(s,) for s in (0.1, 0.3, 0.89, 0.9)], "s double")
    assert [r[0] for r in df.select(metrics.action_level(F.col("s"), 0.3)).collect()] == [0, 1, 1, 2]
    assert [r[0] for r in df.select(metrics.action_level(F.col("s"), 0.8)).collect()] == [0, 0, 1, 1]


def test_binary_check(spark):
    with pytest.raises(Exception, match="0 or 1"):
        metrics.check_binary(spark.createDataFrame([(2,)], "y int"), ["y"]).collect()
