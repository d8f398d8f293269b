"""Bootstrap draws and exact tails at sizes far from the small ones."""

from __future__ import annotations

import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from flowsieve.functions import special
from flowsieve.operators import bootstrap


def test_counted_out(spark):
    df = spark.createDataFrame([(k, n) for k, n in enumerate([1, 2, 1023, 1024, 1025, 40_000])], "k int, n bigint")
    out = bootstrap.counted_out(df, "n", "j", ["k"]).groupBy("k", "n").agg(F.count("*").alias("c"), F.min("j").alias("lo"), F.max("j").alias("hi"), F.count_distinct("j").alias("d"))
    assert all((r.c, r.lo, r.hi, r.d) == (r.n, 0, r.n - 1, r.n) for r in out.collect())
    # numbers beyond 2 ** 32 come without their predecessors being made: the digits alone are counted
    big = spark.createDataFrame([(1 << 41,)], "n bigint")
    some = [r.j for r in bootstrap.counted_out(big, "n", "j").limit(3).collect()]
    assert len(set(some)) == 3 and all(0 <= j < 1 << 41 for j in some)


def test_draws_reach_all_blocks_evenly(spark):
    count = (1 << 40) + 7
    drawn = spark.range(4000).select(bootstrap.draw(5, F.lit(1), F.col("id"), F.lit(count)).alias("b"))
    low, high, mean = drawn.agg(F.min("b"), F.max("b"), F.avg("b")).first()
    assert 0 <= low < count / 500 and count * 0.998 < high < count and abs(mean / count - 0.5) < 0.02


def test_heavy_blocks_are_salted_alike(spark, monkeypatch):
    rows = spark.range(900).select(
        F.lit("d").alias("dataset"), F.when(F.col("id") < 500, "big").otherwise(F.concat(F.lit("r"), F.col("id") % 5)).alias("run_id"),
        (F.xxhash64("id") % 2 == 0).cast("int").alias("label"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(997)) / 997).alias("probability"))
    rows = rows.withColumn("prediction", (F.col("probability") > 0.5).cast("int"))
    read = lambda: sorted(tuple(r) for r in bootstrap.cluster_intervals(rows, ["dataset"], ["run_id"], 20).collect())
    plain = read()
    monkeypatch.setattr(bootstrap, "HEAVY", 50)
    salted = read()
    assert len(plain) == len(salted) == 10
    assert all(a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], rel=1e-12) for a, b in zip(plain, salted))


def test_binomial_tails():
    for a, b in ((0, 5), (1, 9), (3, 4), (7, 7), (40, 60), (450, 550), (10, 1000), (5000, 5200)):
        n, k = a + b, min(a, b)
        exact = Fraction(1) if a == b else min(Fraction(1), 2 * sum(Fraction(math.comb(n, i), 2 ** n) for i in range(k + 1)))
        assert special.binomial_half(a, b) == special.binomial_half(b, a) == pytest.approx(float(exact), rel=1e-12)
    # at 1e12 the normal tail with continuity correction is right to 1 / n
    for z in (0.001, 2.0, 4.0):
        k = int(5e11 - z * 5e5)
        w = (1e12 - 2 * k - 1) / 1e6
        assert special.binomial_half(k, 10 ** 12 - k) == pytest.approx(math.erfc(w / math.sqrt(2)), rel=1e-9)


def test_no_silent_ends(monkeypatch):
    monkeypatch.setattr(special, "MOST_TERMS", 10)
    with pytest.raises(ArithmeticError, match="did not converge"):
        special.binomial_half(499_999_000_000, 500_001_000_000)
    assert special.t_quantile(0.975, 1e9) == pytest.approx(special.t_quantile(0.975, 9e5), rel=1e-5)
    assert special.t_quantile(0.975, 1e12) == pytest.approx(1.959963984540054, rel=1e-11)


def _scored(spark):
    return spark.range(300).select(
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("d"), (F.col("id") % 7).cast("string").alias("c"),
        (F.xxhash64("id") % 2 == 0).cast("int").alias("label"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(40)) / 40).alias("probability"),
        F.lit(1).alias("prediction"))


def test_areas_of_replicates_are_those_of_the_drawn_rows(spark, monkeypatch):
    """Slices of few scores, few replicates and rows at a time, many equal scores."""
    for name, value in (("HEAVY", 17), ("WIDTH", 5), ("CELLS", 60), ("BATCH", 3)):
        monkeypatch.setattr(bootstrap, name, value)
    rows = _scored(spark)
    numbered = bootstrap.numbered_blocks(rows.select("d", "c").distinct(), ["d"], ["c"])
    times = bootstrap.multiplicities(numbered, 12, 4)
    found = {(r.d, r.replicate): (r.roc_auc, r.pr_auc) for r in bootstrap._resampled_areas(rows, ["d"], ["c"], numbered, times, 12).collect()}
    block = {(r.d, r.c): r.block for r in numbered.collect()}
    often = {(r.replicate, r.block): r.times for r in times.collect()}
    data = rows.collect()
    assert len(found) == 24
    for (d, k), (roc, pr) in found.items():
        drawn = [(r.probability, r.label, often.get((k, block[d, r.c]), 0)) for r in data if r.d == d]
        up, down = [(p, n) for p, y, n in drawn if y and n], [(p, n) for p, y, n in drawn if not y and n]
        positives, negatives = sum(n for _, n in up), sum(n for _, n in down)
        wins = sum(n * m * ((p > q) + (p == q) / 2) for p, n in up for q, m in down)
        steps = sum(n * (t := sum(m for q, m in up if q >= p)) / (t + sum(m for q, m in down if q >= p)) for p, n in up)
        assert roc == pytest.approx(wins / positives / negatives, rel=1e-12) and pr == pytest.approx(steps / positives, rel=1e-12)


def test_no_row_for_each_score_and_replicate(spark):
    """Scores times replicates are never rows of a plan: 100,000 scores of 2,000 replicates would be hundreds of millions."""
    plan = bootstrap.cluster_intervals(_scored(spark), ["d"], ["c"], 20)._jdf.queryExecution().optimizedPlan().toString()
    wide = [line for line in plan.splitlines() if "replicate#" in line and "score#" in line and "CoGroups" not in line]
    assert "CoGroups" in plan and not wide
