"""Queries over metrics, curves, bootstrap intervals and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsieve.operators import bootstrap, curves, metrics, summaries, windows
from flowsieve.plans import tables
from flowsieve.plans.registry import Registry
from flowsieve.plans.tables import WINDOW, oracle, place, rounded, sql_round
from flowsieve.schemas import BASELINE_POLICY, FEATURES

R = Registry()


def melt(source: str, keys: str, names) -> str:
    """Long form (metric, v) of ``source`` as SQL, nulls included."""
    labels, values = ", ".join(f"'{n}'" for n in names), ", ".join(f"CAST({n} AS DOUBLE)" for n in names)
    return f"SELECT {keys}, unnest([{labels}]) AS metric, unnest([{values}]) AS v FROM {source}"


COUNTS_SQL = """count(*) FILTER (label = 0 AND prediction = 0) AS tn, count(*) FILTER (label = 0 AND prediction = 1) AS fp,
      count(*) FILTER (label = 1 AND prediction = 0) AS fn, count(*) FILTER (label = 1 AND prediction = 1) AS tp"""
RATIO_SQL = {
    "accuracy": "(tn + tp) / nullif(tn + fp + fn + tp, 0)::DOUBLE", "precision": "tp / nullif(tp + fp, 0)::DOUBLE",
    "recall": "tp / nullif(tp + fn, 0)::DOUBLE", "f1": "2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE",
    "fpr": "fp / nullif(fp + tn, 0)::DOUBLE", "fnr": "fn / nullif(fn + tp, 0)::DOUBLE",
    "benign_damage": "fp / nullif(fp + tn, 0)::DOUBLE",
}
_DEN = {"precision": "tp + fp", "recall": "tp + fn", "f1": "2 * tp + fp + fn", "fpr": "fp + tn", "fnr": "fn + tp", "benign_damage": "fp + tn"}
REASONS_SQL = "concat_ws('; ', " + ", ".join(f"CASE WHEN {d} = 0 THEN '{m}: zero denominator' END" for m, d in _DEN.items()) + ") AS undefined_metrics"
ZERO_SQL = {m: f"coalesce({e}, 0)" for m, e in RATIO_SQL.items()}
# utility of the four counts, summed exactly
UTILITY_SQL = "(2.0::DOUBLE * {tp} - 2.0::DOUBLE * {fn} - 1.25::DOUBLE * {fp} + 0.2::DOUBLE * {tn})".format(
    tn="count(*) FILTER (label = 0 AND prediction = 0)", fp="count(*) FILTER (label = 0 AND prediction = 1)",
    fn="count(*) FILTER (label = 1 AND prediction = 0)", tp="count(*) FILTER (label = 1 AND prediction = 1)")
GAIN = ("CASE WHEN label = 1 AND {a} = 1 THEN 2.0::DOUBLE WHEN label = 1 THEN -2.0::DOUBLE "
        "WHEN {a} = 1 THEN -1.25::DOUBLE ELSE 0.2::DOUBLE END")
DRAW = "CAST(concat('0x', substr(md5(concat_ws('|', '{seed}', r, j)), 1, 15)) AS BIGINT) % b"


@R.add("h1_confusion", oracle(f"SELECT dataset, fold, {COUNTS_SQL} FROM sc GROUP BY dataset, fold"))
def confusion(spark, folder):
    return metrics.confusion(tables.scores(spark, folder), ["dataset", "fold"])


# the hour split leaves groups without positives, so undefined ratios occur
@R.add("h2_strict_metrics", oracle(f"SELECT dataset, fold, tn, fp, fn, tp, tn + fp + fn + tp AS n, {sql_round(RATIO_SQL)}, {REASONS_SQL} FROM c",
      c=f"SELECT dataset, fold, {COUNTS_SQL} FROM sc GROUP BY dataset, fold"))
def strict_metrics(spark, folder):
    return rounded(metrics.strict_metrics(metrics.confusion(tables.scores(spark, folder), ["dataset", "fold"])))


@R.add("h3_zero_metrics", oracle(f"SELECT dataset, fold, tn, fp, fn, tp, tn + fp + fn + tp AS n, {sql_round(ZERO_SQL)} FROM c",
      c=f"SELECT dataset, fold, {COUNTS_SQL} FROM sc GROUP BY dataset, fold"))
def zero_metrics(spark, folder):
    return rounded(metrics.zero_metrics(metrics.confusion(tables.scores(spark, folder), ["dataset", "fold"])))


@R.add("h4_legacy_metrics_brier", oracle(f"SELECT fold, tn, fp, fn, tp, tn + fp + fn + tp AS n, {sql_round({**ZERO_SQL, 'brier': 'brier'})} FROM c",
      c=f"SELECT fold, {COUNTS_SQL}, avg(pow(greatest(0, least(1, probability)) - label, 2)) AS brier FROM sc GROUP BY fold"))
def legacy_metrics(spark, folder):
    s = tables.scores(spark, folder)
    return rounded(metrics.zero_metrics(metrics.confusion(s, ["fold"])).join(metrics.brier(s, ["fold"]), "fold"))


_HIST = {
    "hg": "SELECT {k}, probability AS s, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM {t} GROUP BY ALL",
    "cm": """SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY {k}) AS tpt, sum(neg) OVER (PARTITION BY {k}) AS fpt
      FROM hg WINDOW w AS (PARTITION BY {k} ORDER BY s DESC ROWS UNBOUNDED PRECEDING)""",
    "ar": """SELECT {k}, sum(neg * (tp - pos / 2)) / nullif(max(tpt) * max(fpt), 0) AS roc_auc,
      CASE WHEN max(tpt) > 0 THEN sum(pos * tp / nullif(tp + fp, 0)) / max(tpt) END AS pr_auc,
      CAST(max(tpt) AS BIGINT) AS positives, CAST(max(fpt) AS BIGINT) AS negatives FROM cm GROUP BY {k}""",
}


def _hist(key: str, source: str) -> dict[str, str]:
    return {n: s.format(k=key, t=source) for n, s in _HIST.items()}


@R.add("h5_h6_ranking_areas", oracle(f"SELECT policy, positives, negatives, {sql_round({'roc_auc': 'roc_auc', 'pr_auc': 'pr_auc'})} FROM ar", **_hist("policy", "po")))
def ranking_areas(spark, folder):
    return rounded(curves.ranking(tables.policies(spark, folder), ["policy"]))


@R.add("h5_h6_single_class", oracle(f"SELECT dataset, positives, negatives, {sql_round({'roc_auc': 'roc_auc', 'pr_auc': 'pr_auc'})} FROM ar", **_hist("dataset", "sc")))
def single_class_areas(spark, folder):
    return rounded(curves.ranking(tables.scores(spark, folder), ["dataset"]))


# utilities have two decimals, so their means are compared at more places than they can tie at
@R.add("h7_utility", oracle(f"""SELECT policy, {sql_round({'reward': UTILITY_SQL, 'reward_mean': f"{UTILITY_SQL} / count(*)"}, 9)},
      count(*) FILTER (prediction = 1) AS mitigation_count, count(*) FILTER (prediction = 0) AS no_action_count FROM po GROUP BY policy"""))
def utility(spark, folder):
    return rounded(metrics.utility_totals(tables.policies(spark, folder), ["policy"]), 9)


@R.add("d11_cumulative_confusion", oracle("""SELECT policy, s AS score, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fpt - fp AS BIGINT) AS tn,
      CAST(tpt - tp AS BIGINT) AS fn FROM cm""", **_hist("policy", "po")))
def cumulative_confusion(spark, folder):
    c = curves.cumulative(curves.score_histogram(tables.policies(spark, folder), ["policy"]), ["policy"])
    return c.select("policy", "score", "tp", "fp", (F.col("fp_total") - F.col("fp")).alias("tn"), (F.col("tp_total") - F.col("tp")).alias("fn"))


_CURVE = {
    **_hist("policy", "po"),
    "cand": "SELECT policy, s AS threshold FROM hg UNION SELECT policy, v FROM (SELECT DISTINCT policy FROM hg), (VALUES (0.0::DOUBLE), (1.0000000000000002::DOUBLE)) t(v)",
    "spot": """SELECT cand.policy, threshold, coalesce(pos, 0) AS pos, coalesce(neg, 0) AS neg FROM cand LEFT JOIN hg ON hg.policy = cand.policy AND hg.s = cand.threshold""",
    "cur": """SELECT policy, threshold, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY policy) AS tpt,
      sum(neg) OVER (PARTITION BY policy) AS fpt FROM spot WINDOW w AS (PARTITION BY policy ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)""",
    "crv": """SELECT policy, threshold, CAST(fpt - fp AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(tpt - tp AS BIGINT) AS fn, CAST(tp AS BIGINT) AS tp,
      coalesce(2 * tp / nullif(tpt + tp + fp, 0)::DOUBLE, 0) AS f1, coalesce(tp / nullif(tpt, 0)::DOUBLE, 0) AS recall, coalesce(fp / nullif(fpt, 0)::DOUBLE, 0) AS fpr FROM cur""",
    "best": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY policy ORDER BY f1 DESC, recall DESC, fpr ASC, threshold DESC) AS rn
      FROM crv WHERE fpr <= 0.05::DOUBLE) WHERE rn = 1""",
}
_RATES = {"f1": "crv.f1", "recall": "crv.recall", "fpr": "crv.fpr"}


@R.add("h8_threshold_curve", oracle(f"""SELECT crv.policy, crv.threshold, crv.tn, crv.fp, crv.fn, crv.tp, {sql_round(_RATES)},
      crv.threshold = best.threshold AS selected FROM crv JOIN best ON crv.policy = best.policy""", **_CURVE))
def threshold_curve(spark, folder):
    curve = curves.threshold_curve(tables.policies(spark, folder), ["policy"])
    return _keep_threshold(curves.with_selected(curve, ["policy"], 0.05))


def _keep_threshold(df):
    return df.select(*[place(F.col(c)).alias(c) if c in ("f1", "recall", "fpr") else F.col(c) for c in df.columns])


@R.add("g5_constrained_best", oracle(f"""SELECT policy, threshold, tn, fp, fn, tp, {sql_round({'f1': 'f1', 'recall': 'recall', 'fpr': 'fpr'})} FROM best""", **_CURVE))
def constrained_best(spark, folder):
    curve = curves.threshold_curve(tables.policies(spark, folder), ["policy"])
    return _keep_threshold(curves.select_threshold(curve, ["policy"], 0.05))


_GRID = {
    **_hist("policy", "po"),
    "marks": """SELECT DISTINCT policy, t FROM (SELECT policy, i / 100.0::DOUBLE AS t FROM (SELECT DISTINCT policy FROM hg), range(1, 100) r(i)
      UNION ALL SELECT policy, round_even(s * 10000, 0) / 10000 FROM hg)""",
    "tot": "SELECT policy, sum(pos) AS p, sum(neg) AS n FROM hg GROUP BY policy",
    "mix": "SELECT policy, s AS v, pos, neg, 0 AS mark FROM hg UNION ALL SELECT policy, t, 0, 0, 1 FROM marks",
    "mixc": """SELECT policy, v, mark, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM mix
      WINDOW w AS (PARTITION BY policy ORDER BY v DESC, mark ASC ROWS UNBOUNDED PRECEDING)""",
    "gc": """SELECT policy, v AS threshold, CAST(n - fp AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(p - tp AS BIGINT) AS fn, CAST(tp AS BIGINT) AS tp,
      coalesce(2 * tp / nullif(p + tp + fp, 0)::DOUBLE, 0) AS f1, coalesce(tp / nullif(p, 0)::DOUBLE, 0) AS recall, coalesce(fp / nullif(n, 0)::DOUBLE, 0) AS fpr
      FROM mixc JOIN tot USING (policy) WHERE mark = 1""",
}


@R.add("h9_grid_threshold", oracle(f"""SELECT policy, threshold, tn, fp, fn, tp, {sql_round({'f1': 'f1', 'recall': 'recall', 'fpr': 'fpr'})}
      FROM (SELECT *, row_number() OVER (PARTITION BY policy ORDER BY f1 DESC, recall DESC, fpr ASC, threshold ASC) AS rn FROM gc) WHERE rn = 1""", **_GRID))
def grid_threshold(spark, folder):
    return _keep_threshold(curves.choose_grid_threshold(curves.grid_curve(tables.policies(spark, folder), ["policy"]), ["policy"]))


@R.add("h10_threshold_sweep", oracle(f"""SELECT policy, {sql_round({**ZERO_SQL, 'threshold': 't', 'brier': 'b'})}, tn, fp, fn, tp, tn + fp + fn + tp AS n FROM c""",
      grid="SELECT 0.05::DOUBLE + i * 0.025::DOUBLE AS t FROM range(0, 37) r(i)",
      bs="SELECT policy, avg(pow(probability - label, 2)) AS b FROM po GROUP BY policy",
      c="""SELECT policy, t, any_value(b) AS b, count(*) FILTER (label = 0 AND probability < t) AS tn, count(*) FILTER (label = 0 AND probability >= t) AS fp,
        count(*) FILTER (label = 1 AND probability < t) AS fn, count(*) FILTER (label = 1 AND probability >= t) AS tp FROM po JOIN bs USING (policy), grid GROUP BY policy, t"""))
def threshold_sweep(spark, folder):
    p = tables.policies(spark, folder)
    swept = metrics.zero_metrics(curves.sweep(p, ["policy"], [0.05 + i * 0.025 for i in range(37)]))
    return rounded(swept.join(metrics.brier(p, ["policy"]), "policy"))


@R.add("h23_curve_points", oracle(f"""SELECT policy, s AS threshold, {sql_round({'fpr': 'fp / nullif(fpt, 0)', 'tpr': 'tp / nullif(tpt, 0)', 'precision': 'tp / nullif(tp + fp, 0)', 'recall': 'tp / nullif(tpt, 0)'})}
      FROM cm""", **_hist("policy", "po")))
def curve_points(spark, folder):
    c = curves.curve_points(tables.policies(spark, folder), ["policy"])
    return c.select("policy", "threshold", *[place(F.col(x)).alias(x) for x in ("fpr", "tpr", "precision", "recall")])


def _boot_cte(source: str, key: str, block: str, replicates: int, seed: int, agg: str) -> dict[str, str]:
    return {
        "blk": f"SELECT {key}, {block}, {agg} FROM {source} GROUP BY ALL",
        "nb": f"SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {block}) - 1 AS i, count(*) OVER (PARTITION BY {key}) AS b FROM blk",
        "sz": f"SELECT {key}, max(b) AS b FROM nb GROUP BY {key}",
        "dr": f"""SELECT {key}, r, {DRAW.format(seed=seed)} AS i FROM (SELECT {key}, b, r, unnest(range(0, b)) AS j FROM sz, range(0, {replicates}) t(r))""",
    }


@R.add("h11_block_bootstrap", oracle(f"""SELECT dataset, metric, {sql_round({'lower_95': 'quantile_cont(v, 0.025)', 'upper_95': 'quantile_cont(v, 0.975)'})}, any_value(b) AS blocks
      FROM ({melt('met', 'dataset, r', RATIO_SQL)}) JOIN sz USING (dataset) GROUP BY dataset, metric""",
      **_boot_cte("sc", "dataset", "run_id", 2000, 20260928, COUNTS_SQL),
      rs="SELECT dataset, r, sum(tn) AS tn, sum(fp) AS fp, sum(fn) AS fn, sum(tp) AS tp FROM dr JOIN nb USING (dataset, i) GROUP BY dataset, r",
      met=f"SELECT dataset, r, {', '.join(f'{e} AS {m}' for m, e in ZERO_SQL.items())} FROM rs"))
def block_bootstrap(spark, folder):
    return rounded(bootstrap.block_intervals(tables.scores(spark, folder), ["dataset"], ["run_id"]))


_H12 = 2000


@R.add("h12_cluster_bootstrap", oracle(f"""SELECT dataset, metric, {sql_round({'lower_95': 'quantile_cont(v, 0.025)', 'upper_95': 'quantile_cont(v, 0.975)'})},
      count(v) AS valid_replicates, {_H12} - count(v) AS undefined_replicates
      FROM ({melt('met', 'dataset, r', [*RATIO_SQL, 'reward_mean', 'roc_auc', 'pr_auc'])}) GROUP BY dataset, metric""",
      **_boot_cte("pick", "dataset", "run_id", _H12, 9127, COUNTS_SQL + f", sum({GAIN.format(a='prediction')}) AS reward"),
      pick="SELECT * FROM sc",
      rs="""SELECT dataset, r, sum(tn) AS tn, sum(fp) AS fp, sum(fn) AS fn, sum(tp) AS tp, sum(reward) AS reward
        FROM dr JOIN nb USING (dataset, i) GROUP BY dataset, r""",
      hs="SELECT dataset, run_id, probability AS s, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM pick GROUP BY ALL",
      rh="""SELECT dataset, r, s, sum(pos) AS pos, sum(neg) AS neg FROM dr JOIN nb USING (dataset, i) JOIN hs USING (dataset, run_id) GROUP BY dataset, r, s""",
      rc="""SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM rh WINDOW w AS (PARTITION BY dataset, r ORDER BY s DESC ROWS UNBOUNDED PRECEDING)""",
      ra="""SELECT dataset, r, sum(neg * (tp - pos / 2)) / nullif(sum(pos) * sum(neg), 0) AS roc_auc,
        CASE WHEN sum(pos) > 0 THEN sum(pos * tp / nullif(tp + fp, 0)) / sum(pos) END AS pr_auc FROM rc GROUP BY dataset, r""",
      met=f"""SELECT dataset, r, {', '.join(f'{e} AS {m}' for m, e in RATIO_SQL.items())}, reward / (tn + fp + fn + tp) AS reward_mean, roc_auc, pr_auc
        FROM rs JOIN ra USING (dataset, r)"""))
def cluster_bootstrap(spark, folder):
    return rounded(bootstrap.cluster_intervals(tables.scores(spark, folder), ["dataset"], ["run_id"], _H12))


_PAIR = {
    "bl": "SELECT fold, row_id, prediction AS bp, probability AS bq FROM po WHERE policy = 'ml_window_baseline'",
    "pr": "SELECT po.*, bp, bq FROM po JOIN bl USING (fold, row_id) WHERE policy <> 'ml_window_baseline'",
    **_boot_cte("pr", "policy", "fold, run_id", 2000, 9127, f"""count(*) AS n, count(*) FILTER (label = 1 AND prediction = 1) AS tpa,
      count(*) FILTER (label = 1) + count(*) FILTER (prediction = 1) AS dna, count(*) FILTER (label = 1 AND bp = 1) AS tpb,
      count(*) FILTER (label = 1) + count(*) FILTER (bp = 1) AS dnb, sum({GAIN.format(a='prediction')} - {GAIN.format(a='bp')}) AS gain,
      count(*) FILTER (prediction <> bp) AS dis, count(*) FILTER (prediction = label AND bp <> label) AS po_only,
      count(*) FILTER (bp = label AND prediction <> label) AS ba_only, max(abs(probability - bq)) AS far"""),
    "rs": "SELECT policy, r, sum(n) AS n, sum(tpa) AS tpa, sum(dna) AS dna, sum(tpb) AS tpb, sum(dnb) AS dnb, sum(gain) AS gain FROM dr JOIN nb USING (policy, i) GROUP BY policy, r",
    "bd": """SELECT policy, quantile_cont(f, 0.025) AS fl, quantile_cont(f, 0.975) AS fu, quantile_cont(g, 0.025) AS gl, quantile_cont(g, 0.975) AS gu, count(f) AS nf
      FROM (SELECT policy, 2.0 * tpa / nullif(dna, 0)::DOUBLE - 2.0 * tpb / nullif(dnb, 0)::DOUBLE AS f, gain / n AS g FROM rs) GROUP BY policy""",
    "pt": """SELECT policy, CAST(sum(n) AS BIGINT) AS n, sum(tpa) AS tpa, sum(dna) AS dna, sum(tpb) AS tpb, sum(dnb) AS dnb, sum(gain) AS gain, CAST(sum(dis) AS BIGINT) AS dis,
      CAST(sum(po_only) AS BIGINT) AS po_only, CAST(sum(ba_only) AS BIGINT) AS ba_only, max(far) AS far FROM nb GROUP BY policy""",
}


@R.add("h13_paired_policies", oracle(f"""SELECT policy, 'ml_window_baseline' AS baseline, n, dis AS disagreement_count, dis = 0 AS identical_predictions,
      far = 0 AS identical_probabilities, {sql_round({
          'max_probability_difference': 'far', 'f1_difference': '2.0 * tpa / nullif(dna, 0)::DOUBLE - 2.0 * tpb / nullif(dnb, 0)::DOUBLE',
          'reward_mean_difference': 'gain / n', 'f1_diff_ci_lower': 'fl', 'f1_diff_ci_upper': 'fu', 'reward_diff_ci_lower': 'gl', 'reward_diff_ci_upper': 'gu'}, 9)},
      ba_only AS baseline_only_correct, po_only AS policy_only_correct, nf AS f1_valid_replicates FROM pt JOIN bd USING (policy)""", **_PAIR))
def paired_policies(spark, folder):
    return rounded(bootstrap.paired_differences(tables.policies(spark, folder), BASELINE_POLICY, ["fold", "run_id"], 2000), 9)


@R.add("h14_mcnemar", oracle("""SELECT policy, run_id, a AS policy_only_correct, b AS baseline_only_correct, round(1e-9 + CASE WHEN a = b THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE,
      2 * list_sum(list_transform(range(0, least(a, b) + 1), lambda k: exp(lgamma(a + b + 1) - lgamma(k + 1) - lgamma(a + b - k + 1) - (a + b) * ln(2.0::DOUBLE))))) END, 6) + 0.0 AS mcnemar_exact_p FROM
      (SELECT policy, run_id, count(*) FILTER (prediction = label AND bp <> label) AS a, count(*) FILTER (bp = label AND prediction <> label) AS b FROM pr GROUP BY policy, run_id)""", **_PAIR))
def mcnemar(spark, folder):
    rows = bootstrap.paired_rows(tables.policies(spark, folder), BASELINE_POLICY)
    y, a, b = F.col("label"), F.col("prediction"), F.col("base_prediction")
    counts = rows.groupBy("policy", "run_id").agg(
        F.count_if((a == y) & (b != y)).alias("policy_only_correct"), F.count_if((b == y) & (a != y)).alias("baseline_only_correct"))
    return rounded(bootstrap.with_mcnemar(counts))


@R.add("h21_policy_summary", oracle(f"""SELECT policy, tn, fp, fn, tp, tn + fp + fn + tp AS n, {sql_round({**RATIO_SQL, 'roc_auc': 'roc_auc', 'pr_auc': 'pr_auc',
      'reward': 'rw', 'reward_mean': 'rm', 'policy_agreement_with_baseline': 'ag', 'agreement_final_fold': 'al'}, 9)}, {REASONS_SQL}, mc AS mitigation_count, nc AS no_action_count,
      dis AS disagreement_count, ab AS abstention_count FROM c JOIN ar USING (policy) JOIN g USING (policy)""",
      **_hist("policy", "po"), c=f"SELECT policy, {COUNTS_SQL} FROM po GROUP BY policy", bl=_PAIR["bl"],
      g=f"""SELECT policy, {UTILITY_SQL} AS rw, {UTILITY_SQL} / count(*) AS rm, count(*) FILTER (prediction = 1) AS mc,
        count(*) FILTER (prediction = 0) AS nc, avg(CASE WHEN prediction = bp THEN 1.0 ELSE 0.0 END) AS ag, count(*) FILTER (prediction <> bp) AS dis,
        avg(CASE WHEN fold = 3 THEN CASE WHEN prediction = bp THEN 1.0 ELSE 0.0 END END) AS al, CAST(sum(abstained) AS BIGINT) AS ab
        FROM po JOIN bl USING (fold, row_id) GROUP BY policy"""))
def policy_summary(spark, folder):
    return rounded(summaries.policy_summary(tables.policies(spark, folder), BASELINE_POLICY), 9)


@R.add("c14_action_distribution", oracle("""SELECT policy, count(*) FILTER (action = 'NONE') AS action_none, count(*) FILTER (action = 'RATE_LIMIT') AS action_rate_limit,
      CAST(sum(abstained) AS BIGINT) AS abstention_count FROM po GROUP BY policy"""))
def action_distribution(spark, folder):
    return summaries.action_distribution(tables.policies(spark, folder), ["NONE", "RATE_LIMIT"])


@R.add("h22_action_levels", oracle(f"""SELECT dataset, tn, fp, fn, tp, {sql_round({
      'accuracy': ZERO_SQL['accuracy'], 'precision': ZERO_SQL['precision'], 'recall': ZERO_SQL['recall'], 'f1': ZERO_SQL['f1'], 'reward': 'rw',
      'unsafe_action_rate': 'us / greatest(bn, 1)::DOUBLE', 'benign_damage': 'dm / greatest(bn, 1)::DOUBLE', 'selector_override_rate': 'ovr', 'policy_agreement_with_baseline': 'agr'})},
      a0 AS actions_0, a1 AS actions_1, a2 AS actions_2 FROM q""",
      lv="""SELECT *, CASE WHEN s2 >= 0.9::DOUBLE THEN 2 WHEN s2 >= 0.3::DOUBLE THEN 1 ELSE 0 END AS a, CASE WHEN probability >= 0.9::DOUBLE THEN 2 WHEN probability >= 0.3::DOUBLE THEN 1 ELSE 0 END AS b
        FROM (SELECT *, sqrt(probability) AS s2 FROM sc)""",
      q="""SELECT dataset, count(*) FILTER (label = 0 AND s2 < 0.3::DOUBLE) AS tn, count(*) FILTER (label = 0 AND s2 >= 0.3::DOUBLE) AS fp, count(*) FILTER (label = 1 AND s2 < 0.3::DOUBLE) AS fn,
        count(*) FILTER (label = 1 AND s2 >= 0.3::DOUBLE) AS tp, sum(CASE WHEN label = 1 AND a > 0 THEN 2.0::DOUBLE WHEN label = 1 THEN -2.0::DOUBLE WHEN a > 0 THEN -1.25::DOUBLE ELSE 0.2::DOUBLE END) AS rw,
        count(*) FILTER (label = 0 AND a >= 2) AS us, count(*) FILTER (label = 0 AND a > 0) AS dm, count(*) FILTER (label = 0) AS bn,
        avg(CASE WHEN a <> b THEN 1.0 ELSE 0.0 END) AS ovr, avg(CASE WHEN (s2 >= 0.3::DOUBLE) = (probability >= 0.3::DOUBLE) THEN 1.0 ELSE 0.0 END) AS agr,
        count(*) FILTER (a = 0) AS a0, count(*) FILTER (a = 1) AS a1, count(*) FILTER (a = 2) AS a2 FROM lv GROUP BY dataset"""))
def action_levels(spark, folder):
    s = tables.scores(spark, folder).withColumn("baseline", F.col("probability")).withColumn("probability", F.sqrt("probability"))
    return rounded(metrics.action_metrics(s, ["dataset"], 0.3))


@R.add("h24_stress_table", oracle(f"""SELECT switch_id, count(*) FILTER (label = 0 AND prediction = 1) AS false_mitigation_count,
      {sql_round({'benign_damage_rate': 'count(*) FILTER (label = 0 AND prediction = 1) / greatest(count(*) FILTER (label = 0), 1)::DOUBLE',
                  'latency': 'quantile_cont(lat, 0.9)', 'recovery_time': 'quantile_cont(lat, 0.9) FILTER (prediction = 0)', 'throughput': 'avg(byte_rate * 8 / 1000000)'})}
      FROM (SELECT *, CASE WHEN pkt_sum > 300 THEN 1 ELSE 0 END AS prediction, pkt_rate * 0.005::DOUBLE + flow_rate * 0.09::DOUBLE + 12 AS lat FROM wf) GROUP BY switch_id"""))
def stress_table(spark, folder):
    w = windows.switch_windows(tables.events(spark, folder), WINDOW).withColumn("prediction", (F.col("pkt_sum") > 300).cast("int"))
    return rounded(metrics.stress_table(w, ["switch_id"], F.col("pkt_rate") * 0.005 + F.col("flow_rate") * 0.09 + 12.0))


# ---- trials -----------------------------------------------------------------------------------

_TRIAL = {
    "pv": """SELECT a.*, coalesce(b.next_target, '') AS preceding_target FROM ti a LEFT JOIN ti b ON a.dataset = b.dataset AND a.seed = b.seed
      AND a.setting = b.setting AND a.window_index = b.window_index + 1""",
    "rl": """SELECT pv.*, CASE WHEN x.source_ip IS NULL THEN 0 ELSE 1 END AS benign_target_selected, CASE WHEN y.source_ip IS NULL THEN 0 ELSE 1 END AS follows
      FROM pv LEFT JOIN (SELECT * FROM tr WHERE is_attacker = 0) x ON next_target = x.source_ip LEFT JOIN (SELECT * FROM tr WHERE is_attacker = 0) y ON preceding_target = y.source_ip""",
    "tt": f"""SELECT dataset, seed, setting, {COUNTS_SQL}, CAST(sum(benign_target_selected) AS BIGINT) AS bts, avg(benign_target_selected) AS btr, count(*) FILTER (follows = 1) AS fw,
      count(*) FILTER (follows = 1 AND benign_loss_percent > 0) AS fwl, count(*) FILTER (benign_receiver_mbps IS NULL) AS miss, avg(benign_receiver_mbps) AS m1, avg(benign_loss_percent) AS m2,
      avg(attack_receiver_mbps) FILTER (label = 1) AS m3, avg(benign_loss_percent) FILTER (phase = 'recovery') AS m4 FROM rl GROUP BY dataset, seed, setting""",
    "tm": f"""SELECT dataset, seed, setting, tn, fp, fn, tp, tn + fp + fn + tp AS windows, {', '.join(f'{RATIO_SQL[m]} AS {m}' for m in ('accuracy', 'precision', 'recall', 'f1'))},
      {RATIO_SQL['fpr']} AS window_false_positive_rate, bts AS benign_target_selections, btr AS benign_target_selection_rate, fw AS following_windows,
      fwl AS following_windows_with_measured_loss, miss AS missing_benign_measurements, m1 AS mean_benign_receiver_mbps, m2 AS mean_benign_loss_percent,
      m3 AS mean_attack_receiver_mbps, m4 AS recovery_benign_loss_percent FROM tt""",
}
_TRIAL_COUNTS = ["tn", "fp", "fn", "tp", "windows", "benign_target_selections", "following_windows", "following_windows_with_measured_loss", "missing_benign_measurements"]


def _roles(spark, folder):
    return summaries.with_target_roles(tables.trials(spark, folder), tables.truth(spark, folder))


def _trials(spark, folder):
    return summaries.trial_table(_roles(spark, folder))


@R.add("d3_preceding_target", oracle("SELECT dataset, seed, setting, window_index, next_target, preceding_target FROM pv", **_TRIAL))
def preceding_target(spark, folder):
    return summaries.previous_target(tables.trials(spark, folder)).select(
        "dataset", "seed", "setting", "window_index", "next_target", "preceding_target")


@R.add("c17_trial_metrics", oracle(f"SELECT dataset, seed, setting, {', '.join(_TRIAL_COUNTS)}, {sql_round({m: m for m in summaries.TRIAL_METRICS})} FROM tm", **_TRIAL))
def trial_metrics(spark, folder):
    return rounded(_trials(spark, folder))


@R.add("c18_dataset_totals", oracle("""SELECT dataset, count(*) AS windows, CAST(sum(benign_target_selected) AS BIGINT) AS benign_target_selections,
      count(*) FILTER (follows = 1 AND benign_loss_percent > 0) AS subsequent_windows_with_loss, count(*) FILTER (benign_receiver_mbps IS NULL) AS unavailable_benign_measurements,
      bool_or(setting = 'mitigation_disabled') AS has_no_mitigation_reference FROM rl GROUP BY dataset""", **_TRIAL))
def dataset_totals(spark, folder):
    return summaries.dataset_totals(_roles(spark, folder))


_LONG = melt("tm", "dataset, seed, setting", summaries.TRIAL_METRICS)
_DIFF = """SELECT a.dataset, a.seed, a.metric, 'audit_enabled minus audit_disabled' AS comparison, a.v - b.v AS v FROM lg a JOIN lg b ON a.dataset = b.dataset AND a.seed = b.seed
        AND a.metric = b.metric WHERE a.setting = 'audit_enabled' AND b.setting = 'audit_disabled'
      UNION ALL SELECT a.dataset, a.seed, a.metric, 'audit_disabled minus mitigation_disabled', a.v - b.v FROM lg a JOIN lg b ON a.dataset = b.dataset AND a.seed = b.seed
        AND a.metric = b.metric WHERE a.setting = 'audit_disabled' AND b.setting = 'mitigation_disabled'
      UNION ALL SELECT a.dataset, a.seed, a.metric, 'audit_enabled minus mitigation_disabled', a.v - b.v FROM lg a JOIN lg b ON a.dataset = b.dataset AND a.seed = b.seed
        AND a.metric = b.metric WHERE a.setting = 'audit_enabled' AND b.setting = 'mitigation_disabled'"""


def _summary_sql(source: str, keys: str, replicates: int, seed: int, cte: dict[str, str]) -> str:
    return oracle(f"""SELECT {keys}, {sql_round({c: c for c in ('mean', 'std', 'median', 'minimum', 'maximum')})}, st.n,
      {sql_round({'ci_lower_95': 'CASE WHEN st.n > 1 THEN lo END', 'ci_upper_95': 'CASE WHEN st.n > 1 THEN hi END'})}, undefined_trials
      FROM st LEFT JOIN bd USING ({keys})""",
      **cte, **_boot_cte("ok", keys, "seed", replicates, seed, "any_value(v) AS v"),
      ok=f"SELECT * FROM {source} WHERE v IS NOT NULL",
      st=f"""SELECT {keys}, count(v) AS n, avg(v) AS mean, CASE WHEN count(v) > 1 THEN stddev_samp(v) END AS std, quantile_cont(v, 0.5) AS median, min(v) AS minimum,
        max(v) AS maximum, count(*) FILTER (v IS NULL) AS undefined_trials FROM {source} GROUP BY {keys}""",
      bd=f"""SELECT {keys}, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM
        (SELECT {keys}, r, avg(v) AS m FROM dr JOIN nb USING ({keys}, i) GROUP BY {keys}, r) GROUP BY {keys}""")


def _long_trials(spark, folder):
    return summaries.unpivot(_trials(spark, folder), ["dataset", "seed", "setting"], summaries.TRIAL_METRICS)


@R.add("h17_trial_summary", _summary_sql("lg", "dataset, setting, metric", 2000, 20261002, {**_TRIAL, "lg": _LONG}))
def trial_summary(spark, folder):
    return rounded(bootstrap.mean_summary(_long_trials(spark, folder), ["dataset", "setting", "metric"], ["seed"], "value"))


@R.add("h17_paired_settings", _summary_sql("df", "dataset, comparison, metric", 2000, 20261002, {**_TRIAL, "lg": _LONG, "df": _DIFF}))
def paired_settings(spark, folder):
    gaps = summaries.setting_differences(_trials(spark, folder), summaries.TRIAL_METRICS)
    return rounded(bootstrap.mean_summary(gaps, ["dataset", "comparison", "metric"], ["seed"], "difference"))


@R.add("h18_audit_difference", _summary_sql("ad", "dataset, comparison, metric", 5000, 20261010, {
      **_TRIAL, "lg": _LONG, "df": _DIFF, "ad": "SELECT * FROM df WHERE comparison = 'audit_enabled minus audit_disabled'"}))
def audit_difference(spark, folder):
    gaps = summaries.setting_differences(_trials(spark, folder), summaries.TRIAL_METRICS).filter("comparison = 'audit_enabled minus audit_disabled'")
    return rounded(bootstrap.mean_summary(gaps, ["dataset", "comparison", "metric"], ["seed"], "difference", 5000, 20261010))


@R.add("h18_trial_table", _summary_sql("lg", "dataset, setting, metric", 5000, 20261010, {**_TRIAL, "lg": _LONG}))
def trial_table(spark, folder):
    return rounded(bootstrap.mean_summary(_long_trials(spark, folder), ["dataset", "setting", "metric"], ["seed"], "value", 5000, 20261010))


def _t_table() -> str:
    """Student-t 97.5 % points by integrating the density, independent of the library's own routine."""
    import math

    def cdf(t: float, v: int) -> float:
        c = math.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2)) / math.sqrt(v * math.pi)
        steps = 2000
        h = t / steps
        f = lambda x: c * (1 + x * x / v) ** (-(v + 1) / 2)
        return 0.5 + h / 3 * (f(0) + f(t) + 4 * sum(f((2 * i + 1) * h) for i in range(steps // 2)) + 2 * sum(f(2 * i * h) for i in range(1, steps // 2)))

    rows = []
    for v in range(1, 16):
        low, high = 0.0, 20.0
        for _ in range(45):
            mid = (low + high) / 2
            low, high = (mid, high) if cdf(mid, v) < 0.975 else (low, mid)
        rows.append(f"({v}, {low!r}::DOUBLE)")
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") t(dof, q)"


def _student_sql(source: str, keys: str, cte: dict[str, str]) -> str:
    return oracle(f"""SELECT {keys}, st.n, undefined_trials, {sql_round({c: c for c in ('mean', 'std', 'median', 'minimum', 'maximum')})},
      {sql_round({'ci_lower': 'mean - q * std / sqrt(st.n)', 'ci_upper': 'mean + q * std / sqrt(st.n)'})} FROM st LEFT JOIN tq ON tq.dof = st.n - 1""",
      **cte, tq=_t_table(),
      st=f"""SELECT {keys}, count(v) AS n, avg(v) AS mean, CASE WHEN count(v) > 1 THEN stddev_samp(v) END AS std, quantile_cont(v, 0.5) AS median, min(v) AS minimum,
        max(v) AS maximum, count(*) FILTER (v IS NULL) AS undefined_trials FROM {source} GROUP BY {keys}""")


@R.add("h15_student_summary", _student_sql("lg", "dataset, setting, metric", {**_TRIAL, "lg": _LONG}))
def student_summary(spark, folder):
    return rounded(summaries.student_summary(_long_trials(spark, folder), ["dataset", "setting", "metric"]))


@R.add("h16_paired_student", _student_sql("df", "dataset, comparison, metric", {**_TRIAL, "lg": _LONG, "df": _DIFF}))
def paired_student(spark, folder):
    gaps = summaries.setting_differences(_trials(spark, folder), summaries.TRIAL_METRICS)
    return rounded(summaries.student_summary(gaps, ["dataset", "comparison", "metric"], "difference"))


@R.add("h19_normal_interval", oracle(f"""SELECT dataset, setting, metric, {sql_round({'mean': 'avg(v)', 'std': 'CASE WHEN count(v) > 1 THEN stddev_samp(v) ELSE 0 END',
      'ci95': 'CASE WHEN count(v) > 1 THEN 1.96::DOUBLE * stddev_samp(v) / sqrt(count(v)) ELSE 0 END'})} FROM lg GROUP BY dataset, setting, metric""", **_TRIAL, lg=_LONG))
def normal_interval(spark, folder):
    return rounded(summaries.normal_interval(_long_trials(spark, folder), ["dataset", "setting", "metric"]))


@R.add("g8_setting_pivot", oracle(f"""SELECT dataset, seed, metric, {sql_round({s: f"max(v) FILTER (setting = '{s}')" for s in ('audit_disabled', 'audit_enabled', 'mitigation_disabled')})}
      FROM lg GROUP BY dataset, seed, metric""", **_TRIAL, lg=_LONG))
def setting_pivot(spark, folder):
    return rounded(_long_trials(spark, folder).groupBy("dataset", "seed", "metric").pivot(
        "setting", ["audit_disabled", "audit_enabled", "mitigation_disabled"]).agg(F.first("value")))


@R.add("g9_metric_unpivot", oracle("SELECT dataset, seed, setting, metric, round(v + 1e-9, 6) + 0.0 AS value FROM lg", **_TRIAL, lg=_LONG))
def metric_unpivot(spark, folder):
    return rounded(_long_trials(spark, folder))


@R.add("f3_schedule_mismatches", oracle("""SELECT dataset, seed, window_index, CASE WHEN a IS NULL THEN 'missing_left' WHEN b IS NULL THEN 'missing_right' ELSE 'changed' END AS status
      FROM (SELECT dataset, seed, window_index, any_value(k) FILTER (setting = 'audit_enabled') AS a, any_value(k) FILTER (setting = 'audit_disabled') AS b
        FROM (SELECT *, phase || '|' || label || '|' || scheduled_attackers AS k FROM bent) GROUP BY ALL) WHERE a IS DISTINCT FROM b""",
      bent="""SELECT * REPLACE (CASE WHEN setting = 'audit_enabled' AND seed = 3 AND window_index = 2 THEN 1 - label ELSE label END AS label) FROM ti
        WHERE NOT (setting = 'audit_disabled' AND seed = 5 AND window_index < 2)"""))
def schedule_mismatches(spark, folder):
    t = tables.trials(spark, folder)
    hit = (F.col("setting") == "audit_enabled") & (F.col("seed") == 3) & (F.col("window_index") == 2)
    bent = t.withColumn("label", F.when(hit, 1 - F.col("label")).otherwise(F.col("label"))).filter(
        ~((F.col("setting") == "audit_disabled") & (F.col("seed") == 5) & (F.col("window_index") < 2)))
    return summaries.schedule_mismatches(bent, "audit_enabled", "audit_disabled")


@R.add("f2_metrics_with_intervals", oracle(f"""SELECT c.*, {sql_round({f'{m}_ci_{s}': f"(SELECT {q} FROM bo WHERE bo.dataset = c.dataset AND bo.metric = '{m}')" for m in ('f1', 'recall') for s, q in (('lower', 'lo'), ('upper', 'hi'))})}
      FROM c""", c=f"SELECT dataset, {COUNTS_SQL} FROM sc GROUP BY dataset",
      **_boot_cte("sc", "dataset", "run_id", 2000, 20260928, COUNTS_SQL),
      rs="SELECT dataset, r, sum(tn) AS tn, sum(fp) AS fp, sum(fn) AS fn, sum(tp) AS tp FROM dr JOIN nb USING (dataset, i) GROUP BY dataset, r",
      bo=f"""SELECT dataset, metric, quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi FROM (
        SELECT dataset, 'f1' AS metric, {ZERO_SQL['f1']} AS v FROM rs UNION ALL SELECT dataset, 'recall', {ZERO_SQL['recall']} FROM rs) GROUP BY dataset, metric"""))
def metrics_with_intervals(spark, folder):
    s = tables.scores(spark, folder)
    bounds = bootstrap.block_intervals(s, ["dataset"], ["run_id"], 2000)
    return rounded(summaries.with_intervals(metrics.confusion(s, ["dataset"]), bounds, ["dataset"], ["f1", "recall"]))


@R.add("c10_feature_profile", oracle(f"""SELECT switch_id, label, feature, count(*) AS n, {sql_round({'minimum': 'min(v)', 'median': 'quantile_cont(v, 0.5)', 'maximum': 'max(v)'})}
      FROM (SELECT switch_id, label, metric AS feature, v FROM ({melt('wf', 'switch_id, label', FEATURES)})) GROUP BY switch_id, label, feature"""))
def feature_profile(spark, folder):
    w = windows.switch_windows(tables.events(spark, folder), WINDOW)
    return rounded(summaries.feature_profile(w, ["switch_id", "label"], FEATURES))


@R.add("h20_feature_shift", oracle(f"""SELECT feature, {sql_round({'offline_mean': 'm0', 'offline_std': 's0', 'live_mean': 'm1', 'live_std': 's1', 'mean_delta': 'm1 - m0',
      'standardized_mean_delta': 'coalesce((m1 - m0) / nullif(sqrt((s0 * s0 + s1 * s1) / 2), 0), 0)'})}
      FROM (SELECT feature, avg(v) FILTER (switch_id = 'sw0') AS m0, stddev_pop(v) FILTER (switch_id = 'sw0') AS s0, avg(v) FILTER (switch_id = 'sw1') AS m1, stddev_pop(v) FILTER (switch_id = 'sw1') AS s1
      FROM (SELECT switch_id, metric AS feature, v FROM ({melt('wf', 'switch_id', FEATURES)})) GROUP BY feature)"""))
def feature_shift(spark, folder):
    w = windows.switch_windows(tables.events(spark, folder), WINDOW)
    return rounded(summaries.feature_shift(w.filter("switch_id = 'sw0'"), w.filter("switch_id = 'sw1'"), FEATURES))


@R.add("c16_latency_percentiles", oracle(f"""SELECT dataset, setting, count(inference_latency_ms) AS n, {sql_round({f'p{p}_ms': f'quantile_cont(inference_latency_ms, {p / 100})' for p in (50, 90, 99)})}
      FROM ti GROUP BY dataset, setting"""))
def latency_percentiles(spark, folder):
    return rounded(summaries.latency_percentiles(tables.trials(spark, folder), ["dataset", "setting"], "inference_latency_ms"))


@R.add("c16_latency_percentiles_by_source", oracle(f"""SELECT src_ip, count(*) AS n, {sql_round({f'p{p}_ms': f'quantile_cont(byte_count, {p / 100})' for p in (50, 90, 99)})} FROM ev GROUP BY src_ip"""))
def latency_percentiles_by_source(spark, folder):
    return rounded(summaries.latency_percentiles(tables.events(spark, folder), ["src_ip"], "byte_count"))


_BLOCKS = """SELECT dataset, fold, count(DISTINCT run_id) AS sources, count(*) AS n, count(*) FILTER (label = 1) AS positive_windows,
      count(*) FILTER (label = 0) AS negative_windows FROM sc GROUP BY dataset, fold"""


@R.add("c13_block_map", oracle("SELECT * FROM bm", bm=_BLOCKS))
def block_map(spark, folder):
    return summaries.block_map(tables.scores(spark, folder), ["dataset"], "fold", "label", "run_id")


@R.add("c13_block_sources", oracle("SELECT DISTINCT dataset, fold, run_id FROM sc"))
def block_sources(spark, folder):
    return summaries.block_sources(tables.scores(spark, folder), ["dataset"], "fold", "run_id")


@R.add("c13_block_support", oracle("SELECT dataset, count(*) AS blocks, count(*) FILTER (positive_windows > 0) AS positive_blocks, CAST(sum(n) AS BIGINT) AS n FROM bm GROUP BY dataset", bm=_BLOCKS))
def block_support(spark, folder):
    return summaries.block_support(summaries.block_map(tables.scores(spark, folder), ["dataset"], "fold", "label", "run_id"), ["dataset"])


@R.add("f4_policy_vs_baseline", oracle("SELECT policy, fold, row_id, label, prediction, bp AS base_prediction FROM pr", **_PAIR))
def policy_vs_baseline(spark, folder):
    return bootstrap.paired_rows(tables.policies(spark, folder), BASELINE_POLICY).select(
        "policy", "fold", "row_id", "label", "prediction", "base_prediction")


QUERIES, ORACLES = R.queries, R.oracles
