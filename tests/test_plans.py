"""Shape of the physical plans: pruned scans, no Python, no single-task windows."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from flowsieve.operators import curves, gate, windows
from flowsieve.plans import tables
from flowsieve.schemas import FEATURES

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "5000")
    return df._jdf.queryExecution().executedPlan().toString()


def test_windows_prune_columns_and_combine_before_shuffles(spark):
    text = plan(windows.flow_windows(tables.line_flows(spark, FOLDER), 604800))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert schemas and all("l_tax" not in s and "l_orderkey" not in s for s in schemas)
    assert "Python" not in text and "Pandas" not in text
    assert text.count("partial_sum") >= 4


@pytest.mark.parametrize("build", [
    lambda s: windows.switch_windows(tables.events(s, FOLDER), 10800),
    lambda s: windows.running_features(tables.events(s, FOLDER), 10800),
    lambda s: gate.select_sources(tables.gate_windows(s, FOLDER), tables.observations(s, FOLDER), gate.GatePolicy(1.0, 2)),
    lambda s: curves.threshold_curve(tables.policies(s, FOLDER), ["policy"]),
])
def test_no_python_no_cross_join_no_single_partition(spark, build):
    text = plan(build(spark))
    assert "Python" not in text and "Pandas" not in text and "CartesianProduct" not in text and "NestedLoop" not in text
    assert "SinglePartition" not in text


FEATURE_BUILDS = {
    "flows": (lambda s: windows.flow_windows(tables.table(s, FOLDER, "lineitem").select(
        F.lit("d").alias("dataset_id"), F.lit("s").alias("scenario_id"), "l_linestatus", F.col("l_linestatus").alias("source_file"), F.unix_timestamp("l_shipdate").cast("double").alias("ts_epoch"),
        F.col("l_quantity").alias("packets"), F.col("l_extendedprice").alias("bytes"), F.col("l_suppkey").cast("string").alias("src"), F.col("l_tax").alias("is_attack"),
        F.col("l_discount").alias("is_target"), F.col("l_orderkey").alias("is_other"), F.col("l_returnflag").alias("label_text"), F.lit("unix_utc").alias("timestamp_basis")), 604800),
        {"l_tax", "l_discount", "l_orderkey", "l_returnflag"}, 2),
    "switches": (lambda s: windows.switch_windows(tables.table(s, FOLDER, "lineitem").select(
        F.col("l_linestatus").alias("run_id"), F.col("l_shipdate").cast("timestamp").alias("event_ts"), F.col("l_linenumber").cast("string").alias("switch_id"), F.col("l_linestatus").alias("dst_ip"),
        F.col("l_suppkey").cast("string").alias("src_ip"), F.col("l_quantity").cast("bigint").alias("packet_count"), F.col("l_extendedprice").cast("bigint").alias("byte_count"),
        F.lit(1).alias("flow_count"), F.col("l_tax").alias("label"), F.col("l_returnflag").alias("scenario_id")), 604800), {"l_tax", "l_returnflag"}, 1),
}


@pytest.mark.parametrize("kind", FEATURE_BUILDS)
def test_one_wide_shuffle_and_features_without_labels(spark, kind):
    build, label_columns, scans = FEATURE_BUILDS[kind]
    whole = build(spark)
    text = plan(whole)
    read = lambda df: [set(re.findall(r"(\w+):", s)) for s in re.findall(r"ReadSchema: struct<([^>]*)>", plan(df))]
    found = read(whole)
    assert len(found) == scans and label_columns <= set().union(*found)
    # the source, the wide key, is shuffled once; label texts come from a scan of their own that reads neither it nor a measure
    assert len([s for s in found if "l_suppkey" in s]) == 1 and len(re.findall(r"Exchange hashpartitioning\([^)]*src", text)) == 1
    # with the labels projected away their columns are not read beside the features
    assert not label_columns & next(s for s in read(whole.select(*FEATURES)) if "l_suppkey" in s)
