from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from flowsieve.functions import cleaning
from flowsieve.operators import windows
from flowsieve.schemas import FEATURES, FLOW, WINDOW_COLUMNS
from flowsieve.sources import external, records


def flow(ts, packets, size, src, attack=0, target=0, other=0, text="benign", file="one", scenario="s"):
    return ("d", scenario, file, float(ts), float(packets), float(size), src, attack, target, other, text, "unix_utc")


ORDERED = [flow(1, 2, 20, "a"), flow(6, 9, 90, "c"), flow(2, 3, 30, "b", 1, 1, 0, "ddos"), flow(3, 4, 40, "a")]


def build(spark, data, **kw):
    return windows.flow_windows(spark.createDataFrame(data, FLOW), 5, **kw)


def test_two_windows_and_entropy(spark, rows):
    out = rows(build(spark, ORDERED), "window_start_epoch")
    first, second = out
    assert (first["events"], first["pkt_sum"], first["unique_src"], first["label"]) == (3, 9.0, 2, 1)
    assert first["src_ip_entropy"] == pytest.approx(-(2 / 3) * math.log2(2 / 3) - (1 / 3) * math.log2(1 / 3))
    assert first["label_types"] == "benign;ddos" and first["attack_fraction"] == pytest.approx(1 / 3)
    assert first["window_start_ts"] == "1970-01-01T00:00:00Z" and second["window_end_ts"] == "1970-01-01T00:00:10Z"
    assert (second["events"], second["src_ip_entropy"], second["label"]) == (1, 0.0, 0)
    assert build(spark, ORDERED).columns == WINDOW_COLUMNS


@pytest.mark.parametrize("seed", [1, 2])
def test_row_order_and_partitions_do_not_matter(spark, rows, seed):
    data = ORDERED * 3
    random.Random(seed).shuffle(data)
    shuffled = windows.flow_windows(spark.createDataFrame(data, FLOW).repartition(5), 5)
    assert rows(shuffled, "window_start_epoch") == rows(build(spark, ORDERED * 3), "window_start_epoch")


def test_sources_stay_separate_unless_merged(spark):
    data = [flow(1, 1, 1, "a", file="one"), flow(2, 1, 1, "a", file="two")]
    assert build(spark, data).count() == 2
    merged = build(spark, data, merge_files=True).first()
    assert merged["events"] == 2 and merged["source_file"].startswith("multiple_scenario_logs")


def test_labels_never_reach_features(spark, rows):
    flipped = [(*r[:7], 1 - r[7], 1 - r[8], r[9], "x", r[11]) for r in ORDERED]
    keep = ["window_start_epoch", *FEATURES]
    assert rows(build(spark, ORDERED).select(*keep), "window_start_epoch") == rows(build(spark, flipped).select(*keep), "window_start_epoch")


def test_missing_sources_count_for_traffic_only(spark):
    out = build(spark, [flow(1, 1, 1, ""), flow(1, 1, 1, "-"), flow(1, 1, 1, "a"), flow(2, 1, 1, "b")]).first()
    assert (out["events"], out["unique_src"], out["src_ip_entropy"]) == (4, 2, 1.0)
    empty = build(spark, [flow(1, 1, 1, "-")]).first()
    assert (empty["unique_src"], empty["src_ip_entropy"]) == (0, 0.0)


def test_ineligible_windows(spark):
    out = build(spark, [flow(1, 1, 1, "a", 1, 0, 1, "scan"), flow(2, 1, 1, "a", 1, 1, 0, "ddos")]).first()
    assert (out["label"], out["target_label"], out["target_eligible"]) == (1, 1, 0)


def test_reversal_opens_a_segment(spark):
    data = [("f", 1, 1.0), ("f", 2, 5.0), ("f", 3, 4.0), ("f", 4, 6.0), ("f", 5, 2.0), ("g", 1, 9.0), ("g", 2, 9.0)]
    out = windows.reversal_segments(spark.createDataFrame(data, "source_file string, position int, ts_epoch double"))
    assert {(r.source_file, r.position): r.segment_id for r in out.collect()} == {
        ("f", 1): 0, ("f", 2): 0, ("f", 3): 1, ("f", 4): 1, ("f", 5): 2, ("g", 1): 0, ("g", 2): 0}


def test_day_first_dates(spark):
    cases = {
        "2018-12-01 10:51:39.813448": "2018-12-01 10:51:39.813448", "01/12/2018 10:51": "2018-12-01 10:51:00",
        "13/12/2018 10:51:02": "2018-12-13 10:51:02", "12/13/2018 10:51:02": "2018-12-13 10:51:02", "3/7/2018 8:55:58 AM": "2018-07-03 08:55:58",
        "2018-12-01": "2018-12-01 00:00:00", "2018/12/01 1:02": "2018-12-01 01:02:00", "1-12-2018 10:00": "2018-12-01 10:00:00",
        "20181201": "2018-12-01 00:00:00", "07/03/2018 01:02:03.5": "2018-03-07 01:02:03.5", "abc": None, "": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    found = df.select("t", cleaning.day_first_timestamp(F.col("t")).cast("string").alias("v")).collect()
    assert {r.t: r.v for r in found} == cases


def test_cic_files(spark, tmp_path):
    folder = tmp_path / "CSVs" / "Day-01"
    folder.mkdir(parents=True)
    (folder / "DrDoS DNS.csv").write_text(
        "Flow ID, Source IP, Timestamp, Total Fwd Packets, Total Backward Packets,Total Length of Fwd Packets, Total Length of Bwd Packets, Label\n"
        "1,10.0.0.1,2018-12-01 10:00:01,2,3,100,50,BENIGN\n"
        "2,10.0.0.2,01/12/2018 10:00,Infinity,1,abc,,DrDoS_DNS\n"
        "3,,not a time,1,1,1,1,DrDoS_DNS\n"
        "4,10.0.0.3,2018-12-01 10:00:02,-4,1,10,10, Syn \n")
    flows = external.read_cic(spark, str(tmp_path / "CSVs"))
    out = {r.src: r for r in flows.collect()}
    assert (out["10.0.0.1"].packets, out["10.0.0.1"].bytes, out["10.0.0.1"].is_attack) == (5.0, 150.0, 0)
    assert (out["10.0.0.2"].packets, out["10.0.0.2"].bytes, out["10.0.0.2"].bad_numbers) == (1.0, 0.0, 2)
    assert (out["10.0.0.3"].packets, out["10.0.0.3"].label_text, out["10.0.0.3"].bad_numbers) == (1.0, "Syn", 0)
    assert out[""].ts_epoch is None and out["10.0.0.1"].scenario_id == "day_01_drdos_dns"
    assert out["10.0.0.1"].source_file == "Day-01/DrDoS DNS.csv"
    stats = windows.ingest_statistics(flows).first()
    assert (stats.raw_rows, stats.dropped_bad_timestamps, stats.numeric_coercions) == (4, 1, 2)
    assert external.usable(flows).count() == 3


def test_header_mismatch_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ts,src_ip\n1,a\n")
    (tmp_path / "b.csv").write_text("src_ip,ts\nb,2\n")
    with pytest.raises(Exception):
        external.pruned_csv(spark, str(tmp_path), ["ts", "src_ip"]).collect()


def zeek_line(**kw):
    fields = ["x"] * 21
    for name, value in {"ts": "10.5", "src": "1.1.1.1", "orig_bytes": "7", "resp_bytes": "5", "orig_pkts": "2", "orig_ip_bytes": "0",
                        "resp_pkts": "-", "resp_ip_bytes": "0", "tail": "-   Malicious   DDoS", **kw}.items():
        fields[external.ZEEK[name]] = value
    return "\t".join(fields)


def test_zeek_lines(spark, tmp_path):
    folder = tmp_path / "Capture-1" / "bro"
    folder.mkdir(parents=True)
    (folder / "conn.log.labeled").write_text("\n".join([
        "#fields a", zeek_line(), zeek_line(src="2.2.2.2", orig_pkts="-3", orig_ip_bytes="90", tail="-   Benign   -"), zeek_line(ts="unset", src="3.3.3.3")]) + "\n")
    out = {r.src: r for r in external.read_zeek(spark, str(tmp_path)).collect()}
    a, b = out["1.1.1.1"], out["2.2.2.2"]
    assert (a.packets, a.bytes, a.is_attack, a.is_target, a.is_other, a.label_text, a.bad_numbers) == (2.0, 12.0, 1, 1, 0, "Malicious:DDoS", 0)
    assert (b.packets, b.bytes, b.is_attack, b.label_text, b.bad_numbers) == (0.0, 90.0, 0, "Benign", 1)
    assert a.scenario_id == "Capture-1" and out["3.3.3.3"].ts_epoch is None


def test_short_zeek_line_fails(spark):
    short = spark.createDataFrame([("a\tb",)], "value string")
    with pytest.raises(Exception, match="fewer than 21"):
        external.normalize_zeek(short, F.lit("x/y/z")).collect()


def test_ton_rows(spark, tmp_path):
    (tmp_path / "Network_dataset_1.csv").write_text(
        "ts,src_ip,dst_ip,src_pkts,dst_pkts,src_ip_bytes,dst_ip_bytes,src_bytes,dst_bytes,label,type\n"
        "1,a,z,1,1,0,0,8,9,1,ddos\n2,b,z,1,1,4,0,8,9,1,scanning\n3,c,z,1,1,4,0,8,9,0,xdosx\ninf,d,z,1,1,4,0,8,9,0,dos\n")
    out = {r.src: r for r in external.read_ton(spark, str(tmp_path)).collect()}
    assert (out["a"].bytes, out["a"].is_target, out["a"].is_other, out["a"].scenario_id) == (17.0, 1, 0, "network_dataset_1")
    assert (out["b"].bytes, out["b"].is_target, out["b"].is_other) == (4.0, 0, 1)
    assert (out["c"].is_target, out["c"].is_attack) == (0, 0) and out["d"].ts_epoch is None and out["d"].is_target == 1


def test_event_aliases_and_labels(spark, tmp_path):
    (tmp_path / "e.csv").write_text("event_ts,pkt_count,source_ip,true_attack\n2024-01-01T00:00:01Z,5,a,Benign\n2024-01-01T00:00:02Z,inf,,Mirai\n")
    out = {r.src_ip: r for r in records.read_events(spark, str(tmp_path)).collect()}
    assert (out["a"].packet_count, out["a"].flow_count, out["a"].label, out["a"].run_id) == (5.0, 1.0, 0, "run_unknown")
    assert (out["nan"].packet_count, out["nan"].label) == (0.0, 1)
    with pytest.raises(ValueError, match="label"):
        records.resolve(["event_ts", "packets"])
    bad = spark.createDataFrame([("soon", "1", "0")], "event_ts string, packets string, label string")
    with pytest.raises(Exception, match="timestamp"):
        records.normalize_events(bad).collect()


def test_event_label_words(spark):
    cases = {"0": 0, "0.0": 0, "FALSE": 0, "No": 0, "-2": 0, "1": 1, "0.5": 1, "nan": 0, "Mirai": 1, None: 0}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.v for r in df.select("t", cleaning.event_label(F.col("t")).alias("v")).collect()} == cases


def test_prepared_window_tables(spark, tmp_path):
    head = "scenario_id,label," + ",".join(FEATURES)
    for name in ("one_windows", "two_windows"):
        (tmp_path / f"{name}.csv").write_text(f"{head}\ns,1," + ",".join("1" for _ in FEATURES) + "\n")
    out = records.read_window_tables(spark, str(tmp_path / "*_windows.csv"))
    assert sorted(r.dataset for r in out.collect()) == ["one_windows", "two_windows"]


def test_strict_features(spark):
    good = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    assert records.strict_features(good, ["a", "b"]).first()["b"] == 2.0
    with pytest.raises(ValueError):
        records.strict_features(good, ["b", "a"])
    with pytest.raises(Exception, match="finite"):
        records.strict_features(spark.createDataFrame([(float("nan"), 1.0)], "a double, b double"), ["a", "b"]).collect()


def test_sinks_refuse_to_overwrite(spark, tmp_path):
    out = build(spark, ORDERED)
    records.write_windows(out, str(tmp_path / "w"))
    with pytest.raises(Exception):
        records.write_windows(out, str(tmp_path / "w"))


def events(spark, data):
    return spark.createDataFrame(
        data, "event_id int, t double, run_id string, switch_id string, src_ip string, dst_ip string, packet_count bigint, byte_count bigint, flow_count bigint, label int, scenario_id string",
    ).withColumn("event_ts", F.timestamp_micros((F.col("t") * 1_000_000).cast("bigint")))


DATA = [
    (1, 100.0, "r", "w1", "a", "s1", 2, 20, 1, 0, "x"), (2, 101.0, "r", "w1", "b", "s1", 3, 30, 0, 1, "y"), (3, 102.5, "r", "w1", "a", "s1", 4, 40, 2, 0, "x"),
    (4, 103.0, "r", "w2", "a", "s1", 5, 50, 0, 0, "x"), (5, 106.0, "r", "w1", "c", "s1", 6, 60, 0, 0, "x"),
]


def test_switch_windows_and_flow_fallback(spark, rows):
    out = rows(windows.switch_windows(events(spark, DATA), 5), "window_start", "switch_id")
    assert [(r["switch_id"], r["events"], r["flow_count"], r["label"], r["scenario_id"]) for r in out] == [
        ("w1", 3, 3.0, 1, "x|y"), ("w2", 1, 1.0, 0, "x"), ("w1", 1, 1.0, 0, "x")]
    assert out[0]["row_id"] == "r|1970-01-01T00:01:40+00:00|w1|s1"


def test_last_running_row_equals_completed_window(spark, rows):
    e = events(spark, DATA)
    last = windows.running_features(e, 5).groupBy("switch_id", "dst_ip", "window_start").agg(
        F.max_by(F.struct(*FEATURES), "event_id").alias("f")).select("switch_id", "window_start", "f.*")
    done = windows.switch_windows(e, 5).select("switch_id", "window_start", *FEATURES)
    for a, b in zip(rows(last, "window_start", "switch_id"), rows(done, "window_start", "switch_id")):
        assert {k: pytest.approx(v) for k, v in a.items() if k != "switch_id"} == {k: v for k, v in b.items() if k != "switch_id"}


def test_ingest_reads_its_source_once(spark, tmp_path):
    flows = spark.createDataFrame(
        [("d", "s", "f", t, 1.0, 2.0, src, a, a, 0, "x" if a else "benign", "unix_utc", bad) for t, src, a, bad in [(1.0, "a", 0, 0), (2.0, "b", 1, 2), (7.0, "a", 0, 1), (None, "a", 1, 5), (11.0, "", 0, 0)]],
        "dataset_id string, scenario_id string, source_file string, ts_epoch double, packets double, bytes double, src string, is_attack int, is_target int, is_other int, label_text string, timestamp_basis string, bad_numbers int")
    counts = windows.ingest(flows, f"{tmp_path}/w")
    assert counts == {"raw_rows": 5, "dropped_bad_timestamps": 1, "numeric_coercions": 3, "windows": 3, "windows_label_0": 2, "windows_label_1": 1}
    assert spark.read.parquet(f"{tmp_path}/w/usable=true").count() == 3
    assert set(windows.ingest(flows.limit(0), f"{tmp_path}/e").values()) == {0}
