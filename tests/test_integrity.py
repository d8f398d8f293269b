from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from flowsieve.functions.ordering import lagged, numbered, running, sliced
from flowsieve.operators import integrity
from flowsieve.sources import records


def chain(spark, n=2, chain_id="c"):
    data = [(chain_id, i, json.dumps({"event": f"e{i}", "idx": i, "audit_written_unix": 1.5e-05})) for i in range(n)]
    return integrity.build_chains(spark.createDataFrame(data, "chain_id string, seq bigint, record string"))


def relined(spark, lines):
    return spark.createDataFrame([("c", i, t) for i, t in enumerate(lines)], "chain_id string, seq bigint, raw string")


def lines_of(spark, n=3):
    return [r.raw for r in sorted(chain(spark, n).collect(), key=lambda r: r.seq)]


def test_chain_is_valid_and_linked(spark):
    lines = [json.loads(t) for t in lines_of(spark)]
    assert lines[0]["prev_hash"] == "0" * 64 and lines[1]["prev_hash"] == lines[0]["record_hash"]
    body = json.dumps({"prev_hash": "0" * 64, "record": {"audit_written_unix": 1.5e-05, "event": "e0", "idx": 0}}, sort_keys=True, separators=(",", ":"))
    assert lines[0]["record_hash"] == hashlib.sha256(body.encode()).hexdigest()
    r = integrity.chain_report(chain(spark, 3)).first()
    assert r.valid_embedded_hash_chain and r.chain_tip == lines[2]["record_hash"] and r.records == 3


def test_changed_content_is_found(spark):
    lines = lines_of(spark)
    lines[1] = lines[1].replace('"event":"e1"', '"event":"forged"')
    r = integrity.chain_report(relined(spark, lines)).first()
    assert not r.valid_embedded_hash_chain and (r.record_hash_mismatch, r.prev_hash_mismatch) == (1, 0)


def test_broken_link_and_truncated_tail(spark):
    lines = lines_of(spark)
    r = integrity.chain_report(relined(spark, [lines[0], lines[2]])).first()
    assert (r.prev_hash_mismatch, r.record_hash_mismatch) == (1, 0)
    r = integrity.chain_report(relined(spark, [lines[0], lines[1], lines[2][:-10]])).first()
    assert r.malformed_json and r.embedded_hash_records == 2 and not r.valid_embedded_hash_chain
    back = integrity.recovered(relined(spark, [lines[0], "", lines[1], lines[2][:-10]]))
    assert integrity.chain_report(back).first().valid_embedded_hash_chain and back.count() == 2


def test_nothing_after_a_malformed_line_counts(spark):
    lines = lines_of(spark)
    r = integrity.chain_report(relined(spark, [lines[0], "{", lines[2].replace("e2", "forged")])).first()
    assert (r.embedded_hash_records, r.record_hash_mismatch, r.records) == (1, 0, 3)


def test_unhashed_records_are_not_valid(spark):
    r = integrity.chain_report(relined(spark, ['{"event":"old"}', *lines_of(spark)])).first()
    assert r.legacy_unhashed_records == 1 and not r.valid_embedded_hash_chain and r.valid_with_legacy_prefix
    r = integrity.chain_report(relined(spark, ['{"event":"old"}'])).first()
    assert not r.valid_with_legacy_prefix and r.chain_tip == "0" * 64


def test_canonical_hash_matches_python(spark):
    value = {"b": [1, 2.5, 1e-05], "a": {"z": None, "é": "ü"}}
    r = spark.createDataFrame([(json.dumps(value),)], "t string").select(
        integrity.canonical_hash("t").alias("a"), integrity.spaced_hash("t").alias("b")).first()
    assert r.a == hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert r.b == hashlib.sha256(json.dumps(value, sort_keys=True).encode()).hexdigest()


def test_fingerprints_and_manifest(spark, tmp_path, monkeypatch):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes(b"one\r\ntwo\r\n")
    (tmp_path / "sub" / "b.bin").write_bytes(b"\x00\r")
    (tmp_path / "c.txt").write_bytes(b"new")
    (tmp_path / "extra.txt").write_bytes(b"x")
    listed = records.inventory(spark, str(tmp_path))
    prints = integrity.fingerprints(listed).withColumn("name", F.regexp_extract("path", f"{tmp_path.name}/(.*)$", 1))
    got = {r.name: r for r in prints.collect()}
    assert got["a.txt"].sha256_lf == hashlib.sha256(b"one\ntwo\n").hexdigest() and got["a.txt"].bytes == 10
    assert got["sub/b.bin"].sha256 == got["sub/b.bin"].sha256_lf == hashlib.sha256(b"\x00\r").hexdigest()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    manifest = spark.createDataFrame([(f"{sha(t)}  {n}",) for n, t in [
        ("a.txt", b"one\ntwo\n"), ("sub/b.bin", b"\x00\r"), ("c.txt", b"old"), ("gone.txt", b""), ("../up.txt", b""), ("C:/x", b"")]], "line string")
    out = {r.name: r.status for r in integrity.manifest_check(integrity.manifest_lines(manifest), prints).collect()}
    assert out == {"a.txt": "ok", "sub/b.bin": "ok", "c.txt": "changed", "gone.txt": "missing", "../up.txt": "unsafe", "C:/x": "unsafe", "extra.txt": "extra"}


def test_fingerprint_of_split_line_ends(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(integrity, "BLOCK", 2)
    (tmp_path / "t.txt").write_bytes(b"a\r\nbc\r\r\n\n\r")
    frame = next(integrity._hash_stream(iter([__import__("pandas").DataFrame({"path": [str(tmp_path / "t.txt")]})])))
    lf = b"a\nbc\r\n\n\r"
    assert frame["sha256_lf"][0] == hashlib.sha256(lf).hexdigest() and frame["sha256_crlf"][0] == hashlib.sha256(lf.replace(b"\n", b"\r\n")).hexdigest()


def test_relocated_records(spark):
    df = spark.createDataFrame([("D:\\x\\col\\run\\1.json", "h")], "path string, digest string")
    assert integrity.relocated(df, "col").first().relative == "run/1.json"
    for bad in (["/a/other/1.json"], ["/col/x/col/1.json"], ["/a/col/../1.json"], ["/a/col/1.json", "/b/col/1.json"]):
        with pytest.raises(Exception, match="collection reference|repeated"):
            integrity.relocated(spark.createDataFrame([(p, "h") for p in bad], "path string, digest string"), "col").collect()
    row = spark.createDataFrame([("/x/seed_00000007_on/window_results.csv", 7, "on")], "p string, s int, t string")
    assert row.select(integrity.identity_of(F.col("p"), F.col("s"), F.col("t"))).first()[0] == "seed_00000007_on/window_results.csv"
    with pytest.raises(Exception, match="does not belong"):
        row.select(integrity.identity_of(F.col("p"), F.lit(8), F.col("t"))).collect()


def test_quality_rules(spark):
    df = spark.createDataFrame([("d", float("nan"), 1), ("d", -1e-13, 0), ("d", -1.0, 2), ("d", None, 1)], "k string, x double, label int")
    r = integrity.quality_report(df, ["k"], ["x"]).first()
    assert (r.nonfinite, r.materially_negative, r.roundoff_negative, r.bad_labels) == (2, 1, 1, 1)


def test_receiver_reports(spark):
    good = json.dumps({"end": {"sum_sent": {"bits_per_second": 9e6}, "sum_received": {"bits_per_second": 1e6, "lost_percent": 80}}})
    cases = [good, "{}", None, '{"error": "x"}', "{", '{"end":{"sum_received":{"bits_per_second":NaN,"lost_percent":1}}}']
    out = [r.m for r in spark.createDataFrame([(c,) for c in cases], "t string").select(records.receiver_metrics(F.col("t")).alias("m")).collect()]
    assert (out[0].receiver_mbps, out[0].loss_percent, out[0].status) == (1.0, 80.0, "ok")
    assert all(m.receiver_mbps is None and m.status.startswith("unavailable") for m in out[1:])


def test_trial_tree(spark, tmp_path):
    trial = tmp_path / "seed_00000001_audit_enabled"
    for w in range(2):
        (trial / f"window_{w:03d}").mkdir(parents=True)
        (trial / f"window_{w:03d}" / "iperf_benign.json").write_text('{"end":{"sum_received":{"bits_per_second":2e6,"lost_percent":0}}}')
    (trial / "window_001" / "iperf_attack_0.json").write_text('{"end":{"sum_received":{"bits_per_second":3e6,"lost_percent":0}}}')
    (trial / "window_001" / "iperf_attack_1.json").write_text('{"error":"busy"}')
    (trial / "window_results.csv").write_text(
        "seed,setting,window_index,phase,label,prediction,action,scheduled_benign_mbps,scheduled_attack_mbps\n"
        "1,audit_enabled,0,benign,0,0,NONE,2,0\n1,audit_enabled,1,attack,1,1,NONE,2,10\n")
    windows, reports = records.read_trial_tree(spark, str(tmp_path))
    out = {r.window_index: r for r in records.trial_rows(windows, reports, ["trial", "window_index"]).collect()}
    assert (out[0].benign_receiver_mbps, out[0].attack_receiver_mbps, out[0].attack_measurement_status) == (2.0, 0.0, "no_attack_scheduled")
    assert (out[1].attack_receiver_mbps, out[1].attack_measurement_status, out[1].scheduled_attackers) == (None, "unavailable", 1)


def test_flow_dump(spark):
    head = " cookie={c}, duration=1s, n_packets={p}, n_bytes={b}, priority=100,ip,nw_src={s},nw_dst={d} actions=NORMAL"
    lines = [head.format(c=c, p=p, b=b, s=s, d=d) for c, p, b, s, d in [
        ("0x475401", 12, 900, "10.253.0.1", "10.253.0.3"), ("0x475401", 20, 1500, "10.253.0.2", "10.253.0.3"),
        ("0x475402", 5, 400, "10.253.0.2", "10.253.0.3"), ("0x1", 99, 99, "10.253.0.1", "10.253.0.3")]]
    out = records.flow_counters(spark.createDataFrame([("r", t) for t in lines], "run_id string, line string"), ["run_id"])
    assert {r.source_ip: (r.packets, r.bytes) for r in out.collect()} == {"10.253.0.1": (12, 900), "10.253.0.2": (25, 1900)}


def test_audit_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x":1}\n\n{"y":\n')
    out = records.audit_lines(records.read_audit(spark, str(tmp_path))).collect()
    assert [(r.chain_id[-8:], r.seq, r.malformed) for r in sorted(out, key=lambda r: r.seq)] == [("/a.jsonl", 0, False), ("/a.jsonl", 2, True)]


def test_audit_file_in_many_splits(spark, tmp_path):
    (tmp_path / "big.jsonl").write_text("".join(t + "\n" for t in lines_of(spark, 200)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        lines = records.read_audit(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        report = integrity.chain_report(lines).first()
        assert report.valid_embedded_hash_chain and report.records == 200
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("slices", [1, 3, 16])
def test_ordered_helpers_do_not_depend_on_slices(spark, slices):
    """One group holds most rows and many ties; slices must not show."""
    data = [("hot" if i % 5 else "cold", i // 3, i, i % 7) for i in range(120)]
    df = spark.createDataFrame(data, "g string, t int, id int, v bigint")
    parts = sliced(df, ["g"], ["t", "id"], slices)
    out = lagged(running(parts, ["g"], ["t", "id"], {"s": F.col("v")}, totals=True), ["g"], ["t", "id"], "v", "before", F.lit(-1)).collect()
    for g in ("hot", "cold"):
        mine = sorted((d for d in data if d[0] == g), key=lambda d: (d[1], d[2]))
        found = sorted((r for r in out if r.g == g), key=lambda r: (r.t, r.id))
        total, last = 0, -1
        for d, r in zip(mine, found, strict=True):
            total += d[3]
            assert (r.s, r.before, r.s_total) == (total, last, sum(m[3] for m in mine))
            last = d[3]
    order = numbered(df, ["t", "id"], slices=slices).collect()
    assert [r.id for r in sorted(order, key=lambda r: r.row_index)] == list(range(120)) and {r.row_index_total for r in order} == {120}


def test_null_group_key_is_an_error(spark):
    with pytest.raises(Exception, match="null group key"):
        sliced(spark.createDataFrame([(None, 1)], "g string, t int"), ["g"], ["t"])


def test_digests_tell_rows_apart(spark):
    rows = [("x\u001fy", "z"), ("x", "y\u001fz"), ("", "a"), (None, "a"), ("\u0000", "a"), ("-", "a"), ("1:b", "a")]
    found = spark.createDataFrame(rows, "a string, b string").select(integrity.row_digest(["a", "b"]).alias("d")).distinct()
    assert found.count() == len(rows)
    none = integrity.table_hash(spark.createDataFrame([], "a string"), ["a"]).first()
    assert (none.rows, none.digest_sum) == (0, "0:0:0:0")


def test_last_value_is_carried_over_slices(spark):
    from flowsieve.functions import ordering

    data = [(g, i, (i if i % 7 == 3 else None) if g == "a" else None, i == 40) for g in ("a", "b") for i in range(60)]
    df = spark.createDataFrame(data, "g string, i bigint, v bigint, w boolean")
    parts = ordering.sliced(df, ["g"], ["i"], slices=9)
    out = ordering.last_before(parts, ["g"], ["i"], {"near": F.col("v"), "flag": F.when(F.col("w"), F.lit(True))})
    found = {(r.g, r.i): (r.near, r.flag) for r in out.collect()}
    for g, i, _, _ in data:
        past = [v for h, j, v, _ in data if h == g and j < i and v is not None]
        assert found[g, i] == (past[-1] if past else None, True if i > 40 else None)


def test_verification_joins_no_lines(spark):
    text = integrity.chain_checks(chain(spark, 20))._jdf.queryExecution().executedPlan().toString()
    # the only join brings the carried values, by slice
    assert text.count("Join") <= 1 and "_slice" in text[text.index("Join"):][:200]


def test_build_links_all_records_of_a_run(spark):
    """One genesis a run: a chain is not cut up by source."""
    from flowsieve.plans import integrity_queries, tables

    folder = "/root/testdata/sf0.001"
    lines = integrity_queries.chain_build(spark, folder).collect()
    runs = {r.run_id: r.n for r in tables.events(spark, folder).groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    by_run = {}
    for r in sorted(lines, key=lambda r: r.seq):
        by_run.setdefault(r.chain_id, []).append(json.loads(r.raw))
    assert {c: len(rs) for c, rs in by_run.items()} == runs
    for rs in by_run.values():
        assert [r["prev_hash"] for r in rs] == [integrity.GENESIS, *(r["record_hash"] for r in rs[:-1])]
