"""Readers for events, prepared windows, trials, calibration rows, audit lines and flow dumps."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsieve.functions import cleaning
from flowsieve.functions.ordering import running, sliced
from flowsieve.schemas import FEATURES, OBSERVATION, RECEIVER_REPORT

# fixed values: accepted names per field, in order of preference, and defaults for absent dimensions
ALIASES = {
    "packet_count": ["packet_count", "pkt_count", "packets", "pkt_sum"],
    "byte_count": ["byte_count", "bytes", "byte_sum"],
    "flow_count": ["flow_count", "flows"],
    "src_ip": ["src_ip", "source_ip"],
    "label": ["label", "true_attack"],
}
REQUIRED = ["packet_count", "label"]
DIMENSIONS = {
    "run_id": "run_unknown", "topology_id": "topology_unknown", "scenario_id": "scenario_unknown", "phase": "phase_unknown",
}
# fixed values: tracking cookies and the monitored server
COOKIES = ["0x475401", "0x475402"]
SERVER = "10.253.0.3"


def resolve(columns: Sequence[str]) -> dict[str, str | None]:
    """First alias present per field."""
    found = {field: next((n for n in names if n in columns), None) for field, names in ALIASES.items()}
    absent = [f for f in REQUIRED if found[f] is None]
    if "event_ts" not in columns:
        absent.append("event_ts")
    if absent:
        raise ValueError(f"missing required columns: {absent}")
    return found


def normalize_events(raw: DataFrame) -> DataFrame:
    """Text columns to the event contract; one unusable timestamp fails the job."""
    found = resolve(raw.columns)

    def number(field: str, default: float) -> Column:
        name = found[field]
        if name is None:
            return F.lit(default)
        v = cleaning.as_number(F.col(name).cast("string"))
        return F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")), v).otherwise(F.lit(0.0))

    ts = F.col("event_ts").cast("string").try_cast("timestamp")
    checked = F.when(ts.isNotNull(), ts).otherwise(F.raise_error(F.lit("event_ts cannot be read as a timestamp")).cast("timestamp"))
    others = [
        (F.coalesce(F.col(d).cast("string"), F.lit("nan")) if d in raw.columns else F.lit(default)).alias(d)
        for d, default in DIMENSIONS.items()]
    # a missing source is counted as its own value
    source = F.coalesce(F.col(found["src_ip"]).cast("string"), F.lit("nan")) if found["src_ip"] else F.lit("unknown")
    return raw.select(
        checked.alias("event_ts"), *others, source.alias("src_ip"),
        number("packet_count", 0.0).alias("packet_count"), number("byte_count", 0.0).alias("byte_count"),
        number("flow_count", 1.0).alias("flow_count"), cleaning.event_label(F.col(found["label"])).alias("label"))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return normalize_events(spark.read.option("header", True).option("enforceSchema", False).csv(path))


def read_window_tables(spark: SparkSession, path: str) -> DataFrame:
    """Prepared windows of several files, with the file stem as dataset."""
    raw = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    stem = cleaning.file_stem(F.col("_metadata.file_path"))
    numbers = [F.col(c).cast("double").alias(c) for c in FEATURES]
    rest = [c for c in raw.columns if c not in FEATURES and c != "label"]
    return raw.select(stem.alias("dataset"), *rest, *numbers, F.col("label").cast("int").alias("label"))


def strict_features(df: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Exactly the declared feature columns in order; a missing or non-finite value fails the job."""
    present = [c for c in df.columns if c not in keep]
    if present != list(names):
        raise ValueError("features must be exactly the declared columns, in order")

    def checked(c: str) -> Column:
        v = F.col(c).cast("double")
        ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
        return F.when(ok, v).otherwise(F.raise_error(F.lit(f"{c} is missing or not finite")).cast("double")).alias(c)

    return df.select(*keep, *[checked(c) for c in names])


def scoring_features(df: DataFrame) -> DataFrame:
    """Entropy rounding noise below zero is clamped before scoring."""
    return df.withColumn("src_ip_entropy", F.greatest(F.col("src_ip_entropy"), F.lit(0.0)))


def receiver_metrics(report: Column) -> Column:
    """(receiver_mbps, loss_percent, status) of one receiver report text."""
    parsed = F.from_json(report, RECEIVER_REPORT)
    rate, loss = parsed["end"]["sum_received"]["bits_per_second"], parsed["end"]["sum_received"]["lost_percent"]
    finite = lambda c: ~F.isnan(c) & (F.abs(c) != float("inf"))
    inside = finite(rate) & finite(loss) & (rate >= 0) & (loss >= 0) & (loss <= 100)
    status = (
        F.when(report.isNull(), "unavailable: no report").when(F.try_parse_json(report).isNull(), "unavailable: malformed report")
        .when(F.coalesce(parsed["error"], F.lit("")) != "", "unavailable: reported error")
        .when(rate.isNull() | loss.isNull(), "unavailable: missing field").when(~inside, "unavailable: invalid rate or loss").otherwise("ok"))
    fine = status == "ok"
    return F.struct(F.when(fine, rate / 1e6).alias("receiver_mbps"), F.when(fine, loss).alias("loss_percent"), status.alias("status"))


def trial_rows(windows: DataFrame, reports: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Service measurements per window; ``reports`` holds (keys, role, report).

    The attack rate is a sum only if every attack report is usable, 0 where no attack
    was scheduled, and otherwise unknown.
    """
    measured = reports.withColumn("_m", receiver_metrics(F.col("report"))).select(*keys, "role", "_m.*")
    ok = F.col("status") == "ok"
    merged = measured.groupBy(*keys).agg(
        F.max(F.when(F.col("role") == "benign", F.col("receiver_mbps"))).alias("benign_receiver_mbps"),
        F.max(F.when(F.col("role") == "benign", F.col("loss_percent"))).alias("benign_loss_percent"),
        F.max(F.when(F.col("role") == "benign", F.col("status"))).alias("benign_measurement_status"),
        F.count_if(F.col("role") == "attack").alias("_reports"),
        F.count_if((F.col("role") == "attack") & ok).alias("_usable"),
        F.sum(F.when(F.col("role") == "attack", F.col("receiver_mbps"))).alias("_rate"))
    usable = F.coalesce((F.col("_reports") > 0) & (F.col("_reports") == F.col("_usable")), F.lit(False))
    idle = F.col("scheduled_attack_mbps") == 0
    return windows.join(merged, list(keys), "left").withColumns({
        "benign_measurement_status": F.coalesce("benign_measurement_status", F.lit("unavailable: no report")),
        "attack_receiver_mbps": F.when(usable, F.col("_rate")).when(idle, F.lit(0.0)),
        "attack_measurement_status": F.when(usable, "ok").when(idle, "no_attack_scheduled").otherwise("unavailable"),
    }).drop("_reports", "_usable", "_rate")


def read_trial_tree(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Window rows and receiver reports of a tree of trials, keyed by trial folder and window."""
    rows = (spark.read.option("header", True).option("enforceSchema", False).option("recursiveFileLookup", True)
            .option("pathGlobFilter", "window_results.csv").csv(root))
    trial = cleaning.ancestor(F.col("_metadata.file_path"), 1)
    typed = {
        "seed": "int", "window_index": "int", "label": "int", "prediction": "int", "scheduled_benign_mbps": "double", "scheduled_attack_mbps": "double"}
    windows = rows.select(
        trial.alias("trial"), F.col("_metadata.file_path").alias("record_path"),
        *[F.col(c).cast(typed[c]).alias(c) if c in typed else F.col(c) for c in rows.columns])
    if "scheduled_attackers" in rows.columns:
        windows = windows.withColumn("scheduled_attackers", F.col("scheduled_attackers").cast("int"))
    else:
        windows = windows.withColumn("scheduled_attackers", (F.col("label") != 0).cast("int"))
    texts = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "iperf_*.json").text(root, wholetext=True))
    path = F.col("_metadata.file_path")
    reports = texts.select(
        cleaning.ancestor(path, 2).alias("trial"),
        F.regexp_extract(path, r"window_(\d+)/[^/]+$", 1).cast("int").alias("window_index"),
        F.when(path.rlike(r"/iperf_benign[^/]*$"), "benign").otherwise("attack").alias("role"), F.col("value").alias("report"))
    return windows, reports


def explode_observations(texts: DataFrame, keys: Sequence[str], column: str = "observations") -> DataFrame:
    """Long source observations out of JSON arrays."""
    return texts.select(*keys, F.explode(F.from_json(column, T.ArrayType(OBSERVATION))).alias("o")).select(*keys, "o.*")


def truth_rows(texts: DataFrame, keys: Sequence[str], column: str = "truth") -> DataFrame:
    """(source, is_attacker) out of JSON objects."""
    parsed = F.from_json(column, T.MapType(T.StringType(), T.IntegerType()))
    return texts.select(*keys, F.explode(parsed).alias("source_ip", "is_attacker"))


def calibration_report(windows: DataFrame, expected_windows: int, seeds: tuple[int, int], by: Sequence[str] = ()) -> DataFrame:
    """Completeness, order and absence of enforcement per seed, and per value of ``by``; missing seeds appear with zero windows."""
    from flowsieve.operators.gate import index_report

    keys = [*by, "seed"]
    groups = windows.select(*by).distinct() if by else windows.sparkSession.range(1).select()
    wanted = groups.withColumn("seed", F.explode(F.sequence(F.lit(seeds[0]), F.lit(seeds[0] + seeds[1] - 1))))
    acted = windows.groupBy(*keys).agg(F.count_if(F.col("action") != "NONE").alias("_acted"))
    seen = index_report(windows, keys).join(acted, keys)
    return wanted.join(seen, keys, "full").select(
        *keys, F.coalesce("windows", F.lit(0)).alias("windows"),
        F.coalesce((F.col("windows") == expected_windows) & F.col("consecutive"), F.lit(False)).alias("complete"),
        F.coalesce(F.col("_acted") == 0, F.lit(False)).alias("unenforced"))


@dataclass(frozen=True)
class Collection:
    """A verified collection: windows, observations and roles of its trials, keyed by seed, and the detector that made its predictions."""

    windows: DataFrame
    observations: DataFrame
    truth: DataFrame
    detector_hash: str


def read_collection(spark: SparkSession, root: str, stage: str, protocol: dict, setting: str = "mitigation_disabled") -> Collection:
    """The trials of one stage of a protocol, after all that must hold for fitting has been checked again.

    Errors: a configuration of another stage or protocol, a verification that is missing, failed or of another stage, a file that is missing, new
    or changed since, a seed that is missing or extra, windows that are incomplete, out of order or enforced. Only the two single-record
    files and single verdicts reach the driver.
    """
    from flowsieve.operators.integrity import compact_json, manifest_check, manifest_lines

    def record(name: str) -> dict:
        found = spark.read.text(f"{root}/{name}", wholetext=True).first()
        if found is None:
            raise ValueError(f"{name} is empty")
        return json.loads(found["value"])

    config, report = record("run_configuration.json"), record("verification_v3.json")
    if config.get("stage") != stage or config.get("protocol_hash") != hashlib.sha256(compact_json(protocol).encode()).hexdigest():
        raise ValueError("another stage or protocol")
    if not report.get("passed") or report.get("stage") != stage:
        raise ValueError("the collection is not verified for this stage")
    top = f"/{root.rstrip('/').rpartition('/')[2]}/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(
        F.substring_index("path", top, -1).alias("name"), F.sha2("content", 256).alias("sha256")).filter(~F.col("name").isin("verification_v3.json", "CHECKSUMS.sha256"))
    listed = manifest_lines(spark.read.text(f"{root}/CHECKSUMS.sha256").withColumnRenamed("value", "line"))
    wrong = manifest_check(listed, files.withColumns({"sha256_lf": F.col("sha256"), "sha256_crlf": F.col("sha256")})).filter("status <> 'ok'").first()
    if wrong is not None:
        raise ValueError(f"{wrong['name']} is {wrong['status']} since the collection was verified")
    windows, _ = read_trial_tree(spark, root)
    kept = windows.filter(F.col("trial") == F.format_string(f"seed_%08d_{setting}", "seed"))
    part, traffic = protocol[stage], protocol["traffic"]
    expected = sum(traffic[k] for k in ("benign_windows", "attack_windows", "recovery_windows"))
    bad = calibration_report(kept, expected, (part["seed_start"], part["runs"])).filter(
        ~F.col("complete") | ~F.col("unenforced") | ~F.col("seed").between(part["seed_start"], part["seed_start"] + part["runs"] - 1)).first()
    if bad is not None:
        raise ValueError(f"seed {bad['seed']}: {bad['windows']} windows, complete {bad['complete']}, unenforced {bad['unenforced']}")

    def texts(name: str, column: str, levels: int) -> DataFrame:
        path = F.col("_metadata.file_path")
        found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).text(root, wholetext=True)
        seed = F.regexp_extract(cleaning.ancestor(path, levels), r"^seed_(\d+)_", 1).cast("int")
        return found.select(seed.alias("seed"), F.regexp_extract(path, r"window_(\d+)/[^/]+$", 1).try_cast("int").alias("window_index"), F.col("value").alias(column)).join(
            kept.select("seed").distinct(), "seed", "left_semi")

    return Collection(
        kept, explode_observations(texts("source_observations.json", "observations", 2), ["seed", "window_index"]),
        truth_rows(texts("source_truth.json", "truth", 1), ["seed"]), config["detector_model_hash"])


def window_contract(windows: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """One report row: duplicates, runs, seeds, bad features, classes and bad bounds."""
    bad = F.lit(0)
    for c in features:
        v = F.col(c).cast("double")
        wrong = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")) | (v < 0)
        bad = bad + wrong.cast("int")
    counts = ("_n", "_bad", "_order", "_zero", "_one", "_else")
    per_row = windows.withColumn("_bad", bad).groupBy("run_id", "row_id").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_bad").alias("_bad"), F.count_if(F.col("window_start") >= F.col("window_end")).alias("_order"),
        F.count_if(F.col("label") == 0).alias("_zero"), F.count_if(F.col("label") == 1).alias("_one"), F.count_if(~F.col("label").isin(0, 1)).alias("_else"))
    # one row an id and one a run, from the same scan
    sets = per_row.groupingSets([["run_id"], ["row_id"]], "run_id", "row_id").agg(
        (F.grouping("run_id") == 1).alias("_id"), *[F.sum(c).alias(c) for c in counts])
    of = lambda c: F.coalesce(F.sum(F.when(F.col("_id"), F.col(c))), F.lit(0))
    return sets.agg(
        F.sum(F.when(F.col("_id"), F.col("_n"))).alias("rows"), F.count_if(F.col("_id") & (F.col("_n") > 1)).alias("duplicate_row_ids"),
        F.sum(F.when(F.col("_id"), F.col("_bad"))).alias("bad_features"), F.sum(F.when(F.col("_id"), F.col("_order"))).alias("bad_bounds"),
        ((of("_zero") > 0) & (of("_one") > 0) & (of("_else") == 0)).alias("both_classes"), F.count_if(~F.col("_id")).alias("runs"))


def audit_lines(lines: DataFrame) -> DataFrame:
    """Non-blank lines with a flag for those that are not JSON; needs (chain_id, seq, raw)."""
    body = lines.withColumn("raw", F.trim("raw")).filter(F.col("raw") != "")
    return body.withColumn("malformed", F.try_parse_json("raw").isNull())


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """(chain_id, seq, raw): one chain per file, numbered by line.

    Files may be split: a line's place is its split's offset and its order inside the
    split, and line numbers are running counts over that order.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("chain_id"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"), F.col("value").alias("raw"))
    place = ["_block", "_at"]
    counted = running(sliced(lines, ["chain_id"], place), ["chain_id"], place, {"seq": F.lit(1).cast("bigint")})
    return counted.select("chain_id", (F.col("seq") - 1).alias("seq"), "raw")


def flow_counters(lines: DataFrame, keys: Sequence[str], server: str = SERVER) -> DataFrame:
    """Packets and bytes per source from flow-table dump lines with a tracking cookie."""
    line = F.col("line")
    tracked = line.contains(f"cookie={COOKIES[0]}") | line.contains(f"cookie={COOKIES[1]}")
    found = lines.filter(tracked & line.contains(f"nw_dst={server}")).select(
        *keys, F.regexp_extract(line, r"nw_src=([0-9.]+)", 1).alias("source_ip"),
        F.regexp_extract(line, r"n_packets=(\d+)", 1).alias("_p"), F.regexp_extract(line, r"n_bytes=(\d+)", 1).alias("_b"))
    whole = (F.col("source_ip") != "") & (F.col("_p") != "") & (F.col("_b") != "")
    return found.filter(whole).groupBy(*keys, "source_ip").agg(
        F.sum(F.col("_p").cast("bigint")).alias("packets"), F.sum(F.col("_b").cast("bigint")).alias("bytes"))


def inventory(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Path, size and modification time of files; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def write_windows(df: DataFrame, path: str, partition: str = "dataset_id") -> None:
    """Partitioned parquet; an existing target is an error."""
    df.write.mode("errorifexists").partitionBy(partition).parquet(path)


def write_table(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Manifest, curve or report table; an existing target is an error."""
    writer = df.write.mode("errorifexists")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)
