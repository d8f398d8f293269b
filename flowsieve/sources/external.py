"""Flow records of three public layouts, normalized to one contract.

Every reader returns all rows: ``ts_epoch`` is null where the timestamp is unusable and
``bad_numbers`` counts coerced fields, so ingest statistics come from the same frame.
``usable`` then keeps the rows that can be windowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowsieve.functions import cleaning
from flowsieve.functions.ordering import SLICE, running, sliced
from flowsieve.schemas import FLOW

#: Spark's own bound (windowGroupLimitThreshold) up to which it cuts groups before a shuffle.
GROUP_LIMIT = 1000

# fixed values: columns used from each layout
CIC_COLUMNS = [
    "Timestamp", "Source IP", "Total Fwd Packets", "Total Backward Packets",
    "Total Length of Fwd Packets", "Total Length of Bwd Packets", "Label",
]
TON_COLUMNS = [
    "ts", "src_ip", "src_pkts", "dst_pkts", "src_ip_bytes", "dst_ip_bytes", "src_bytes", "dst_bytes", "label", "type",
]
# fixed values: zero-based fields of a labeled Zeek connection line
ZEEK = {"ts": 0, "src": 2, "orig_bytes": 9, "resp_bytes": 10, "orig_pkts": 16, "orig_ip_bytes": 17, "resp_pkts": 18, "resp_ip_bytes": 19, "tail": 20}


def _relative(root: str) -> Column:
    """Path below ``root``, as found in the file metadata."""
    path = F.url_decode(F.regexp_replace(F.col("_path"), r"^file:/+", "/"))
    base = root.removeprefix("file:").rstrip("/")
    at = F.locate(base + "/", path)
    return F.when(at > 0, F.substring(path, at + len(base) + 1, F.length(path))).otherwise(path)


def pruned_csv(spark: SparkSession, root: str, columns: list[str], pattern: str = "*.csv") -> DataFrame:
    """Header-trimmed text columns of every matching file below ``root``.

    A file whose header differs from the first one is an error, not a silent shift.
    """
    raw = (spark.read.option("header", True).option("enforceSchema", False).option("recursiveFileLookup", True)
           .option("pathGlobFilter", pattern).csv(root))
    named = {c.strip(): c for c in raw.columns}
    missing = [c for c in columns if c not in named]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return raw.select(*[F.col(f"`{named[c]}`").alias(c) for c in columns], F.col("_metadata.file_path").alias("_path"))


def _text(column: str, missing: str) -> Column:
    c = F.col(f"`{column}`")
    return F.trim(F.when(c.isNull() | c.isin(cleaning.MISSING_TEXT), missing).otherwise(c))


def _sum_of(columns: list[str], fn) -> Column:
    total = fn(F.col(f"`{columns[0]}`"))
    for c in columns[1:]:
        total = total + fn(F.col(f"`{c}`"))
    return total


def _finish(df: DataFrame) -> DataFrame:
    names = [f.name for f in FLOW.fields]
    typed = [F.col(f.name).cast(f.dataType).alias(f.name) for f in FLOW.fields]
    return df.select(*names, "bad_numbers").select(*typed, F.col("bad_numbers").cast("int").alias("bad_numbers"))


def normalize_cic(raw: DataFrame, source_file: Column, dataset: str = "cicddos2019") -> DataFrame:
    counts = ["Total Fwd Packets", "Total Backward Packets"]
    sizes = ["Total Length of Fwd Packets", "Total Length of Bwd Packets"]
    label = _text("Label", "nan")
    attack = cleaning.flow_attack(label)
    return _finish(raw.withColumn("_file", source_file).select(
        F.lit(dataset).alias("dataset_id"), cleaning.scenario_from_path(F.col("_file")).alias("scenario_id"), F.col("_file").alias("source_file"),
        cleaning.epoch_seconds(cleaning.day_first_timestamp(F.col("Timestamp"))).alias("ts_epoch"),
        _sum_of(counts, cleaning.coerced).alias("packets"), _sum_of(sizes, cleaning.coerced).alias("bytes"),
        _text("Source IP", "").alias("src"), attack.alias("is_attack"), attack.alias("is_target"), F.lit(0).alias("is_other"),
        label.alias("label_text"), F.lit("local_time_timezone_unspecified").alias("timestamp_basis"),
        _sum_of(counts + sizes, cleaning.coerced_bad).alias("bad_numbers")))


def normalize_ton(raw: DataFrame, source_file: Column, dataset: str = "toniot") -> DataFrame:
    counts, ip, payload = ["src_pkts", "dst_pkts"], ["src_ip_bytes", "dst_ip_bytes"], ["src_bytes", "dst_bytes"]
    epoch = cleaning.as_number(F.col("ts"))
    attack = F.coalesce(cleaning.as_number(F.col("label")), F.lit(0.0)) > 0
    kind = F.lower(_text("type", ""))
    target = kind.rlike(cleaning.TON_TARGET)
    return _finish(raw.withColumn("_file", source_file).select(
        F.lit(dataset).alias("dataset_id"), F.lower(cleaning.file_stem(F.col("_file"))).alias("scenario_id"), F.col("_file").alias("source_file"),
        F.when(cleaning.is_finite(epoch), epoch).alias("ts_epoch"),
        _sum_of(counts, cleaning.coerced).alias("packets"),
        cleaning.preferred_bytes(_sum_of(ip, cleaning.coerced), _sum_of(payload, cleaning.coerced)).alias("bytes"),
        _text("src_ip", "").alias("src"), attack.cast("int").alias("is_attack"), target.cast("int").alias("is_target"),
        (attack & ~target).cast("int").alias("is_other"), kind.alias("label_text"), F.lit("unix_utc").alias("timestamp_basis"),
        _sum_of(counts + ip + payload, cleaning.coerced_bad).alias("bad_numbers")))


def normalize_zeek(lines: DataFrame, source_file: Column, dataset: str = "iot23") -> DataFrame:
    """``lines`` has one text line per row in ``value``; comment lines are skipped, short lines are an error."""
    body = lines.filter(~F.col("value").startswith("#")).withColumn("_file", source_file)
    parts = F.split("value", "\t")
    checked = F.when(F.size(parts) >= 21, parts).otherwise(F.raise_error(F.lit("Zeek line with fewer than 21 fields")).cast("array<string>"))
    fields = body.withColumn("_f", checked).select("_file", *[F.col("_f")[i].alias(n) for n, i in ZEEK.items()])
    tail = cleaning.zeek_tail(F.col("tail"))
    split = fields.withColumn("_t", tail)
    label, detail = F.col("_t.label"), F.col("_t.detail")
    attack = cleaning.flow_attack(label)
    target = F.lower(detail).contains("ddos").cast("int")
    counts, ip, payload = ["orig_pkts", "resp_pkts"], ["orig_ip_bytes", "resp_ip_bytes"], ["orig_bytes", "resp_bytes"]
    return _finish(split.select(
        F.lit(dataset).alias("dataset_id"), cleaning.ancestor(F.col("_file"), 2).alias("scenario_id"), F.col("_file").alias("source_file"),
        F.when(cleaning.is_finite(cleaning.as_number(F.col("ts"))), cleaning.as_number(F.col("ts"))).alias("ts_epoch"),
        _sum_of(counts, cleaning.zeek_number).alias("packets"),
        cleaning.preferred_bytes(_sum_of(ip, cleaning.zeek_number), _sum_of(payload, cleaning.zeek_number)).alias("bytes"),
        F.trim("src").alias("src"), attack.alias("is_attack"), target.alias("is_target"),
        ((attack == 1) & (target == 0)).cast("int").alias("is_other"),
        cleaning.label_with_detail(label, detail).alias("label_text"), F.lit("unix_utc").alias("timestamp_basis"),
        _sum_of(counts + ip + payload, cleaning.zeek_bad).alias("bad_numbers")))


def read_cic(spark: SparkSession, root: str) -> DataFrame:
    return normalize_cic(pruned_csv(spark, root, CIC_COLUMNS), _relative(root))


def read_ton(spark: SparkSession, root: str, pattern: str = "*.csv") -> DataFrame:
    return normalize_ton(pruned_csv(spark, root, TON_COLUMNS, pattern), _relative(root))


def read_zeek(spark: SparkSession, root: str, pattern: str = "*.labeled") -> DataFrame:
    lines = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root)
             .select("value", F.col("_metadata.file_path").alias("_path")))
    return normalize_zeek(lines, _relative(root))


def usable(normalized: DataFrame) -> DataFrame:
    return normalized.filter(F.col("ts_epoch").isNotNull()).drop("bad_numbers")


def first_rows(df: DataFrame, source: str, order: str, n: int) -> DataFrame:
    """The first n rows of every source.

    Up to GROUP_LIMIT rows Spark cuts each task's rows of a source before they are shuffled, so n rows per source and task move, first
    to the source's salts and then together. Beyond that, running counts over range slices, so a large source is not one task.
    """
    if n <= GROUP_LIMIT:
        salted = Window.partitionBy(source, F.pmod(F.xxhash64(order), F.lit(32))).orderBy(order)
        some = df.withColumn("_at", F.row_number().over(salted)).filter(F.col("_at") <= n)
        return some.withColumn("_at", F.row_number().over(Window.partitionBy(source).orderBy(order))).filter(F.col("_at") <= n).drop("_at")
    counted = running(sliced(df, [source], [order]), [source], [order], {"_at": F.lit(1).cast("bigint")})
    return counted.filter(F.col("_at") <= n).drop("_at", SLICE)
