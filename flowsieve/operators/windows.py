"""Fixed windows with traffic features and, beside them, labels.

Both are built in two levels, first per (window, source) and then per window,
so entropy and distinct sources never need a collected list or a distinct set, and
a hot window or a hot source is reduced before it is shuffled. Labels ride in columns of
their own through the same two aggregates: one wide shuffle a table. A plan of the features
alone reads no label column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.functions import cleaning
from flowsieve.schemas import FEATURES, WINDOW_COLUMNS


def entropy_of(total: Column, weighted: Column) -> Column:
    """Base-2 entropy from N and sum(n*log2 n), never below zero."""
    return F.when(total > 0, F.greatest(F.log2(total) - weighted / total, F.lit(0.0))).otherwise(F.lit(0.0))


def source_counts(df: DataFrame, keys: Sequence[str], source: str, sums: dict[str, Column], beside: dict[str, Column] | None = None) -> DataFrame:
    """Level one: one row per (window, source); ``beside`` are further aggregates, such as those of labels."""
    return df.groupBy(*keys, F.col(source).alias("_src")).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(n) for n, c in sums.items()],
        *[c.alias(n) for n, c in (beside or {}).items()]
    )


def window_totals(counts: DataFrame, keys: Sequence[str], sums: Sequence[str], beside: dict[str, Column] | None = None) -> DataFrame:
    """Level two: one row per window; a null source counts for traffic, not for entropy. ``beside`` aggregates the columns of level one's."""
    named = F.col("_src").isNotNull()
    n = F.col("_n").cast("double")
    merged = counts.groupBy(*keys).agg(
        F.sum("_n").alias("_events"),
        F.count("_src").alias("_unique"),
        F.sum(F.when(named, n)).alias("_named"),
        F.sum(F.when(named, n * F.log2(n))).alias("_weighted"),
        *[F.sum(c).alias(c) for c in sums],
        *[c.alias(n) for n, c in (beside or {}).items()],
    )
    return merged.withColumn(
        "_entropy", F.coalesce(entropy_of(F.col("_named"), F.col("_weighted")), F.lit(0.0))
    )


def _features(totals: DataFrame, keys: Sequence[str], seconds: int, flow_count: Column, beside: Sequence[Column] = ()) -> DataFrame:
    w = F.lit(float(seconds))
    flows = flow_count.cast("double")
    return totals.select(
        *keys,
        (F.col("_pkt") / w).alias("pkt_rate"),
        (F.col("_byte") / w).alias("byte_rate"),
        F.col("_pkt").cast("double").alias("pkt_sum"),
        F.col("_events").alias("events"),
        F.col("_unique").alias("unique_src"),
        F.col("_entropy").alias("src_ip_entropy"),
        flows.alias("flow_count"),
        (flows / w).alias("flow_rate"),
        *beside,
    )


def _sorted_text(column: str, separator: str) -> Column:
    return F.array_join(F.array_sort(F.collect_set(column)), separator)


def _text_sets(column: str, separator: str) -> Column:
    """Sorted union of the sets that level one has made; sources with equal sets give one."""
    return F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(column)))), separator)


def _label_columns(attack: Column, target: Column, other: Column, rows: Column) -> dict[str, Column]:
    return {
        "label": (attack > 0).cast("int"), "target_label": (target > 0).cast("int"), "target_eligible": (other == 0).cast("int"),
        "attack_fraction": attack / rows,
    }


def labelled_flow_windows(flows: DataFrame, keys: Sequence[str], seconds: int, carried: Sequence[str] = ()) -> DataFrame:
    """Features of normalized flow rows per ``keys`` and window start, and beside them the window's labels and the sums of ``carried``.

    Label counts ride through the features' own aggregates. The set of label texts does not: sets would turn the wide (window, source)
    aggregate into a sorting one (measured: twice the time), so it comes from the key and text columns alone, reduced to texts per window before it moves.
    """
    by = [*keys, "window_start_epoch"]
    start = cleaning.window_floor(F.col("ts_epoch"), seconds).alias("window_start_epoch")
    source = F.when(F.col("src").isin("", "-"), F.lit(None)).otherwise(F.col("src"))
    marks = ["is_attack", "is_target", "is_other", *carried]
    rows = flows.select(*keys, start, source.alias("src"), "packets", "bytes", *marks)
    counts = source_counts(rows, by, "src", {"_pkt": F.col("packets"), "_byte": F.col("bytes")}, {c: F.sum(c) for c in marks})
    totals = window_totals(counts, by, ["_pkt", "_byte"], {c: F.sum(c) for c in marks})
    labels = _label_columns(*[F.col(c) for c in marks[:3]], F.col("_events"))
    table = _features(totals, by, seconds, F.col("_events"), [
        *[c.alias(n) for n, c in labels.items()], F.col("_events").alias("raw_rows"), *[F.col(c) for c in carried]])
    texts = flows.select(*keys, start, F.when(F.col("label_text") != "", F.col("label_text")).alias("label_text")).groupBy(*by, "label_text").agg(
        F.lit(1).alias("_one")).groupBy(*[F.col(c).alias(f"_k_{c}") for c in by]).agg(_sorted_text("label_text", ";").alias("label_types"))
    # keys may be null, as those of rows without a time are
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by]
    return table.join(texts, same, "left").drop(*[f"_k_{c}" for c in by])


def flow_window_labels(flows: DataFrame, keys: Sequence[str], seconds: int) -> DataFrame:
    """Window labels, from the label columns only. Reduced per label text before the set is built."""
    by = [*keys, "window_start_epoch"]
    per_text = flows.select(
        *keys, cleaning.window_floor(F.col("ts_epoch"), seconds).alias("window_start_epoch"),
        "is_attack", "is_target", "is_other",
        F.when(F.col("label_text") != "", F.col("label_text")).alias("label_text"),
    ).groupBy(*by, "label_text").agg(
        F.count(F.lit(1)).alias("_rows"), F.sum("is_attack").alias("_attack"),
        F.sum("is_target").alias("_target"), F.sum("is_other").alias("_other"),
    )
    merged = per_text.groupBy(*by).agg(
        F.sum("_rows").alias("raw_rows"), F.sum("_attack").alias("_attack"),
        F.sum("_target").alias("_target"), F.sum("_other").alias("_other"),
        _sorted_text("label_text", ";").alias("label_types"),
    )
    labels = _label_columns(F.col("_attack"), F.col("_target"), F.col("_other"), F.col("raw_rows"))
    return merged.select(*by, *[c.alias(n) for n, c in labels.items()], "raw_rows", "label_types")


def flow_windows(flows: DataFrame, seconds: int = 5, *, merge_files: bool = False, carried: Sequence[str] = ()) -> DataFrame:
    """The external window table: per source file, or merged over all files of a scenario; ``carried`` adds sums of further columns."""
    keys = ["dataset_id", "scenario_id", "timestamp_basis"]
    if not merge_files:
        keys = [*keys, "source_file"]
    table = labelled_flow_windows(flows, keys, seconds, carried)
    if merge_files:
        table = table.withColumn("source_file", F.lit("multiple_scenario_logs; see source_files.csv"))
    basis = F.col("timestamp_basis")
    return table.withColumns({
        "segment_id": F.lit(0),
        "window_start_ts": cleaning.rendered_time(F.col("window_start_epoch"), basis),
        "window_end_ts": cleaning.rendered_time(F.col("window_start_epoch") + seconds, basis),
        "measurement_type": F.lit("offline_flow_derived_diagnostic"),
    }).select(*WINDOW_COLUMNS, *carried)


def _start(df: DataFrame, seconds: int) -> Column:
    micros = F.unix_micros("event_ts")
    return F.floor((micros - F.pmod(micros, F.lit(seconds * 1_000_000))) / F.lit(1_000_000)).cast("bigint")


def with_window(events: DataFrame, seconds: int) -> DataFrame:
    return events.withColumn("window_start", _start(events, seconds))


def event_windows(events: DataFrame, seconds: int = 5) -> DataFrame:
    """Per (run, topology, scenario, phase, window); flow_count is the plain sum."""
    keys = ["run_id", "topology_id", "scenario_id", "phase", "window_start"]
    rows = with_window(events, seconds)
    counts = source_counts(rows, keys, "src_ip", {
        "_pkt": F.col("packet_count"), "_byte": F.col("byte_count"), "_flow": F.col("flow_count"),
    }, {"label": F.max("label")})
    totals = window_totals(counts, keys, ["_pkt", "_byte", "_flow"], {"label": F.max("label")})
    return _features(totals, keys, seconds, F.col("_flow"), [F.col("label")]).withColumn("window_end", F.col("window_start") + seconds)


def switch_windows(events: DataFrame, seconds: int = 5) -> DataFrame:
    """Features plus row id, label and the sorted scenario set of each switch-destination window."""
    keys = ["run_id", "window_start", "switch_id", "dst_ip"]
    counts = source_counts(with_window(events, seconds), keys, "src_ip", {
        "_pkt": F.col("packet_count"), "_byte": F.col("byte_count"), "_flow": F.col("flow_count"),
    }, {"label": F.max("label"), "_scenarios": F.collect_set("scenario_id")})
    totals = window_totals(counts, keys, ["_pkt", "_byte", "_flow"], {"label": F.max("label"), "scenario_id": _text_sets("_scenarios", "|")})
    # the flow count falls back to the number of events
    flows = F.when(F.col("_flow") > 0, F.col("_flow")).otherwise(F.col("_events"))
    table = _features(totals, keys, seconds, flows, [F.col("label"), F.col("scenario_id")])
    iso = F.date_format(F.timestamp_seconds("window_start"), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return table.withColumns({
        "row_id": F.concat_ws("|", "run_id", iso, "switch_id", "dst_ip"),
        "window_end": F.col("window_start") + seconds,
    }).select("row_id", *keys, "window_end", "scenario_id", "label", *FEATURES)


def window_profile(windows: DataFrame) -> DataFrame:
    """Row count, time range and counts per value of five dimensions in one pass."""
    dims = ["label", "run_id", "topology_id", "scenario_id", "phase"]
    rows = windows.withColumn("label", F.col("label").cast("string"))
    grouped = rows.groupingSets(
        [[d] for d in dims] + [[]], *dims,
    ).agg(
        F.grouping_id().alias("_gid"), F.count(F.lit(1)).alias("n"),
        F.min("window_start").alias("start"), F.max("window_end").alias("end"),
    )
    full = 2 ** len(dims) - 1
    dimension, value = F.lit("all"), F.lit("all")
    for i, d in enumerate(dims):
        mine = F.col("_gid") == F.lit(full - 2 ** (len(dims) - 1 - i))
        dimension = F.when(mine, F.lit(d)).otherwise(dimension)
        value = F.when(mine, F.col(d)).otherwise(value)
    return grouped.select(dimension.alias("dimension"), value.alias("value"), "n", "start", "end")


def reversal_segments(flows: DataFrame, position: str = "position") -> DataFrame:
    """Segment number per source file; a timestamp before the previous one opens a new segment."""
    from flowsieve.functions.ordering import SLICE, lagged, running, sliced

    parts = sliced(flows, ["source_file"], [position])
    before = lagged(parts, ["source_file"], [position], "ts_epoch", "_previous")
    flag = F.coalesce((F.col("ts_epoch") < F.col("_previous")).cast("int"), F.lit(0))
    return running(
        before.withColumn("_reset", flag), ["source_file"], [position], {"segment_id": F.col("_reset")}
    ).drop(SLICE, "_previous", "_reset")


def running_features(events: DataFrame, seconds: int = 5) -> DataFrame:
    """Partial-window features after every event of a (switch, destination) window.

    The n-th occurrence of a source adds ``n log2 n - (n-1) log2(n-1)`` to the weighted
    sum and 1 to the distinct sources when n is 1, so both are running sums.
    """
    from flowsieve.functions.ordering import SLICE, running, sliced

    keys = ["switch_id", "dst_ip", "window_start"]
    order = ["event_ts", "event_id"]
    rows = with_window(events, seconds).select(
        *keys, *order, "src_ip", "packet_count", "byte_count", "flow_count",
    )
    parts = sliced(rows, keys, order)
    nth = running(parts, [*keys, "src_ip"], order, {"_nth": F.lit(1).cast("bigint")})
    n = F.col("_nth").cast("double")
    gain = F.when(F.col("_nth") == 1, F.lit(0.0)).otherwise(n * F.log2(n) - (n - 1) * F.log2(n - 1))
    steps = running(nth, keys, order, {
        "_events": F.lit(1).cast("bigint"),
        "_pkt": F.coalesce("packet_count", F.lit(0)),
        "_byte": F.coalesce("byte_count", F.lit(0)),
        "_flow": F.coalesce("flow_count", F.lit(0)),
        "_unique": (F.col("_nth") == 1).cast("bigint"),
        "_weighted": gain,
    })
    flows = F.when(F.col("_flow") > 0, F.col("_flow")).otherwise(F.col("_events"))
    steps = steps.withColumn("_entropy", entropy_of(F.col("_events").cast("double"), F.col("_weighted"))).drop(SLICE)
    return _features(steps, ["event_id", *keys], seconds, flows)


def ingest_statistics(normalized: DataFrame) -> DataFrame:
    """Row, drop and coercion counts per dataset from the un-dropped normalized rows."""
    return normalized.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("raw_rows"),
        F.count_if(F.col("ts_epoch").isNull()).alias("dropped_bad_timestamps"),
        F.sum(F.when(F.col("ts_epoch").isNotNull(), F.col("bad_numbers")).otherwise(0)).alias("numeric_coercions"),
    )


def ingest(normalized: DataFrame, path: str, seconds: int = 5, *, merge_files: bool = False) -> dict[str, int]:
    """Write one dataset's windows below ``path`` and count rows, dropped times, bad numbers, windows and windows by label.

    The source is read once: bad numbers are summed along with the features, and rows without a usable time are a group without a window. Windows
    lie in ``usable=true``, those groups in ``usable=false``; the counts are sums over four columns of what was written. A dataset without rows counts 0.
    """
    table = flow_windows(normalized, seconds, merge_files=merge_files, carried=["bad_numbers"])
    table.withColumn("usable", F.col("window_start_epoch").isNotNull()).write.partitionBy("usable").mode("errorifexists").parquet(path)
    spark = normalized.sparkSession
    made = spark.read.schema(f"raw_rows bigint, label int, bad_numbers {dict(table.dtypes)['bad_numbers']}, usable boolean").parquet(path)
    usable = F.col("usable")
    row = made.agg(
        F.sum("raw_rows").alias("raw_rows"), F.sum(F.when(~usable, F.col("raw_rows"))).alias("dropped_bad_timestamps"), F.sum(F.when(usable, F.col("bad_numbers"))).alias("numeric_coercions"),
        F.count_if(usable).alias("windows"), F.count_if(usable & (F.col("label") == 0)).alias("windows_label_0"), F.count_if(usable & (F.col("label") == 1)).alias("windows_label_1")).first()
    return {name: int(value or 0) for name, value in row.asDict().items()}
