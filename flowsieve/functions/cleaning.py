"""Column expressions that normalize raw text fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: text read as a missing number
MISSING_TEXT = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
# fixed values: label words meaning "no attack"
FLOW_BENIGN = ["benign", "normal", "0"]
EVENT_BENIGN = ["0", "0.0", "false", "benign", "normal", "none", "no"]
# fixed values: Zeek placeholders for an absent number
ZEEK_EMPTY = ["", "-", "(empty)"]
TON_TARGET = r"(?:^|[^a-z])d?dos(?:[^a-z]|$)"

# Java would also take "1d" or hex floats; only plain decimal text counts as a number.
_DECIMAL = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def as_number(text: Column) -> Column:
    """Finite or overflowing decimal text as a double, everything else null."""
    return F.when(text.rlike(_DECIMAL), text.try_cast("double"))


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))


def coerced(text: Column) -> Column:
    """Non-negative number; bad and missing text become 0."""
    number = as_number(text)
    return F.when(is_finite(number), F.greatest(number, F.lit(0.0))).otherwise(F.lit(0.0))


def coerced_bad(text: Column) -> Column:
    """1 where text is present but not a finite number (a clipped negative is not counted)."""
    present = text.isNotNull() & ~text.isin(MISSING_TEXT)
    return (present & ~is_finite(as_number(text))).cast("int")


def zeek_number(text: Column) -> Column:
    number = as_number(text)
    usable = is_finite(number) & (number >= 0)
    return F.when(usable, number).otherwise(F.lit(0.0))


def zeek_bad(text: Column) -> Column:
    """1 where the field is neither a placeholder nor a finite non-negative number."""
    number = as_number(text)
    usable = F.coalesce(is_finite(number) & (number >= 0), F.lit(False))
    return (~text.isin(ZEEK_EMPTY) & ~usable).cast("int")


def day_first_timestamp(text: Column) -> Column:
    """ISO text as written, slashed or dashed dates with the day first, month first only if that is impossible."""
    value = F.regexp_replace(F.trim(text), r"[TZ]", " ")
    value = F.trim(F.regexp_replace(value, r"\s+([AaPp])\s*([Mm])\s*$", " $1$2"))
    dashed = F.regexp_replace(value, r"^(\d{1,2})-(\d{1,2})-(\d{4})", "$1/$2/$3")
    iso = F.regexp_replace(value, r"^(\d{4})/(\d{1,2})/(\d{1,2})", "$1-$2-$3")
    patterns = ["H:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS][.S]", "H:mm"]
    tries = [F.try_to_timestamp(iso, F.lit(f"y-M-d {p}")) for p in patterns]
    tries.append(F.try_to_timestamp(iso, F.lit("y-M-d")))
    tries.append(F.when(value.rlike(r"^\d{8}$"), F.try_to_timestamp(value, F.lit("yyyyMMdd"))))
    for head in ("d/M/y", "M/d/y"):
        for tail in (*patterns, "h:mm:ss a", "h:mm a"):
            body = F.regexp_replace(F.upper(dashed), r"\.\d+$", "") if "a" in tail else dashed
            tries.append(F.try_to_timestamp(body, F.lit(f"{head} {tail}")))
        tries.append(F.try_to_timestamp(dashed, F.lit(head)))
    return F.coalesce(*tries)


def epoch_seconds(timestamp: Column) -> Column:
    return F.unix_micros(timestamp) / F.lit(1_000_000.0)


def zeek_tail(value: Column) -> Column:
    """(tunnel, label, detail) of the last field, split on runs of two or more blanks."""
    parts = F.split(F.trim(F.regexp_replace(value, r"^\s+|\s+$", "")), r"\s{2,}", 3)
    piece = lambda i: F.coalesce(F.try_element_at(parts, F.lit(i)), F.lit(""))
    return F.struct(piece(1).alias("tunnel"), piece(2).alias("label"), piece(3).alias("detail"))


def label_with_detail(label: Column, detail: Column) -> Column:
    label, detail = F.trim(label), F.trim(detail)
    return F.when(detail.isin("", "-"), label).otherwise(F.concat(label, F.lit(":"), detail))


def flow_attack(label: Column) -> Column:
    return (~F.lower(F.trim(label)).isin(FLOW_BENIGN)).cast("int")


def event_label(value: Column) -> Column:
    """Generic binary label: null and benign words 0, numbers by sign, any other word 1."""
    text = F.lower(F.trim(value.cast("string")))
    number = text.try_cast("double")
    return (
        F.when(text.isNull() | text.isin(EVENT_BENIGN), 0)
        .when(number.isNotNull(), F.when(F.isnan(number), 0).otherwise((number > 0).cast("int")))
        .otherwise(1)
    )


def scenario_from_path(path: Column, depth: int = 1) -> Column:
    """Lower-case ``parent_stem`` with every run of non-word characters as one underscore."""
    parent = F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)
    raw = F.concat_ws("_", parent, file_stem(path))
    return F.lower(F.regexp_replace(F.regexp_replace(raw, r"\W+", "_"), r"^_+|_+$", ""))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"(?<=.)\.[^.]*$", "")


def ancestor(path: Column, levels: int) -> Column:
    """Directory name ``levels`` above the file."""
    return F.regexp_extract(path, r"([^/]+)/" + r"[^/]+/" * (levels - 1) + r"[^/]+$", 1)


def rendered_time(epoch: Column, basis: Column) -> Column:
    """ISO second text, suffixed by what is known about its zone."""
    text = F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd'T'HH:mm:ss")
    suffix = F.when(basis == "unix_utc", F.lit("Z")).otherwise(F.lit("[timezone_unspecified]"))
    return F.concat(text, suffix)


def preferred_bytes(ip_bytes: Column, payload: Column) -> Column:
    return F.when(ip_bytes > 0, ip_bytes).otherwise(payload)


def window_floor(epoch: Column, seconds: int) -> Column:
    return (F.floor(epoch / F.lit(float(seconds))) * seconds).cast("bigint")


def normalized_location(path: Column) -> Column:
    """Last two path parts whatever the separator."""
    return F.regexp_extract(F.regexp_replace(path, r"\\", "/"), r"([^/]+/[^/]+)$", 1)
