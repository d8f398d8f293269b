"""Exact linear-interpolation quantiles without holding a group's values in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.functions.ordering import SLICE, running, sliced


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """One column per name in ``wanted``; nulls are ignored.

    Values are counted, the counts accumulated slice by slice, and each quantile reads
    the one or two values whose rank range covers its position.
    """
    counted = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v")).groupBy(
        *by, "_v").agg(F.count(F.lit(1)).alias("_c"))
    ranked = running(sliced(counted, by, ["_v"]), by, ["_v"], {"_upto": F.col("_c")}, totals=True).drop(SLICE)
    columns, results = [], []
    for i, (name, q) in enumerate(wanted.items()):
        place = F.lit(q) * (F.col("_upto_total") - 1)
        low, high = F.floor(place), F.ceil(place)
        covers = lambda at: (F.col("_upto") > at) & (F.col("_upto") - F.col("_c") <= at)
        columns += [
            F.max(F.when(covers(low), F.col("_v"))).alias(f"_l{i}"), F.max(F.when(covers(high), F.col("_v"))).alias(f"_h{i}"),
            F.max(place - low).alias(f"_f{i}")]
        results.append((F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * F.col(f"_f{i}")).alias(name))
    return ranked.groupBy(*by).agg(*columns).select(*by, *results)
