"""Ordered computations that no single task has to hold.

A plain analytic window puts a whole group into one task. Here the rows are first
range-partitioned on ``(group keys, order keys)`` and written with their slice
number, so a group of any size is cut into as many slices as it needs; each slice
then only needs one carried value per group from the slices before it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.session import written

SLICE = "_slice"


def _plain(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def sliced(
    df: DataFrame, by: Sequence[str], order: Sequence[str | Column], slices: int | None = None,
    then: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Rows plus ``_slice``, increasing along ``order`` inside every group of ``by``.

    Group keys must not be null, so that later joins stay plain equi-joins on the
    partitioning the rows already have. ``then`` runs after the range shuffle, so costly
    columns are computed once and not again by the pass that samples the ranges.
    """
    keys = [*(F.col(c) for c in by), *_plain(order)]
    named = df.withColumns({
        c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"null group key {c}")).cast(t)).otherwise(F.col(c))
        for c, t in df.dtypes if c in by
    }) if by else df
    # without a number, adaptive execution merges neighbouring ranges up to its advisory size
    ranged = named.repartitionByRange(slices, *keys) if slices else named.repartitionByRange(*keys)
    ranged = ranged.withColumn(SLICE, F.spark_partition_id())
    return written(then(ranged) if then else ranged, "sliced")


def running(
    df: DataFrame, by: Sequence[str], order: Sequence[str | Column], sums: dict[str, Column],
    *, totals: bool = False, descending: bool = False,
) -> DataFrame:
    """Inclusive running sums along ``order`` per group of a sliced frame.

    With ``descending`` the caller's ``order`` runs against the slice numbers.
    ``totals`` adds ``<name>_total`` per group.
    """
    per_slice = df.groupBy(*by, SLICE).agg(*[F.sum(c).alias(f"_sum_{n}") for n, c in sums.items()])
    along = F.col(SLICE).desc() if descending else F.col(SLICE).asc()
    # one row per (group, slice): at most as many rows per group as there are slices
    earlier = Window.partitionBy(*by, F.lit(0)).orderBy(along).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by, F.lit(0))
    carried = per_slice.select(
        *by, SLICE,
        *[F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_base_{n}") for n in sums],
        *([F.sum(f"_sum_{n}").over(whole).alias(f"{n}_total") for n in sums] if totals else []),
    )
    local = Window.partitionBy(*by, SLICE).orderBy(*_plain(order)).rowsBetween(Window.unboundedPreceding, 0)
    inside = df.withColumns({f"_run_{n}": F.sum(c).over(local) for n, c in sums.items()})
    joined = inside.join(carried, [*by, SLICE], "left")
    return joined.withColumns(
        {n: F.col(f"_run_{n}") + F.col(f"_base_{n}") for n in sums}
    ).drop(*[f"_run_{n}" for n in sums], *[f"_base_{n}" for n in sums])


def lagged(
    df: DataFrame, by: Sequence[str], order: Sequence[str | Column], column: str, name: str, default: Column | None = None,
) -> DataFrame:
    """Value of ``column`` on the row before, per group of a sliced frame."""
    keys = _plain(order)
    local = Window.partitionBy(*by, SLICE).orderBy(*keys)
    tails = df.groupBy(*by, SLICE).agg(
        F.max_by(F.struct(F.col(column).alias("v")), F.struct(*keys)).alias("_tail"),
    )
    carried = tails.select(
        *by, SLICE,
        F.lag("_tail").over(Window.partitionBy(*by, F.lit(0)).orderBy(SLICE))["v"].alias("_carry"),
    )
    inside = df.withColumns({
        "_first": F.row_number().over(local) == 1,
        "_local": F.lag(column).over(local),
    })
    fallback = F.lit(None) if default is None else default
    joined = inside.join(carried, [*by, SLICE], "left")
    value = F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_local"))
    return joined.withColumn(name, F.coalesce(value, fallback)).drop("_first", "_local", "_carry")


def last_before(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], columns: dict[str, Column]) -> DataFrame:
    """For each column its last value that is not null on the rows before, per group of a sliced frame; null if there is none.

    All columns are carried together: one value a (group, slice) and column crosses the slices, and the rows themselves are sorted once.
    """
    keys = _plain(order)
    named = df.withColumns({f"_own_{n}": c for n, c in columns.items()})
    tails = named.groupBy(*by, SLICE).agg(*[
        F.max_by(f"_own_{n}", F.when(F.col(f"_own_{n}").isNotNull(), F.struct(*keys))).alias(f"_tail_{n}") for n in columns])
    # one row per (group, slice): at most as many rows per group as there are slices
    earlier = Window.partitionBy(*by, F.lit(0)).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select(*by, SLICE, *[F.last(f"_tail_{n}", ignorenulls=True).over(earlier).alias(f"_carry_{n}") for n in columns])
    local = Window.partitionBy(*by, SLICE).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    inside = named.withColumns({f"_near_{n}": F.last(f"_own_{n}", ignorenulls=True).over(local) for n in columns})
    joined = inside.join(carried, [*by, SLICE], "left")
    return joined.withColumns({n: F.coalesce(f"_near_{n}", f"_carry_{n}") for n in columns}).drop(
        *[f"_{part}_{n}" for part in ("own", "near", "carry") for n in columns])


def numbered(df: DataFrame, order: Sequence[str | Column], name: str = "row_index", slices: int | None = None) -> DataFrame:
    """Zero-based position in the total order, plus ``<name>_total``."""
    parts = sliced(df, [], order, slices)
    counted = running(parts, [], order, {name: F.lit(1).cast("bigint")}, totals=True)
    return counted.withColumn(name, F.col(name) - 1).drop(SLICE)
