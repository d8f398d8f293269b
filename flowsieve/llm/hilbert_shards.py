"""Shards as runs of a Hilbert curve through the documents' metadata; DataFrame functions only.

Every dimension is quantised into cells of about equally many rows: the cell of a value is the share of rows below it, found
from counts of distinct values, so only the cells' lower bounds (2 ** bits - 1 values a dimension) reach the driver. Rows are
ordered by the curve's index over the cells, then by the dimensions, the text's digest and the id, and the order is cut into
runs whose row counts differ by one at most. A shard so covers a compact box of the metadata, and a filter on any of the
dimensions leaves most shards unread.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.functions.ordering import running, sliced
from flowsieve.session import written

#: The metadata through which the curve runs, and the bits of a cell's number.
DIMENSIONS = ("lang", "source", "size")
BITS, SHARDS = 4, 24
#: ``monotonically_increasing_id`` has the partition above these bits and the row's place in it below.
PLACE_BITS = 33


def curve_steps(n: int, bits: int, xor: Callable[[str, str], str]) -> Iterator[dict[str, str]]:
    """SQL that turns cell numbers ``x0 .. x(n-1)`` into ``curve``, one projection after another.

    Skilling's transform: undo the rotations from the highest bit down, Gray code, then interleave the bits.
    """
    x = [f"x{i}" for i in range(n)]
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for i, c in enumerate(x):
            swap = f"({xor(x[0], c)} & {low})"
            hit = f"(({c} >> {bit}) & 1) = 1"
            changed = {x[0]: f"CASE WHEN {hit} THEN {xor(x[0], str(low))} ELSE {xor(x[0], swap)} END"}
            if i:
                changed[c] = f"CASE WHEN {hit} THEN {c} ELSE {xor(c, swap)} END"
            yield changed
    for before, c in zip(x, x[1:]):
        yield {c: xor(c, before)}
    turn = "0"
    for bit in range(bits - 1, 0, -1):
        turn = xor(turn, f"((({x[-1]} >> {bit}) & 1) * {(1 << bit) - 1})")
    yield {c: xor(c, turn) for c in x}
    places = [f"((({c} >> {bit}) & 1) * {1 << (bit * n + n - 1 - i)})" for bit in range(bits) for i, c in enumerate(x)]
    yield {"curve": " + ".join(places)}


def cell_bounds(rows: DataFrame, dimension: str, bits: int) -> list:
    """Lower bounds of the cells 1, 2, ... of one dimension: at most ``2 ** bits - 1`` values, in order; nulls sort first."""
    counted = rows.groupBy(dimension).agg(F.sum("rows").alias("rows"))
    parts = running(sliced(counted, [], [F.col(dimension).asc_nulls_first()]), [], [F.col(dimension).asc_nulls_first()], {"upto": F.col("rows")}, totals=True)
    cell = F.expr(f"(upto - rows) * {1 << bits} div upto_total")
    firsts = parts.groupBy(cell.alias("cell")).agg(F.min(dimension).alias("bound")).where("cell > 0").orderBy("cell").collect()
    # a cell number that no value has falls together with the next one that has
    bounds, at = [], 0
    for r in firsts:
        bounds += [(r["bound"], r["cell"] - at)]
        at = r["cell"]
    return bounds


def _cell(column: Column, bounds: list) -> Column:
    """Cell number of a value; null lies in the first cell."""
    return sum((F.when(column >= F.lit(b), step).otherwise(0) for b, step in bounds), F.lit(0)).cast("bigint")


def curve_order(docs: DataFrame, dimensions: Sequence[str] = DIMENSIONS, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` plus ``curve, place, size, text_crc32``, written in curve order.

    ``place`` holds the written slice and the row's place in it. Texts move once, in the range shuffle.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = {"size": F.octet_length(text).cast("bigint") + 8, "text_crc32": F.crc32(text), "_digest": F.md5(text)}
    taken = {"curve", "place", *own, *(f"x{i}" for i in range(len(dimensions)))}
    rows = docs.drop(*(taken - {id_col, text_col} - {d for d in dimensions if d not in own}))
    rows = rows.withColumns(own)
    kinds = written(rows.groupBy(*dict.fromkeys(dimensions)).agg(F.count(F.lit(1)).alias("rows")), "kinds")
    rows = rows.withColumns({f"x{i}": _cell(F.col(d), cell_bounds(kinds, d, bits)) for i, d in enumerate(dimensions)})
    for step in curve_steps(len(dimensions), bits, lambda a, b: f"({a} ^ {b})"):
        rows = rows.withColumns({c: F.expr(e).cast("bigint") for c, e in step.items()})
    keys = ["curve", *dimensions, "_digest", id_col]
    ordered = rows.drop(*(f"x{i}" for i in range(len(dimensions)))).repartitionByRange(*keys).sortWithinPartitions(*keys)
    return written(ordered.withColumn("place", F.monotonically_increasing_id()).drop("_digest"), "curve_order")


def sharded(docs: DataFrame, shards: int = SHARDS, dimensions: Sequence[str] = DIMENSIONS, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with its own columns and ``size, text_crc32, curve, shard, slot``.

    Row counts of shards differ by one at most, the earlier shards being the larger ones; ``slot`` counts from 0 in a shard. A null
    text is empty: size 8, checksum 0. Null metadata sorts first. Rows with equal metadata lie by the text's digest, then by
    the id, so equal texts in one cell lie together; rows alike in all of them are in any order, which shows in columns outside
    the order only. Equal ids, a hot source or a third of all rows with one text are cut like any other rows, for the id is
    part of the order. Texts of any length move whole. With fewer rows than shards the last shards stay empty; an empty
    table gives an empty result. Columns that have the names of the new ones are replaced.
    """
    rows = curve_order(docs, dimensions, bits, id_col, text_col)
    part = F.shiftright("place", PLACE_BITS)
    # one row a slice; its rows come before those of all later slices
    slices = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    window = Window.partitionBy(F.lit(0))
    slices = written(slices.select(
        "_part", (F.sum("_rows").over(window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_rows")).alias("_base"),
        F.sum("_rows").over(window).alias("_all")), "slices")
    placed = rows.drop("shard", "slot").withColumn("_part", part).join(slices, "_part")
    placed = placed.withColumn("_rank", F.col("_base") + F.col("place").bitwiseAND((1 << PLACE_BITS) - 1))
    placed = placed.withColumns({"_least": F.expr(f"_all div {shards}"), "_more": F.expr(f"_all % {shards}")})
    placed = placed.withColumn("_long", F.expr("_more * (_least + 1)"))
    # the branch not taken would divide by zero where there are fewer rows than shards
    placed = placed.withColumns({
        "shard": F.expr("IF(_rank < _long, _rank div (_least + 1), _more + (_rank - _long) div greatest(_least, 1))").cast("int"),
        "slot": F.expr("IF(_rank < _long, _rank % (_least + 1), (_rank - _long) % greatest(_least, 1))")})
    return placed.drop("place", "_part", "_base", "_all", "_rank", "_least", "_more", "_long")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, dimensions: Sequence[str] = DIMENSIONS) -> None:
    """Write the shards as folders ``shard=0, shard=1, ...`` of Parquet files in curve order, by the slices the rows already lie in."""
    sharded(docs, shards, dimensions).write.partitionBy("shard").mode("errorifexists").parquet(path)


def digest(shards: DataFrame) -> DataFrame:
    """The columns that say where each row lies: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``."""
    return shards.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
