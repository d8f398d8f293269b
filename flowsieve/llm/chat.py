"""Chat formatting with cumulative snapshots collapsed.

A logged conversation that is the beginning of a longer one, or equal to another, adds nothing. Every turn gets the hash of
the turns up to it; a conversation whose whole hash is such a prefix hash of a longer one goes. The prefix hash is a running
sum of hashes of (position, role, text), 128 bits wide: a sum over any split of a conversation, so neither the hashes nor the
rendering ever hold one conversation in one task. Each turn is rendered as a segment of its own with its offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.functions.ordering import running, sliced
from flowsieve.session import written

# fixed values of the rendering: how a turn begins and ends
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _half(seed: int) -> Column:
    hashed = F.xxhash64(F.lit(seed), "pos", F.coalesce("role", F.lit("")), F.col("role").isNull(), F.coalesce("text", F.lit("")), F.col("text").isNull())
    return hashed.cast("decimal(28,0)")


def numbered_turns(turns: DataFrame) -> DataFrame:
    """Distinct turns with ``pos`` from 0 on by (turn, role, text), the prefix hash, and the conversation's own size and hash."""
    rows = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.where("conv_id is not null").distinct()
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]
    parts = sliced(rows, ["conv_id"], order)
    counted = running(parts, ["conv_id"], order, {"upto": F.lit(1).cast("bigint")})
    counted = counted.withColumn("pos", F.col("upto") - 1)
    segment = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(CLOSE))
    counted = written(counted.withColumn("segment", segment), "turns")
    sums = {"h1": _half(1), "h2": _half(2), "after": F.length("segment").cast("bigint"), "size": F.lit(1).cast("bigint")}
    return running(counted, ["conv_id"], ["pos"], sums, totals=True)


def collapsed(turns: DataFrame) -> DataFrame:
    """The rendered turns of the conversations that stay: ``conv_id, pos, role, segment, start, n_turns, bears_loss``.

    A conversation goes if its turns are the first turns of a longer one; of equal conversations the one with the smallest
    id stays. Rows that repeat id, turn, role and text count once; other rows of one turn number are ordered by role and
    text, nulls first. A null role or text is rendered as empty and differs from an empty one. Rows without an id are in no
    conversation. ``start`` is where the segment begins in the conversation's text, so the text is its segments in order;
    ``bears_loss`` marks the assistant's turns. Other columns are ignored. An empty table gives an empty result.
    """
    marked = written(numbered_turns(turns).select(
        "conv_id", "pos", "role", "segment", "h1", "h2", "after", "size", "size_total", "h1_total", "h2_total"), "prefixes")
    whole = marked.where("size = size_total").select("conv_id", F.col("size_total").alias("n"), F.col("h1").alias("a"), F.col("h2").alias("b"))
    beginnings = marked.where("size < size_total").groupBy(F.col("size").alias("n"), F.col("h1").alias("a"), F.col("h2").alias("b")).agg(F.count(F.lit(1)).alias("longer"))
    beginnings = written(beginnings, "beginnings")
    maximal = whole.join(beginnings, ["n", "a", "b"], "left_anti")
    stay = written(maximal.groupBy("n", "a", "b").agg(F.min("conv_id").alias("conv_id")).select("conv_id"), "maximal")
    return marked.join(stay, "conv_id", "left_semi").select(
        "conv_id", "pos", "role", "segment", (F.col("after") - F.length("segment")).alias("start"), F.col("size_total").alias("n_turns"),
        F.coalesce(F.col("role") == "assistant", F.lit(False)).alias("bears_loss"))
