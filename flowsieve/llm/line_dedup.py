"""Repeated passages of lines, found by content-defined line chunks; DataFrame functions only.

A rolling hash over the hashes of the last two lines says where a chunk of lines ends, so a passage is cut alike wherever it
stands, two lines after its beginning at the latest. Chunks of several lines that occur more than once in the corpus are
candidates; they are compared byte by byte, and every occurrence but the first is taken out of its document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.session import written

#: The first hex digits of a rolling hash that end a chunk: five of sixteen, so a chunk has about three lines.
ENDS = "01234"


def line_chunks(docs: DataFrame) -> DataFrame:
    """``doc_id, own, start, n, key, bytes``: the chunks of several lines; ``start`` counts lines from 1."""
    lines = docs.withColumn("lines", F.split("text", "\n")).where(F.size("lines") > 1)
    # columns of their own, so that no line is hashed again for each of its neighbours
    hashed = lines.withColumn("hashes", F.transform("lines", F.md5)).withColumn(
        "before", F.concat(F.array(F.lit("")), F.slice("hashes", F.lit(1), F.size("hashes") - 1)))
    rolled = hashed.withColumn("ends", F.zip_with("before", "hashes", lambda a, b: F.substring(F.md5(F.concat(a, b)), 1, 1).isin(*ENDS)))
    cut = rolled.withColumn("ends", F.filter(F.transform("ends", lambda e, i: F.when(e | (i == F.size("ends") - 1), i + 1)), lambda e: e.isNotNull()))
    spans = F.zip_with(F.concat(F.array(F.lit(0)), F.slice("ends", F.lit(1), F.size("ends") - 1)), "ends", lambda a, e: F.struct((a + 1).alias("start"), (e - a).alias("n")))
    one = cut.select("doc_id", "own", "lines", F.explode(F.filter(spans, lambda s: s["n"] > 1)).alias("s"))
    body = one.select("doc_id", "own", F.col("s.start").alias("start"), F.col("s.n").alias("n"), _body(F.col("lines"), F.col("s")).alias("body"))
    return body.select("doc_id", "own", "start", "n", F.xxhash64("body").alias("key"), F.octet_length("body").alias("bytes"))


def _body(lines: Column, span: Column) -> Column:
    return F.array_join(F.slice(lines, span["start"], span["n"]), "\n")


def _beside(texts: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """Texts with their document's list; a merge at every size, for the lists grow with the corpus."""
    return texts.join(lists.hint("merge"), texts["doc_id"].eqNullSafe(F.col("_doc")) & (F.col("own") == F.col("_own")), how)


def without_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, text, lines_removed, chunks_removed``.

    Of a chunk's occurrences the one in the smallest doc_id, there the first, stays. A null text counts as empty; a text of
    one line has no chunk of several lines and comes back as it is. If all lines go the text is empty. Rows that
    repeat both id and text count as one document and come back alike; rows that share an id alone are told apart by their text.
    A null id is allowed and sorts first. Other columns are ignored. An empty table gives an empty result.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.withColumn("own", F.xxhash64("text"))
    found = written(line_chunks(texts), "chunks")
    keys = found.groupBy("key", "bytes").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    keys = written(keys.drop("times"), "chunk_keys")
    spans = found.join(keys, ["key", "bytes"], "left_semi").groupBy(F.col("doc_id").alias("_doc"), F.col("own").alias("_own"))
    spans = written(spans.agg(F.collect_set(F.struct("start", "n", "key")).alias("spans")), "spans")
    held = _beside(texts, spans, "inner").withColumn("lines", F.split("text", "\n")).select("doc_id", "own", "lines", F.explode("spans").alias("s"))
    again = held.select("doc_id", "own", F.col("s.start").alias("start"), F.col("s.n").alias("n"), F.col("s.key").alias("key"), _body(F.col("lines"), F.col("s")).alias("body"))
    # rows that repeat id and text say the same
    again = written(again, "repeated_chunks")
    # grouping by the body itself is the byte comparison
    firsts = again.groupBy("key", "body").agg(F.min(F.struct("doc_id", "own", "start")).alias("first"), F.count(F.lit(1)).alias("times"))
    firsts = written(firsts.where("times > 1").select("key", F.col("body").alias("same"), "first"), "first_chunks")
    gone = again.join(firsts, (again["key"] == firsts["key"]) & (F.col("body") == F.col("same"))).where(
        ~F.struct("doc_id", "own", "start").eqNullSafe(F.col("first")))
    lists = gone.groupBy(F.col("doc_id").alias("_doc"), F.col("own").alias("_own")).agg(F.collect_set(F.struct("start", "n")).alias("gone"))
    lists = written(lists, "removals")
    joined = _beside(texts, lists, "left")
    lines = F.split("text", "\n")
    kept = F.array_join(F.filter(lines, lambda l, i: ~F.exists("gone", lambda g: (i + 1 >= g["start"]) & (i + 1 < g["start"] + g["n"]))), "\n")
    return joined.select(
        "doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"),
        F.coalesce(F.aggregate("gone", F.lit(0), lambda a, g: a + g["n"]), F.lit(0)).cast("bigint").alias("lines_removed"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("chunks_removed"))
