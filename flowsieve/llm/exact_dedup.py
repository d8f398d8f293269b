"""Exact duplicates by content-defined chunk recipes.

A document becomes the ordered list of its chunks' identifiers. Chunks are cut where a rolling hash of the last 16 bytes
says so, so equal passages give equal chunks. A chunk's identifier is its 64-bit fingerprint and length; that identifier is
verified over the whole corpus by SHA-256: where one fingerprint stands for several contents, each content gets an identifier
of its own. Texts are equal exactly when their identifier lists are; only fingerprints and digests move, never the texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.llm.common import by_text
from flowsieve.session import written

WINDOW, LEAST, MASK, MOST = 16, 512, (1 << 11) - 1, 16_384
_GEAR = np.random.default_rng(20).integers(0, 2**64, 256, dtype=np.uint64)
_CHUNKS = pa.schema([
    ("doc_id", pa.int64()), ("text_sha256", pa.string()), ("pos", pa.int32()), ("fp", pa.int64()), ("n", pa.int32()), ("sha", pa.binary()),
])


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``; a cut depends on the 16 bytes before it and on the distance to the last cut."""
    size = len(data)
    if size <= LEAST:
        return [size]
    rolling = _GEAR[np.frombuffer(data, np.uint8)]
    step = 1
    while step < WINDOW:
        rolling[step:] += rolling[:-step] << np.uint64(step)
        step *= 2
    found, last = [], 0
    marks = np.flatnonzero((rolling >> np.uint64(8)) & np.uint64(MASK) == 0) + 1
    for mark in [*marks.tolist(), size]:
        if mark - last < LEAST and mark < size:
            continue
        while mark - last > MOST:
            last += MOST
            found.append(last)
        if mark > last:
            found.append(mark)
            last = mark
    return found


def _chunk_columns(batch: pa.RecordBatch) -> dict:
    out: dict[str, list] = {name: [] for name in _CHUNKS.names}
    for doc, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        digest, start = hashlib.sha256(data).hexdigest(), 0
        for pos, end in enumerate(cuts(data)):
            chunk = data[start:end]
            for name, value in zip(out, (doc, digest, pos, xxhash.xxh3_64_intdigest(chunk) - 2**63, end - start, hashlib.sha256(chunk).digest())):
                out[name].append(value)
            start = end
    return out


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256, n_chunks``.

    A null text counts as empty, and all empty texts are equal. Of equal texts the row with the largest id stays. Rows that
    repeat both id and text are separate rows of one group, of which one stays. A null id is never chosen over another id.
    Other columns are ignored, so their names cannot clash. An empty table gives an empty result.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    chunks = written(texts.mapInArrow(by_text(_chunk_columns, _CHUNKS), "doc_id bigint, text_sha256 string, pos int, fp bigint, n int, sha binary"), "chunks")
    shared = chunks.groupBy("fp", "n").agg(F.min("sha").alias("lo"), F.max("sha").alias("hi")).where("lo <> hi")
    shared = written(shared.select("fp", "n", F.lit(True).alias("several")), "fingerprints")
    named = chunks.join(shared, ["fp", "n"], "left").select(
        "doc_id", "text_sha256", "pos",
        F.struct("fp", "n", F.when(F.col("several"), F.col("sha")).otherwise(F.lit(b"")).alias("variant")).alias("chunk"))
    recipes = named.groupBy("doc_id", "text_sha256").agg(
        F.array_sort(F.collect_set(F.struct("pos", "chunk"))).alias("found"), F.count_if(F.col("pos") == 0).alias("rows"))
    recipes = written(recipes.select("doc_id", "text_sha256", "rows", F.col("found.chunk").alias("recipe")), "recipes")
    groups = recipes.groupBy("recipe").agg(F.max("doc_id").alias("keep"), F.sum("rows").alias("size")).where("size > 1")
    groups = written(groups, "groups")
    whole = recipes.join(groups, "recipe", "left").select(
        "doc_id", F.coalesce("keep", "doc_id").alias("keep_id"), F.coalesce("size", F.lit(1)).alias("group_size"),
        "text_sha256", F.size("recipe").cast("bigint").alias("n_chunks"),
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("rows"))).alias("copy"))
    return whole.select(
        "doc_id", "keep_id", F.col("group_size").cast("bigint").alias("group_size"),
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256", "n_chunks")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows equal in id and text, one."""
    from pyspark.sql import Window

    stay = exact_duplicates(docs).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    marked = docs.withColumn("_sha", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    left = marked.join(stay, marked["doc_id"].eqNullSafe(stay["_id"]) & (marked["_sha"] == stay["_sha"]), "left_semi")
    once = left.withColumn("_row", F.row_number().over(Window.partitionBy("doc_id", "_sha").orderBy(F.lit(1))))
    return once.where("_row = 1").select(*docs.columns)
