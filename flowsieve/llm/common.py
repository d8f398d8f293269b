"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.session import written


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def small_slices(batch: pa.RecordBatch, column: int, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the given text or binary column holds about ``most`` bytes per part; no row is lost."""
    texts = batch.column(column)
    if texts.nbytes <= most:
        if batch.num_rows:
            yield batch
        return
    start = size = 0
    for row, length in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if size and size + length > most:
            yield batch.slice(start, row - start)
            start, size = row, 0
        size += length
    yield batch.slice(start)


def by_text(make: Callable[[pa.RecordBatch], dict], schema: pa.Schema) -> Callable:
    """A ``mapInArrow`` function: ``make`` turns a small batch, whose column 1 is the text, into output columns."""
    def run(batches):
        for batch in batches:
            for part in small_slices(batch, 1):
                yield pa.RecordBatch.from_pydict(make(part), schema=schema)
    return run


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``a - b``: rows ``v, comp``, where ``comp`` is the smallest vertex reachable.

    Labels take the minimum over the neighbours and over the label's own label, so paths shrink by doubling. Every
    round is a written table. A hub's edges are pre-aggregated by task, and its joins are ones that Spark can split.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both.where("a <> b"), "edges")
    labels = written(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("l")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("v")).groupBy("a").agg(F.min("l").alias("m"))
        up = labels.select(F.col("v").alias("p"), F.col("l").alias("pl"))
        new = (
            labels.join(near, F.col("v") == F.col("a"), "left").join(up, F.col("l") == F.col("p"), "left")
            .select("v", F.least("l", "m", "pl").alias("l"), (F.least("l", "m", "pl") < F.col("l")).alias("moved"))
        )
        new = written(new, "labels")
        labels = new.drop("moved")
        if new.where("moved").isEmpty():
            return labels.withColumnRenamed("l", "comp")
