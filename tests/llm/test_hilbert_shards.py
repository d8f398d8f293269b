"""Shards along a Hilbert curve: the curve, the law, odd rows and pruning."""

from __future__ import annotations

import zlib

import pytest
from pyspark.sql import functions as F

from flowsieve.llm import hilbert_shards as hs


@pytest.mark.parametrize(("n", "bits"), [(1, 3), (2, 3), (3, 2), (4, 2)])
def test_neighbours_on_the_curve_are_neighbours_in_space(spark, n, bits):
    cells = spark.range(1 << (n * bits)).select(*[F.expr(f"(id >> {i * bits}) & {(1 << bits) - 1}").alias(f"x{i}") for i in range(n)])
    cells = cells.withColumns({f"o{i}": F.col(f"x{i}") for i in range(n)})
    for step in hs.curve_steps(n, bits, lambda a, b: f"({a} ^ {b})"):
        cells = cells.withColumns({c: F.expr(e) for c, e in step.items()})
    along = sorted((r["curve"], [r[f"o{i}"] for i in range(n)]) for r in cells.collect())
    assert [k for k, _ in along] == list(range(1 << (n * bits)))
    assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for (_, p), (_, q) in zip(along, along[1:]))


def check(found, n, shards):
    sizes = [0] * shards
    for r in sorted(found, key=lambda r: (r["shard"], r["slot"])):
        assert r["slot"] == sizes[r["shard"]]
        sizes[r["shard"]] += 1
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1


def test_odd_rows(spark, rows):
    long = "wörd " * 40_000
    table = [(1, "a", "en", "s"), (1, "a", "en", "s"), (2, None, None, None), (3, "", "de", "s"), (None, "a", "en", None), (4, long, "en", "t"), (5, "a", "en", "s")]
    frame = spark.createDataFrame([(*r, "x", 7, True, 1.0) for r in table], "doc_id bigint, text string, lang string, source string, size string, shard int, slot boolean, curve double")
    for shards in (24, 3):
        out = hs.sharded(frame, shards)
        assert out.columns == ["doc_id", "text", "lang", "source", "size", "text_crc32", "curve", "shard", "slot"]
        found = rows(out)
        check(found, len(table), shards)
        assert sorted((str(r["doc_id"]), r["text"] or "", r["size"], r["text_crc32"]) for r in found) == sorted(
            (str(k), t or "", len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for k, t, *_ in table)
    assert hs.sharded(frame.limit(0)).count() == 0
    assert [r["law"] for r in rows(hs.digest(hs.sharded(frame)))] == ["rows"] * len(table)
    plan = hs.sharded(frame)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_hot_text_is_cut_and_slices_agree(spark, rows):
    frame = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.concat(F.lit("t"), "id")).alias("text"),
                                     F.lit("en").alias("lang"), (F.col("id") % 5).cast("string").alias("source"))
    frame = frame.repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = rows(hs.digest(hs.sharded(frame)), "doc_id")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    check(found, 3000, 24)
    assert found == rows(hs.digest(hs.sharded(frame.coalesce(1))), "doc_id")


def test_written_shards_prune(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    hs.write_shards(docs, f"{tmp_path}/s")
    back = spark.read.parquet(f"{tmp_path}/s")
    assert back.count() == docs.count() and back.drop("size", "text_crc32", "curve", "shard", "slot").exceptAll(docs).isEmpty()

    def touched(column):
        """Shards whose range of a column holds a value, on average over the rows' values."""
        ranges = back.groupBy("shard").agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
        return docs.join(ranges, F.col(column).between(F.col("lo"), F.col("hi"))).count() / docs.where(F.col(column).isNotNull()).count()

    # 24 shards: an order by one column prunes that column alone
    assert touched("lang") < 16 and touched("source") < 18 and touched("n_chars") < 12
