"""Token ids in fixed-width bit packing.

A token table is a folder of Parquet files whose rows are blocks. A block holds whole documents' ids or parts of them, each
id in as few bits as the vocabulary needs, lowest bit first, so that numpy unpacks a block in a few vector operations. With
it stand the block's place (shard, block, first id in the shard) and, for each document in it, id and count. Random access
reads one block: the row filter on shard and first id prunes row groups. Spark's writer commits each task's file or none.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.llm.common import small_slices
from flowsieve.llm.tokens import END_ID, encoder, tokenizer_path

VOCABULARY = 50_257
BLOCK = 65_536
_BLOCKS = pa.schema([
    ("shard", pa.int32()), ("block", pa.int64()), ("first", pa.int64()), ("n", pa.int32()), ("bits", pa.int32()), ("payload", pa.binary()),
    ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int64())), ("doc_counts", pa.list_(pa.int32())), ("doc_ends", pa.list_(pa.bool_())),
])
BLOCKS = ("shard int, block bigint, first bigint, n int, bits int, payload binary, doc_ids array<bigint>, doc_starts array<bigint>, doc_counts array<int>, "
          "doc_ends array<boolean>")


def width(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """The ids' low ``bits`` bits, one after another, lowest first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype("<u4")[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes, n: int, bits: int, start: int = 0) -> np.ndarray:
    """``n`` ids from id ``start`` on; only the bytes they stand in are touched."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n, start * bits // 8).astype("<u4")
    first = start * bits // 8
    raw = np.frombuffer(data, np.uint8)[first:(start + n) * bits // 8 + 1]
    shift = start * bits - 8 * first
    spread = np.unpackbits(raw, bitorder="little")[shift:shift + n * bits].reshape(n, bits).astype(np.uint32)
    return (spread << np.arange(bits, dtype=np.uint32)).sum(1, dtype=np.uint32).astype("<u4")


def _write_blocks(path: str, vocabulary: int, size: int):
    bits = width(vocabulary)

    def run(batches):
        from pyspark import TaskContext

        encode, shard = encoder(path), TaskContext.get().partitionId()
        held, docs, block, first, total = np.empty(0, "<u4"), [], 0, 0, 0

        def cut(last: bool):
            nonlocal held, docs, block, first
            out = {n: [] for n in _BLOCKS.names}
            while len(held) >= size or last and len(held):
                take, part, left = min(size, len(held)), [], []
                room = take
                for k, (doc, start, count) in enumerate(docs):
                    if not room:
                        left = docs[k:]
                        break
                    here = min(room, count)
                    part.append((doc, start, here, here == count))
                    room -= here
                    if here < count:
                        left = [(doc, start, count - here), *docs[k + 1:]]
                        break
                row = (shard, block, first, take, bits, pack_bits(held[:take], bits), *([d[k] for d in part] for k in range(4)))
                for name, value in zip(out, row):
                    out[name].append(value)
                held, docs, block, first = held[take:], left, block + 1, first + take
            return pa.RecordBatch.from_pydict(out, schema=_BLOCKS)

        for batch in batches:
            for part in small_slices(batch, 1, 2_000_000):
                ids = [np.frombuffer(i + END_ID.to_bytes(4, "little"), "<u4") for i in encode(part.column(1).to_pylist())]
                for doc, own in zip(part.column(0).to_pylist(), ids):
                    docs.append((doc, total, len(own)))
                    total += len(own)
                held = np.concatenate([held, *ids])
                if len(held) and int(held.max()) >= 1 << bits:
                    raise ValueError("an id does not fit the vocabulary's width")
                yield cut(False)
        yield cut(True)
    return run


def write_tokens(
    docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
    vocabulary: int = VOCABULARY, size: int = BLOCK,
) -> None:
    """Write all documents' ids, each followed by the end id, in ascending order of their id; null ids come first.

    A null text is empty. Repeated ids are written each, in any order among themselves. Shards follow each other in that
    order: a shard is a range of ids, sized by Spark's own sampling. An empty table gives a folder without blocks.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = texts.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    blocks = ranged.mapInArrow(_write_blocks(path or tokenizer_path("byte_bpe_50k.json"), vocabulary, size), BLOCKS)
    blocks.write.parquet(folder)


_PARTS = pa.schema([
    ("shard", pa.int32()), ("doc_start", pa.int64()), ("doc_id", pa.int64()), ("first", pa.int64()), ("count", pa.int64()), ("crc", pa.int64()), ("whole", pa.bool_()),
])
_PART_ROW = "shard int, doc_start bigint, doc_id bigint, first bigint, count bigint, crc bigint, whole boolean"


def _parts(batches):
    for batch in batches:
        out: dict[str, list] = {n: [] for n in _PARTS.names}
        for r in batch.to_pylist():
            ids, at = unpack_bits(r["payload"], r["n"], r["bits"]).tobytes(), 0
            for doc, start, count, ends in zip(r["doc_ids"], r["doc_starts"], r["doc_counts"], r["doc_ends"]):
                first = r["first"] + at
                row = (r["shard"], start, doc, first, count, zlib.crc32(ids[4 * at:4 * (at + count)]), ends and first == start)
                for name, value in zip(out, row):
                    out[name].append(value)
                at += count
        yield pa.RecordBatch.from_pydict(out, schema=_PARTS)


def joined_crc(parts: list[tuple[int, int]]) -> int:
    """Crc of a whole from the ``(crc, bytes)`` of its parts: crc(ab) = crc(a 0..0) ^ crc(0..0) ^ crc(b)."""
    whole = 0
    for crc, size in parts:
        zeros = bytes(size)
        whole = zlib.crc32(zeros, whole) ^ zlib.crc32(zeros) ^ crc
    return whole


def _joined(batches):
    for batch in batches:
        rows = batch.to_pylist()
        yield pa.RecordBatch.from_pydict({
            "shard": [r["shard"] for r in rows], "doc_start": [r["doc_start"] for r in rows], "doc_id": [r["doc_id"] for r in rows],
            "count": [sum(p["count"] for p in r["parts"]) for r in rows],
            "crc": [joined_crc([(p["crc"], 4 * p["count"]) for p in sorted(r["parts"], key=lambda p: p["first"])]) for r in rows],
        }, schema=pa.schema([_PARTS.field(n) for n in ("shard", "doc_start", "doc_id", "count", "crc")]))


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of a token table: ``doc_id, start, n_tokens, ids_crc32``, where start counts the ids of all documents before."""
    blocks = spark.read.schema(BLOCKS).parquet(folder)
    parts = blocks.select("shard", "first", "n", "bits", "payload", "doc_ids", "doc_starts", "doc_counts", "doc_ends").mapInArrow(_parts, _PART_ROW)
    cut = parts.where("not whole").groupBy("shard", "doc_start", "doc_id").agg(F.collect_list(F.struct("first", "count", "crc")).alias("parts"))
    cut = cut.mapInArrow(_joined, "shard int, doc_start bigint, doc_id bigint, count bigint, crc bigint")
    found = parts.where("whole").select("shard", "doc_start", "doc_id", "count", "crc").union(cut)
    # one row per file of the table
    sizes = sorted((r["shard"], r["n"]) for r in blocks.groupBy("shard").agg(F.sum("n").alias("n")).collect())
    bases, before = [], 0
    for shard, n in sizes:
        bases.append((shard, before))
        before += n
    base = spark.createDataFrame(bases, "shard int, base bigint")
    return found.join(base, "shard").select(
        "doc_id", (F.col("base") + F.col("doc_start")).alias("start"), F.col("count").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


def read_ids(spark: SparkSession, folder: str, shard: int, start: int, n: int) -> np.ndarray:
    """``n`` ids of a shard from id ``start`` on, from the blocks that hold them alone."""
    held = spark.read.schema(BLOCKS).parquet(folder).where(
        (F.col("shard") == shard) & (F.col("first") < start + n) & (F.col("first") + F.col("n") > start)).orderBy("first")
    out = []
    for r in held.select("first", "n", "bits", "payload").toLocalIterator():
        low, high = max(start, r["first"]), min(start + n, r["first"] + r["n"])
        out.append(unpack_bits(bytes(r["payload"]), high - low, r["bits"], low - r["first"]))
    return np.concatenate(out) if out else np.empty(0, "<u4")
