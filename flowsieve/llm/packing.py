"""Vector bin packing of token sequences: tokens, segments and loss-bearing tokens are limited together.

Every task packs the documents it reads as a stream: it holds a bounded pool of pieces, fills one sequence after another by
the dot-product rule and carries what is left to the next batch. There is no shuffle, and a repeated task gives the same
sequences, because its input split is the same.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.llm.common import small_slices
from flowsieve.llm.tokens import END_ID, encoder, tokenizer_path


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold. Documents bear loss on every token; a piece of a document is one segment."""

    tokens: int = 4096
    segments: int = 512
    loss: int = 4096


class Packer:
    """Fills sequences from a pool of pieces ``(key, start, tokens, loss)``.

    The next piece is the one whose vector (tokens, one segment, loss), each divided by its limit, has the largest dot
    product with what the sequence has left; it has to fit. If none fits and room is left, the smallest piece that is too
    long is cut, so a sequence stays short only at the end of a task, or when another limit than tokens is met.
    """

    def __init__(self, limits: Limits, pool: int = 256):
        self.limits, self.pool = limits, pool
        self.most = np.array([limits.tokens, limits.segments, limits.loss], float)
        self.items: list[tuple] = []
        self.sequence = 0

    def feed(self, items, last: bool = False):
        """Take pieces; give ``(piece, sequence, offset)`` for each that is placed."""
        self.items.extend(items)
        while self.items and (last or len(self.items) > self.pool):
            yield from self._fill(self.pool * 2)

    def _fill(self, seen: int):
        near, later = self.items[:seen], self.items[seen:]
        size = np.array([(i[2], 1, i[3]) for i in near], float)
        free, left = np.ones(len(near), bool), self.most.copy()
        offset = 0
        rest = []
        while left[0] > 0 and left[1] > 0 and free.any():
            fits = free & (size <= left).all(1)
            if fits.any():
                score = (size / self.most) @ (left / self.most)
                best = int(np.argmax(np.where(fits, score, -1)))
                piece = near[best]
            else:
                longer = np.flatnonzero(free & (size[:, 0] > 0))
                best = int(longer[np.argmin(size[longer, 0])])
                key, start, tokens, loss = near[best]
                part = int(min(left[0], tokens if loss == 0 else left[2] if loss >= tokens else left[2] * tokens // loss))
                if part <= 0:
                    break
                borne = loss * part // tokens
                piece = (key, start, part, borne)
                if part < tokens:
                    rest.append((key, start + part, tokens - part, loss - borne))
            free[best] = False
            yield piece, self.sequence, offset
            offset += piece[2]
            left -= (piece[2], 1, piece[3])
        self.sequence += 1
        self.items = rest + [i for i, f in zip(near, free) if f] + later


_PIECES = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def _pack(path: str, limits: Limits, pool: int, with_ids: bool):
    schema = _PIECES.append(pa.field("ids", pa.binary())) if with_ids else _PIECES

    def run(batches):
        encode, packer, held = encoder(path), Packer(limits, pool), {}
        first, number = TaskContext.get().partitionId() << 40, 0

        def placed(found):
            out = {n: [] for n in schema.names}
            for (key, start, length, _), sequence, offset in found:
                doc, ids, used = held[key]
                part = ids[4 * start:4 * (start + length)]
                row = (doc, start, length, zlib.crc32(part), len(ids) // 4, first + sequence, offset, part)
                for name, value in zip(out, row):
                    out[name].append(value)
                held[key][2] = used + length
                if used + length == len(ids) // 4:
                    del held[key]
            return pa.RecordBatch.from_pydict(out, schema=schema)

        for batch in batches:
            for part in small_slices(batch, 1, 2_000_000):
                docs = part.column(0).to_pylist()
                items = []
                for doc, ids in zip(docs, encode(part.column(1).to_pylist())):
                    ids += END_ID.to_bytes(4, "little")
                    count = len(ids) // 4
                    held[number] = [doc, ids, 0]
                    items.append((number, 0, count, count))
                    number += 1
                yield placed(packer.feed(items))
        yield placed(packer.feed([], last=True))
    return run


def packed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limits: Limits = Limits(),
    pool: int = 256, with_ids: bool = False,
) -> DataFrame:
    """Pieces of documents placed in sequences: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    With ``with_ids`` each piece carries its ids as little-endian unsigned 32-bit integers. A null or empty text is its end
    id alone. Rows that repeat an id are packed each; a null id is carried through. A document longer than a sequence is cut.
    Other columns are ignored. An empty table gives no piece. Sequence ids are unique, not gapless: the task's number stands
    in the upper bits.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.mapInArrow(_pack(path or tokenizer_path("word_bpe_49k.json"), limits, pool, with_ids), PIECES + (", ids binary" if with_ids else ""))
