"""SentencePiece encoding and decoding by a streaming Viterbi search.

A boundary of the text holds the best segmentation up to it as a score and a backpointer. In a unigram model the score is the
sum of the pieces' scores. A BPE model's ids are those of its merges, which no sum gives; but a segmentation is the merges'
result exactly when each two neighbours in it, merged alone, stay as they are. So there two neighbouring pieces weigh
nothing or forbid each other, and one path to each boundary survives. The search keeps boundaries only as far back as a piece
can reach. Whenever the backpointer paths of all of them meet in one boundary, the ids before it are final and are given out;
what is kept does not grow with the text. A boundary that no piece of the vocabulary crosses, as before a space mark, is such
a meeting point in every text, so equal segments between them give equal ids; a worker remembers short ones up to a bound.
Characters without a piece fall back to their UTF-8 bytes' pieces.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.llm.common import small_slices
from flowsieve.llm.tokens import tokenizer_path

MARK = "▁"
REMEMBERED, LONGEST = 700_000, 48
UNKNOWN_PENALTY = 10.0


def _is_bpe(path: str) -> bool:
    from sentencepiece import sentencepiece_model_pb2

    with open(path, "rb") as f:
        model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
    return model.trainer_spec.model_type == 2


class Pieces:
    """The pieces and scores of a model file. ``dummy_prefix`` puts one space mark before a text that is not empty."""

    def __init__(self, path: str, dummy_prefix: bool = True):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(len(names))]
        self.names, self.dummy_prefix = names, dummy_prefix
        self.ids = {n: i for i, (n, s) in enumerate(zip(names, special)) if not s}
        self.scores = {n: model.get_score(i) for n, i in self.ids.items()}
        self.bytes = {int(n[3:5], 16): i for i, n in enumerate(names) if model.is_byte(i)}
        self.of_byte = {i: bytes([b]) for b, i in self.bytes.items()}
        self.special, self.unknown = special, model.unk_id()
        self.longest = max(map(len, self.ids), default=1)
        self.lowest = min(self.scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.bpe = _is_bpe(path)
        self.fits: dict[tuple[str, str], bool] = {}
        if any(MARK in n.lstrip(MARK) for n in self.ids):
            self.segment = re.compile(r"[\s\S]+")
        else:
            letter = "A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff"
            crossed = {c for n in self.ids for c in re.findall(f"(?<=[{letter}])[!-/:-@]", n)}
            marks = re.escape("".join(sorted({*map(chr, range(33, 65))} - set("0123456789") - crossed))) or "\\x00"
            self.segment = re.compile(f"{MARK}*[^{MARK}{marks}{letter}]*[{letter}]+(?=[{marks}])|{MARK}*[^{MARK}]+|{MARK}+")
        # character -> (the piece that ends here or None, the characters that may follow)
        self.trie: dict[str, tuple] = {}
        for n in sorted(self.ids):
            node = self.trie
            for c in n[:-1]:
                node = node.setdefault(c, (None, {}))[1]
            node[n[-1]] = (n, {})
        self.known: dict[str, bytes] = {}

    def normalized(self, text: str) -> str:
        text = text.replace(" ", MARK)
        return MARK + text if self.dummy_prefix and text else text

    def merged(self, chars: str) -> list[str]:
        """The merges' result on a short string: the best-scored neighbours first, the left ones of equals."""
        parts = list(chars)
        while len(parts) > 1:
            score, at = max(((self.scores.get(a + b, -np.inf), -i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
            if score == -np.inf:
                break
            parts[-at:2 - at] = [parts[-at] + parts[1 - at]]
        return parts

    def together(self, left: str, right: str) -> bool:
        """Whether the merges of the two alone leave them as they are; an empty left side asks for the right one alone."""
        if len(self.fits) > REMEMBERED:
            self.fits.clear()
        found = self.fits[left, right] = self.merged(left + right) == ([left, right] if left else [right])
        return found

    def stream(self, chars: str) -> Iterator[int]:
        """Ids of a normalized text, given out as soon as they are final."""
        reach, size, done = self.longest, len(chars), 0
        best: dict[int, tuple[float, int, str | None]] = {0: (0.0, -1, None)}
        scores, trie, fits, bpe = self.scores, self.trie, self.fits, self.bpe
        for at in range(size):
            if at not in best:
                continue
            score, _, last = best[at]
            if chars[at] not in scores and (at + 1 not in best or best[at + 1][0] < score + self.lowest):
                best[at + 1] = (score + self.lowest, at, None)
            follow, end, left = trie, at, last or ""
            for c in chars[at:at + reach]:
                step = follow.get(c)
                if step is None:
                    break
                piece, follow = step
                end += 1
                if piece is None:
                    continue
                if bpe:
                    if end in best:
                        continue
                    fit = fits.get((left, piece))
                    if self.together(left, piece) if fit is None else fit:
                        best[end] = (0.0, at, piece)
                elif end not in best or best[end][0] < score + scores[piece]:
                    best[end] = (score + scores[piece], at, piece)
            if at - done >= 2 * reach:
                done = yield from self._commit(best, chars, done, at)
        yield from self._emit(best, chars, done, size)

    def _commit(self, best: dict, chars: str, done: int, at: int):
        """Give out what all paths to the positions behind ``at`` share; forget it."""
        fronts = {p for p in best if p > at}
        while len(fronts) > 1:
            last = max(fronts)
            fronts.remove(last)
            fronts.add(best[last][1])
        meet = fronts.pop()
        if meet > done:
            yield from self._emit(best, chars, done, meet)
            for p in [p for p in best if p < meet]:
                del best[p]
            return meet
        return done

    def _emit(self, best: dict, chars: str, done: int, end: int) -> Iterator[int]:
        path = []
        while end > done:
            _, start, piece = best[end]
            path.append((start, piece))
            end = start
        for start, piece in reversed(path):
            if piece is not None:
                yield self.ids[piece]
            elif self.bytes:
                yield from (self.bytes[b] for b in chars[start].encode())
            else:
                yield self.unknown

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        known, segments = self.known, self.segment.findall(self.normalized(text))
        out = list(map(known.get, segments))
        if None in out:
            for k, ids in enumerate(out):
                if ids is None:
                    out[k] = known.get(segments[k]) or self._met(segments[k])
        return b"".join(out)

    def _met(self, segment: str) -> bytes:
        ids = array("I", self.stream(segment)).tobytes()
        if len(segment) <= LONGEST and len(self.known) < REMEMBERED:
            self.known[segment] = ids
        return ids

    def decode(self, ids: list[int]) -> str:
        parts = [self.of_byte[i] if i in self.of_byte else b"" if self.special[i] and i != self.unknown else (" ⁇ " if i == self.unknown else self.names[i]).encode() for i in ids]
        text = b"".join(parts).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


@lru_cache(2)
def loaded(path: str) -> Pieces:
    """A worker's model: it outlives the task, so the next task starts with what this one has met."""
    return Pieces(path)


_OUT = pa.schema([("doc_id", pa.int64()), ("n_ids", pa.int64()), ("ids_crc32", pa.int64()), ("round_trip", pa.bool_())])


def _encode(path: str, with_ids: bool):
    schema = _OUT.append(pa.field("ids", pa.binary())) if with_ids else _OUT

    def run(batches):
        pieces = loaded(path)
        names = np.array([(pieces.of_byte.get(i) or b"") if s else n.encode() for i, (n, s) in enumerate(zip(pieces.names, pieces.special))], object)
        for batch in batches:
            for part in small_slices(batch, 1):
                texts = part.column(1).to_pylist()
                ids = [pieces.encode(t) for t in texts]
                same = []
                for text, own in zip(texts, ids):
                    back = b"".join(names[np.frombuffer(own, "<u4")].tolist()).decode("utf-8", "replace").replace(MARK, " ")
                    same.append((back[1:] if back else back) == text.replace(MARK, " "))
                out = {"doc_id": part.column(0), "n_ids": [len(i) // 4 for i in ids], "ids_crc32": [zlib.crc32(i) for i in ids], "round_trip": same}
                yield pa.RecordBatch.from_pydict(out | {"ids": ids} if with_ids else out, schema=schema)
    return run


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per row: ``doc_id, n_ids, ids_crc32, round_trip``, and the ids as 32-bit integers on demand.

    A null or empty text has no ids. Of equally good segmentations of a unigram model the one whose last piece is longest wins,
    at every position; repeated rows give repeated results. ``round_trip`` says that decoding gives the text back; a space mark in the
    text itself comes back as a space. Other columns are ignored. An empty table gives an empty result.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.mapInArrow(_encode(path or tokenizer_path("piece_bpe_32k.model"), with_ids), "doc_id bigint, n_ids bigint, ids_crc32 bigint, round_trip boolean" + (", ids binary" if with_ids else ""))


def decoded(rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """Texts of 32-bit id strings: ``doc_id, text``. A null id string gives an empty text; control ids give nothing."""
    model = path or tokenizer_path("piece_bpe_32k.model")
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        pieces = loaded(model)
        for batch in batches:
            texts = [pieces.decode(np.frombuffer(i or b"", "<u4").tolist()) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "text": texts}, schema=schema)
    return rows.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id bigint, text string")
