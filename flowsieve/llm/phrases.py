"""Collocations: phrases of two and three words that occur more often than their parts suggest.

A task cuts its texts into words, sorts the phrases of one to three words of each shard and builds count transducers
(``transducer.py``) of them, one for each range of prefixes. Transducers of one range are united and their weights summed; a range that
is still large is cut further between unions, so no task holds more than about ``TARGET`` phrases, whatever the corpus.
What is rarer than the least count then goes, for a phrase's parts are at least as frequent as the phrase. The parts'
counts come from composing an automaton of the parts asked for with the transducer of their range.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.llm.common import small_slices
from flowsieve.llm.transducer import Phrases, Transducer, packed, unpacked
from flowsieve.session import written

#: Bytes of text in a shard; phrases of all shards in a range that one task may unite; bits of the first cut and of each further one.
SHARD_BYTES, TARGET, FIRST_BITS, MORE_BITS = 5_000_000, 4_000_000, 6, 4
#: Least count of a candidate; a longer candidate with this share of its count covers it; rows given out for a language.
LEAST, SHARE, TOP = 10, 50, 2000
# fixed values: what ends a piece, and the blanks between words
ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
TABLE = bytes.maketrans(bytes(range(65, 91)) + ENDS + BLANKS, bytes(range(97, 123)) + b"\n" * len(ENDS) + b" " * len(BLANKS))
PIECES = "lang string, cell bigint, block bigint, n bigint, entries bigint, data binary"


def words_of(texts: list[bytes]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of the texts, in order, and the number of the piece in which each stands."""
    data = np.frombuffer(b"\n".join(texts).translate(TABLE), np.uint8)
    ends = data == 10
    inside = ~(ends | (data == 32))
    edges = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, stops = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    offsets = np.append(0, np.cumsum(stops - starts)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
    return words.dictionary_encode(), np.searchsorted(np.flatnonzero(ends), starts)


def shard_phrases(texts: list[bytes]) -> tuple[int, Phrases]:
    """Number of words, and the counted phrases of one to three words within pieces."""
    words, piece = words_of(texts)
    n, ids = len(words), words.indices.to_numpy()
    places = [np.flatnonzero(piece[:n - m + 1] == piece[m - 1:]) if n >= m else np.zeros(0, np.int64) for m in (1, 2, 3)]
    del piece
    columns = []
    for k in range(3):
        # a phrase of m words fills the first m columns
        columns.append(np.full(sum(map(len, places)), -1, np.int32))
        start = 0
        for m, at in enumerate(places, 1):
            if k < m:
                columns[k][start:start + len(at)] = ids[at + k]
            start += len(at)
    del places, ids
    return n, Phrases.summed(words.dictionary, columns)


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    names = [c.split()[0] for c in PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)], names=names)


def shard_transducers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``lang, text`` to transducers: of each shard one for each range of prefixes."""
    held, size, made = defaultdict(list), defaultdict(int), 0

    def shard(lang: str) -> pa.RecordBatch:
        nonlocal made
        n, phrases = shard_phrases(held.pop(lang))
        del size[lang]
        made += 1
        block = (TaskContext.get().partitionId() << 24) + made
        rows = [(lang, cell, block, 0, len(p), packed(p)) for cell, p in phrases.by_cell(FIRST_BITS)]
        # the words of the shard are counted with its first piece
        return _pieces([(*r[:3], n if k == 0 else 0, *r[4:]) for k, r in enumerate(rows)])

    for batch in batches:
        for part in small_slices(batch, 1, SHARD_BYTES // 2):
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()):
                if text:
                    held[lang].append(text)
                    size[lang] += len(text)
                    if size[lang] >= SHARD_BYTES:
                        yield shard(lang)
            if sum(size.values()) >= 2 * SHARD_BYTES:
                yield shard(max(size, key=size.get))
    for lang in list(held):
        yield shard(lang)


def united(least: int = 1, more: int = 0) -> Callable[[pa.Table], pa.Table]:
    """A group's transducers in one, without phrases rarer than ``least``; cut into ranges of so many bits, if any are given."""
    def run(rows: pa.Table) -> pa.Table:
        first = rows.slice(0, 1).to_pylist()[0]
        phrases = Phrases.union(unpacked(d) for d in rows["data"].to_pylist())
        if least > 1:
            phrases = phrases.where(phrases.counts >= least)
        cut = phrases.by_cell(more) if more else [(first["cell"], phrases)]
        return pa.Table.from_batches([_pieces([(first["lang"], cell, first["block"], 0, len(p), packed(p)) for cell, p in cut if len(p)])])
    return run


def phrase_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, target: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Transducers ``lang, cell, data`` of all phrases of one to three words that occur at least so often, and ``lang, n``, the words of each language."""
    target = target or TARGET
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    pieces = written(rows.mapInArrow(shard_transducers, PIECES), "phrase_shards")
    totals = written(pieces.groupBy("lang").agg(F.sum("n").alias("n")).where("n > 0"), "phrase_words")
    done, depth = [], FIRST_BITS
    while True:
        cells = pieces.groupBy("lang", "cell").agg(F.sum("entries").alias("_all"))
        sized = written(pieces.join(cells, ["lang", "cell"]), "phrase_pieces") if depth > FIRST_BITS or not cells.where(F.col("_all") > target).isEmpty() else pieces.withColumn("_all", F.lit(0))
        small = sized.where(F.col("_all") <= target).select(*pieces.columns)
        done.append(small.groupBy("lang", "cell", F.lit(depth).alias("_depth")).applyInArrow(united(least), PIECES))
        large = sized.where(F.col("_all") > target)
        if large.isEmpty():
            break
        # shards are united by batches that fit, then cut into narrower ranges
        batch = F.pmod(F.xxhash64("block"), F.expr(f"_all div {target} + 1"))
        depth += MORE_BITS
        large = large.groupBy("lang", "cell", batch.alias("_batch")).applyInArrow(united(1, depth), PIECES)
        pieces = written(large.withColumn("block", F.monotonically_increasing_id()), "phrase_pieces")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return written(out.select("lang", F.monotonically_increasing_id().alias("home"), "entries", "data"), "phrase_counts"), totals


def _parts(p: Phrases) -> tuple[np.ndarray, list[tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]]]:
    """Lengths, and for the cut after one word and after two: the phrases it applies to, the columns of the first part and of the rest."""
    lengths, none = p.lengths(), np.full(len(p), -1)
    w1, w2, w3 = p.columns
    return lengths, [(lengths >= 2, [w1, none, none], [w2, w3, none]), (lengths == 3, [w1, w2, none], [w3, none, none])]


ASKED = "lang string, range bigint, kind int, home bigint, data binary, most binary"


def _requests(depth: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each row's phrases by range (kind 0), and the parts of its candidates by the range where their counts lie (kind 1).

    ``most`` holds for each part the largest count among the three-word candidates that ask for it.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, home, data in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2))):
                p = unpacked(data)
                rows = [(lang, cell, 0, home, packed(q), None) for cell, q in p.by_cell(depth)]
                lengths, cuts = _parts(p)
                sides = [([c[mask] for c in side], np.where(lengths[mask] == 3, p.counts[mask], 0)) for mask, *both in cuts for side in both]
                columns = [np.concatenate(c) for c in zip(*(s for s, _ in sides))]
                if len(columns[0]):
                    asked = Phrases.summed(p.words, columns)
                    most = _largest(asked, columns, np.concatenate([m for _, m in sides]))
                    cells = asked.cells(depth)
                    for cell in np.unique(cells):
                        own = np.flatnonzero(cells == cell)
                        rows.append((lang, int(cell), 1, home, packed(asked.where(own)), most[own].astype("<i8").tobytes()))
                yield pa.RecordBatch.from_pylist([dict(zip(("lang", "range", "kind", "home", "data", "most"), r)) for r in rows], schema=_ASKED)
    return run


_ASKED = pa.schema([("lang", pa.string()), ("range", pa.int64()), ("kind", pa.int32()), ("home", pa.int64()), ("data", pa.binary()), ("most", pa.binary())])


def _place(p: Phrases, columns: list[np.ndarray]) -> np.ndarray:
    """Place in ``p`` of each phrase given by columns of p's own word numbers; -1 where it is none."""
    pair = lambda c: (c[0] << 32) | (c[1] + 1)
    heads, number = np.unique(np.concatenate([pair(p.columns), pair(columns)]), return_inverse=True)
    key = (number << 32) | np.concatenate([p.columns[2], columns[2]]) + 1
    own, wanted = key[:len(p)], key[len(p):]
    if not len(own):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
    return np.where(own[at] == wanted, at, -1)


def _largest(p: Phrases, columns: list[np.ndarray], values: np.ndarray) -> np.ndarray:
    """For each phrase of ``p`` the largest of the values given for it."""
    out, at = np.zeros(len(p), np.int64), _place(p, columns)
    np.maximum.at(out, at[at >= 0], values[at >= 0])
    return out


def _answered(rows: pa.Table) -> pa.Table:
    """One range: every automaton asked for is composed with the range's transducer.

    Kind 1 goes back with counts for the parts; kind 0 goes back to its home with the largest count of the three-word candidates that ask for each phrase.
    """
    held = rows.to_pylist()
    own = [r for r in held if r["kind"] == 0]
    table = Phrases.union(unpacked(r["data"]) for r in own) if own else None
    automaton = Transducer.of(table) if own else None
    cover, out = np.zeros(len(table) if own else 0, np.int64), []
    for r in (r for r in held if r["kind"] == 1 and own):
        asked = unpacked(r["data"])
        counts = automaton.composed(asked)
        out.append({**r, "most": counts.astype("<i8").tobytes()})
        columns = _renumbered(asked, table)
        at = _place(table, columns)
        np.maximum.at(cover, at[at >= 0], np.frombuffer(r["most"], "<i8")[at >= 0])
    for r in own:
        p = unpacked(r["data"])
        out.append({**r, "most": cover[_place(table, _renumbered(p, table))].astype("<i8").tobytes()})
    return pa.Table.from_pylist(out, schema=_ASKED)


def _renumbered(p: Phrases, other: Phrases) -> list[np.ndarray]:
    """The columns of ``p`` in the word numbers of ``other``; an unknown word becomes a number that no word has."""
    number = np.append(pc.index_in(p.words, value_set=other.words).fill_null(len(other.words)).to_numpy(zero_copy_only=False), -1).astype(np.int64)
    return [number[c] for c in p.columns]


SCORED = "lang string, phrase string, a bigint, l bigint, r bigint, score bigint"


def floor_scores(a: np.ndarray, l: np.ndarray, r: np.ndarray) -> np.ndarray:
    """floor(1000000 * a * a / (l * r)), exact: in 64 bits where the products fit, else in whole numbers of any size."""
    if not len(a):
        return a
    if 1_000_000 * int(a.max()) ** 2 < 1 << 63 and int(l.max()) * int(r.max()) < 1 << 63:
        return 1_000_000 * a * a // (l * r)
    return np.array([1_000_000 * x * x // (y * z) for x, y, z in zip(a.tolist(), l.tolist(), r.tolist())], np.int64)


def _scored(least: int, share: int, top: int) -> Callable[[pa.Table], pa.Table]:
    """One home: its candidates with the parts' counts; the lowest cut counts, covered ones go, the best ``top`` stay."""
    def run(rows: pa.Table) -> pa.Table:
        held = rows.to_pylist()
        mine, answers = [r for r in held if r["kind"] == 0], [r for r in held if r["kind"] == 1]
        schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("a", pa.int64()), ("l", pa.int64()), ("r", pa.int64()), ("score", pa.int64())])
        if not answers:
            return schema.empty_table()
        parts = [unpacked(r["data"]) for r in answers]
        known = Phrases.union(Phrases(p.words, p.columns, np.frombuffer(r["most"], "<i8")) for p, r in zip(parts, answers))
        found = []
        for r in mine:
            p = unpacked(r["data"])
            lengths, cuts = _parts(p)
            best = np.full((3, len(p)), np.iinfo(np.int64).max)
            for mask, left, rest in cuts:
                here = np.flatnonzero(mask)
                sides = []
                for side in (left, rest):
                    part = Phrases(p.words, [c[here] for c in side], p.counts[here])
                    sides.append(known.counts[_place(known, _renumbered(part, known))])
                score = floor_scores(p.counts[here], *sides)
                lower = score < best[2, here]
                best[:, here[lower]] = [sides[0][lower], sides[1][lower], score[lower]]
            stay = np.flatnonzero((lengths >= 2) & (p.counts >= least) & (100 * np.frombuffer(r["most"], "<i8") < share * p.counts))
            if len(stay):
                texts = p.where(stay).texts()
                found += zip(texts, p.counts[stay].tolist(), *(b[stay].tolist() for b in best))
        found.sort(key=lambda t: (-t[4], -t[1], t[0]))
        columns = [list(c) for c in zip(*found[:top])] or [[]] * 5
        return pa.Table.from_arrays([pa.array([held[0]["lang"]] * len(columns[0]), pa.string()), pa.array(columns[0], pa.binary()).cast(pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], schema=schema)
    return run


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, share: int = SHARE, top: int = TOP, target: int | None = None) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` phrases by score, count and bytes of the phrase.

    A null language is ``und``, together with rows that say so; a null or empty text has no words, and a language without words no
    rows. Repeated rows count each time; ids and other columns, whatever their names, are ignored. Texts of any
    length are read whole: a text larger than a shard is a shard of its own. Counts add over shards, so a hot language or a passage in a third of all rows
    is met once a shard. An empty table gives an empty result. Scores are exact whole numbers.
    """
    counts, totals = phrase_counts(docs, lang_col, text_col, least, target)
    entries = counts.agg(F.sum("entries").alias("m")).first()["m"] or 0
    # ranges of about half a million frequent phrases
    depth = max(4, (entries // 500_000).bit_length() + 2)
    asked = written(counts.select("lang", "home", "data").mapInArrow(_requests(depth), ASKED), "phrase_parts")
    answers = written(asked.groupBy("lang", "range").applyInArrow(_answered, ASKED), "phrase_answers")
    scored = written(answers.groupBy("lang", "home").applyInArrow(_scored(least, share, top), SCORED), "phrase_scores")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    # a first cut by salts, so the last one reads at most 16 * top rows of a language
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(16))).orderBy(*order)
    some = scored.withColumn("_k", F.row_number().over(salted)).where(F.col("_k") <= top).drop("_k")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
