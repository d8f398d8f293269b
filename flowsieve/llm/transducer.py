"""Weighted acyclic automata over words: phrases of one to three words and a count on each path.

States are the places after no word, one word and two words; an arc reads a word and gives out the count of the phrase that ends
there (0: none ends). States that accept the same continuations with the same counts are one state, found level by level
from the ends of the phrases, so the sorted phrases of a shard are read once. All work is on whole arrays.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The word whose hash gives each bit of a cell number: first words first, so the cells are ranges of prefixes, and a frequent
#: first word is split by what follows it.
BITS = "111122" + "312" * 26


def joined_ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``starts[0], starts[0] + 1, ...`` for each range, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Phrases:
    """A vocabulary (a binary array) and phrases as columns of word numbers, -1 for no word, with counts; sorted and distinct."""

    def __init__(self, words: pa.Array, columns: list[np.ndarray], counts: np.ndarray):
        self.words, self.columns, self.counts = words, columns, counts

    def __len__(self) -> int:
        return len(self.counts)

    @classmethod
    def summed(cls, words: pa.Array, columns: list[np.ndarray], counts: np.ndarray | None = None) -> Phrases:
        """Equal phrases become one with the sum of their counts (of ones, if none are given)."""
        bits = len(words).bit_length()
        if 3 * bits <= 63:
            key = np.zeros(len(columns[0]), np.int64)
            for c in columns:
                # in place: this is the largest array of a shard
                key <<= bits
                key += c
                key += 1
            if counts is None:
                key.sort()
                order = None
            else:
                order = np.argsort(key, kind="stable")
                key = key[order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[:len(key)])
            mask, key = (1 << bits) - 1, key[first]
            found = [((key >> (bits * (2 - k))) & mask) - 1 for k in range(3)]
        else:
            order = np.lexsort(columns[::-1])
            ranked = [c[order] for c in columns]
            moved = np.zeros(len(order), bool)
            moved[:1] = True
            for c in ranked:
                moved[1:] |= c[1:] != c[:-1]
            first = np.flatnonzero(moved)
            found = [c[first] for c in ranked]
        if counts is None:
            sums = np.diff(np.append(first, len(columns[0])))
        else:
            sums = np.add.reduceat(counts[order], first) if len(first) else counts[:0]
        return cls(words, found, sums.astype(np.int64))

    @classmethod
    def union(cls, several: Iterable[Phrases]) -> Phrases:
        """All phrases of several, counts added."""
        several = list(several)
        words = pa.chunked_array([p.words for p in several], pa.large_binary()).combine_chunks().dictionary_encode()
        number, at, columns = words.indices.to_numpy(), 0, []
        for p in several:
            local = np.append(number[at:at + len(p.words)], -1)
            columns.append([local[c] for c in p.columns])
            at += len(p.words)
        both = [np.concatenate(c).astype(np.int64) for c in zip(*columns)]
        return cls.summed(words.dictionary, both, np.concatenate([p.counts for p in several]))

    def where(self, mask: np.ndarray) -> Phrases:
        """The phrases of a mask or of sorted places, with the words they use."""
        columns = [c[mask] for c in self.columns]
        used = np.unique(np.concatenate([c[c >= 0] for c in columns]))
        number = np.full(len(self.words) + 1, -1)
        number[used] = np.arange(len(used))
        return Phrases(self.words.take(pa.array(used)), [number[c] for c in columns], self.counts[mask])

    def lengths(self) -> np.ndarray:
        return 1 + (self.columns[1] >= 0) + (self.columns[2] >= 0)

    def cells(self, depth: int) -> np.ndarray:
        """Cell number of each phrase: ``depth`` bits from the hashes of its words."""
        hashes = np.append(np.fromiter(map(zlib.crc32, self.words.to_pylist()), np.uint32, len(self.words)), np.uint32(0))
        own, cell, taken = [hashes[c] for c in self.columns], np.zeros(len(self), np.int64), [0, 0, 0]
        for word in BITS[:depth]:
            k = int(word) - 1
            cell = (cell << 1) | ((own[k] >> np.uint32(31 - taken[k])) & np.uint32(1)).astype(np.int64)
            taken[k] += 1
        return cell

    def by_cell(self, depth: int) -> Iterator[tuple[int, Phrases]]:
        cell = self.cells(depth)
        order = np.argsort(cell, kind="stable")
        cell = cell[order]
        first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])[:len(cell)])
        for a, b in zip(first, np.append(first[1:], len(cell))):
            yield int(cell[a]), self.where(order[a:b])

    def texts(self) -> list[bytes]:
        """Each phrase as its words with blanks between."""
        words = np.append(np.array(self.words.to_pylist(), object), None)
        return [b" ".join(w for w in p if w is not None) for p in zip(*(words[c] for c in self.columns))]


def _registered(starts: np.ndarray, arcs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """States with the arcs between their starts: a class of equal states for each, the classes' starts, their arcs."""
    nodes = len(starts) - 1
    if not nodes:
        return np.zeros(0, np.int64), np.zeros(1, np.int64), [a[:0] for a in arcs]
    mixed = np.zeros(len(arcs[0]), np.uint64)
    for a in arcs:
        mixed = (mixed ^ a.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    sizes = np.diff(starts)
    hashes = np.add.reduceat(mixed, starts[:-1]) + sizes.astype(np.uint64)
    order = np.argsort(hashes, kind="stable")
    a, b = order[:-1], order[1:]
    same = (hashes[a] == hashes[b]) & (sizes[a] == sizes[b])
    # equal hashes are not trusted: the arcs themselves are compared
    pairs = np.flatnonzero(same)
    if len(pairs):
        left, right = joined_ranges(starts[a[pairs]], sizes[a[pairs]]), joined_ranges(starts[b[pairs]], sizes[b[pairs]])
        differ = np.zeros(len(left), bool)
        for x in arcs:
            differ |= x[left] != x[right]
        same[pairs] = ~np.logical_or.reduceat(differ, np.append(0, np.cumsum(sizes[a[pairs]])[:-1]))
    new = np.append(True, ~same)
    classes = np.empty(nodes, np.int64)
    classes[order] = np.cumsum(new) - 1
    kept = order[new]
    return classes, np.append(0, np.cumsum(sizes[kept])), [x[joined_ranges(starts[kept], sizes[kept])] for x in arcs]


class Transducer:
    """The minimal automaton of sorted phrases. ``levels`` holds for each number of words read: states' starts, labels, counts, next states."""

    def __init__(self, words: pa.Array, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]):
        self.words, self.levels = words, levels

    @classmethod
    def of(cls, phrases: Phrases) -> Transducer:
        columns, counts = phrases.columns, phrases.counts
        levels, moved, below = [], np.zeros(len(phrases), bool), []
        moved[:1] = True
        # nodes of the sorted phrases' prefix tree, by level: its first row, and its parent in the level above
        for k in range(3):
            moved[1:] |= columns[k][1:] != columns[k][:-1]
            rows = np.flatnonzero(moved & (columns[k] >= 0))
            own = counts[rows] if k == 2 else np.where(columns[k + 1][rows] < 0, counts[rows], 0)
            below.append((rows, columns[k][rows], own))
        to = np.full(len(below[2][0]), -1)
        for k in (2, 1, 0):
            rows, label, own = below[k]
            if k == 0:
                starts = np.array([0, len(rows)])
                levels.insert(0, (starts, label, own, to))
                break
            parent = np.searchsorted(below[k - 1][0], rows, side="right") - 1
            has = np.flatnonzero(np.append(True, parent[1:] != parent[:-1])[:len(parent)])
            classes, starts, arcs = _registered(np.append(has, len(rows)), [label, own, to])
            levels.insert(0, (starts, *arcs))
            to = np.full(len(below[k - 1][0]), -1)
            to[parent[has]] = classes
        return cls(phrases.words, levels)

    def phrases(self) -> Phrases:
        """All accepted phrases, sorted."""
        state, columns, found = np.zeros(1, np.int64), [np.full(1, -1)] * 3, []
        for k, (starts, label, own, to) in enumerate(self.levels):
            sizes = starts[state + 1] - starts[state]
            arc = joined_ranges(starts[state], sizes)
            columns = [np.repeat(c, sizes) for c in columns]
            columns[k] = label[arc].astype(np.int64)
            ends = own[arc] > 0
            found.append(([c[ends] for c in columns], own[arc][ends]))
            on = to[arc] >= 0
            columns, state = [c[on] for c in columns], to[arc][on].astype(np.int64)
        both = [np.concatenate(c) for c in zip(*(c for c, _ in found))]
        return Phrases.summed(self.words, both, np.concatenate([n for _, n in found]).astype(np.int64))

    def composed(self, asked: Phrases) -> np.ndarray:
        """The count this automaton gives to each phrase asked for, 0 where it accepts none: both are walked together."""
        number = np.append(pc.index_in(asked.words, value_set=self.words).fill_null(-1).to_numpy(zero_copy_only=False), -1).astype(np.int64)
        state, out = np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64)
        for (starts, label, own, to), column in zip(self.levels, asked.columns):
            out[column >= 0] = 0
            reads = (column >= 0) & (state >= 0)
            key = np.repeat(np.arange(len(starts) - 1), np.diff(starts)) << 32 | label
            wanted = (state[reads] << 32) | number[column[reads]]
            at = np.minimum(np.searchsorted(key, wanted), max(len(key) - 1, 0))
            hit = (key[at] == wanted) & (number[column[reads]] >= 0) if len(key) else np.zeros(len(wanted), bool)
            out[reads] = np.where(hit, own[at] if len(key) else 0, 0)
            state[reads] = np.where(hit, to[at] if len(key) else -1, -1)
        return out

    def to_bytes(self) -> bytes:
        data, ends = self.words.buffers()[2], np.frombuffer(self.words.buffers()[1], np.int64)[self.words.offset:self.words.offset + len(self.words) + 1]
        letters = data.slice(int(ends[0]), int(ends[-1] - ends[0])).to_pybytes() if len(self.words) else b""
        # next states are stored one up, so that none is negative; each array in the least whole bytes, bytes of one weight together
        arrays = [np.diff(ends), *(a + (k == 3) for level in self.levels for k, a in enumerate(level))]
        widths = [next(w for w in (1, 2, 4, 8) if w == 8 or not len(a) or a.max() < 1 << 8 * w) for a in arrays]
        parts = [a.astype(f"<u{w}").view(np.uint8).reshape(-1, w).T.tobytes() for a, w in zip(arrays, widths)]
        head = np.array([len(arrays), len(letters), *(len(a) for a in arrays), *widths], "<u8").tobytes()
        body = b"".join([head, letters, *parts])
        return len(body).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)

    @classmethod
    def from_bytes(cls, data: bytes) -> Transducer:
        body = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
        n, letters = np.frombuffer(body, "<u8", 2).astype(int)
        sizes, widths = np.frombuffer(body, "<u8", 2 * n, 16).astype(int).reshape(2, n)
        at = 16 + 16 * n
        text, at, arrays = body[at:at + letters], at + letters, []
        for size, width in zip(sizes, widths):
            planes = np.frombuffer(body, np.uint8, size * width, at).reshape(width, size)
            arrays.append(np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.int64))
            at += size * width
        ends = np.append(0, np.cumsum(arrays[0]))
        words = pa.Array.from_buffers(pa.large_binary(), len(arrays[0]), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(text)])
        levels = [(arrays[k], arrays[k + 1], arrays[k + 2], arrays[k + 3] - 1) for k in range(1, n, 4)]
        return cls(words, levels)


def packed(phrases: Phrases) -> bytes:
    return Transducer.of(phrases).to_bytes()


def unpacked(data: bytes) -> Phrases:
    return Transducer.from_bytes(data).phrases()
