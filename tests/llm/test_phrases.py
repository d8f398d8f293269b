"""Word transducers, and collocations against a count by hand."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from flowsieve.llm import phrases as ph
from flowsieve.llm.transducer import Phrases, Transducer, packed, unpacked


def counted(rng, n, words):
    found = Counter()
    for _ in range(n):
        found[tuple(rng.choice(words) for _ in range(rng.randrange(1, 4)))] += rng.randrange(1, 3)
    return found


def phrases_of(counts):
    words = sorted({w for p in counts for w in p})
    number = {w: k for k, w in enumerate(words)}
    columns = [np.array([number[p[k]] if k < len(p) else -1 for p in counts], np.int64) for k in range(3)]
    return Phrases.summed(pa.array(words, pa.large_binary()), columns, np.array(list(counts.values()), np.int64))


def back(p):
    return dict(zip(p.texts(), p.counts.tolist()))


@pytest.mark.parametrize(("n", "words"), [(5, [b"a", b"b"]), (300, [bytes([97 + k]) for k in range(8)]), (2000, [b"w%d" % k for k in range(50)])])
def test_transducers(n, words):
    rng = random.Random(n)
    one, two = counted(rng, n, words), counted(rng, n, [*words, "zé".encode()])
    flat = lambda c: {b" ".join(k): v for k, v in c.items()}
    a, b = phrases_of(one), phrases_of(two)
    automaton = Transducer.of(a)
    assert back(a) == back(automaton.phrases()) == back(unpacked(packed(a))) == flat(one)
    assert back(Phrases.union([a, unpacked(packed(b))])) == flat(one + two)
    asked = phrases_of(Counter(dict.fromkeys([*one, *two], 1)))
    assert dict(zip(asked.texts(), automaton.composed(asked).tolist())) == {b" ".join(k): one.get(k, 0) for k in {*one, *two}}
    cells: dict = {}
    for cell, p in a.by_cell(9):
        assert (p.cells(9) == cell).all() and (p.cells(6) == cell >> 3).all()
        cells.update(back(p))
    assert cells == flat(one)
    # no two states of a level have the same arcs
    for starts, *arcs in automaton.levels[1:]:
        states = [tuple(zip(*(x[i:j].tolist() for x in arcs))) for i, j in zip(starts, starts[1:])]
        assert len(set(states)) == len(states)
    none = a.where(np.zeros(0, int))
    assert len(unpacked(packed(none))) == 0 and not Transducer.of(none).composed(asked).any()


def test_many_words_take_the_long_way(monkeypatch):
    words = pa.array([b"%d" % k for k in range(3_000_000)], pa.large_binary())
    columns = [np.array(c) for c in ([5, 2_999_999, 5, 5], [-1, 7, 2_000_000, 2_000_000], [-1, -1, 9, 9])]
    assert back(Phrases.summed(words, columns)) == {b"5": 1, b"2999999 7": 1, b"5 2000000 9": 2}


def test_scores_are_exact():
    a = np.array([2 ** 40 + 1, 10])
    l, r = np.array([2 ** 41, 11]), np.array([2 ** 40 + 7, 13])
    assert ph.floor_scores(a, l, r).tolist() == [1_000_000 * x * x // (y * z) for x, y, z in zip(a.tolist(), l.tolist(), r.tolist())]
    assert ph.floor_scores(a[1:], l[1:], r[1:]).tolist() == [699300]


def by_hand(table, least, share, top):
    f, n = Counter(), Counter()
    lower = {k: k + 32 for k in range(65, 91)}
    for lang, text in table:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for m in (1, 2, 3):
                f.update((lang or "und", *words[k:k + m]) for k in range(len(words) - m + 1))
    out = []
    for (lang, *p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        longer = [v for (other, *q), v in f.items() if other == lang and len(q) == 3 > len(p) and v >= least and (q[:2] == p or q[1:] == p)]
        if any(100 * v >= share * a for v in longer):
            continue
        score, _, l, r = min((1_000_000 * a * a // (f[lang, *p[:k]] * f[lang, *p[k:]]), k, f[lang, *p[:k]], f[lang, *p[k:]]) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, l, r, n[lang], score))
    rows = []
    for lang in sorted({r[0] for r in out}):
        best = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        rows += [(lang, k + 1, *r[1:]) for k, r in enumerate(best)]
    return rows


def test_collocations(spark, monkeypatch):
    rng = random.Random(8)
    words = ["the", "The", "of", "new", "york", "été", "\x1cx", "a\xa0b", "city", "ÀB", "q"]
    def text():
        return "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t ", ". ", "\x0b", ", ", "\n"]) for _ in range(rng.randrange(60)))
    table = [(rng.choice(["en", "de", None, "und"]), text()) for _ in range(150)] + [("en", "Tail of it " * 400), ("fr", None), ("fr", ""), ("en", "..! ,\n"), (None, None)]
    table += [("en", "new york city of the same passage")] * 200
    rng.shuffle(table)
    frame = spark.createDataFrame([(k, lang, text, 1, "z", 2) for k, (lang, text) in enumerate(table)], "doc_id bigint, lang string, text string, n int, phrase string, cell int").repartition(6)
    read = lambda df: sorted(tuple(r) for r in df.collect())
    for least, share, top in ((10, 50, 2000), (3, 90, 20)):
        want = by_hand(table, least, share, top)
        assert read(ph.collocations(frame, least=least, share=share, top=top)) == want and want
    # ranges that are too large for a task are cut further
    assert read(ph.collocations(frame, least=3, share=90, top=20, target=150)) == want
    assert ph.collocations(frame.limit(0)).count() == 0
    assert ph.collocations(frame).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_shards_of_a_long_text(monkeypatch):
    monkeypatch.setattr(ph, "SHARD_BYTES", 500)
    class Context:
        partitionId = staticmethod(lambda: 3)
    monkeypatch.setattr(ph.TaskContext, "get", classmethod(lambda cls: Context))
    texts = [("en", "a b c " * 300), ("de", "x y"), ("en", None), ("en", "b c"), ("de", "")] * 3
    batch = pa.RecordBatch.from_arrays([pa.array([t[0] for t in texts]), pa.array([t[1] for t in texts], pa.string())], names=["lang", "text"])
    rows = [r for b in ph.shard_transducers(iter([batch])) for r in b.to_pylist()]
    assert sum(r["n"] for r in rows) == 3 * (900 + 2 + 2) and len({(r["block"], r["cell"]) for r in rows}) == len(rows) and len({r["block"] for r in rows}) > 3
    total = back(Phrases.union(unpacked(r["data"]) for r in rows if r["lang"] == "en"))
    assert total[b"b c"] == 903 and total[b"a"] == 900
