"""Language of documents by a linear-chain conditional random field over their words.

The field labels every word with a language: affixes, character n-grams and the word itself (the lexicon) are its features,
and transitions are learned, so code-switched text gets several languages and a rare word follows its neighbours. It is
fitted on a bounded sample of labelled documents, in runs of words from several languages. A document's language is the one
with the largest mean probability over its words, by forward-backward over the whole text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from flowsieve.llm.common import small_slices
from flowsieve.llm.crf import Crf, fit, marginals

#: The fit's bound: documents for each language, and the longest text among them. A language with under 20 texts so short
#: gives a tenth as many, of any length, each read up to ten times that length.
PER_LANGUAGE, SAMPLE_CHARS, SEQUENCES, BUCKETS = 300, 4_000, 6_000, 1 << 16
_WORD = re.compile(r"[^\W\d_]+")
REMEMBERED = 400_000


def words_of(text: str) -> list[str]:
    """Runs of letters, in lower case."""
    found = _WORD.findall(text.lower())
    # other numerals than digits count as word characters
    return found if any(map(str.isalpha, found)) or any(c.isalpha() for w in found for c in w) else []


_POWERS = np.cumprod(np.full(64, 0x100000001B3, np.uint64))


def _bucket(x: np.ndarray, kind: int) -> np.ndarray:
    x = (x + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x >> np.uint64(32)) % np.uint64(BUCKETS)).astype(np.int64)


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of many words at once, and for each the number of its word.

    A word has itself, its affixes of one to three letters, and its n-grams of two to four letters with its ends marked.
    """
    sizes = np.array([len(w) + 2 for w in words])
    code = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum(sizes)
    heads, word = ends - sizes, np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(code)) - heads[word]
    flat, owner = [_bucket(np.add.reduceat(code * _POWERS[place % 64] * (place // 64 + 1).astype(np.uint64), heads), 1)], [np.arange(len(words))]
    gram = code.copy()
    for n in (2, 3, 4):
        gram = gram[:-1] * np.uint64(0x100000001B3) + code[n - 1:]
        inside = word[:len(gram)] == word[n - 1:]
        flat.append(_bucket(gram[inside], n))
        owner.append(word[:len(gram)][inside])
        # with the mark of the end in it, a gram at either end is an affix
        long = sizes >= n
        for kind, at in ((8 + n, heads[long]), (16 + n, ends[long] - n)):
            flat.append(_bucket(gram[at], kind))
            owner.append(np.flatnonzero(long))
    return np.concatenate(flat), np.concatenate(owner)


def word_scores(words: list[str], crf: Crf) -> np.ndarray:
    flat, owner = word_features(words)
    order = np.argsort(owner, kind="stable")
    return np.add.reduceat(crf.weights[flat[order]], np.searchsorted(owner[order], np.arange(len(words))), axis=0)


def _held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def sample(docs: DataFrame) -> dict[str, list[str]]:
    """At most ``PER_LANGUAGE`` training texts for each language, chosen by a hash of id and text.

    Rows that repeat an id are told apart by their text; rows that repeat both count once. No language gives more than
    ``PER_LANGUAGE * SAMPLE_CHARS`` characters.
    """
    rows = docs.where("text is not null and lang is not null and doc_id is not null").where(~_held_out(F.col("doc_id")))
    rows = rows.select("text", "lang", F.length("text").alias("size"), F.xxhash64(F.lit(10), "doc_id", "text").alias("rank"))
    short = F.col("size") <= SAMPLE_CHARS
    found = rows.groupBy("lang").agg(F.approx_count_distinct(F.when(short, F.col("rank"))).alias("short"), F.approx_count_distinct("rank").alias("all")).collect()
    if not found:
        return {}
    top, wanted = 2**63 - 1, F.lit(0)
    for r in found:
        # three times the bound is asked for, so neither the hash's spread nor the count's error leaves too few
        n, most = (r["short"], PER_LANGUAGE) if r["short"] >= 20 else (r["all"], PER_LANGUAGE // 10)
        own = (F.col("lang") == r["lang"]) & (F.col("rank") <= min(top, -top + int(2 * top * min(1.0, 3 * most / n))))
        wanted = F.when(own & short if r["short"] >= 20 else own, most).otherwise(wanted)
    asked = rows.withColumn("most", wanted).where("most > 0").groupBy("lang", "rank", "most").agg(
        F.min(F.substring("text", 1, 10 * SAMPLE_CHARS)).alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("rank"))
    texts: dict[str, list[str]] = {r["lang"]: [] for r in found}
    for r in sorted(asked.withColumn("place", place).where("place <= most").select("lang", "rank", "text").collect()):
        texts[r["lang"]].append(r["text"])
    return texts


def fit_languages(texts: dict[str, list[str]], seed: int = 10) -> Crf:
    """Fits on sequences of one to four runs of words, each run from one language."""
    labels = sorted(texts)
    pools = [[words_of(t) for t in texts[k]] for k in labels]
    pools = [[w for w in pool if w] for pool in pools]
    usable = [i for i, pool in enumerate(pools) if pool]
    rng = np.random.default_rng(seed)
    vocabulary = sorted({w for pool in pools for words in pool for w in words})
    flat, owner = word_features(vocabulary) if vocabulary else (np.empty(0, np.int64), np.empty(0, np.int64))
    order = np.argsort(owner, kind="stable")
    known = dict(zip(vocabulary, np.split(flat[order], np.searchsorted(owner[order], np.arange(1, len(vocabulary))))))
    sequences, targets = [], []
    for _ in range(SEQUENCES if usable else 0):
        sequence, target = [], []
        for _ in range(int(rng.integers(1, 5))):
            label = usable[int(rng.integers(len(usable)))]
            words = pools[label][int(rng.integers(len(pools[label])))]
            start, size = int(rng.integers(len(words))), int(rng.integers(3, 16))
            for w in words[start:start + size]:
                sequence.append(known[w])
                target.append(label)
        sequences.append(sequence)
        targets.append(target)
    return fit(sequences, targets, labels, BUCKETS)


class Labeller:
    """Label probabilities of texts; remembers the scores of at most ``REMEMBERED`` words."""

    def __init__(self, crf: Crf):
        self.crf, self.known = crf, {}
        self.rows = np.empty((1024, len(crf.labels)))

    def _learn(self, words: list[str]) -> None:
        at = len(self.known)
        while at + len(words) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
        score = word_scores(words, self.crf)
        self.rows[at:at + len(words)] = np.exp(score - score.max(1, keepdims=True))
        self.known.update(zip(words, range(at, at + len(words))))

    def word_probabilities(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Each text's (words, labels) probabilities."""
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        order = sorted((i for i, t in enumerate(texts) if t), key=lambda i: -len(texts[i]))
        out = [np.empty((0, len(self.crf.labels)))] * len(texts)
        if order:
            new = list({w for i in order for w in texts[i] if w not in known})
            if new:
                self._learn(new)
            at = np.array([known[w] for i in order for w in texts[i]])
            lengths = np.array([len(texts[i]) for i in order])
            gamma, _ = marginals(self.rows[at], lengths, self.crf)
            for i, part in zip(order, np.split(gamma, np.cumsum(lengths)[:-1])):
                out[i] = part
        return out

    def documents(self, texts: list[str]) -> list[tuple[str, float]]:
        found = []
        if not self.crf.labels:
            return [("und", 0.0)] * len(texts)
        for p in self.word_probabilities([words_of(t) for t in texts]):
            mean = p.mean(0) if len(p) else None
            found.append(("und", 0.0) if mean is None else (self.crf.labels[int(mean.argmax())], float(min(1.0, mean.max()))))
        return found


def identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with ``held_out``, ``lang_pred`` and ``score``.

    Learns from text and lang of the rows whose crc32(doc_id) mod 4 is not 2. A null text, or one without letters, is ``und``
    with score 0, and so is every text if there is no training row. Ties between languages go to the first by name. Rows that
    repeat an id or text are judged each. A null id is not held out and not learned from. Columns of ``docs`` with the names
    of new ones are replaced. An empty table gives an empty result.
    """
    crf = fit_languages(sample(docs.select("doc_id", "text", "lang")))
    crf.weights = crf.weights.astype(np.float32)
    docs = docs.drop("held_out", "lang_pred", "score")
    kept = docs.select("text", *[c for c in docs.columns if c != "text"])
    schema = StructType([*kept.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches):
        label = Labeller(crf)
        for batch in batches:
            for part in small_slices(batch, 0, 6_000_000):
                found = label.documents([t or "" for t in part.column(0).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                    names=[*part.schema.names, "lang_pred", "score"])
    held = F.coalesce(_held_out(F.col("doc_id")), F.lit(False))
    return kept.mapInArrow(run, schema).withColumn("held_out", held).select(*docs.columns, "held_out", "lang_pred", "score")
