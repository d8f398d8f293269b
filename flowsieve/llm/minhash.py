"""Near duplicates by MinHash with tensored banding, confirmed on whole shingle sets.

Two collections of ``GROUPS`` groups of ``ROWS`` minima give ``GROUPS * GROUPS`` table keys, one for each pair of a group of
the first and a group of the second, from 60 minima where independent tables would need 600. Documents with equal sets are
one class from the start. A pair of classes is a candidate if it shares a key; candidates are compared in waves:

1. every class with the smallest class of its buckets;
2. in the buckets that still hold several components, with the member that meets most others, as an original among its copies;
3. what is left: pairs in a bucket with several components whose difference may be small enough. A shingle flips one of 1024
   bits of its document, so two documents differ in as many shingles as in bits at least: an exact bound, checked in the join.

Pairs that lie in one component already are left out, since they change nothing, and a pair that shares many keys comes from
the first of them alone. So a bucket of copies costs two comparisons per member, and a family of texts below the similarity is
told apart by its bits. Every pair that passes is compared on the whole sets.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.llm.common import by_text, components
from flowsieve.session import written

GROUPS, ROWS, PERCENT, FLIPS = 10, 3, 80, 1024
_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)
_KEYS = np.random.default_rng(9).integers(0, 2**64, 2 * GROUPS * ROWS, dtype=np.uint64) | np.uint64(1)
_EMPTY = np.empty(0, np.uint64)


class Words(dict):
    """64-bit hashes of words; forgets all of them when there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _STEP)) * _MIX
    return x ^ (x >> np.uint64(32))


def shingles(data: bytes, size: int, words: Words) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; with fewer words, of the whole sequence; empty without words.

    Words are the runs of bytes other than ASCII white space, with A-Z in lower case.
    """
    found = [words[w] for w in data.lower().split()]
    if not found:
        return _EMPTY
    hashed = np.array(found, np.uint64)
    n = min(size, len(hashed))
    runs = np.full(len(hashed) - n + 1, n, np.uint64)
    for k in range(n):
        runs = _mixed(runs * np.uint64(3) + hashed[k:len(hashed) - n + 1 + k])
    return np.unique(runs)


def minima(found: np.ndarray) -> np.ndarray:
    """The two collections' group hashes, each of ``ROWS`` minima."""
    least = np.empty(len(_KEYS), np.uint64)
    for k, key in enumerate(_KEYS):
        x = found * key
        least[k] = (x ^ (x >> np.uint64(31))).min()
    rows = least.reshape(2 * GROUPS, ROWS)
    out = np.zeros(2 * GROUPS, np.uint64)
    for k in range(ROWS):
        out = _mixed(out * np.uint64(3) + rows[:, k])
    return out.view(np.int64)


def flips(found: np.ndarray) -> np.ndarray:
    """Bit by bit, whether an odd number of shingles falls on it."""
    odd = np.bincount((found >> np.uint64(40)).astype(np.int64) % FLIPS, minlength=FLIPS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


_SIGNED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("same", pa.binary()), ("sig", pa.list_(pa.int64()))])


def _signer(size: int):
    def make(batch):
        words = Words()
        sets = [shingles(t, size, words) for t in batch.column(1).to_pylist()]
        return {
            "doc_id": batch.column(0), "n": [len(s) for s in sets],
            "same": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
            "sig": [np.concatenate([minima(s), flips(s)]) if len(s) else None for s in sets],
        }
    return by_text(make, _SIGNED)


def first_key() -> Column:
    """The first key that the signatures ``sig`` and ``sig_a`` share."""
    own, other = F.col("sig"), F.col("sig_a")
    place = [F.coalesce(*[F.when(own[b + k] == other[b + k], F.lit(k)) for k in range(GROUPS)]) for b in (0, GROUPS)]
    return F.xxhash64(place[0], place[1], own[place[0]], own[place[1] + GROUPS])


def may_be_near() -> Column:
    """Whether the flipped bits leave room for the similarity: with sizes n and m it takes at most (n + m) / 9 differences."""
    bits = [F.bit_count(F.col("sig")[k].bitwiseXOR(F.col("sig_a")[k])) for k in range(2 * GROUPS, 2 * GROUPS + FLIPS // 64)]
    return (100 + PERCENT) * reduce(lambda a, b: a + b, bits) <= (100 - PERCENT) * (F.col("n") + F.col("m"))


def _confirm(size: int):
    """Pairs of texts to pairs whose sets are similar enough, counted in whole numbers."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        words, last, held = Words(), None, _EMPTY
        for batch in batches:
            a, b = [], []
            for lead, one, other, text in zip(*(c.to_pylist() for c in batch.columns)):
                if lead != last:
                    last, held = lead, shingles(text, size, words)
                own = shingles(other, size, words)
                both = len(np.intersect1d(held, own, assume_unique=True))
                if 100 * both >= PERCENT * (len(held) + len(own) - both):
                    a.append(lead)
                    b.append(one)
            yield pa.RecordBatch.from_pydict({"a": a, "b": b}, schema=schema)
    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5) -> DataFrame:
    """One row per row: ``doc_id, n_shingles, component_id, kept``.

    Linked are documents whose sets of ``size``-word shingles have a Jaccard similarity of 0.8 or more; components are the
    classes of what links reach, named by their smallest doc_id, which is the one kept. A document with fewer words than
    ``size`` has its whole sequence as its set; one without words, or a null text, has an empty set, is linked with nothing and
    kept. A row without an id is linked with nothing and kept; rows that repeat an id share a component, and rows that repeat
    id and set come back alike. Other columns are ignored. An empty table gives an empty result.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    signed = written(texts.mapInArrow(_signer(size), "doc_id bigint, n bigint, same binary, sig array<bigint>"), "signatures")
    sets = signed.where("n > 0 and doc_id is not null")
    classes = sets.groupBy("same").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = written(classes, "classes")
    first, second = F.slice("sig", 1, GROUPS), F.slice("sig", GROUPS + 1, GROUPS)
    tables = F.flatten(F.transform(first, lambda x, i: F.transform(second, lambda y, j: F.xxhash64(i, j, x, y))))
    keyed = classes.select("id", "n", F.explode(tables).alias("key"))
    buckets = keyed.groupBy("key").agg(F.min(F.struct("id", "n")).alias("lead"), F.count(F.lit(1)).alias("members")).where("members > 1")
    buckets = written(buckets, "buckets")
    inside = written(keyed.join(buckets, "key").select("key", "id", "n", "lead", "members"), "members")
    fits = 100 * F.least("n", "m") >= PERCENT * F.greatest("n", "m")
    stars = inside.select("id", "n", F.col("lead.id").alias("other"), F.col("lead.n").alias("m")).where((F.col("id") != F.col("other")) & fits)
    stars = stars.groupBy(F.col("id").alias("b")).agg(F.min("other").alias("a")).select("a", "b")
    bodies = texts.join(inside.groupBy(F.col("id").alias("doc_id")).agg(F.lit(1)).select("doc_id"), "doc_id", "left_semi")
    bodies = written(bodies, "candidates")

    def confirmed(pairs: DataFrame) -> DataFrame:
        a = bodies.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
        b = bodies.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
        both = pairs.join(b, "b").join(a, "a").select("a", "b", "text_b", "text_a")
        return written(both.mapInArrow(_confirm(size), "a bigint, b bigint"), "links")

    def still_open(links: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Components, and the rows of the buckets that hold several of them."""
        parts = components(links)
        placed = inside.select("key", "id", "n", "members").join(parts, F.col("id") == F.col("v"), "left").select("key", "id", "n", "members", F.coalesce("comp", "id").alias("comp"))
        several = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
        return parts, written(placed.join(written(several, "open"), "key", "left_semi"), "open_members")

    done = written(stars, "pairs")
    links = confirmed(done)
    _, left = still_open(links)
    met = written(left.groupBy("id").agg(F.sum("members").alias("met")), "met")
    centre = left.join(met, "id").groupBy("key").agg(F.max_by(F.struct("id", "n", "comp"), F.struct("met", "id")).alias("c"))
    centre = written(centre.select("key", F.col("c.id").alias("a"), F.col("c.n").alias("m"), F.col("c.comp").alias("other")), "centres")
    pairs = left.join(centre, "key").where((F.col("comp") != F.col("other")) & fits).select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct()
    new = written(pairs.join(done, ["a", "b"], "left_anti"), "pairs")
    done, links = done.union(new), written(links.union(confirmed(new)), "all_links")
    _, left = still_open(links)
    full = written(left.join(classes.select("id", "sig"), "id"), "open_signatures")
    # of a pair of components one is not the bucket's largest: its members meet all, and the largest never meets itself
    main = full.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"))
    full = written(full.join(written(main, "main_components"), "key").withColumn("small", F.col("comp") != F.col("main")), "sided")
    ahead = full.where("small").select("key", F.col("id").alias("a"), F.col("n").alias("m"), F.col("comp").alias("other"), F.col("sig").alias("sig_a"))
    pairs = full.join(ahead, "key").where(
        (~F.col("small") | (F.col("a") < F.col("id"))) & (F.col("comp") != F.col("other")) & fits & may_be_near() & (F.col("key") == first_key()))
    pairs = pairs.select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b"))
    new = written(pairs.join(done, ["a", "b"], "left_anti"), "pairs")
    parts = components(written(links.union(confirmed(new)), "all_links"))
    named = classes.join(parts, F.col("id") == F.col("v"), "left").select(F.col("same").alias("_same"), F.coalesce("comp", "id").alias("comp"))
    named = written(named, "class_components")
    out = signed.join(named, F.when(F.col("doc_id").isNotNull(), F.col("same")) == F.col("_same"), "left")
    comp = F.coalesce("comp", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id"), F.col("doc_id").eqNullSafe(comp).alias("kept"))
