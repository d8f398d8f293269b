"""Near duplicates of embeddings by NN-descent.

1. Equal directions become one vector with a count.
2. A first neighbour graph: in several tables, vectors are sorted by the signs of random projections and cut into blocks of
   ``BLOCK`` neighbours in that order; a block's vectors are compared, and each keeps its ``K`` best.
3. Descent: the vectors that a vector's list and those whose lists hold it are its neighbours; they are compared with each
   other (neighbours of neighbours), and each list takes the better ones, until a round changes few lists. A vector that many
   lists hold is spread over several local joins of bounded size.
4. Links: every link that a block or a local join meets counts for the classes, whatever the lists hold. It gives out a
   spanning forest of its links, which joins the same vectors and has no more rows than the block.
5. Dense classes: a list full of its own class says nothing of others, so a list has ``K`` more places for vectors outside
   the class. Classes of more than ``K`` members are sorted again by samples, and the descent goes on, until none meet.
6. Audit: a fixed number of vectors is compared with all others. Vectors with up to ``K`` links and those with more are judged
   apart: if less than ``RECALL`` of either have all their links in their class, more tables are sorted and the descent goes on.
7. Enlargement: the lists of a class are enlarged to the class: its members are compared in blocks and counted; no pair
   leaves a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.llm.common import components
from flowsieve.session import written

LINK, EXPLORE, K = 0.9, 0.5, 12
TABLES, BITS, BLOCK, SPREAD, TILE = 8, 24, 96, 64, 128
RECALL, AUDITED, ROUNDS, CHANGED = 0.99, 2048, 6, 0.01
MOST_TABLES = 8 * TABLES

# away: not of one class, as far as the task knows; link: an edge of the task's spanning forest and no entry of a list
_EDGES = pa.schema([("u", pa.int64()), ("w", pa.int64()), ("cos", pa.float64()), ("away", pa.bool_()), ("link", pa.bool_())])
_EDGE_ROW = "u bigint, w bigint, cos double, away boolean, link boolean"


def _matrix(vectors: pa.Array) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(vectors), -1)


def _forest(joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each vector its tree in a spanning forest and the vector that it hangs on, itself for a root."""
    tree, on = np.arange(len(joined)), np.arange(len(joined))
    free = joined.any(1)
    for root in np.flatnonzero(free):
        if free[root]:
            free[root], edge = False, np.array([root])
            while len(edge):
                reach = joined[edge] & free
                new = np.flatnonzero(reach.any(0))
                on[new], tree[new], free[new] = edge[reach[:, new].argmax(0)], root, False
                edge = new
    return tree, on


def _best(ids: np.ndarray, x: np.ndarray, least: float, classes: np.ndarray) -> dict:
    """For each vector its ``K`` best of the others at ``least`` or above, ``K`` more outside its class if these are all in it,
    and a spanning forest of all links between classes."""
    cos = x @ x.T
    np.fill_diagonal(cos, -2)
    n = len(ids)
    same = classes[:, None] == classes[None, :]
    tree, on = _forest((cos >= LINK) | same & ~np.eye(n, dtype=bool))
    away = tree[:, None] != tree[None, :]

    def top(cos):
        k = min(K, n - 1)
        w = np.argpartition(-cos, k - 1, axis=1)[:, :k] if 0 < k < n - 1 else np.tile(np.arange(n), (n, 1))
        u, w = np.repeat(np.arange(n), w.shape[1]), w.ravel()
        good = (cos[u, w] >= least) & (u != w)
        return u[good], w[good]

    u, w = top(cos)
    full = np.flatnonzero((np.bincount(u, minlength=n) >= min(K, n - 1)) & (np.bincount(u[away[u, w]], minlength=n) == 0))
    if len(full) and away[full].any():
        more, behind = top(np.where(away, cos, -2))
        mine = np.isin(more, full)
        u, w = np.concatenate([u, more[mine]]), np.concatenate([w, behind[mine]])
    hung = np.flatnonzero((on != np.arange(n)) & ~same[np.arange(n), on])
    link = np.repeat([False, True], [len(u), len(hung)])
    u, w = np.concatenate([u, hung]), np.concatenate([w, on[hung]])
    return {"u": ids[u], "w": ids[w], "cos": cos[u, w], "away": away[u, w], "link": link}


def _sorted_blocks(batches):
    """Rows sorted by table, dimension and code: consecutive ones of a table are compared, ``BLOCK`` at a time."""
    held = None

    def cut(rows, last):
        nonlocal held
        key = rows.column("t").to_numpy() * 100_000 + rows.column("d").to_numpy()
        edges = np.flatnonzero(np.diff(key)) + 1
        for start, end in zip([0, *edges], [*edges, len(key)]):
            at = start
            while end - at >= BLOCK or (at < end and (last or end < len(key))):
                part = rows.slice(at, min(BLOCK, end - at))
                yield pa.RecordBatch.from_pydict(_best(part.column("id").to_numpy(), _matrix(part.column("x")), EXPLORE, part.column("c").to_numpy()), schema=_EDGES)
                at += part.num_rows
            if end == len(key):
                held = rows.slice(at) if at < end else None

    for batch in batches:
        rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if rows.num_rows:
            yield from cut(rows, False)
    if held is not None:
        yield from cut(held, True)


def _local_join(batches):
    for batch in batches:
        for row in range(batch.num_rows):
            members = batch.column("members")[row].values
            ids = members.field("id").to_numpy()
            _, once = np.unique(ids, return_index=True)
            yield pa.RecordBatch.from_pydict(_best(ids[once], _matrix(members.field("x"))[once], EXPLORE, members.field("c").to_numpy()[once]), schema=_EDGES)


def _top(edges: DataFrame) -> DataFrame:
    """``u, w, cos, away``: for each vector the ``K`` best inside its class and the ``K`` best outside."""
    once = edges.groupBy("u", "w").agg(F.max("cos").alias("cos"), F.bool_and("away").alias("away"))
    rank = F.row_number().over(Window.partitionBy("u", "away").orderBy(F.col("cos").desc(), "w"))
    return once.withColumn("r", rank).where(F.col("r") <= K).drop("r")


def _lists(edges: DataFrame) -> DataFrame:
    return edges.where("not link").drop("link")


def _links(edges: DataFrame) -> DataFrame:
    return edges.where("link").select(F.col("u").alias("a"), F.col("w").alias("b"))


def vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, x``: unit vectors in double precision; x is null for a vector that cannot have a link."""
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    out = rows.select(F.col(id_col).cast("bigint").alias("id"), x.alias("x"))
    usable = F.size("x") > 0
    usable &= F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    out = out.withColumn("most", F.when(usable & F.col("id").isNotNull(), F.array_max(F.transform("x", lambda v: F.abs(v)))))
    # the largest component is divided out first, so no square overflows or vanishes
    out = out.withColumn("x", F.when(F.col("most") > 0, F.transform("x", lambda v: v / F.col("most"))))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))
    return out.withColumn("norm", norm).select("id", F.transform("x", lambda v: v / F.col("norm") + 0.0).alias("x"))


def _coded(tables: range):
    """Each vector once for each table, with the table's signs as a code."""
    schema = pa.schema([("t", pa.int32()), ("d", pa.int32()), ("code", pa.int64()), ("id", pa.int64()), ("c", pa.int64()), ("x", pa.list_(pa.float64()))])

    def run(batches):
        for batch in batches:
            sizes = np.diff(batch.column("x").offsets.to_numpy())
            for d in np.unique(sizes):
                part = batch.take(pa.array(np.flatnonzero(sizes == d)))
                x = _matrix(part.column("x"))
                for t in tables:
                    planes = np.random.default_rng([t, int(d)]).standard_normal((int(d), BITS))
                    code = ((x @ planes > 0) @ (1 << np.arange(BITS, dtype=np.int64)[::-1])).astype(np.int64)
                    n = part.num_rows
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t, np.int32)), pa.array(np.full(n, d, np.int32)), pa.array(code), part.column("id"), part.column("c"), part.column("x")], schema=schema)
    return run


def seeded(distinct: DataFrame, tables: range) -> DataFrame:
    """Edges from the blocks of some tables; ``distinct`` has ``id, c, x``."""
    coded = distinct.select("id", "c", "x").mapInArrow(_coded(tables), "t int, d int, code bigint, id bigint, c bigint, x array<double>")
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = coded.repartitionByRange(parts, "t", "d", "code", "id").sortWithinPartitions("t", "d", "code", "id")
    return ranged.mapInArrow(_sorted_blocks, _EDGE_ROW)


def descended(distinct: DataFrame, graph: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rounds of local joins over a graph of ``u, w, cos, away`` until few lists change; the graph, and all links met."""
    members = distinct.select(F.col("id").alias("w"), "c", "x")
    for _ in range(ROUNDS):
        held = graph.groupBy(F.col("w").alias("v")).agg(F.count(F.lit(1)).alias("n"))
        held = written(held.withColumn("parts", F.ceil(F.col("n") / SPREAD).cast("int")).where("parts > 1").select("v", "parts"), "hubs")
        back = graph.select(F.col("w").alias("v"), F.col("u").alias("w")).join(held, "v", "left")
        back = back.select("v", "w", F.pmod(F.xxhash64("w"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
        own = graph.select(F.col("u").alias("v"), "w").union(graph.select(F.col("u").alias("v"), F.col("u").alias("w")).distinct())
        own = own.join(held, "v", "left").select("v", "w", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
        near = own.union(back).distinct().join(members, "w")
        joins = near.groupBy("v", "part").agg(F.collect_list(F.struct(F.col("w").alias("id"), "c", "x")).alias("members")).select("members")
        new = written(joins.mapInArrow(_local_join, _EDGE_ROW), "joined")
        links = written(links.union(_links(new)).distinct(), "links")
        better = written(_top(graph.union(_lists(new))), "graph")
        gained, size = better.join(graph, ["u", "w"], "left_anti").count(), better.count()
        graph = better
        if gained <= CHANGED * size:
            break
    return graph, links


def met(distinct: DataFrame, classes: DataFrame, graph: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes and links after those of more than ``K`` members have been compared by samples until no two of them meet.

    A link between two vectors that both have more than ``K`` links in their classes can be in neither's list; the link of a
    vector with fewer is in its own.
    """
    again = 0
    while True:
        sizes = written(classes.groupBy("comp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > K), "dense_sizes")
        count = sizes.count()
        if count < 2:
            return classes, links
        dense = classes.join(sizes, "comp").select(F.col("v").alias("id"), F.col("comp").alias("c"), "n")
        dense = written(distinct.select("id", "x").join(dense, "id"), "dense")
        again += 1
        # as many of each class, so that a block holds several classes however large they are
        few = dense.where(F.pmod(F.xxhash64(F.lit(again), "id"), F.col("n")) < SPREAD)
        first = MOST_TABLES * again
        found = written(seeded(few, range(first, first + TABLES)), "seeded")
        u, w = dense.select(F.col("id").alias("u"), F.col("c").alias("cu")), dense.select(F.col("id").alias("w"), F.col("c").alias("cw"))
        old = graph.drop("away").join(u, "u").join(w, "w").select("u", "w", "cos", (F.col("cu") != F.col("cw")).alias("away"))
        links = written(links.union(_links(found)), "links")
        # inside a class nothing is sought any more, so only lists that look out of it go on
        out = _top(old.union(_lists(found))).withColumn("any", F.max("away").over(Window.partitionBy("u"))).where("any").drop("any")
        _, links = descended(dense, written(out, "graph"), links)
        before, classes = classes, components(links)
        if classes.select("comp").distinct().count() == before.select("comp").distinct().count():
            return classes, links


_AUDIT = pa.schema([("q", pa.int64()), ("n", pa.int64()), ("same", pa.int64())])


def _audit(queries: list, comps: list, matrix: np.ndarray):
    ids, own_comps = np.array(queries, np.int64), np.array(comps, np.int64)

    def run(batches):
        for batch in batches:
            sizes = np.diff(batch.column("x").offsets.to_numpy())
            part = batch.take(pa.array(np.flatnonzero(sizes == matrix.shape[1])))
            if part.num_rows:
                linked = matrix @ _matrix(part.column("x")).T >= LINK
                linked &= ids[:, None] != part.column("id").to_numpy()
                n, same = linked.sum(1), (linked & (own_comps[:, None] == part.column("comp").to_numpy())).sum(1)
                some = n > 0
                yield pa.RecordBatch.from_pydict({"q": ids[some], "n": n[some], "same": same[some]}, schema=_AUDIT)
    return run


def recall(distinct: DataFrame, classes: DataFrame) -> list[tuple[int, int]]:
    """Of ``AUDITED`` vectors compared with all: how many have all their links in their class, and how many have links.

    First of the vectors with up to ``K`` links, then of those with more: a large group cannot speak for small ones.
    """
    named = written(distinct.join(classes, F.col("id") == F.col("v"), "left").select("id", "x", F.coalesce("comp", "id").alias("comp")), "audited")
    chosen = named.select("id", "x", "comp").orderBy(F.xxhash64(F.lit(5), "id"), "id").limit(AUDITED).collect()
    reached = [[0, 0], [0, 0]]
    for d in sorted({len(r["x"]) for r in chosen}):
        rows = [r for r in chosen if len(r["x"]) == d]
        task = _audit([r["id"] for r in rows], [r["comp"] for r in rows], np.array([r["x"] for r in rows]))
        links = named.mapInArrow(task, "q bigint, n bigint, same bigint").groupBy("q").agg(F.sum("n").alias("n"), F.sum("same").alias("same"))
        for r in links.collect():
            reached[r["n"] > K][0] += r["same"] == r["n"]
            reached[r["n"] > K][1] += 1
    return [tuple(r) for r in reached]


_COUNTS = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("low", pa.int64())])


def _tile_counts(batches):
    for batch in batches:
        for row in range(batch.num_rows):
            i, j = batch.column("i")[row].as_py(), batch.column("j")[row].as_py()
            members = batch.column("members")[row].values
            ids, count, tile = (members.field(n).to_numpy() for n in ("id", "times", "tile"))
            x = _matrix(members.field("x"))
            a, b = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
            linked = x[a] @ x[b].T >= LINK
            if i == j:
                np.fill_diagonal(linked, False)
            out = {"id": ids[a], "links": linked @ count[b], "low": np.where(linked, ids[b], 2**62).min(1, initial=2**62)}
            yield pa.RecordBatch.from_pydict(out, schema=_COUNTS)
            if i != j:
                yield pa.RecordBatch.from_pydict({"id": ids[b], "links": linked.T @ count[a], "low": np.where(linked.T, ids[a], 2**62).min(1, initial=2**62)}, schema=_COUNTS)


def enlarged(distinct: DataFrame, classes: DataFrame) -> DataFrame:
    """``id, links``: how many vectors, copies counted, each vector of a class is linked with inside it."""
    placed = written(distinct.join(classes, F.col("id") == F.col("v")).select("id", "x", "times", "comp"), "placed")
    sizes = placed.groupBy("comp").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
    sized = placed.join(written(sizes, "class_sizes"), "comp").withColumn("tile", F.pmod(F.xxhash64("id"), "tiles").cast("int"))
    # a tile meets every other tile of its class once, the lower number first
    met = sized.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    met = met.withColumns({"i": F.least("tile", "o"), "j": F.greatest("tile", "o")})
    tiles = met.groupBy("comp", "i", "j").agg(F.collect_list(F.struct("id", "x", "times", "tile")).alias("members"))
    counts = tiles.select("i", "j", "members").mapInArrow(_tile_counts, "id bigint, links bigint, low bigint")
    return counts.groupBy("id").agg(F.sum("links").alias("links"))


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per row: ``vec_id, n_links, component_id, kept``.

    Linked are vectors of equal dimension with a cosine of 0.9 or more in double precision. A vector that is null, empty, zero
    or holds a null or non-finite component has no link and is its own component; so is a row without an id, whose component is
    null and which is kept. Copies are linked with each other; rows that repeat an id are copies with one name. Other columns
    are ignored. An empty table gives an empty result. If the audit is not passed after ``MOST_TABLES`` tables, an error says
    how far it came.
    """
    every = written(vectors(rows, id_col, vector_col), "vectors")
    distinct = every.where("x is not null").groupBy("x").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("times"))
    distinct = written(distinct, "distinct_vectors")
    single = distinct.select("id", F.col("id").alias("c"), "x")
    graph = links = None
    for first in range(0, MOST_TABLES, TABLES):
        found = written(seeded(single, range(first, first + TABLES)), "seeded")
        links = _links(found) if links is None else links.union(_links(found))
        lists = _lists(found) if graph is None else graph.union(_lists(found))
        graph, links = descended(single, written(_top(lists), "graph"), links)
        classes, links = met(distinct, components(links), graph, links)
        reached = recall(distinct, classes)
        if all(whole >= RECALL * n for whole, n in reached):
            break
    else:
        raise RuntimeError(f"after {MOST_TABLES} tables the audited vectors whose links are all found are {reached[0]} with up to {K} links and {reached[1]} with more (found, of)")
    counted = enlarged(distinct, classes)
    named = distinct.join(classes, F.col("id") == F.col("v"), "left").join(counted, "id", "left").select(
        F.col("x").alias("_x"), F.coalesce("comp", "id").alias("comp"), (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("links"))
    named = written(named, "named_vectors")
    out = every.join(named, F.col("x") == F.col("_x"), "left")
    comp = F.coalesce("comp", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), comp.alias("component_id"), F.col("id").eqNullSafe(comp).alias("kept"))
