"""Exact top-k by inner product: dual-tree search over cover trees.

Vectors become integers floor(1024 x).  Each is dealt to the nearest of some pivots (cells; more of them for more
vectors), and cells to blocks of bounded size; queries of a few cells, or of a part of one, make groups of bounded size.
Queries first search
their own cell, which gives each a k-th score.  A cell is visited by a group of queries only if a bound from centres and
covering radii reaches the group's worst k-th score, and its vectors are sent to the groups that visit it alone.  Where queries and a
block meet, a cover tree over either side is walked in pairs of nodes; a pair is pruned when its bound is below the
worst k-th score among the query node's queries.  Bounds round up, so no result is lost.

Vectors that are null or hold null or non-finite components take no part; vectors of another length than the query's
are no candidates.  Rows with one vec_id are candidates each, and queries each; only a query's own row is left out.
Ties go to the smaller vec_id.  An empty table gives an empty result.  Other columns are ignored.
A score beyond 64 bits is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandwise.llm.common import stored
from strandwise.llm.jaccard import bounds, runs

TOP, SCALE, EVERY = 10, 1024, 100
#: Fewest and most pivots, and vectors for each; rows of a block, queries that meet a block at once; points of a leaf
#: among data and among queries; data points of a page, whose leaves are bounded together.
PIVOTS, MOST_PIVOTS, PER_PIVOT = 16, 1024, 1 << 16
BLOCK, CHUNK, LEAF, QUERY_LEAF, PAGE = 4096, 4096, 32, 32, 512


def integer_vectors(table: DataFrame) -> DataFrame:
    """uid, vec_id, dims, v (int64 components) of the rows that take part."""
    ok = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    return table.where(ok).select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long").alias("vec_id"), F.size("embedding").alias("dims"), whole.alias("v"))


def matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten()).reshape(len(column), dims)


class Node:
    """A cover tree's node: a centre, the radius that covers its points, and children or, in a leaf, the points."""

    __slots__ = ("centre", "norm", "radius", "points", "children", "page")

    def __init__(self, vectors: np.ndarray, points: np.ndarray, at: int, leaf: int = LEAF) -> None:
        self.centre = vectors[at]
        self.norm = float(np.linalg.norm(self.centre))
        gap = np.linalg.norm(vectors[points] - self.centre, axis=1)
        self.radius = float(gap.max()) * (1 + 1e-9) if len(points) else 0.0
        self.points, self.children = points, []
        if len(points) <= leaf or self.radius == 0:
            return
        # Cover the points with balls of half the radius, each round the farthest point that none holds yet.
        left, own, near = points, at, gap
        while len(left):
            inside = near <= self.radius / 2
            if not inside.any():
                break
            self.children.append((own, left[inside]))
            left, gap = left[~inside], gap[~inside]
            if not len(left):
                break
            own = left[int(np.argmax(gap))]
            near = np.linalg.norm(vectors[left] - vectors[own], axis=1)
            if len(self.children) >= 64:  # thin covers: the rest is cut by nearest centre
                centres = [c for c, _ in self.children]
                own_ = vectors[centres]
                nearest = np.argmin((own_**2).sum(1)[None, :] - 2 * (vectors[left] @ own_.T), axis=1)
                self.children = [(c, np.concatenate([p, left[nearest == k]])) for k, (c, p) in enumerate(self.children)]
                left = left[:0]
        self.children = [Node(vectors, p, c, leaf) if len(p) < len(points) else _leaf(vectors, p, c) for c, p in self.children]


def _leaf(vectors: np.ndarray, points: np.ndarray, at: int) -> Node:
    node = Node.__new__(Node)
    node.centre, node.norm, node.points, node.children = vectors[at], float(np.linalg.norm(vectors[at])), points, []
    node.radius = float(np.linalg.norm(vectors[points] - vectors[at], axis=1).max()) * (1 + 1e-9)
    return node


def upper(q: Node, d: Node) -> float:
    """No query under q has a larger product with any point under d."""
    x = float(q.centre @ d.centre) + q.norm * d.radius + d.norm * q.radius + q.radius * d.radius
    return x + abs(x) * 1e-9 + 1e-6


class Page:
    """The leaves under a node: centres, radii, and the points of all, leaf by leaf."""

    def __init__(self, node: Node) -> None:
        leaves, stack = [], [node]
        while stack:
            n = stack.pop()
            stack += n.children
            if not n.children:
                leaves.append(n)
        self.centres, self.radii = np.stack([n.centre for n in leaves]), np.array([n.radius for n in leaves])
        self.points, self.sizes = np.concatenate([n.points for n in leaves]), np.array([len(n.points) for n in leaves])

    def near(self, vectors: np.ndarray, norms: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """Leaves in which some query may reach its floor: a point's product is the centre's and its norm times the radius at most."""
        bound = vectors @ self.centres.T + norms[:, None] * self.radii
        return (bound + np.abs(bound) * 1e-9 + 1e-6 >= floor[:, None]).any(axis=0)


def pages(node: Node, most: int = PAGE) -> Node:
    """The tree with pages as its leaves: nodes of ``most`` points at most, and leaves of more."""
    if len(node.points) <= most or not node.children:
        node.page, node.children = Page(node), []
    else:
        node.children = [pages(c, most) for c in node.children]
    return node


class Best:
    """The best scores of each query so far."""

    def __init__(self, n: int, floor: np.ndarray) -> None:
        self.rows = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(n)]
        self.floor = floor.astype(np.float64)  # the k-th score known so far, -inf where there are fewer
        self.pairs = self.pruned = self.products = 0  # of nodes that were looked at, of these cut off, and scores worked out

    def offer(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        for k in np.flatnonzero(scores.max(axis=1) >= self.floor[queries]):
            q = queries[k]
            keep = (scores[k] >= self.floor[q]) & ~own[k]
            if keep.any():
                s, i = np.concatenate([self.rows[q][0], scores[k][keep]]), np.concatenate([self.rows[q][1], ids[keep]])
                order = np.lexsort((i, -s))[:TOP]
                self.rows[q] = s[order], i[order]
                if len(order) == TOP:
                    self.floor[q] = max(self.floor[q], s[order[-1]])


def dual_search(queries: np.ndarray, q_uid: np.ndarray, floor: np.ndarray, data: np.ndarray, d_uid: np.ndarray, d_id: np.ndarray) -> Best:
    """The TOP products of each query with the data that reach its floor, by a walk over pairs of nodes."""
    qf, df = queries.astype(np.float64), data.astype(np.float64)
    most = data.shape[1] * float(np.abs(qf).max(initial=0)) * float(np.abs(df).max(initial=0))
    best = Best(len(queries), floor)
    q_root = Node(qf, np.arange(len(queries)), 0, QUERY_LEAF)
    d_root = pages(Node(df, np.arange(len(data)), 0))
    norms = np.linalg.norm(qf, axis=1)
    stack = [(q_root, d_root, upper(q_root, d_root))]
    while stack:
        q, d, bound = stack.pop()
        best.pairs += 1
        if bound < best.floor[q.points].min():
            best.pruned += 1
            continue
        if not q.children and not d.children:
            near = d.page.near(qf[q.points], norms[q.points], best.floor[q.points])
            best.pairs += len(near) - 1
            best.pruned += len(near) - int(near.sum())
            if not near.any():
                continue
            points = d.page.points if near.all() else d.page.points[np.repeat(near, d.page.sizes)]
            if most < 2.0**52:
                scores = (qf[q.points] @ df[points].T).astype(np.int64)
            elif most < 2.0**62:
                scores = queries[q.points] @ data[points].T
            else:
                exact = queries[q.points].astype(object) @ data[points].astype(object).T
                if max(map(abs, exact.flat)) >= 1 << 63:
                    raise OverflowError("a score is beyond 64 bits")
                scores = exact.astype(np.int64)
            best.products += scores.size
            best.offer(q.points, scores, d_id[points], d_uid[points][None, :] == q_uid[q.points][:, None])
            continue
        if q.children and (not d.children or q.radius >= d.radius):
            pairs = [(c, d, upper(c, d)) for c in q.children]
        else:
            pairs = [(q, c, upper(q, c)) for c in d.children]
        stack += sorted(pairs, key=lambda p: p[2])  # the most promising pair is walked first
    return best


def _meet(queries: DataFrame, data: DataFrame, n_parts: int) -> DataFrame:
    """query uid, vec_id, score.  queries: uid, v, floor and data: uid, vec_id, v, both with dims, block, chunk."""
    left = queries.select("dims", "block", "chunk", F.lit(0).alias("side"), "uid", F.lit(0).cast("long").alias("vec_id"), "v", "floor")
    right = data.select("dims", "block", "chunk", F.lit(1).alias("side"), "uid", "vec_id", "v", F.lit(None).cast("double").alias("floor"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["dims", "block", "chunk"]):
            at = bounds(table, ["dims", "block", "chunk"])
            for a, b in zip(at[:-1], at[1:]):
                part = table.slice(a, b - a)
                n = int((part["side"].to_numpy() == 0).sum())
                if not n or n == b - a:
                    continue
                dims = part["dims"][0].as_py()
                v, uid = matrix(part["v"], dims), part["uid"].to_numpy()
                floor = np.nan_to_num(part["floor"].to_numpy()[:n], nan=-np.inf, neginf=-np.inf)
                best = dual_search(v[:n], uid[:n], floor, v[n:], uid[n:], part["vec_id"].to_numpy()[n:])
                sizes = [len(s) for s, _ in best.rows]
                if sum(sizes):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(uid[:n], sizes)), pa.array(np.concatenate([i for _, i in best.rows])), pa.array(np.concatenate([s for s, _ in best.rows]))],
                        ["uid", "vec_id", "score"],
                    )

    both = left.unionByName(right).repartition(n_parts, "dims", "block", "chunk").sortWithinPartitions("dims", "block", "chunk", "side")
    return both.mapInArrow(run, "uid long, vec_id long, score long")


def packed(cells: list) -> list[tuple]:
    """dims, cell, pack, chunks: cells in order are packed up to CHUNK queries; one with more is a pack of several chunks."""
    out, pack, held = [], 0, 0
    for dims, cell, n in sorted(map(tuple, cells)):
        if out and (out[-1][0] != dims or held + n > CHUNK):
            pack, held = pack + 1, 0
        held += n
        out.append((dims, cell, str(pack), max(1, -(-n // CHUNK))))
    return out


def top_products(table: DataFrame, every: int = EVERY, k: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest products."""
    spark = table.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = stored(integer_vectors(table), "vectors")
    n_pivots = min(MOST_PIVOTS, max(PIVOTS, rows.count() // PER_PIVOT))
    picked = rows.orderBy(F.xxhash64("uid")).limit(n_pivots).select("dims", "v").collect()  # MOST_PIVOTS rows at most
    pivots = {}
    for r in picked:
        pivots.setdefault(r["dims"], []).append(r["v"])
    pivots = {d: np.array(p, np.int64) for d, p in pivots.items()}

    def centres_of(dims: int) -> np.ndarray:
        return pivots.get(dims, np.zeros((1, dims))).astype(np.float64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            cell, far = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for d in np.unique(dims):
                own = np.flatnonzero(dims == d)
                v = matrix(batch.column("v").take(pa.array(own)), d).astype(np.float64)
                centres = centres_of(d)
                cell[own] = np.argmin((centres**2).sum(axis=1) - 2 * (v @ centres.T), axis=1)  # any centre would do, the nearest prunes most
                far[own] = np.linalg.norm(v - centres[cell[own]], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], [*batch.schema.names, "cell", "far"])

    dealt = stored(rows.mapInArrow(deal, "uid long, vec_id long, dims int, v array<bigint>, cell int, far double"), "cells")
    cells = dealt.groupBy("dims", "cell").agg(F.count("*").alias("n"), F.max("far").alias("radius"), F.count_if(F.pmod("vec_id", F.lit(every)) == 0).alias("queries"))
    cells = cells.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    cells = stored(cells, "cell-sizes")  # MOST_PIVOTS rows and one for each other length
    at = ["dims", "cell"]
    block = F.concat_ws("-", "cell", F.pmod(F.xxhash64("uid", F.lit(1)), F.col("blocks")))
    blocked = dealt.join(cells.select(*at, "blocks"), at).withColumn("block", block).drop("blocks")
    group = F.concat_ws("-", "pack", F.pmod(F.xxhash64("uid", F.lit(2)), F.col("chunks")))
    packs = spark.createDataFrame(packed(cells.select(*at, "queries").collect()), "dims int, cell int, pack string, chunks int")  # a row for each cell
    queries = dealt.where(F.pmod("vec_id", F.lit(every)) == 0).join(packs, at).withColumn("chunk", group).drop("chunks", "pack")
    block_list = cells.select(*at, F.explode(F.expr("transform(sequence(0, blocks - 1), b -> concat_ws('-', cell, b))")).alias("block"))

    def met(asking: DataFrame, visits: DataFrame, home: bool) -> DataFrame:
        """The products of queries (with floor) and the cells that their groups visit: their own cell, or the others.  visits: dims, cell, chunk."""
        sent = asking.withColumnRenamed("cell", "home").join(visits, ["dims", "chunk"]).where((F.col("home") == F.col("cell")) == F.lit(home))
        return _meet(sent.join(block_list, at), blocked.join(visits, at), n_parts)

    # First the own cell, which gives each query a k-th score.
    own = queries.select(*at, "chunk").distinct()
    first = stored(met(queries.withColumn("floor", F.lit(None).cast("double")), own, True), "own-cell")
    rank = W.partitionBy("uid").orderBy(F.desc("score"), "vec_id")
    kth = first.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") == k).select("uid", F.col("score").cast("double").alias("floor"))
    known = stored(queries.join(kth, "uid", "left"), "queries")

    # Then the cells that a group of queries may gain from.
    groups = known.groupBy("dims", F.col("cell").alias("home"), "chunk").agg(F.max("far").alias("reach"), F.min(F.coalesce("floor", F.lit(float("-inf")))).alias("worst"))
    radii = {(r["dims"], r["cell"]): r["radius"] for r in cells.collect()}

    def visited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for g in batch.to_pylist():
                mine = np.array([c for d, c in radii if d == g["dims"] and c != g["home"]], np.int64)
                if not len(mine):
                    continue
                centres, radius = centres_of(g["dims"]), np.array([radii[g["dims"], c] for c in mine])
                p, q = centres[g["home"]], centres[mine]
                bound = q @ p + np.linalg.norm(p) * radius + np.linalg.norm(q, axis=1) * g["reach"] + radius * g["reach"]
                out += [(g["dims"], c, g["chunk"]) for c in mine[bound + np.abs(bound) * 1e-9 + 1e-6 >= g["worst"]].tolist()]
            if out:
                dims, cell, chunk = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(dims, pa.int32()), pa.array(cell, pa.int32()), pa.array(chunk, pa.string())], ["dims", "cell", "chunk"])

    visits = stored(groups.mapInArrow(visited, "dims int, cell int, chunk string").distinct(), "visits")
    found = first.unionByName(met(known, visits, False))
    ranked = found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
    return ranked.join(known.select("uid", F.col("vec_id").alias("query_id")), "uid").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op8_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP8_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id,
    CAST(coalesce(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * d.v[i])), 0) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id AND len(q.v) = len(d.v) WHERE q.vec_id % {EVERY} = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {TOP}
"""
