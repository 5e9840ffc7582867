"""Operator 9: exact top-k inner products by best-first search in M-trees.

The vectors are dealt into shards of about ``SHARD`` rows. Each shard is an M-tree of pages: a node keeps its routing
object, the covering radius and the distance to its parent's routing object, a leaf keeps each vector's distance to the
routing object. For a query q and a ball with centre p and radius r no score is above q.p + |q| r; with the stored
distance d(p, P) to the parent the bound q.P + |q| (d(p, P) + r) needs no new product, so that nodes and vectors are left
out without computing anything on them. Nodes are visited best bound first until no bound reaches the k-th score.

The query set (ids divisible by 100) meets the shards in blocks of queries, never row by row; each shard's best k of a
query are merged. Components are floor(1024 * x).

Defined cases: vectors that are null or hold null or non-finite components (also those whose 1024-fold is none) and rows
without an id take no part; vectors of different lengths have no score with each other; rows that repeat the query's id are
the query's own; other rows that repeat an id are candidates each by itself; where a query's id has several vectors each is
searched and the scores are ranked together, equal rows once; ties go to the smaller id; empty tables give no rows; other
columns are not read. Where products could leave the integers that a double holds (2^53), whole-number arithmetic is used;
a score beyond the range of a long counts as that range's end.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_rows, table

K, SHARD, BLOCK = 10, 8192, 256
PAGE, FANOUT = 64, 16


@dataclass
class Page:
    """A node. Children's or vectors' values are kept side by side, so that bounds come from one operation."""

    centres: np.ndarray  # of children (routing objects), or the vectors of a leaf
    to_parent: np.ndarray  # stored distances to this page's own routing object
    radii: np.ndarray  # covering radii of children; empty in a leaf
    ids: np.ndarray  # of a leaf's vectors
    children: list[Page] = field(default_factory=list)


def _distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, ((x - p) ** 2).sum(axis=1)))


def build(x: np.ndarray, ids: np.ndarray, centre: np.ndarray, rng: np.random.Generator) -> Page:
    """A page over the rows of x, whose routing object is ``centre``."""
    far = _distances(x, centre)
    if len(x) <= PAGE or float(far.max()) == 0.0:
        order = np.argsort(ids, kind="stable")
        return Page(x[order], far[order], np.empty(0), ids[order])
    pivots = x[rng.choice(len(x), min(FANOUT, len(x)), replace=False)]
    nearest = np.argmin(((x**2).sum(axis=1)[:, None] - 2 * x @ pivots.T) + (pivots**2).sum(axis=1)[None, :], axis=1)
    groups = [np.flatnonzero(nearest == k) for k in range(len(pivots))]
    groups = [(k, g) for k, g in enumerate(groups) if len(g)]
    if len(groups) == 1:  # equal pivots: halves by distance
        order = np.argsort(far, kind="stable")
        groups = [(0, order[: len(order) // 2]), (0, order[len(order) // 2 :])]
    centres = np.stack([pivots[k] for k, _ in groups])
    children = [build(x[g], ids[g], pivots[k], rng) for k, g in groups]
    radii = np.array([_distances(x[g], pivots[k]).max() for k, g in groups])
    return Page(centres, _distances(centres, centre), radii, np.empty(0, dtype=np.int64), children)


def make_tree(x: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, Page]:
    centre = np.floor(x.mean(axis=0))
    return centre, build(x, ids, centre, np.random.default_rng(len(x)))


#: Products below this are exact in doubles.
EXACT = 2.0**52
_LONG = (-(1 << 63), (1 << 63) - 1)


def _reach(page: Page) -> float:
    """The largest distance of a vector from the page's routing object, or more."""
    far = page.to_parent + page.radii if page.children else page.to_parent
    return float(far.max()) if len(far) else 0.0


def _rows(page: Page) -> Iterator[tuple[np.ndarray, int]]:
    if page.children:
        for child in page.children:
            yield from _rows(child)
    else:
        yield from zip(page.centres, page.ids.tolist(), strict=True)


def _search_wide(root: Page, q: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
    """The same in whole-number arithmetic, for components so large that bounds in doubles mean nothing."""
    whole = [int(v) for v in q]
    scores = ((max(_LONG[0], min(_LONG[1], sum(a * int(b) for a, b in zip(whole, x, strict=True)))), -i) for x, i in _rows(root) if i != own)
    return [(s, -i) for s, i in heapq.nlargest(k, scores)]


def search(tree: tuple[np.ndarray, Page], q: np.ndarray, own: int, k: int = K) -> list[tuple[int, int]]:
    """The best k as (score, id): higher scores first, ties to smaller ids. Exact."""
    centre, root = tree
    norm = math.sqrt(float(q @ q))
    if norm * (math.sqrt(float(centre @ centre)) + _reach(root)) >= EXACT:
        return _search_wide(root, q, own, k)
    slack = 1e-9 * (1 + norm)  # bounds are rounded; scores are exact
    best: list[tuple[float, int]] = []  # (score, -id), the worst first
    heap: list[tuple[float, int, Page, float]] = [(-math.inf, 0, root, float(q @ centre))]
    count = 1
    while heap:
        bound, _, page, at_centre = heapq.heappop(heap)
        worst = best[0][0] if len(best) == k else -math.inf
        if -bound < worst:
            break
        if not page.children:
            tops = at_centre + norm * page.to_parent + slack * (1 + page.to_parent)
            rows = np.flatnonzero(tops >= worst)
            scores = page.centres[rows] @ q
            for i, s in zip(page.ids[rows].tolist(), scores.tolist(), strict=True):
                if i == own:
                    continue
                if len(best) < k:
                    heapq.heappush(best, (s, -i))
                elif (s, -i) > best[0]:
                    heapq.heapreplace(best, (s, -i))
            continue
        cheap = at_centre + norm * (page.to_parent + page.radii) + slack * (1 + page.to_parent + page.radii)
        rows = np.flatnonzero(cheap >= worst)
        at = page.centres[rows] @ q
        tops = np.minimum(cheap[rows], at + norm * page.radii[rows] + slack * (1 + page.radii[rows]))
        for r, a, t in zip(rows.tolist(), at.tolist(), tops.tolist(), strict=True):
            if t >= worst:
                heapq.heappush(heap, (-t, count, page.children[r], a))
                count += 1
    return [(int(s), -i) for s, i in sorted(best, reverse=True)]


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<f8").reshape(len(column), size)


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>, size): floor(1024 * x) of the vectors that take part."""
    x = F.transform(F.col("embedding"), lambda e: e.cast("double"))
    good = F.forall(F.col("embedding"), lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double") * 1024.0) < float("inf")))
    return vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & good).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.when(F.abs(e * 1024.0) < EXACT, F.floor(e * 1024.0).cast("double")).otherwise(e * 1024.0)).alias("v"), F.size("embedding").alias("size"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) for ``queries`` (vec_id, v, size) against ``vectors`` (the same columns)."""
    n = vectors.count()
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-queries.count() // BLOCK))

    def trees(keys: tuple, rows: pa.Table) -> pa.Table:
        size = keys[1].as_py()
        ids = rows.column("vec_id").to_numpy()
        x = rows.column("v").combine_chunks().values.to_numpy(zero_copy_only=False).reshape(len(ids), size)
        order = np.argsort(ids, kind="stable")
        return pa.table({"shard": [keys[0].as_py()], "size": [size], "tree": [pickle.dumps(make_tree(x[order], ids[order]), protocol=5)]}, schema=pa.schema([("shard", pa.int32()), ("size", pa.int32()), ("tree", pa.binary())]))

    def blocked(keys: tuple, rows: pa.Table) -> pa.Table:
        size = keys[1].as_py()
        ids = rows.column("vec_id").to_numpy()
        x = rows.column("v").combine_chunks().values.to_numpy(zero_copy_only=False).reshape(len(ids), size)
        return pa.table({"size": [size], "queries": [pickle.dumps((ids, x), protocol=5)]}, schema=pa.schema([("size", pa.int32()), ("queries", pa.binary())]))

    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    forest = dealt.groupBy("shard", "size").applyInArrow(trees, "shard int, size int, tree binary")
    unique = queries.select("vec_id", "size", "v").distinct()
    asked = unique.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).groupBy("block", "size").applyInArrow(blocked, "size int, queries binary")
    # each block of queries meets each shard once
    met = asked.select("size", "queries", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")).join(forest, ["shard", "size"]).select("queries", "tree")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            for block, tree in zip(batch.column(0), batch.column(1), strict=True):
                ids, x = pickle.loads(block.as_py())
                tree = pickle.loads(tree.as_py())
                out = [(q, i, s) for q, v in zip(ids.tolist(), x, strict=True) for s, i in search(tree, v, q, k)]
                yield [[o[0] for o in out], [o[1] for o in out], [o[2] for o in out]]

    found = map_rows(met, run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM (SELECT DISTINCT vec_id, e FROM v) q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""
