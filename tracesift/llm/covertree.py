"""Exact top-k inner products by dual-tree search over cover trees, one tree pair to a task.

The first level of the tree over all vectors are pivots from a bounded sample;
every vector belongs to its nearest pivot, and a pivot's vectors are dealt into
cells of bounded size, each with a covering radius. A query meets the cells
that its bound can't rule out. Within a task the cell and its block of queries
each get a cover tree, and node pairs are pruned against the worst kth score of
the query node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracesift.session import discard, written_once

#: Vectors in a cell, queries in a block, pivots, and vectors that pivots are chosen from.
CELL, BLOCK, PIVOTS, SAMPLE = 4096, 4096, 64, 4096
#: Vectors in a leaf, and children of a node.
LEAF, FANOUT = 96, 12
#: Relative slack for rounding in the bounds; scores themselves are exact integers.
SLACK = 1e-9


def farthest_first(points: np.ndarray, most: int, stop: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres that cover the points: each next one is the point farthest from those before.

    Ends at ``most`` centres or once every point lies within ``stop`` of one.
    Returns the centres' rows, each point's centre number and its distance.
    """
    chosen = [0]
    distance = np.sqrt(((points - points[0]) ** 2).sum(axis=1))
    owner = np.zeros(len(points), np.int64)
    while len(chosen) < most:
        far = int(np.argmax(distance))
        if distance[far] <= stop:
            break
        other = np.sqrt(((points - points[far]) ** 2).sum(axis=1))
        closer = other < distance
        owner[closer], distance = len(chosen), np.minimum(distance, other)
        chosen.append(far)
    return np.array(chosen), owner, distance


class Node:
    """A centre, the radius that covers its points, and its children; a leaf holds the rows of its points."""

    __slots__ = ("centre", "children", "norm", "radius", "rows", "worst")

    def __init__(self, points: np.ndarray, rows: np.ndarray, centre: np.ndarray):
        own = points[rows]
        self.centre, self.rows, self.worst = centre, rows, -np.inf
        self.norm = float(np.sqrt((centre**2).sum()))
        self.radius = float(np.sqrt(((own - centre) ** 2).sum(axis=1).max()))
        self.children: list[Node] = []
        if len(rows) <= LEAF:
            return
        if self.radius == 0:
            self.children = [Node(points, rows[k : k + LEAF], centre) for k in range(0, len(rows), LEAF)]
            return
        chosen, owner, _ = farthest_first(own, FANOUT, self.radius / 2)
        self.children = [Node(points, rows[owner == k], own[c]) for k, c in enumerate(chosen)]


class Search:
    """Exact k best integer inner products of every query over the points of one cell."""

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, points: np.ndarray, point_ids: np.ndarray, k: int, floor: np.ndarray):
        order = np.argsort(point_ids, kind="stable")
        self.points, self.ids = points[order], point_ids[order]
        self.queries, self.query_ids, self.k = queries, query_ids, k
        self.scores = np.full((len(queries), k), -np.inf)
        self.found = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.floor = floor
        self.pairs = 0
        if len(queries) and len(points):
            q, p = (Node(x, np.arange(len(x)), x.mean(axis=0)) for x in (self.queries, self.points))
            self._visit(q, p)

    def _bound(self, q: Node, p: Node) -> float:
        value = float(q.centre @ p.centre) + q.radius * p.norm + p.radius * q.norm + q.radius * p.radius
        return value + SLACK * (abs(value) + 1)

    def _worst(self, rows: np.ndarray) -> float:
        return float(np.maximum(self.scores[rows, -1], self.floor[rows]).min())

    def _visit(self, q: Node, p: Node) -> None:
        if self._bound(q, p) < q.worst:
            return
        if not q.children and not p.children:
            self._leaves(q, p)
            q.worst = self._worst(q.rows)
            return
        # The side with the larger radius is opened; the most promising pairs come first.
        if q.children and (not p.children or q.radius >= p.radius):
            for c in q.children:
                self._visit(c, p)
            q.worst = max(q.worst, min(c.worst for c in q.children))
        else:
            for c in sorted(p.children, key=lambda x: -self._bound(q, x)):
                self._visit(q, c)

    def _leaves(self, q: Node, p: Node) -> None:
        self.pairs += len(q.rows) * len(p.rows)
        scores = self.queries[q.rows] @ self.points[p.rows].T
        scores[self.query_ids[q.rows][:, None] == self.ids[p.rows][None, :]] = -np.inf
        for i in np.flatnonzero((scores >= np.maximum(self.scores[q.rows, -1], self.floor[q.rows])[:, None]).any(axis=1)):
            row = q.rows[i]
            values = np.concatenate((self.scores[row], scores[i]))
            ids = np.concatenate((self.found[row], self.ids[p.rows]))
            best = np.lexsort((ids, -values))[: self.k]
            self.scores[row], self.found[row] = values[best], ids[best]


def _stack(column: pd.Series) -> np.ndarray:
    """Vectors as rows of float64, whose products of up to 2**53 are exact."""
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.empty((0, 0))


def floored(embedding: Column, factor: int = 256) -> Column:
    """floor(factor * x) of every component as double; null if the vector is null, empty, or has a null or non-finite component."""
    doubles = F.transform(embedding, lambda x: x.cast("double"))
    bad = F.exists(doubles, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(embedding.isNull() | (F.size(embedding) == 0) | bad, None).otherwise(F.transform(doubles, lambda x: F.floor(x * factor)))


def top_products(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: each query's ``k`` best rows by inner product.

    ``vectors``: ``vec_id`` and ``v`` (array of long, see ``floored``). Queries
    are the rows whose id is divisible by ``every``; candidates are all rows of
    another id. Ties go to the smaller id; fewer candidates give fewer rows.

    Rows with null id or vector take no part, nor do pairs of vectors of different
    length. Equal rows are one row. Scores must stay below 2**53, where doubles
    are exact. An empty table gives no rows; further columns are ignored.
    """
    usable = vectors.where("vec_id is not null and v is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<long>").alias("v"))
    # The pivots' sample is bounded by SAMPLE, the pivots by PIVOTS for each vector length.
    sample = usable.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()
    pivots: dict[int, np.ndarray] = {}
    for size, part in sample.groupby(sample["v"].map(len)):
        points = _stack(part["v"])
        pivots[int(size)] = points[farthest_first(points, PIVOTS)[0]]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            sizes = np.diff(column.offsets.to_numpy())
            flat = column.flatten().to_numpy().astype(np.float64)
            begin = np.concatenate(([0], np.cumsum(sizes)))
            pivot, distance = np.zeros(len(sizes), np.int64), np.zeros(len(sizes))
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                points = flat[begin[rows][:, None] + np.arange(size)]
                centres = pivots.get(int(size), np.zeros((1, size)))
                square = (points**2).sum(axis=1)[:, None] - 2 * points @ centres.T + (centres**2).sum(axis=1)[None, :]
                pivot[rows] = square.argmin(axis=1)
                distance[rows] = np.sqrt(((points - centres[pivot[rows]]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0), column, pa.array(sizes, pa.int32()), pa.array(pivot, pa.int32()), pa.array(distance)],
                                             names=["vec_id", "v", "size", "pivot", "distance"])

    placed = written_once(usable.mapInArrow(assign, "vec_id long, v array<long>, size int, pivot int, distance double").distinct())
    # One row per pivot: at most PIVOTS for each vector length, so it is broadcast.
    cells = placed.groupBy("size", "pivot").agg(F.ceil(F.count("*") / CELL).alias("cells"), F.max("distance").alias("radius"))
    blocks = placed.where(F.col("vec_id") % every == 0).groupBy("size").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    summary = {(r["size"], r["pivot"]): (r["cells"], r["radius"]) for r in cells.collect()}
    counts = {r["size"]: r["blocks"] for r in blocks.collect()}

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every pivot with vectors, for every query, and the largest score that its cells may hold."""
        for batch in batches:
            ids, vectors_, sizes = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2).to_numpy()
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                q = np.array([vectors_[r] for r in rows], np.float64).reshape(len(rows), size)
                own = sorted(p for s, p in summary if s == size)
                centres = pivots.get(int(size), np.zeros((1, size)))[own]
                radius = np.array([summary[int(size), p][1] for p in own])
                bound = q @ centres.T + np.sqrt((q**2).sum(axis=1))[:, None] * radius[None, :]
                bound += SLACK * (np.abs(bound) + 1)
                first = np.zeros(bound.shape, bool)
                first[np.arange(len(rows)), bound.argmax(axis=1)] = True
                n = len(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids[rows], n)), batch.column(1).take(pa.array(np.repeat(rows, n))), pa.array(np.full(n * len(rows), size), pa.int32()),
                     pa.array(np.tile(np.array(own, np.int32), len(rows)), pa.int32()), pa.array(bound.ravel()), pa.array(first.ravel())],
                    names=["query_id", "q", "size", "pivot", "bound", "first"])

    queries = placed.where(F.col("vec_id") % every == 0).select("vec_id", "v", "size")
    reached = queries.mapInArrow(reach, "query_id long, q array<long>, size int, pivot int, bound double, first boolean")
    many = cells.select("size", "pivot", "cells")
    number = F.create_map(*(x for s, n in counts.items() for x in (F.lit(s), F.lit(n)))) if counts else F.lit(None)
    block = F.pmod(F.xxhash64("query_id"), F.element_at(number, F.col("size"))) if counts else F.lit(0).cast("long")
    points = placed.join(F.broadcast(many), ["size", "pivot"]).withColumn("cell", F.pmod(F.xxhash64("vec_id"), F.col("cells")))
    if counts:
        points = points.where(F.col("size").isin(list(counts))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.element_at(number, F.col("size")) - 1)))
    else:
        points = points.where("false").withColumn("block", F.lit(0).cast("long"))

    def search(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        ids = right["query_id"].to_numpy()
        found = Search(_stack(right["q"]), ids, _stack(left["v"]), left["vec_id"].to_numpy(), k, right["least"].to_numpy(np.float64))
        real = np.isfinite(found.scores)
        return pd.DataFrame({"query_id": np.repeat(ids, k)[real.ravel()], "vec_id": found.found[real], "score": found.scores[real].astype(np.int64)})

    def searched(asked: DataFrame) -> DataFrame:
        dealt = asked.join(F.broadcast(many), ["size", "pivot"]).withColumn("block", block).withColumn(
            "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)))
        keys = ["size", "pivot", "cell", "block"]
        found = points.select(*keys, "vec_id", "v").groupBy(*keys).cogroup(dealt.select(*keys, "query_id", "q", "least").groupBy(*keys)).applyInPandas(
            search, "query_id long, vec_id long, score long")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    first = written_once(searched(reached.where("first").withColumn("least", F.lit(float("-inf")))))
    kth = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("kth"))
    rest = reached.where("not first").join(kth, "query_id", "left").withColumn(
        "least", F.when(F.col("n") >= k, F.col("kth").cast("double")).otherwise(F.lit(float("-inf")))).where(F.col("bound") >= F.col("least"))
    both = first.select("query_id", "vec_id", "score").union(searched(rest).select("query_id", "vec_id", "score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = written_once(both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
    discard(first)
    discard(placed)
    return out


#: DuckDB SQL for the rows of ``top_products`` over ``embeddings`` with floored components: brute force.
ORACLE = """
WITH usable AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM scored)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM ranked WHERE n <= 5
"""
