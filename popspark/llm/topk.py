"""Exact top-k inner products by best-first search of M-trees.

Rows are dealt to the nearest of at most PIVOTS sampled vectors; a cell's rows are cut by hash into groups of bounded size,
and a task builds one M-tree a group: pages with a routing object, a covering radius and the distance to the parent's
routing object. With s = <q, routing object of the page>, any x below an entry has <q, x> <= s + |q| (distance to parent +
radius), which is known before the entry's own routing object is compared; only entries that may still hold one of the k
best are compared. Each query is answered in the group of its own cell first; with the k-th score found there it is sent
only to the groups of cells whose bound reaches that score. Queries stream past the tree, so that memory is one group and
one batch. The k best of the groups are merged by a window over at most k rows a group and query.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, small_batches, table

#: Rows of one group, entries of an inner page, rows of a leaf.
GROUP, PAGE, LEAF = 4096, 64, 256
#: Sampled vectors that rows are dealt to; what the driver holds is this many vectors.
PIVOTS = 256
#: Stands for no score yet.
NONE = -(2**63)


class MTree:
    """Over the rows of an integer matrix."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, copies: np.ndarray | None = None, page: int = PAGE, leaf: int = LEAF):
        order = np.argsort(ids, kind="stable")
        self.exact, self.ids, self.page, self.leaf = rows[order], ids[order], max(2, page), max(2, leaf)
        self.copies = np.ones(len(ids), np.int64) if copies is None else copies[order]
        self.x = self.exact.astype(np.float64)
        self.most = float(np.abs(self.x).max(initial=0.0))
        self.compared = 0
        self.root = self._build(np.arange(len(ids)))

    def _build(self, rows: np.ndarray) -> dict:
        x = self.x[rows]
        centre = x[int(np.argmin(((x - x.mean(0)) ** 2).sum(1)))]
        far = np.sqrt(((x - centre) ** 2).sum(1))
        node = {"centre": centre, "radius": float(far.max())}
        if len(rows) <= self.leaf:
            return node | {"rows": rows, "far": far}
        k = min(self.page, -(-len(rows) // self.leaf))
        k = max(2, k)
        pivots = x[np.linspace(0, len(rows) - 1, k).astype(int)]
        near = np.argmin((pivots**2).sum(1)[None, :] - 2 * x @ pivots.T, axis=1)
        parts = [rows[near == i] for i in range(k)]
        parts = [p for p in parts if len(p)]
        if max(map(len, parts)) > 0.9 * len(rows):  # copies: split by position, which keeps pages bounded
            parts = [p for p in np.array_split(rows, k) if len(p)]
        below = [self._build(p) for p in parts]
        centres = np.stack([b["centre"] for b in below])
        return node | {"below": below, "centres": centres, "radii": np.array([b["radius"] for b in below]), "parent": np.sqrt(((centres - centre) ** 2).sum(1))}

    def search(self, query: np.ndarray, own: int, k: int, floor: int = NONE) -> list[tuple[int, int]]:
        """The k (score, id) best by score, then id, of those with score floor or more; one row equal to the query in id and vector is left out."""
        q = query.astype(np.float64)
        norm = float(np.sqrt((q * q).sum()))
        whole = float(np.abs(q).max(initial=0.0)) * self.most * max(1, len(q))
        exact = whole < 2**52  # float sums of integers are exact below
        slack = 1e-9 * (1 + whole)
        best: list[tuple[int, int]] = []  # (score, -id), the worst first
        worst = -np.inf if floor == NONE else floor
        tie = 0
        queue = [(-np.inf, tie, self.root, float(self.root["centre"] @ q))]
        while queue:
            bound, _, node, s = heapq.heappop(queue)
            if -bound + slack < worst:
                break
            if "rows" in node:
                keep = s + norm * node["far"] + slack >= worst
                rows = node["rows"][keep]
                self.compared += len(rows)
                scores = self.x[rows] @ q if exact else (self.exact[rows].astype(object) @ query.astype(object))
                for i in np.flatnonzero(scores + 0 >= worst) if len(rows) else ():
                    at, copies = int(self.ids[rows[i]]), int(self.copies[rows[i]])
                    if at == own and np.array_equal(self.exact[rows[i]], query):
                        copies -= 1
                    item = (int(scores[i]), -at)
                    for _ in range(min(copies, k)):
                        if len(best) < k:
                            heapq.heappush(best, item)
                        elif item > best[0]:
                            heapq.heapreplace(best, item)
                    if len(best) == k:
                        worst = best[0][0]
                continue
            may = np.flatnonzero(s + norm * (node["parent"] + node["radii"]) + slack >= worst)
            self.compared += len(may)
            scores = node["centres"][may] @ q
            for i, score in zip(may, scores, strict=True):
                bound = score + norm * node["radii"][i]
                if bound + slack >= worst:
                    tie += 1
                    heapq.heappush(queue, (-bound, tie, node["below"][i], float(score)))
        return sorted(((s, -i) for s, i in best), key=lambda x: (-x[0], x[1]))


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """dim, positions, vectors of a batch's rows, by dimension."""
    v = batch.column("v")
    flat, offsets = v.values.to_numpy(zero_copy_only=False), v.offsets.to_numpy()
    dims = np.diff(offsets)
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        yield int(dim), at, flat[offsets[at][:, None] + np.arange(dim)[None, :]]


def _cells(pivots: dict[int, tuple[np.ndarray, np.ndarray]]):
    """Appends cell, far, most: the nearest pivot's number (-1: none of this dimension), the distance to it, the largest component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, far, most = np.full(batch.num_rows, -1, np.int32), np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for dim, at, x in _matrices(batch):
                if dim not in pivots:
                    continue
                numbers, p = pivots[dim]
                x = x.astype(np.float64)
                near = np.argmin((p**2).sum(1)[None, :] - 2 * x @ p.T, axis=1)
                cell[at], far[at], most[at] = numbers[near], np.sqrt(((x - p[near]) ** 2).sum(1)), np.abs(x).max(1, initial=0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far), pa.array(most)], [*batch.schema.names, "cell", "far", "most"])

    return run


def _routes(pivots: dict[int, tuple[np.ndarray, np.ndarray]], cells: dict[int, tuple[float, float]]):
    """Of each query the cells whose bound reaches its floor. cells: cell -> (radius, largest component)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            floors = batch.column("floor").to_numpy(zero_copy_only=False)
            to: list = [[-1]] * batch.num_rows
            for dim, at, q in _matrices(batch):
                if dim not in pivots:
                    continue
                numbers, p = pivots[dim]
                radius, most = (np.array([cells[int(c)][i] if int(c) in cells else np.nan for c in numbers]) for i in (0, 1))
                q = q.astype(np.float64)
                bound = q @ p.T + np.sqrt((q * q).sum(1))[:, None] * radius[None, :]
                slack = 1e-9 * (1 + np.abs(q).max(1, initial=0.0)[:, None] * np.maximum(most, np.abs(p).max(1, initial=0.0))[None, :] * max(1, dim))
                may = (bound + slack >= floors[at][:, None]) & ~np.isnan(radius)[None, :]
                for i, row in zip(at, may, strict=True):
                    to[i] = numbers[row].tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(to, pa.list_(pa.int32()))], [*batch.schema.names, "to"])

    return run


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (grp, dim, is_query): of each group first the data, then the queries."""
        at, rows, ids, copies, tree = None, [], [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            group, dim, ask, vec, n, key, floor = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("grp", "dim", "is_query", "vec_id", "n", "ask", "floor"))
            v = batch.column("v")
            flat, offsets = v.values.to_numpy(zero_copy_only=False), v.offsets.to_numpy()
            edges = np.flatnonzero((np.diff(group) != 0) | (np.diff(dim) != 0) | (np.diff(ask) != 0)) + 1
            out: list[tuple[int, int, int, int, int]] = []
            for lo, hi in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                place = (int(group[lo]), int(dim[lo]))
                matrix = flat[offsets[lo] : offsets[hi]].reshape(hi - lo, place[1])
                if place != at:
                    at, rows, ids, copies, tree = place, [], [], [], None
                if not ask[lo]:
                    rows.append(matrix)
                    ids.append(vec[lo:hi])
                    copies.append(n[lo:hi])
                    continue
                if not rows:
                    continue
                if tree is None:
                    tree = MTree(np.concatenate(rows), np.concatenate(ids), np.concatenate(copies))
                for i, one in enumerate(matrix, lo):
                    out += [(int(vec[i]), int(key[i]), int(n[i]), found, s) for s, found in tree.search(one, int(vec[i]), k, int(floor[i]))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["query_id", "ask", "n", "vec_id", "score"])

    return run


def usable(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, v, dim, n: floor(scale * x) of vectors that are not null and hold only finite components; n: rows alike in both."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(~bad)
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v")).groupBy("vec_id", "v").agg(F.count("*").alias("n")).withColumn("dim", F.size("v"))


def _pivots(data: DataFrame, most: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """dim -> numbers and vectors of at most `most` unlike vectors, drawn by hash."""
    drawn = data.select("v", "dim", F.xxhash64("vec_id", "v").alias("h")).orderBy("h", "v").limit(2 * most).collect()
    unlike = list(dict.fromkeys(tuple(r["v"]) for r in drawn))[:most]
    dims = np.array([len(v) for v in unlike], np.int64)
    return {int(d): (np.flatnonzero(dims == d).astype(np.int32), np.array([v for v in unlike if len(v) == d], np.float64).reshape(-1, int(d))) for d in np.unique(dims)}


def top_k(data: DataFrame, asked: DataFrame, rows: int, k: int = 5, group: int = GROUP) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of asked the k largest inner products with rows of data other than itself.

    data, asked: vec_id, v array<long>, dim, n (rows alike: each counts, as a candidate and as a query). rows: how many data
    has, about; sets the number of pivots. Of the candidates one row with the query's id and vector is the query itself; rows
    that repeat an id with another vector are candidates. Vectors of unlike dimension have no inner product. Ties go to the
    smaller vec_id. Fewer than k candidates: all of them. Empty tables give an empty result.
    """
    spark = data.sparkSession
    small_batches(spark)
    pivots = _pivots(data, min(PIVOTS, max(1, -(-rows // group))))
    added = ", cell int, far double, most double"
    held = materialise(data.select("vec_id", "v", "dim", "n").mapInArrow(_cells(pivots), "vec_id long, v array<long>, dim int, n long" + added), "vectors")
    found = held.groupBy("cell").agg(F.count("*").alias("c"), F.max("far").alias("far"), F.max("most").alias("most")).orderBy("cell").collect()  # a row a pivot
    cells, places, groups = {}, [], 0
    for r in found:
        cells[r["cell"]], parts = (r["far"], r["most"]), -(-r["c"] // group)
        places.append((r["cell"], groups, parts))
        groups += parts
    places = F.broadcast(spark.createDataFrame(places, "cell int, first int, parts int"))
    own = (F.col("first") + F.pmod(F.xxhash64("vec_id", "v"), F.col("parts"))).cast("int")

    def searched(queries: DataFrame) -> DataFrame:
        """queries: grp, dim, vec_id, v, n, ask, floor."""
        trees = held.join(places, "cell").select(own.alias("grp"), "dim", F.lit(0).alias("is_query"), "vec_id", "v", "n", F.lit(0).cast("long").alias("ask"), F.lit(NONE).alias("floor"))
        dealt = trees.unionByName(queries.withColumn("is_query", F.lit(1))).repartition(2 * max(1, groups), "grp").sortWithinPartitions("grp", "dim", "is_query")
        return dealt.mapInArrow(_search(k), "query_id long, ask long, n long, vec_id long, score long")

    def best(hits: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_id", "ask").orderBy(F.desc("score"), "vec_id"))
        return hits.withColumn("rank", rank).where(F.col("rank") <= k)

    asked = asked.select("vec_id", "v", "dim", "n", F.xxhash64("v").alias("ask"))
    asked = asked.mapInArrow(_cells(pivots), "vec_id long, v array<long>, dim int, n long, ask long" + added).drop("far", "most")
    asked = materialise(asked.join(places, "cell", "left").select("vec_id", "v", "dim", "n", "ask", F.coalesce(own, F.lit(-1)).alias("grp")), "asked")
    near = materialise(searched(asked.withColumn("floor", F.lit(NONE))), "near")
    floors = near.groupBy(F.col("query_id").alias("vec_id"), "ask").agg(F.min("score").alias("floor"), F.count("*").alias("c")).where(F.col("c") == k).drop("c")
    routed = asked.join(floors, ["vec_id", "ask"], "left").withColumn("floor", F.coalesce("floor", F.lit(NONE))).withColumnRenamed("grp", "searched")
    routed = routed.mapInArrow(_routes(pivots, cells), "vec_id long, ask long, v array<long>, dim int, n long, searched int, floor long, to array<int>")
    sent = routed.withColumn("cell", F.explode("to")).join(places, "cell").withColumn("grp", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("parts") - 1)))
    far = searched(sent.where(F.col("grp") != F.col("searched")).select("grp", "dim", "vec_id", "v", "n", "ask", "floor"))
    every = best(near.unionByName(far)).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return every.select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: rows whose vec_id is divisible by 50. Null vec_id takes no part; every other usable row counts, repeated ids too."""
    vectors = materialise(usable(table(spark, sf_dir, "embeddings")), "usable")
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), vectors.count())


SQL = """
WITH e AS MATERIALIZED (
  SELECT vec_id, v, row_number() OVER (ORDER BY vec_id, v) AS n
  FROM (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  )
), s AS (
  SELECT q.n AS row_id, q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND c.n <> q.n AND len(q.v) = len(c.v)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, vec_id) AS place FROM s
)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM r WHERE place <= 5
"""
