"""Approximate nearest neighbours by inner product: a hierarchical k-means tree, searched best bin first.

The tree is fitted on at most SAMPLE vectors (those whose id hashes lowest) and
holds a bounded number of nodes; every vector is indexed, as a row of its leaf.
A query walks the tree with a priority queue of nodes by the inner product with
their centres and visits leaves in that order. How many leaves: for CALIBRATE
queries the exact neighbours are found by brute force over all vectors, and the
visits are widened until the wanted share of them lies in visited leaves. Each
query further visits leaves until they hold more than k vectors.

Queries and vectors meet by leaf. Leaves are cut into blocks of vectors and
chunks of queries, so a leaf that holds a third of all rows is many groups. In a
group, scores are inner products in double precision; the k best of each group
go on to the k best of the query.

Vectors that are null or zero, or hold null or non-finite components, or are not
of the common length take no part, neither as query nor as candidate; nor do rows
without an id. Rows that repeat an id are candidates each. Ties go to the smaller
id. Extra columns are ignored. Without vectors or queries the result is empty.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pooltide.llm.tables import written

#: Vectors the tree is fitted on, children of a node, sample vectors of a leaf.
SAMPLE, BRANCH, LEAF = 16_384, 8, 128
#: Queries of the calibration and the share of their neighbours that must be found.
CALIBRATE, RECALL = 256, 0.96
#: Most vectors and queries of a group.
BLOCK, CHUNK = 8_192, 1_024


class Tree:
    """Nodes of a k-means tree: centres, children, and the number of each leaf."""

    def __init__(self, vectors: np.ndarray, branch: int, leaf: int) -> None:
        self.centres: list[np.ndarray] = []
        self.children: list[np.ndarray | None] = []
        self.leaf_of: list[int] = []
        self.leaves = 0
        rng = np.random.default_rng(7)
        self._grow(vectors, branch, leaf, rng)
        self.matrix = np.array(self.centres)

    def _grow(self, v: np.ndarray, branch: int, leaf: int, rng: np.random.Generator) -> int:
        at = len(self.centres)
        self.centres.append(v.mean(axis=0))
        self.children.append(None)
        self.leaf_of.append(-1)
        groups = _kmeans(v, branch, rng) if len(v) > leaf else []
        if len(groups) < 2:
            self.leaf_of[at] = self.leaves
            self.leaves += 1
        else:
            self.children[at] = np.array([self._grow(v[g], branch, leaf, rng) for g in groups])
        return at

    def assign(self, v: np.ndarray) -> np.ndarray:
        """Leaf of each vector: down the tree to the nearest centre."""
        out = np.empty(len(v), np.int32)
        todo = [(0, np.arange(len(v)))]
        while todo:
            node, rows = todo.pop()
            kids = self.children[node]
            if kids is None:
                out[rows] = self.leaf_of[node]
                continue
            c = self.matrix[kids]
            near = np.argmin((c * c).sum(axis=1) - 2 * (v[rows] @ c.T), axis=1)
            for k in np.unique(near).tolist():
                todo.append((int(kids[k]), rows[near == k]))
        return out

    def best_first(self, q: np.ndarray) -> Iterator[int]:
        """Leaves in the order of a best-bin-first walk."""
        gain = self.matrix @ q
        queue = [(-float(gain[0]), 0)]
        while queue:
            _, node = heapq.heappop(queue)
            kids = self.children[node]
            if kids is None:
                yield self.leaf_of[node]
            else:
                for kid in kids.tolist():
                    heapq.heappush(queue, (-float(gain[kid]), kid))


def _kmeans(v: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> list[np.ndarray]:
    """Row numbers of the non-empty groups."""
    centres = v[rng.choice(len(v), k, replace=False)]
    near = np.zeros(len(v), np.int64)
    for _ in range(rounds):
        near = np.argmin((centres * centres).sum(axis=1) - 2 * (v @ centres.T), axis=1)
        for j in range(k):
            if (near == j).any():
                centres[j] = v[near == j].mean(axis=0)
    return [g for j in range(k) if len(g := np.flatnonzero(near == j))]


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(id, v) of the rows that take part; v has doubles."""
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("id"), F.col(embedding).cast("array<double>").alias("v")).where(
        "id IS NOT NULL AND v IS NOT NULL AND NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity')) "
        "AND exists(v, x -> x <> 0)")
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return rows.where(F.size("v") == (sizes[0]["n"] if sizes else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten() if isinstance(column, pa.ListArray) else column.combine_chunks().flatten()
    flat = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of rows of v with q; equal vectors get equal products wherever they stand."""
    return (v * q).sum(axis=-1)


def top_rows(queries: np.ndarray, own: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query row, candidate rows, scores): the k best candidates other than the query's own id, ties to smaller ids."""
    scale = np.abs(v).max(initial=0.0) * v.shape[1] * 1e-12
    for s in range(0, len(queries), 128):
        rough = queries[s:s + 128] @ v.T
        rough[own[s:s + 128, None] == ids[None, :]] = -np.inf
        cut = min(k, rough.shape[1])
        kth = -np.partition(-rough, cut - 1, axis=1)[:, cut - 1]
        for i, (row, low) in enumerate(zip(rough, kth)):
            q = queries[s + i]
            # Rounding of the matrix product must not decide a tie.
            rows = np.flatnonzero((row >= low - scale * np.abs(q).max()) & (row > -np.inf))
            if not len(rows):
                continue
            score = _exact(q, v[rows])
            order = np.lexsort((ids[rows], -score))[:k]
            yield s + i, rows[order], score[order]


def _calibrated(tree, rows: DataFrame, probes: np.ndarray, probe_ids: np.ndarray, k: int, recall: float) -> int:
    """Leaves to visit so that ``recall`` of the probes' exact neighbours lie in them."""
    shared = rows.sparkSession.sparkContext.broadcast((probes, probe_ids))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, own = shared.value
        best = {i: (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int32)) for i in range(len(q))}
        for b in batches:
            ids, leaf = b.column(0).to_numpy(), b.column(2).to_numpy()
            for i, at, score in top_rows(q, own, ids, _matrix(b.column(1)), k):
                a, s, f = best[i]
                a, s, f = np.append(a, ids[at]), np.append(s, score), np.append(f, leaf[at])
                order = np.lexsort((a, -s))[:k]
                best[i] = a[order], s[order], f[order]
        found = [(i, int(a), float(s), int(f)) for i, x in best.items() for a, s, f in zip(*x)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[c] for x in found], t) for c, t in enumerate((pa.int32(), pa.int64(), pa.float64(), pa.int32()))],
            ["probe", "id", "score", "leaf"])

    from pyspark.sql import Window

    w = Window.partitionBy("probe").orderBy(F.desc("score"), "id")
    found = (rows.mapInArrow(nearest, "probe int, id bigint, score double, leaf int")
             .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("probe", "leaf").collect())  # at most CALIBRATE * k
    place = [{leaf: n for n, leaf in enumerate(tree.best_first(q))} for q in probes]
    depth = np.sort([place[r["probe"]][r["leaf"]] for r in found])
    visits = 1
    while len(depth) and np.searchsorted(depth, visits, side="left") < recall * len(depth):
        visits += 1
    return visits


def nearest_neighbours(vectors: DataFrame, is_query: str, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding",
                       recall: float = RECALL, sample: int = SAMPLE, branch: int = BRANCH, leaf: int = LEAF) -> DataFrame:
    """(query_id, rank, vec_id, score): of each row that satisfies the SQL condition ``is_query`` the k nearest others found.

    Runs jobs: the sample, the indexed table, the calibration and the leaf sizes
    (all results on the driver are bounded by the parameters).
    """
    spark = vectors.sparkSession
    result = "query_id bigint, rank int, vec_id bigint, score double"
    # The condition may use the input's own columns.
    flagged = vectors.withColumn("__query", F.coalesce(F.expr(is_query), F.lit(False)))
    rows = usable(flagged, vec_id, embedding)
    fitted = rows.orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
    if not fitted.num_rows:
        return spark.createDataFrame([], result)
    v = _matrix(fitted.column("v"))
    tree = Tree(v, branch, leaf)
    shared = spark.sparkContext.broadcast(tree)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = shared.value.assign(_matrix(b.column(1))) if b.num_rows else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.int32())], ["id", "v", "leaf"])

    indexed = written(rows.mapInArrow(index, "id bigint, v array<double>, leaf int"), "indexed")
    visits = _calibrated(tree, indexed, v[:CALIBRATE], fitted.column("id").to_numpy()[:CALIBRATE], k, recall)
    held = {r["leaf"]: r["n"] for r in indexed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # one row per leaf
    sizes = [held.get(i, 0) for i in range(tree.leaves)]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaves, at = [], []
            for i, q in enumerate(_matrix(b.column(1))):
                seen = 0
                for n, leaf_no in enumerate(shared.value.best_first(q)):
                    if n >= visits and seen > k:
                        break
                    if sizes[leaf_no]:
                        seen += sizes[leaf_no]
                        leaves.append(leaf_no)
                        at.append(i)
            take = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(leaves, pa.int32())],
                                             ["query_id", "q", "leaf"])

    asked = usable(flagged.where("__query"), vec_id, embedding)
    visited = written(asked.mapInArrow(walk, "query_id bigint, q array<double>, leaf int"), "visited")
    plan = (visited.groupBy("leaf").agg(F.count("*").alias("asks")).join(indexed.groupBy("leaf").agg(F.count("*").alias("rows")), "leaf")
            .select("leaf", F.expr(f"CAST(ceil(rows / {BLOCK}) AS INT)").alias("blocks"),
                    F.expr(f"CAST(ceil(asks / {CHUNK}) AS INT)").alias("chunks")))
    plan = F.broadcast(plan)  # one row per leaf, at most the sample
    left = visited.join(plan, "leaf").select(
        "leaf", F.expr("pmod(hash(query_id), chunks)").alias("chunk"), F.expr("explode(sequence(0, blocks - 1))").alias("block"), "query_id", "q")
    right = indexed.join(plan, "leaf").select(
        "leaf", F.expr("explode(sequence(0, chunks - 1))").alias("chunk"), F.expr("pmod(hash(id), blocks)").alias("block"), "id", "v")
    group = ("leaf", "chunk", "block")

    def score(asks: pa.Table, cands: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if asks.num_rows and cands.num_rows:
            own, ids = asks.column("query_id").to_numpy(), cands.column("id").to_numpy()
            for i, at, s in top_rows(_matrix(asks.column("q")), own, ids, _matrix(cands.column("v")), k):
                out.append((np.full(len(at), own[i]), ids[at], s))
        columns = [np.concatenate(c) if out else [] for c in zip(*out)] if out else [[], [], []]
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())],
                        names=["query_id", "vec_id", "score"])

    from pyspark.sql import Window

    scored = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(score, "query_id bigint, vec_id bigint, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
