"""Approximate nearest neighbours: a hierarchical k-means tree, searched best bin first.

Nearness is the inner product. Vectors are lifted by one coordinate to a common
norm, which turns largest inner product into least distance, and a tree of
k-means centres is built over a bounded sample (`sample` vectors, those with the
smallest hash of their id). Every row is then assigned to a leaf. A query walks
the tree with a priority queue: the nearest open node is taken, a leaf is
visited, the children of an inner node join the queue. A query goes on beyond its
calibrated number of leaves until they hold `k` rows besides its own, as a leaf
may hold few rows or one. Leaves are visited in
rounds of growing length, and the scores found so far bound what later rounds
send on. How many leaves a query visits is calibrated: for some queries the true neighbours are found by going
through all rows, and visits are widened until the leaves met first hold
`recall` of them.

Vectors of a leaf and the queries that visit it meet in blocks of bounded size,
so a leaf may hold any share of the rows. Scores are exact, in double precision.

Defined results: vectors that are null, empty, zero, hold null or non-finite
components, or are of another length than most take no part, nor do rows without
an id; of rows that share an id the least vector counts; equal scores go to the
smaller id; fewer candidates than `k` give fewer rows; no valid vectors give none.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from relief.llm.common import column, long_values
from relief.session import materialise

FOUND = "query_id long, vec_id long, score double"


@dataclass
class Tree:
    """Centres of all nodes; children of inner nodes; the leaf number of the others."""

    centre: np.ndarray
    children: list
    leaf: np.ndarray
    norm: float

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.norm**2 - np.einsum("nd,nd->n", x, x), 0))
        return np.column_stack((x, rest)) / self.norm

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each vector, by the nearest child from the root on."""
        node = np.zeros(len(x), dtype=np.int64)
        lifted = self.lift(x)
        open_ = np.arange(len(x))
        while len(open_):
            at = node[open_]
            for n in np.unique(at):
                rows = open_[at == n]
                kids = self.children[n]
                if len(kids):
                    node[rows] = kids[_nearest(lifted[rows], self.centre[kids])]
            open_ = open_[self.leaf[node[open_]] < 0]
        return self.leaf[node]

    def visit(self, query: np.ndarray, least: int, rows: np.ndarray | None = None, wanted: int = 0) -> list[int]:
        """The leaves that a query meets, best bin first: `least`, and more until they hold `wanted` of `rows`."""
        lifted = np.append(query / np.linalg.norm(query), 0.0)
        queue, out = [(0.0, 0)], []
        while queue and (len(out) < least or wanted > 0):
            _, n = heapq.heappop(queue)
            if self.leaf[n] >= 0:
                out.append(int(self.leaf[n]))
                if rows is not None:
                    wanted -= int(rows[out[-1]])
                continue
            kids = self.children[n]
            gap = self.centre[kids] - lifted
            for d, kid in zip(np.einsum("nd,nd->n", gap, gap).tolist(), kids.tolist(), strict=True):
                heapq.heappush(queue, (d, kid))
        return out


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (np.einsum("nd,nd->n", centres, centres) - 2 * x @ centres.T).argmin(axis=1)


def build(sample: np.ndarray, norm: float, leaves: int, branching: int = 8, steps: int = 8) -> Tree:
    """Split the sample by k-means, the largest node first, until there are `leaves` leaves."""
    tree = Tree(np.empty((0, 0)), [], np.empty(0), norm)
    x = tree.lift(sample)
    centre, children = [x.mean(axis=0)], [np.empty(0, np.int64)]
    queue = [(-len(x), 0, np.arange(len(x)))]
    count = 1
    random = np.random.default_rng(7)
    while queue and count < leaves:
        size, node, rows = heapq.heappop(queue)
        points = x[rows]
        # centres start at sampled points, the next one far from those before
        seeds = [points[random.integers(len(points))]]
        for _ in range(branching - 1):
            gap = np.min([((points - s) ** 2).sum(axis=1) for s in seeds], axis=0)
            if gap.sum() <= 1e-12:
                break
            seeds.append(points[random.choice(len(points), p=gap / gap.sum())])
        if len(seeds) < 2:
            continue
        own = np.array(seeds)
        for _ in range(steps):
            part = _nearest(points, own)
            for k in range(len(own)):
                if (part == k).any():
                    own[k] = points[part == k].mean(axis=0)
        part = _nearest(points, own)
        kids = []
        for k in np.unique(part):
            kids.append(len(centre))
            centre.append(own[k])
            children.append(np.empty(0, np.int64))
            heapq.heappush(queue, (-int((part == k).sum()), kids[-1], rows[part == k]))
        children[node] = np.array(kids)
        count += len(kids) - 1
    leaf = np.full(len(centre), -1)
    ends = [n for n in range(len(centre)) if not len(children[n])]
    leaf[ends] = np.arange(len(ends))
    return Tree(np.array(centre), children, leaf, norm)


def valid(vector: str) -> Column:
    """Whether a vector can take part: present, finite, not zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)


def _matrix(batch: pa.RecordBatch, name: str, dim: int) -> np.ndarray:
    return np.asarray(column(batch, name).flatten()).astype(np.float64).reshape(-1, dim)


def _best(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, least=-np.inf) -> tuple:
    """The k nearest rows of each query within one block: query position, row position, score.

    Rows below `least`, the score that a query has k rows for already, are left out.
    """
    rough = q @ x.T
    rough[query_ids[:, None] == ids[None, :]] = -np.inf
    most = min(k, len(ids))
    # equal vectors may differ in the last bits here, so near-ties are scored anew
    edge = np.partition(rough, len(ids) - most, axis=1)[:, len(ids) - most]
    edge = np.maximum(edge, least)
    edge = np.where(np.isfinite(edge), edge - 1e-9 * (1 + np.abs(edge)), -1e300)
    who, row = np.nonzero(rough >= edge[:, None])
    score = np.einsum("nd,nd->n", q[who], x[row])
    order = np.lexsort((ids[row], -score, who))
    who, row, score = who[order], row[order], score[order]
    start = np.searchsorted(who, np.arange(len(q)))
    keep = np.arange(len(who)) - start[who] < k
    return who[keep], row[keep], score[keep]


def _top(found: DataFrame, k: int) -> DataFrame:
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)


def calibrate(rows: DataFrame, tree: Tree, dim: int, k: int, recall: float, queries: int) -> int:
    """How many leaves a query must visit to meet `recall` of its true neighbours."""
    probe = rows.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(queries).toArrow()
    q_ids = np.asarray(probe.column("vec_id"))
    q = np.asarray(probe.column("x").combine_chunks().flatten()).astype(np.float64).reshape(-1, dim)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x = long_values(batch, "vec_id"), _matrix(batch, "x", dim)
            who, row, score = _best(ids, x, q_ids, q, k)
            leaf = long_values(batch, "leaf")
            yield pa.RecordBatch.from_arrays(
                [pa.array(q_ids[who]), pa.array(ids[row]), pa.array(score), pa.array(leaf[row])],
                ["query_id", "vec_id", "score", "leaf"],
            )

    # the best of each task go on: queries x k rows for a batch, whatever its size
    true = _top(rows.mapInArrow(scan, FOUND + ", leaf long"), k).select("query_id", "leaf").collect()
    if not true:
        return tree.leaves
    place = {int(i): {leaf: n for n, leaf in enumerate(tree.visit(v, tree.leaves))} for i, v in zip(q_ids, q, strict=True)}
    needed = np.sort([place[r["query_id"]][r["leaf"]] for r in true])
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1


def search(
    vectors: DataFrame,
    is_query: Column,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    k: int = 20,
    recall: float = 0.97,
    sample: int = 50_000,
    leaf_rows: int = 200,
    most_leaves: int = 4096,
    probes: int = 128,
) -> DataFrame:
    """The nearest rows of every query row: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    good = vectors.withColumn("_q", is_query).where(valid(embedding) & F.col(vec_id).isNotNull())
    lengths = good.groupBy(F.size(embedding).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, rows_in = lengths["n"], lengths["count"]
    good = good.where(F.size(embedding) == dim)
    one = good.groupBy(F.col(vec_id).cast("long").alias("vec_id")).agg(
        F.min(F.col(embedding).cast("array<double>")).alias("x"), F.max("_q").alias("is_query")
    )
    one = materialise(one)
    norm = one.agg(F.max(F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)))).first()[0]
    taken = one.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("x").toArrow()
    points = np.asarray(taken.column("x").combine_chunks().flatten()).reshape(-1, dim)
    leaves = int(np.clip(rows_in // leaf_rows, 1, most_leaves))
    tree = build(points, norm, leaves)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.assign(_matrix(batch, "x", dim)) if batch.num_rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], [*batch.schema.names, "leaf"])

    rows = materialise(one.mapInArrow(assign, "vec_id long, x array<double>, is_query boolean, leaf long"))
    visits = calibrate(rows, tree, dim, k, recall, probes)
    held = np.zeros(tree.leaves, dtype=np.int64)
    for r in rows.groupBy("leaf").count().collect():
        held[r["leaf"]] = r["count"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                # one row more than `k`, as the query's own may be among them
                seen = [tree.visit(v, visits, held, k + 1) for v in _matrix(batch, "x", dim)]
                yield pa.RecordBatch.from_arrays(
                    [column(batch, "vec_id"), column(batch, "x"), pa.array(seen, pa.list_(pa.int64()))],
                    ["query_id", "q", "leaves"],
                )

    asked = materialise(
        rows.where("is_query")
        .select("vec_id", "x")
        .mapInArrow(walk, "query_id long, q array<double>, leaves array<long>")
    )
    block = int(np.clip(rows_in // 256, 128, 4096))

    def meet(base: pa.Table, queries: pa.Table) -> pa.Table:
        if not base.num_rows or not queries.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids, q_ids = np.asarray(base.column("vec_id")), np.asarray(queries.column("query_id"))
        x = np.asarray(base.column("x").combine_chunks().flatten()).reshape(-1, dim)
        q = np.asarray(queries.column("q").combine_chunks().flatten()).reshape(-1, dim)
        who, row, score = _best(ids, x, q_ids, q, k, np.asarray(queries.column("least")))
        own = q_ids[who] != ids[row]
        return pa.table({"query_id": q_ids[who][own], "vec_id": ids[row][own], "score": score[own]})

    best = None
    low, high = 0, 1
    longest = asked.agg(F.max(F.size("leaves"))).first()[0] or visits
    while low < longest:
        # leaves are visited in rounds; what has been found so far bounds what later ones send on
        turn = asked.select("query_id", "q", F.slice("leaves", low + 1, min(high, longest) - low).alias("leaves"))
        if best is None:
            turn = turn.withColumn("least", F.lit(-np.inf))
        else:
            kth = best.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
            turn = turn.join(kth, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(-np.inf)))
        found = _meetings(rows, turn, block).applyInArrow(meet, FOUND)
        best = materialise(_top(found if best is None else found.unionByName(best.drop("rank")), k))
        low, high = high, 4 * high
    return best.select("query_id", "rank", "vec_id", "score")


def _meetings(rows: DataFrame, asked: DataFrame, block: int):
    """Rows and queries of each leaf, grouped together in blocks of about `block` of either."""
    # how many blocks a leaf's rows and its visitors are cut into; one entry for each leaf
    held = rows.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / block).alias("parts"))
    visitors = asked.select(F.explode("leaves").alias("leaf"))
    visitors = visitors.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / block).alias("turns"))
    cut = materialise(held.join(visitors, "leaf"))
    left = rows.join(cut, "leaf").select(
        "leaf",
        F.pmod(F.xxhash64("vec_id", F.lit(1)), "parts").alias("part"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)).alias("turn"),
        "vec_id",
        "x",
    )
    right = (
        asked.select("query_id", "q", "least", F.explode("leaves").alias("leaf"))
        .join(cut, "leaf")
        .select(
            "leaf",
            F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"),
            F.pmod(F.xxhash64("query_id", F.lit(2)), "turns").alias("turn"),
            "query_id",
            "q",
            "least",
        )
    )
    keys = ["leaf", "part", "turn"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys))
