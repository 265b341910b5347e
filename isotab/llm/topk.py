"""Exact search for the largest integer inner products with KD-trees.

Rows are dealt into shards of a bounded number by a hash. In a shard, a KD-tree splits at medians of the widest
dimension and keeps each node's tight bounding box. A query walks the tree best first: the bound of a node is the
largest inner product that any point of its box could have with the query, and the walk ends where no bound reaches
the kth best score so far. Every query first searches one home shard; the kth score found there goes with it to all
others and cuts off what cannot reach it. Queries come in blocks of a bounded number, as large as a shard, so that rows are
copied once per block of queries and a shard's tree is built once for all of a block; a task holds one
shard and one block, and scores of some hundred queries at a time. The work is queries times shards at worst, as an exact search of all rows must be.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isotab.llm.common import checkpointed

SCALE = 64
K, SHARD_ROWS, QUERY_BLOCK, LEAF = 20, 16_384, 16_384, 256
#: Queries whose scores with a leaf are computed together.
TOGETHER = 256


class KdTree:
    """Median splits of rows of integers; nodes in an array, boxes tight."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.low, self.high, self.span, self.kids = points, [], [], [], []
        self.order = np.arange(len(points))
        todo = [(0, len(points), -1)]
        while todo:
            a, b, parent = todo.pop()
            rows = points[self.order[a:b]]
            lo, hi = rows.min(0), rows.max(0)
            me = len(self.span)
            self.low.append(lo)
            self.high.append(hi)
            self.span.append((a, b))
            self.kids.append([])
            if parent >= 0:
                self.kids[parent].append(me)
            axis = int((hi - lo).argmax()) if len(lo) else 0
            if b - a > leaf and len(lo) and hi[axis] > lo[axis]:
                mid = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(rows[:, axis], mid)]
                todo += [(a, a + mid, me), (a + mid, b, me)]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """(queries, nodes): the largest inner product with any point of the node's box."""
        return np.maximum(queries, 0) @ np.array(self.high).T + np.minimum(queries, 0) @ np.array(self.low).T


def exact_type(points: np.ndarray, queries: np.ndarray):
    """Floats where every product and sum fits 53 bits (BLAS), else integers, else Python's numbers."""
    most = max(1, points.shape[1]) * int(np.abs(points).max(initial=0)) * int(np.abs(queries).max(initial=0)) if points.size and queries.size else 0
    return np.float64 if most < 2**53 else np.int64 if most < 2**63 else object


def search(ids: np.ndarray, points: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, floor: list[int | None], k: int = K, leaf: int = LEAF) -> list[tuple[int, int, int]]:
    """(query, id, score) of the k best of each query that reach its floor, ties to smaller ids, its own id aside."""
    kind = exact_type(points, queries)
    points, queries = points.astype(kind), queries.astype(kind)
    tree = KdTree(points, leaf)
    out: list[tuple[int, int, int]] = []
    for at in range(0, len(queries), TOGETHER):
        part = slice(at, at + TOGETHER)
        out += _walked(tree, ids, query_ids[part], queries[part], floor[part], k)
    return out


def _walked(tree: KdTree, ids: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, floor: list[int | None], k: int) -> list[tuple[int, int, int]]:
    points, bound = tree.points, tree.bounds(queries)
    scored: dict[int, np.ndarray] = {}  # a leaf's scores for these queries, from its first visit
    out = []
    for q, own in enumerate(query_ids):
        kth, best_s, best_i = floor[q], np.empty(0, points.dtype), np.empty(0, np.int64)
        heap = [(-bound[q, 0], 0)]
        while heap:
            b, node = heapq.heappop(heap)
            if kth is not None and -b < kth:
                break
            if tree.kids[node]:
                for kid in tree.kids[node]:
                    if kth is None or bound[q, kid] >= kth:
                        heapq.heappush(heap, (-bound[q, kid], kid))
                continue
            rows = tree.order[slice(*tree.span[node])]
            if node not in scored:
                scored[node] = queries @ points[rows].T
            s = scored[node][q]
            keep = ids[rows] != own
            if kth is not None:
                keep &= s >= kth
            if not keep.any():
                continue
            best_s, best_i = np.concatenate([best_s, s[keep]]), np.concatenate([best_i, ids[rows][keep]])
            if len(best_s) > k:
                top = np.lexsort((best_i, -best_s))[:k]
                best_s, best_i = best_s[top], best_i[top]
                kth = best_s[-1] if kth is None or best_s[-1] > kth else kth
        out += [(int(own), int(i), int(s)) for s, i in zip(best_s, best_i, strict=True)]
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best rows by inner product of floor(scale * component).

    Rows whose id or vector is NULL, or that hold a NULL or non-finite component, take no part. Vectors of different
    lengths are not compared. A query's own id is never in its result; of rows that repeat a query's id, the one whose vector comes first in order asks; a candidate that stands twice in the table counts
    twice. A table without queries gives an empty result; other columns are ignored.
    """
    v = F.col(f"`{vector_col}`")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    whole = vectors.where(F.col(f"`{id_col}`").isNotNull() & v.isNotNull() & ~odd & (F.size(v) > 0))
    rows = whole.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("v"), F.size(v).alias("dim"), is_query.alias("asks"))
    count = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("q")).collect()[0]
    shards, blocks = max(1, -(-count["n"] // shard_rows)), max(1, -(-count["q"] // query_block))
    here = rows.select("id", "v", "dim", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"))
    asked = rows.where("asks").groupBy("id").agg(F.min("v").alias("v")).select("id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(shards)).cast("int").alias("home"), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(blocks)).cast("int").alias("block"))
    at_home = asked.select("id", "v", "dim", F.col("home").alias("shard"), F.col("block"), F.lit(None).cast("long").alias("floor"))
    spread = here.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    first = _searched(spread, at_home, k)
    if shards > 1:
        first = checkpointed(first)  # read twice: for the kth scores and for the result
    if shards == 1:
        found = first
    else:
        kth = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k).select(F.col("query_id").alias("id"), "floor")
        known = asked.join(kth, "id", "left")
        rest = known.select("id", "v", "dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "block", "floor", "home").where("shard != home").drop("home")
        found = first.unionByName(_searched(spread, rest, k))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searched(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            floors = [None if pd.isna(x) else int(x) for x in right["q_floor"]]
            out = search(left["id"].to_numpy(), np.stack(left["v"].to_list()), right["q_id"].to_numpy(), np.stack(right["q_v"].to_list()), floors, k)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"], dtype="int64")

    key = ["shard", "block", "dim"]
    apart = queries.select(*[F.col(c).alias(f"q_{c}") for c in queries.columns])
    return rows.groupBy(*key).cogroup(apart.groupBy(*[f"q_{c}" for c in key])).applyInPandas(run, "query_id long, vec_id long, score long")
