"""Exact top-k by integer inner product: a KD-tree for each shard.

Nodes are split at the median of their widest dimension and have tight
bounding boxes. No row in a box can score more than the sum of the larger of
query * low and query * high over the dimensions, so nodes are taken best bound
first, and a shard is done when the best bound is below the k-th score, which
goes along from shard to shard; those with the longest vectors come first.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import Best, search

LEAF = 64
#: Components below this keep every sum of products exact in double precision.
EXACT = 2.0**20


def build(names: list[np.ndarray], x: np.ndarray) -> dict:
    low, high, children, leaves = [], [], [], []

    def split(rows: np.ndarray) -> int:
        me = len(low)
        own = x[rows]
        low.append(own.min(axis=0))
        high.append(own.max(axis=0))
        children.append(None)
        leaves.append(rows)
        if len(rows) > LEAF:
            p = own[:, int((high[me] - low[me]).argmax())]
            half = len(rows) // 2
            order = np.argpartition(p, half)
            leaves[me] = None
            children[me] = (split(rows[order[:half]]), split(rows[order[half:]]))
        return me

    split(np.arange(len(x)))
    return {"names": names, "x": x, "low": np.array(low), "high": np.array(high), "children": children, "leaves": leaves}


def look(index: dict, best: Best) -> None:
    x, names, queries = index["x"], index["names"], best.queries
    if max(np.abs(x).max(), np.abs(queries).max()) > EXACT:
        big, own = exactly(x), exactly(queries)
        for q in range(len(queries)):
            scores = big @ own[q]
            if max(map(abs, scores)) >= 2**63:
                raise OverflowError("an inner product does not fit into 64 bits")
            best.offer(q, scores, names)
        return
    bounds = np.maximum(queries, 0) @ index["high"].T + np.minimum(queries, 0) @ index["low"].T
    for q in range(len(queries)):
        bound = bounds[q]
        heap = [(-bound[0], 0)]
        while heap:
            at, node = heapq.heappop(heap)
            if -at < best.bound(q):
                break
            rows = index["leaves"][node]
            if rows is None:
                for c in index["children"][node]:
                    heapq.heappush(heap, (-bound[c], c))
                continue
            scores = x[rows] @ queries[q]
            least = best.bound(q)
            if len(rows) > best.k:
                least = max(least, np.partition(scores, len(scores) - best.k - 1)[len(scores) - best.k - 1])
            own = np.flatnonzero(scores >= least)
            if len(own):
                best.offer(q, scores[own].astype(np.int64), [names[r] for r in rows[own]])


def exactly(x: np.ndarray) -> np.ndarray:
    """As Python's integers, for components too large for exact double precision."""
    return np.array([[int(v) for v in row] for row in x], dtype=object)


def top(vectors: DataFrame, *, every: int = 50, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score long): for each row whose id is divisible by `every` its k highest inner products of floor(scale * x).

    Vectors that are null or hold a null or a non-finite component take no
    part, nor do rows without an id; zero vectors do. Repeated rows, repeated
    ids, ties and empty tables are as in `search`. A score beyond 64 bits is an
    error.
    """
    return search(vectors, "kd", F.col("id") % every == 0, k, build, look, id_col=id_col, vector_col=vector_col, nonzero=False, convert=lambda x: np.floor(scale * x), score_type="long")
