"""Top-k search of a query set against all vectors, in blocks of queries and shards of candidates.

Each shard is indexed once and stored. Blocks of queries and groups of shards
form a grid; a task has one block and goes through the shards of one group,
those that may hold the highest scores first, so that what the earlier ones
found bounds the search of the later. There is a fixed number of groups, and a
block is as large as a task can hold: queries are sent a fixed number of times,
and shards once for each BLOCK of queries. Every candidate row is in a shard,
every block meets every shard.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Store, tune

#: Rows of a shard at most, and of a block of queries about; groups of shards.
SHARD, BLOCK, GROUPS = 4096, 8192, 16


def usable(df: DataFrame, id_col: str, vector_col: str, nonzero: bool) -> DataFrame:
    """(id, v array<double>) of rows with an id and only finite components; vectors of another length are only compared among themselves."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null and size(v) > 0").where(~odd)
    return rows.where(F.exists("v", lambda x: x != 0)) if nonzero else rows


def collapse(ids: np.ndarray, x: np.ndarray, keep: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Equal rows of x as one, with their `keep` least ids: no more of them can be among the first."""
    order = np.lexsort((ids, *x.T[::-1]))
    ids, x = ids[order], x[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]).any(axis=1)
    starts = np.flatnonzero(new)
    return [np.unique(own)[:keep] for own in np.split(ids, starts[1:])], x[starts]


class Best:
    """The ids and vectors of a block of queries, and for each the k best (score, id) so far: highest score first, then least id."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.found: list[list[tuple]] = [[] for _ in ids]

    def bound(self, q: int) -> float:
        """The k-th best score; what is below it cannot enter, what equals it may by its id."""
        return self.found[q][-1][0] if len(self.found[q]) == self.k else -np.inf

    def offer(self, q: int, scores: np.ndarray, names: list[np.ndarray]) -> None:
        bound, own = self.bound(q), self.ids[q]
        new = [(s, i) for s, group in zip(scores.tolist(), names) if s >= bound for i in group.tolist() if i != own]
        if new:
            self.found[q] = sorted({*self.found[q], *new}, key=lambda x: (-x[0], x[1]))[: self.k]


def search(
    df: DataFrame, name: str, is_query: Column, k: int, build: Callable[[list[np.ndarray], np.ndarray], object], look: Callable[[object, Best], None],
    *, id_col: str, vector_col: str, nonzero: bool, convert: Callable[[np.ndarray], np.ndarray], score_type: str,
) -> DataFrame:
    """(query_id, rank, <vector id>, score). build indexes a shard's ids and rows; look searches it for a block's queries.

    Rows that repeat an id and a vector count once; where ids repeat with
    different vectors, each is a candidate and each query id has the best of
    them. Vectors of another length are only compared among themselves. Ties go
    to the smaller id. No queries or no candidates give no rows.
    """
    spark = df.sparkSession
    tune(spark)
    store = Store(spark, name)
    rows = usable(df, id_col, vector_col, nonzero).distinct()
    counts = rows.agg(F.count("*"), F.count_if(is_query)).first()
    shards, blocks = max(1, -(-counts[0] // SHARD)), max(1, -(-counts[1] // BLOCK))

    def packed(size: int | None, make: Callable[[np.ndarray, np.ndarray], object]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        """Rows of a block (or of whatever comes, for shards) and of equal dimensions as one binary each."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}

            def close(key: tuple[int, int]) -> pd.DataFrame:
                own = held.pop(key)
                ids, x = np.array([i for i, _ in own], np.int64), convert(np.stack([v for _, v in own]))
                most = float((x * x).sum(axis=1).max())
                return pd.DataFrame({"block": [key[0]], "dim": [key[1]], "part": [int(ids.min() & 0x7FFFFFFF)], "most": [most], "data": [pickle.dumps(make(ids, x))]})

            for b in batches:
                for block, i, v in zip(b.block, b.id, b.v):
                    key = (block, len(v))
                    held.setdefault(key, []).append((i, np.asarray(v, np.float64)))
                    if len(held[key]) == size:
                        yield close(key)
            for key in list(held):
                yield close(key)

        return run

    kind = "block int, dim int, part int, most double, data binary"
    one = rows.select(F.lit(0).alias("block"), "id", "v").repartition(shards, "id", "v")
    indexed = store.write(one.mapInPandas(packed(SHARD, lambda ids, x: build(*collapse(ids, x, k + 1))), kind), "shards")
    queries = rows.where(is_query).select(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int").alias("block"), "id", "v").repartition(blocks, "block")
    asked = store.write(queries.mapInPandas(packed(None, lambda ids, x: (ids, x)), kind), "blocks")
    store.forget_shuffles()
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    columns = ["block", "g", "dim", "shard", "most", "part", "data"]
    left = asked.withColumn("g", every(GROUPS)).withColumn("shard", F.lit(False)).select(*columns)
    right = indexed.withColumn("block", every(blocks)).withColumn("g", F.pmod(F.hash("part", "dim"), F.lit(GROUPS))).withColumn("shard", F.lit(True)).select(*columns)
    # a block's queries come before the shards, and these by their longest vector
    both = left.unionByName(right).repartition(blocks * GROUPS, "block", "g").sortWithinPartitions("block", "g", "dim", "shard", F.col("most").desc(), "part")

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, best = None, None

        def close() -> pd.DataFrame:
            out = [(int(best.ids[q]), i, s) for q, own in enumerate(best.found) for s, i in own]
            return pd.DataFrame(out, columns=["query_id", "id", "score"])

        for b in batches:
            for block, g, dim, shard, data in zip(b.block, b.g, b.dim, b.shard, b.data):
                if (block, g, dim) != now:
                    if best:
                        yield close()
                    now, best = (block, g, dim), None
                if not shard:
                    best = Best(*pickle.loads(data), k)
                elif best:
                    look(pickle.loads(data), best)
        if best:
            yield close()

    found = both.select("block", "g", "dim", "shard", "data").mapInPandas(find, f"query_id long, id long, score {score_type}")
    # where ids repeat, an id counts with its best vector
    found = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
