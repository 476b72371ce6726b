"""Frequent itemsets over (basket, item) rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.plans.session import checkpoint

#: Slices are dealt over so many partitions by hash, so that hardly any two meet in one.
SPREAD = 32

def baskets(df: DataFrame, least: int = 0) -> DataFrame:
    """(basket, items): each basket's distinct items, sorted; only baskets with more than `least`."""
    return df.groupBy("basket").agg(F.array_sort(F.collect_set("item")).alias("items")).where(F.size("items") > least)


def frequent_items(df: DataFrame, support: int) -> DataFrame:
    """(items, freq) for single items in at least so many baskets."""
    return df.distinct().groupBy("item").agg(F.count("*").alias("freq")).where(F.col("freq") >= support).select(F.array("item").alias("items"), "freq")


def next_level(df: DataFrame, level: DataFrame, k: int, support: int) -> DataFrame:
    """The frequent itemsets of size k from those of size k - 1.

    Each frequent set meets the larger frequent items of its baskets, and only
    candidates all of whose subsets are frequent are counted, by semi joins.
    """
    rows = df.distinct()
    names = [f"i{n}" for n in range(1, k)]
    last = level.select(*(F.col("items")[n].alias(f"i{n + 1}") for n in range(k - 1)))
    held = rows.select("basket", F.col("item").alias("i1")) if k == 2 else None
    if k > 2:
        held = rows.select("basket", F.col("item").alias("i1"))
        for n in range(2, k):
            more = rows.select("basket", F.col("item").alias(f"i{n}"))
            prefix = last.select(*names[:n]).distinct()
            held = held.join(more, "basket").where(F.col(f"i{n}") > F.col(f"i{n - 1}")).join(prefix, names[:n], "left_semi")
    held = held.join(last, names, "left_semi")
    grown = held.join(rows.select("basket", F.col("item").alias(f"i{k}")), "basket").where(F.col(f"i{k}") > F.col(f"i{k - 1}"))
    for left_out in range(k - 1):
        kept = [f"i{n}" for n in range(1, k + 1) if n != left_out + 1]
        grown = grown.join(last.toDF(*kept), kept, "left_semi")
    found = grown.groupBy(*(f"i{n}" for n in range(1, k + 1))).agg(F.count("*").alias("freq")).where(F.col("freq") >= support)
    return found.select(F.array(*(f"i{n}" for n in range(1, k + 1))).alias("items"), "freq")


def apriori(df: DataFrame, support: int, most: int | None = None) -> DataFrame:
    """(items, freq): all itemsets (of up to `most` items) in at least so many baskets, exactly; level by level until one is empty."""
    levels = [checkpoint(frequent_items(df, support))]
    while most is None or len(levels) < most:
        level = checkpoint(next_level(df, levels[-1], len(levels) + 1, support))
        if level.isEmpty():
            break
        levels.append(level)
    return reduce(DataFrame.unionByName, levels)


def fp_growth(df: DataFrame, support: int, most: int | None = None) -> DataFrame:
    """The same by FP-growth. The share that it takes lies half a basket below the support, so no rounding can matter."""
    sets = baskets(df)
    n = sets.count()
    found = FPGrowth(itemsCol="items", minSupport=max(0.0, (support - 0.5) / max(1, n))).fit(sets).freqItemsets
    found = found.select(F.array_sort("items").alias("items"), "freq")
    return found.where(F.size("items") <= most) if most else found


def sets_of(baskets: list[np.ndarray], weights: np.ndarray, n: int, chosen: Callable, most: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Level by level (sets, counts) in sorted baskets of numbers below n, each there `weights` times.

    A row of sets has a set's numbers. chosen(level, keys, counts) gives the
    keys to keep, in order; a key is n times the place of the set's prefix on
    the level before, plus its last number. Only what is kept grows, by later items.
    """
    x, size = np.concatenate(baskets), np.array([len(b) for b in baskets])
    end, weight = np.repeat(np.cumsum(size), size), np.repeat(weights, size)
    at, key, k, sets = np.arange(len(x)), x.astype(np.int64), 1, np.zeros((1, 0), np.int64)
    while len(at) and (most is None or k <= most):
        keys, kind = np.unique(key, return_inverse=True)
        counts = np.bincount(kind, weight[at]).astype(np.int64)
        kept = chosen(k, keys, counts)
        place = np.searchsorted(kept, keys)
        there = place < len(kept)
        there[there] = kept[place[there]] == keys[there]
        total = np.zeros(len(kept), np.int64)
        total[place[there]] = counts[there]
        sets = np.column_stack([sets[kept // n], kept % n])
        yield sets, total
        own = there[kind]
        at, prefix = at[own], place[kind[own]]
        more = end[at] - at - 1
        prefix = np.repeat(prefix, more)
        at = np.repeat(at + 1 - np.cumsum(more) + more, more) + np.arange(more.sum())
        key, k = prefix * n + x[at], k + 1


def sliced(df: DataFrame, slices: int) -> DataFrame:
    """(slice, items, n): the baskets' distinct items, sorted, equal ones of a slice once with their number; slices are by hash of the basket."""
    whole = baskets(df.where(F.col("item").isNotNull()))
    return checkpoint(whole.groupBy(F.pmod(F.xxhash64("basket"), F.lit(slices)).cast("int").alias("slice"), "items").agg(F.count("*").alias("n")))


def numbers(column: pd.Series, items: pd.Index) -> list[np.ndarray]:
    """The places in `items` of each row's items; -1 where one is not there."""
    size = column.str.len().to_numpy()
    return np.split(items.get_indexer(np.concatenate(column.to_numpy())), np.cumsum(size)[:-1])


def local_candidates(rows: DataFrame, support: int, most: int | None) -> DataFrame:
    """(items): the sets that reach their share of the support in some slice of (slice, items, n)."""
    total = rows.agg(F.sum("n")).first()[0] or 0

    def found(b: pd.DataFrame) -> pd.DataFrame:
        items = pd.Index(np.unique(np.concatenate(b["items"].to_numpy())))
        least = max(1, -(-support * int(b["n"].sum()) // total))
        levels = sets_of(numbers(b["items"], items), b["n"].to_numpy(), len(items), lambda k, keys, counts: keys[counts >= least], most)
        values = items.to_numpy()
        return pd.DataFrame({"items": [x for sets, _ in levels for x in values[sets]]})

    kind = rows.schema["items"].dataType.simpleString()
    return rows.repartition(SPREAD, "slice").groupBy("slice").applyInPandas(found, f"items {kind}").distinct()


def candidates_by_partition(df: DataFrame, support: int, most: int | None = None, slices: int = 8) -> DataFrame:
    """(items): local candidates of the two-phase scheme, of all sizes (of up to `most` items).

    A globally frequent set reaches its share of the support in some slice, so none is lost.
    """
    return local_candidates(sliced(df, slices), support, most)


def two_phase(df: DataFrame, support: int, most: int | None = None, slices: int = 8) -> DataFrame:
    """(items, freq): local candidates of all sizes, then the exact counts of those alone.

    Both phases go through a slice in memory; the second has all candidates in every slice.
    """
    rows = sliced(df, slices)
    candidates = checkpoint(local_candidates(rows, support, most))
    everywhere = candidates.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))

    def counted(b: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if not len(b) or not len(wanted):
            return pd.DataFrame({"items": [], "freq": []})
        items = pd.Index(np.unique(np.concatenate(b["items"].to_numpy())))
        n, size, tables = len(items), wanted["items"].str.len().to_numpy(), {}
        for k in np.unique(size):
            sets = np.array(numbers(wanted["items"][size == k], items))
            sets = sets[(sets >= 0).all(axis=1)]
            # a candidate's prefixes are candidates too
            key = sets[:, 0].astype(np.int64)
            for j in range(1, k):
                key = np.searchsorted(tables[j], key) * n + sets[:, j]
            tables[k] = np.sort(key)
        none = np.zeros(0, np.int64)
        levels = sets_of(numbers(b["items"], items), b["n"].to_numpy(), n, lambda k, keys, counts: tables.get(k, none), most)
        values = items.to_numpy()
        found = [(x, c) for sets, total in levels for x, c in zip(values[sets], total.tolist()) if c]
        return pd.DataFrame(found, columns=["items", "freq"])

    kind = rows.schema["items"].dataType.simpleString()
    both = rows.repartition(SPREAD, "slice").groupBy("slice").cogroup(everywhere.repartition(SPREAD, "slice").groupBy("slice"))
    parts = both.applyInPandas(counted, f"items {kind}, freq long")
    return parts.groupBy("items").agg(F.sum("freq").alias("freq")).where(F.col("freq") >= support)


def pair_buckets(df: DataFrame, buckets: int = 500, number: Column | None = None) -> DataFrame:
    """(bucket, n): pairs of a basket hashed by (sum + product) of their numbers."""
    x = df.select("basket", (number if number is not None else F.col("item").cast("long")).alias("x")).distinct()
    both = x.join(x.withColumnRenamed("x", "y"), "basket").where("x < y")
    bucket = F.pmod(F.col("x") + F.col("y") + F.col("x") * F.col("y"), F.lit(buckets).cast("long"))
    return both.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def pairs_by_buckets(df: DataFrame, support: int, buckets: int = 500, number: Column | None = None) -> DataFrame:
    """Frequent pairs, counted only in buckets that reach the support as a whole."""
    x = df.select("basket", "item", (number if number is not None else F.col("item").cast("long")).alias("x")).distinct()
    both = x.join(x.select("basket", F.col("item").alias("other"), F.col("x").alias("y")), "basket").where("x < y")
    both = both.withColumn("bucket", F.pmod(F.col("x") + F.col("y") + F.col("x") * F.col("y"), F.lit(buckets).cast("long")))
    full = pair_buckets(df, buckets, number).where(F.col("n") >= support)
    found = both.join(full.select("bucket"), "bucket", "left_semi").groupBy("item", "other").agg(F.count("*").alias("freq")).where(F.col("freq") >= support)
    return found.select(F.array_sort(F.array("item", "other")).alias("items"), "freq")
