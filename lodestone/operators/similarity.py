"""Similar items: exact Jaccard, MinHash signatures and banded LSH over (item, user) rows."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A prime above the numbers that users have.
PRIME = 2_147_483_647


def coefficients(n: int, seed: int = 1, modulus: int = PRIME) -> list[tuple[int, int]]:
    """n hash functions a x + b with a from 1 on, over the whole range of the modulus (small ones would keep the order of small numbers); the same for the same seed."""
    r = random.Random(seed)
    return [(r.randrange(1, modulus), r.randrange(modulus)) for _ in range(n)]


def signatures(df: DataFrame, hashes: list[tuple[int, int]], modulus: int = PRIME) -> DataFrame:
    """(item, signature): the least of each hash over an item's users, in one aggregation with partial minima."""
    least = [F.min(F.pmod(F.col("user") * a + b, F.lit(modulus).cast("long"))) for a, b in hashes]
    return df.groupBy("item").agg(F.array(*least).alias("signature"))


def candidates(signed: DataFrame, bands: int, rows: int) -> DataFrame:
    """(a, b): pairs that agree in all rows of some band. Bands with a single item drop out before the join."""
    bucket = F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.struct(i.alias("band"), F.slice("signature", i * rows + 1, rows).alias("part"))))
    placed = signed.select("item", bucket.alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    placed = placed.join(shared, "bucket", "left_semi")
    return placed.select("bucket", F.col("item").alias("a")).join(placed.select("bucket", F.col("item").alias("b")), "bucket").where("a < b").select("a", "b").distinct()


def jaccard(df: DataFrame, least: float, pairs: DataFrame | None = None) -> DataFrame:
    """(a, b, similarity): of the given pairs, or of all that share a user, those of at least this Jaccard similarity."""
    rows = df.select("item", "user").distinct()
    size = rows.groupBy("item").agg(F.count("*").alias("n"))
    left, right = rows.withColumnRenamed("item", "a"), rows.withColumnRenamed("item", "b")
    both = pairs.join(left, "a").join(right, ["b", "user"]) if pairs is not None else left.join(right, "user").where("a < b")
    common = both.groupBy("a", "b").agg(F.count("*").alias("c"))
    sized = common.join(size.select(F.col("item").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("item").alias("b"), F.col("n").alias("nb")), "b")
    return sized.select("a", "b", (F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))).alias("similarity")).where(F.col("similarity") >= least)


def similar_items(df: DataFrame, least: float = 0.5, bands: int = 30, rows: int = 2, seed: int = 1) -> DataFrame:
    """Banded LSH candidates, then their exact similarity."""
    signed = signatures(df, coefficients(bands * rows, seed))
    return jaccard(df, least, candidates(signed, bands, rows))
