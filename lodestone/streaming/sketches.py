"""Sketches over a sequence of keys (seq, key), by batches of a fixed number of rows.

Each has a batch form over the whole sequence and a streaming form that works
on files as they come; both give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import scalar
from lodestone.operators.relational import seeded
from lodestone.plans.session import checkpoint

#: Bits of the filter, and its six hash functions (a, b): affine in the key's number modulo the bits.
BITS = 69_997
BLOOM = [(2 * i + 3, 31 * i + 17) for i in range(6)]
#: Sixteen hash functions modulo 1024 for counting distinct keys.
COUNTERS = [(4 * i + 3, 97 * i + 11) for i in range(16)]


def batched(df: DataFrame, size: int) -> DataFrame:
    """The batch of each row, counted from 0."""
    return df.withColumn("batch", F.floor(F.col("seq") / size).cast("long"))


def positions(x: Column, hashes: list[tuple[int, int]], modulus: int) -> Column:
    return F.array(*(scalar.affine(x, a, b, modulus) for a, b in hashes))


def bloom(df: DataFrame, size: int, bits: int = BITS, hashes: list[tuple[int, int]] = BLOOM, text: bool = False) -> DataFrame:
    """(batch, n_new, n_false, fpr, reported_fpr): false positives among keys that are new, by batch.

    The filter in relational form: a position is set from the least seq that
    maps to it; a row's key seems known if all its positions were set before
    it; it is new if it is the first of its key. reported_fpr counts one
    true-negative event for each other hash of each new key.
    """
    x = scalar.text_mod(F.col("key").cast("string"), bits) if text else F.col("key").cast("long")
    rows = df.select("seq", "key", positions(x, hashes, bits).alias("p"))
    each = rows.select("seq", "key", F.explode("p").alias("pos"))
    first = each.groupBy("pos").agg(F.min("seq").alias("first"))
    seen = each.join(first, "pos").groupBy("seq", "key").agg(F.max("first").alias("latest"))
    new = rows.groupBy("key").agg(F.min("seq").alias("seq"))
    judged = batched(seen.join(new, ["key", "seq"]), size)
    wrong = F.sum(F.when(F.col("latest") < F.col("seq"), 1).otherwise(0))
    out = judged.groupBy("batch").agg(F.count("*").alias("n_new"), wrong.cast("long").alias("n_false"))
    return out.select("batch", "n_new", "n_false", (F.col("n_false") / F.col("n_new")).alias("fpr"), (F.col("n_false") / (len(hashes) * F.col("n_new"))).alias("reported_fpr"))


def distinct_estimate(df: DataFrame, size: int, hashes: list[tuple[int, int]] = COUNTERS, modulus: int = 1024, groups: tuple[tuple[int, int], ...] = ((0, 4), (4, 8), (8, 12))) -> DataFrame:
    """(batch, actual, estimate): distinct keys of each batch, exact and by trailing zeros.

    For each hash 2 to the most trailing zeros in the batch; averages over
    groups of hashes; of the three averages the mean of the upper two, rounded
    half to even.
    """
    rows = batched(df, size)
    zeros = [F.max(scalar.trailing_zeros(scalar.affine("key", a, b, modulus))) for a, b in hashes]
    found = rows.groupBy("batch").agg(F.count_distinct("key").alias("actual"), F.array(*zeros).alias("z"))
    power = F.transform("z", lambda z: F.pow(F.lit(2.0), z))
    means = F.sort_array(F.array(*(F.aggregate(F.slice("w", a + 1, b - a), F.lit(0.0), lambda s, v: s + v) / (b - a) for a, b in groups)))
    rows = found.withColumn("w", power).withColumn("m", means)
    return rows.select("batch", "actual", F.bround((F.element_at("m", -1) + F.element_at("m", -2)) / 2).cast("long").alias("estimate"))


def exact_distinct(df: DataFrame, size: int) -> DataFrame:
    return batched(df, size).groupBy("batch").agg(F.count_distinct("key").alias("n_distinct"))


def totals(estimates: DataFrame) -> DataFrame:
    """(batch, actual_total, estimate_total, ratio): running sums over batches."""
    so_far = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    rows = estimates.select("batch", F.sum("actual").over(so_far).alias("actual_total"), F.sum("estimate").over(so_far).alias("estimate_total"))
    return rows.withColumn("ratio", F.col("estimate_total") / F.col("actual_total"))


def least_of_each(df: DataFrame, k: int) -> DataFrame:
    own = Window.partitionBy("batch").orderBy("h", "seq")
    return df.withColumn("r", F.row_number().over(own)).where(F.col("r") <= k).select("batch", "seq", "key", "h")


def reservoir(df: DataFrame, size: int, k: int, seed: int = 1) -> DataFrame:
    """(batch, seq, key): after each batch the k rows of the least seeded hashes so far, a uniform sample of what has come.

    Only a batch's own k least can ever enter. They are carried forward by 1,
    2, 4 ... batches: a round deals twice k rows for each batch at most.
    """
    rows = batched(df, size)
    return carried(least_of_each(rows.withColumn("h", seeded(seed, "seq")), k), rows.select("batch").distinct(), k)


def carried(best: DataFrame, batches: DataFrame, k: int) -> DataFrame:
    """The k least of all rows up to each of the batches, given the k least of each."""
    best = checkpoint(best)
    # batches without rows of their own hold what came before but are not reported
    last, step = best.agg(F.max("batch") - F.min("batch")).first()[0] or 0, 1
    top = best.agg(F.max("batch")).first()[0] or 0
    while step <= last:
        moved = best.withColumn("batch", F.col("batch") + step).where(F.col("batch") <= top)
        best = checkpoint(least_of_each(best.unionByName(moved).dropDuplicates(["batch", "seq", "h"]), k))
        step *= 2
    return best.join(batches, "batch", "left_semi").select("batch", "seq", "key")


def algorithm_r(keys: Iterator, k: int, seed: int = 1) -> list:
    """The sequential reservoir: the first k, then each with probability k / n for a uniform place."""
    import random

    r, out = random.Random(seed), []
    for n, key in enumerate(keys, 1):
        if n <= k:
            out.append(key)
        elif r.random() < k / n:
            out[r.randrange(k)] = key
    return out


# Streams


def run(stream: DataFrame, handle, checkpoint_dir: str) -> None:
    """All that is available, by micro-batches; handle gets each batch as a DataFrame."""
    query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()


def epochs(spark: SparkSession, table: str, before: int, schema: str) -> DataFrame:
    """What the epochs before this one have written; a later run of an epoch replaces an earlier one."""
    if before < 1:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{table}/epoch={e}" for e in range(before)))


def latest(spark: SparkSession, table: str, before: int, schema: str) -> DataFrame:
    """The state that the epoch before this one has left."""
    return spark.read.schema(schema).parquet(f"{table}/epoch={before - 1}") if before else spark.createDataFrame([], schema)


def keep(df: DataFrame, table: str, epoch: int) -> None:
    df.write.mode("overwrite").parquet(f"{table}/epoch={epoch}")


def stream_distinct(stream: DataFrame, size: int, table: str, checkpoint_dir: str, **options) -> None:
    """The distinct (batch, key) of each micro-batch, in a folder for each epoch; the estimate is taken from what they hold.

    A batch may be spread over micro-batches. An epoch that runs again replaces its rows.
    """

    def handle(df: DataFrame, epoch: int) -> None:
        keep(batched(df.select("seq", "key"), size).groupBy("batch", "key").agg(F.min("seq").alias("seq")), table, epoch)

    run(stream, handle, checkpoint_dir)


def stream_bloom(stream: DataFrame, size: int, table: str, checkpoint_dir: str, bits: int = BITS, hashes: list[tuple[int, int]] = BLOOM) -> None:
    """The filter as state across micro-batches, which come in the order of seq: `bloom_counts` adds up what they have found.

    The state is the first seq of each position and the keys seen; each epoch
    reads what the one before it left and writes its own, so that one that
    runs again finds the same.
    """

    def handle(df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        rows = df.select("seq", F.col("key").cast("long").alias("key")).withColumn("p", positions(F.col("key"), hashes, bits))
        fresh = rows.groupBy("key").agg(F.min("seq").alias("seq")).join(epochs(spark, f"{table}/keys", epoch, "key long"), "key", "left_anti")
        fresh = checkpoint(fresh)
        each = rows.select("seq", "key", F.explode("p").alias("pos"))
        old = latest(spark, f"{table}/positions", epoch, "pos long, first long")
        first = old.unionByName(each.groupBy("pos").agg(F.min("seq").alias("first")).select(F.col("pos").cast("long").alias("pos"), "first"))
        first = checkpoint(first.groupBy("pos").agg(F.min("first").alias("first")))
        judged = each.join(fresh, ["key", "seq"]).join(first, "pos").groupBy("seq", "key").agg(F.max("first").alias("latest"))
        wrong = F.sum(F.when(F.col("latest") < F.col("seq"), 1).otherwise(0)).cast("long")
        keep(batched(judged, size).groupBy("batch").agg(F.count("*").alias("n_new"), wrong.alias("n_false")), f"{table}/counts", epoch)
        keep(fresh.select("key"), f"{table}/keys", epoch)
        keep(first, f"{table}/positions", epoch)

    run(stream, handle, checkpoint_dir)


def bloom_counts(spark: SparkSession, table: str, n_hashes: int = len(BLOOM)) -> DataFrame:
    """(batch, n_new, n_false, fpr, reported_fpr) of the counts that a stream has written."""
    rows = spark.read.schema("batch long, n_new long, n_false long").parquet(f"{table}/counts/epoch=*").groupBy("batch").agg(F.sum("n_new").alias("n_new"), F.sum("n_false").alias("n_false"))
    return rows.select("batch", "n_new", "n_false", (F.col("n_false") / F.col("n_new")).alias("fpr"), (F.col("n_false") / (n_hashes * F.col("n_new"))).alias("reported_fpr"))


def stream_reservoir(stream: DataFrame, size: int, k: int, table: str, checkpoint_dir: str, seed: int = 1) -> None:
    """The sample after each batch, from a state of k rows; micro-batches come in the order of seq. `reservoir_rows` reads it.

    Each epoch reads the k rows that the one before it held, and writes its
    batches' samples and its own k rows, so that one that runs again finds the same.
    """
    schema = "batch long, seq long, key long"

    def handle(df: DataFrame, epoch: int) -> None:
        rows = df.select("seq", F.col("key").cast("long").alias("key"))
        own = batched(rows, size).select("batch").distinct()
        held = latest(df.sparkSession, f"{table}/held", epoch, schema)
        # what was held counts for the first batch there is
        start = own.agg(F.min("batch").alias("start"))
        old = held.crossJoin(F.broadcast(start)).select("seq", "key", F.col("start").alias("batch"))  # one row
        both = batched(rows, size).unionByName(old, allowMissingColumns=True).withColumn("h", seeded(seed, "seq"))
        found = checkpoint(carried(least_of_each(both, k), own, k))
        keep(found, f"{table}/rows", epoch)
        keep(found.join(found.agg(F.max("batch").alias("batch")), "batch"), f"{table}/held", epoch)

    run(stream, handle, checkpoint_dir)


def reservoir_rows(spark: SparkSession, table: str) -> DataFrame:
    """(batch, seq, key): of a batch that came in several micro-batches, as the last of them left it."""
    rows = spark.read.schema("batch long, seq long, key long, epoch int").parquet(f"{table}/rows")
    return rows.join(rows.groupBy("batch").agg(F.max("epoch").alias("epoch")), ["batch", "epoch"], "left_semi").select("batch", "seq", "key")


def stream_counts(stream: DataFrame, state_table: str, checkpoint_dir: str) -> None:
    """Rows and last seq of each key, by a state per key that lives across micro-batches."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, last = state.get if state.exists else (0, -1)
        for b in batches:
            n, last = n + len(b), max(last, int(b.seq.max()))
        state.update((n, last))
        yield pd.DataFrame({"key": [key[0]], "n": [n], "last": [last]})

    counted = stream.groupBy("key").applyInPandasWithState(step, "key long, n long, last long", "n long, last long", "update", "NoTimeout")

    def handle(df: DataFrame, epoch: int) -> None:
        df.withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(state_table)

    query = counted.writeStream.outputMode("update").foreachBatch(handle).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
