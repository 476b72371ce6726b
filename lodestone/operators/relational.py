"""Relational operators: projections, filters, joins, aggregates, order, sets, partitions and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.plans.session import checkpoint

# Projections and filters


def pairs(df: DataFrame, key: str, value: str, case: int = 1) -> DataFrame:
    """(key, value), or swapped for case 2."""
    a, b = (key, value) if case == 1 else (value, key)
    return df.select(F.col(a).alias("key"), F.col(b).alias("value"))


def exploded(df: DataFrame, array: str, name: str) -> DataFrame:
    return df.withColumn(name, F.explode(array)).drop(array) if name != array else df.withColumn(name, F.explode(array))


def in_year(df: DataFrame, date: str, year: int) -> DataFrame:
    """Rows whose date string begins with the year."""
    return df.where(F.substring(F.col(date).cast("string"), 1, 4) == str(year))


def larger_than(df: DataFrame, array: str, k: int) -> DataFrame:
    return df.where(F.size(array) > k)


# Joins


def average_by(left: DataFrame, right: DataFrame, on: str, group: str, value: str) -> DataFrame:
    """Mean of a value by a column of the other side, highest first, then by name; partial sums before the shuffle."""
    return left.join(right, on).groupBy(group).agg(F.avg(value).alias("mean")).orderBy(F.col("mean").desc(), group)


def with_defaults(left: DataFrame, right: DataFrame, on: str | list[str], defaults: dict[str, Column | float]) -> DataFrame:
    """A left join in which columns that have no match take a default."""
    joined = left.join(right, on, "left")
    return joined.withColumns({c: F.coalesce(c, d if isinstance(d, Column) else F.lit(d)) for c, d in defaults.items()})


def with_means(left: DataFrame, right: DataFrame, on: str, columns: list[str]) -> DataFrame:
    """A left join in which missing numbers take the column's mean over the right side; all means come from one pass."""
    means = right.agg(*(F.avg(c).alias(f"__{c}") for c in columns))
    joined = left.join(right.select(on, *columns), on, "left").crossJoin(F.broadcast(means))  # one row
    return joined.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"__{c}")) for c in columns}).drop(*(f"__{c}" for c in columns))


def known(df: DataFrame, others: DataFrame, on: str | list[str]) -> DataFrame:
    return df.join(others, on, "left_semi")


def unknown(df: DataFrame, others: DataFrame, on: str | list[str]) -> DataFrame:
    return df.join(others, on, "left_anti")


def sharing(df: DataFrame, group: str, item: str, least: int) -> DataFrame:
    """(a, b, n): pairs of groups with at least so many items in common, by a join on the item instead of all pairs of groups."""
    own = df.select(group, item).distinct()
    left, right = own.select(F.col(group).alias("a"), item), own.select(F.col(group).alias("b"), item)
    return left.join(right, item).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def encoded(df: DataFrame, column: str, name: str) -> tuple[DataFrame, DataFrame]:
    """The rows with a dense number for each value of a column, in its order, and the dictionary for decoding."""
    dictionary = numbered(df.select(column).distinct(), column, name)
    return df.join(dictionary, column), dictionary


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """Numbers from 0 in order. Ranges are counted first, so that no task holds more than its own."""
    # stored, as a second run would sample other range bounds
    ranged = checkpoint(df.repartitionByRange(order).withColumn("__p", F.spark_partition_id()))
    counts = ranged.groupBy("__p").count()
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("__p", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__base"))
    own = Window.partitionBy("__p").orderBy(order)
    return ranged.withColumn("__i", F.row_number().over(own) - 1).join(base, "__p").withColumn(name, F.col("__base") + F.col("__i")).drop("__p", "__i", "__base")


# Aggregates


def summary(df: DataFrame, **measures: Column) -> DataFrame:
    """Several measures in one pass."""
    return df.agg(*(c.alias(k) for k, c in measures.items()))


def partition_profile(df: DataFrame) -> DataFrame:
    """(partition, n): rows of each physical partition."""
    return df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count("*").alias("n"))


def repartitioned(df: DataFrame, n: int, key: str | None = None) -> DataFrame:
    return df.repartition(n, key) if key else df.repartition(n)


def partitions(df: DataFrame) -> int:
    return df.rdd.getNumPartitions()


def rmse(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    error = F.col(prediction) - F.col(truth)
    return df.agg(F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(error * error).alias("mse"), F.count(error).alias("n"))


def error_histogram(df: DataFrame, truth: str, prediction: str, last: int = 4) -> DataFrame:
    """(bin, n): whole absolute errors, those from `last` on together."""
    size = F.least(F.floor(F.abs(F.col(prediction) - F.col(truth))), F.lit(last)).cast("int")
    return df.groupBy(size.alias("bin")).agg(F.count("*").alias("n"))


def largest(df: DataFrame, value: str, digits: int = 9) -> DataFrame:
    """All rows that tie at the largest value, compared after rounding."""
    most = df.agg(F.max(F.round(value, digits)).alias("__m"))
    return df.crossJoin(F.broadcast(most)).where(F.round(value, digits) == F.col("__m")).drop("__m")  # one row


# Order


def top(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    return df.orderBy(*order).limit(k)


def top_counts(df: DataFrame, key: str, k: int = 10) -> DataFrame:
    """(key, n): the k most frequent values, ties by value."""
    return top(df.groupBy(key).agg(F.count("*").alias("n")), k, F.col("n").desc(), key)


def top_of_each(df: DataFrame, group: list[str], k: int, *order: Column | str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


# Sets


def either(a: DataFrame, b: DataFrame) -> DataFrame:
    """All rows of both, by column name, repeats included."""
    return a.unionByName(b)


# Samples and order of data


def seeded(seed: int, key: Column | str) -> Column:
    """A hash that other engines compute alike."""
    return F.md5(F.concat(F.lit(f"{seed}-"), (key if isinstance(key, Column) else F.col(key)).cast("string")))


def sample(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """k rows without replacement: those with the least seeded hashes."""
    return df.orderBy(seeded(seed, key), key).limit(k)


def sample_fraction(df: DataFrame, key: str, percent: int, seed: int) -> DataFrame:
    """About so many per cent of the rows, by the hash of each; no sort."""
    return df.where(F.conv(F.substring(seeded(seed, key), 1, 7), 16, 10).cast("long") % 100 < percent)


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    return df.orderBy(seeded(seed, key), key)


def loads(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """Each row's load from 0 to n - 1: slices of the order by seeded hash, of a rounded nth of the rows each, the rest in the last."""
    size = max(1, round(df.count() / n))
    placed = numbered(df.withColumn("__h", F.struct(seeded(seed, key), F.col(key))), "__h", "__n")
    return placed.withColumn("load", F.least(F.floor(F.col("__n") / size), F.lit(n - 1)).cast("int")).drop("__h", "__n")
