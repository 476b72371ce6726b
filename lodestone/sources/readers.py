"""Sources: text, JSON lines, CSV, numeric points, Parquet, memory, streams and saved models."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REVIEW = "review_id string, user_id string, business_id string, stars double, date string"
BUSINESS = "business_id string, city string, state string, stars double, review_count long, categories string, latitude double, longitude double"
USER = (
    "user_id string, review_count long, yelping_since string, friends string, elite string, useful long, funny long, cool long, fans long, average_stars double, "
    + ", ".join(f"compliment_{x} long" for x in ("hot", "more", "profile", "cute", "list", "note", "plain", "cool", "funny", "writer", "photos"))
)
CHECKIN = "business_id string, time map<string, long>"
PHOTO = "business_id string, photo_id string"
RATING = "user_id string, business_id string, stars double"


def text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Only the fields of the schema are parsed; lines that are no JSON give nulls."""
    return spark.read.schema(schema).json(path)


def csv(spark: SparkSession, path: str, schema: str | None = None, *, header: bool = True, quote: str = '"') -> DataFrame:
    """Without the header line; commas inside quotes belong to the field."""
    reader = spark.read.option("header", header).option("quote", quote).option("escape", quote).option("ignoreLeadingWhiteSpace", False)
    return (reader.schema(schema) if schema else reader).csv(path)


def points(spark: SparkSession, path: str, dims: int) -> DataFrame:
    """(id, label, features) from lines of an index, a label and `dims` numbers."""
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("label", T.IntegerType()), *(T.StructField(f"x{i}", T.DoubleType()) for i in range(dims))])
    return spark.read.schema(schema).csv(path).select("id", "label", F.array(*(f"x{i}" for i in range(dims))).alias("features"))


def parquet(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def memory(spark: SparkSession, rows: Iterable, schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def stream(spark: SparkSession, folder: str, schema: str | T.StructType, *, form: str = "parquet", files: int = 1) -> DataFrame:
    """Files of a folder as a stream, at most so many in a micro-batch."""
    return spark.readStream.schema(schema).format(form).option("maxFilesPerTrigger", files).load(folder)


def drawn(df: DataFrame, key: str, ask: int, size: int, seed: int = 1) -> DataFrame:
    """(seq, key): `size` rows for each of `ask` asks, drawn uniformly with replacement; the same for the same seed."""
    from lodestone.operators.relational import numbered as number

    numbered = number(df.select(key), key, "i")
    n = df.count()
    draws = df.sparkSession.range(ask * size).select(F.col("id").alias("seq"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(max(1, n))).alias("i"))
    return draws.join(numbered, "i").select("seq", key)


def ratings(folder: DataFrame | str, spark: SparkSession | None = None, item: str = "l_suppkey") -> DataFrame:
    """(user_id, item_id, stars) from orders and their lines: the quantity's tenth, 5 at most, averaged over a user's lines of an item."""
    lines = parquet(spark, folder, "lineitem").select("l_orderkey", F.col(item).alias("item_id"), F.least(F.lit(5.0), F.ceil(F.col("l_quantity") / 10).cast("double")).alias("s"))
    orders = parquet(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user_id"))
    return lines.join(orders, "l_orderkey").groupBy("user_id", "item_id").agg(F.avg("s").alias("stars"))


def brand_baskets(spark: SparkSession, folder: str) -> DataFrame:
    """(basket, item): the brands of each order, once each."""
    lines = parquet(spark, folder, "lineitem").select(F.col("l_orderkey").alias("basket"), "l_partkey")
    parts = parquet(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("item"))
    return lines.join(parts, "l_partkey").select("basket", "item").distinct()


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(kind: type, path: str):
    return kind.load(path)
