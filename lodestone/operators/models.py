"""Rating models on Spark ML: boosted trees, factorisations, linear and nearest-neighbour regression, evaluation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.recommendation import ALS
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import hashing, scalar
from lodestone.plans.session import stored

from .relational import either, sample_fraction

#: Sampled users are dealt into so many packs.
PACKS = 48


def assembled(df: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep").transform(df)


def boosted_trees(train: DataFrame, columns: list[str], label: str = "stars", *, trees: int = 20, depth: int = 5, rate: float = 0.07, rows: float = 0.9, features: str = "0.9", least: int = 4, gain: float = 0.0, seed: int = 1):
    """A fitted pipeline. Penalties on leaf weights have no counterpart here; `gain` is the least gain of a split."""
    trees_ = GBTRegressor(labelCol=label, maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=rows, featureSubsetStrategy=features, minInstancesPerNode=least, minInfoGain=gain, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep"), trees_]).fit(train)


def clipped_predictions(model, df: DataFrame) -> DataFrame:
    return model.transform(df).withColumn("prediction", scalar.clipped("prediction"))


def grid_search(train: DataFrame, columns: list[str], label: str = "stars", *, depths: tuple = (3, 5), rates: tuple = (0.07, 0.3), trees: int = 10, folds: int = 3, seed: int = 1) -> tuple[object, DataFrame]:
    """The best boosted trees by cross-validation, and (depth, rate, rmse) of all."""
    gbt = GBTRegressor(labelCol=label, maxIter=trees, seed=seed)
    grid = ParamGridBuilder().addGrid(gbt.maxDepth, list(depths)).addGrid(gbt.stepSize, list(rates)).build()
    train = stored(train.select(*columns, label))  # each fold would make it twice, out of all that it is joined from
    found = CrossValidator(estimator=gbt, estimatorParamMaps=grid, evaluator=RegressionEvaluator(labelCol=label), numFolds=folds, seed=seed).fit(assembled(train, columns))
    rows = [(int(p[gbt.maxDepth]), float(p[gbt.stepSize]), float(m)) for p, m in zip(grid, found.avgMetrics)]
    return found.bestModel, train.sparkSession.createDataFrame(rows, "depth int, rate double, rmse double")


def als(ratings: DataFrame, *, rank: int = 15, rounds: int = 10, reg: float = 0.1, seed: int = 1):
    """Matrix factorisation; ids must be integers."""
    return ALS(userCol="user_id", itemCol="item_id", ratingCol="stars", rank=rank, maxIter=rounds, regParam=reg, coldStartStrategy="drop", seed=seed).fit(ratings)


def als_search(ratings: DataFrame, *, ranks: tuple = (5, 10, 15), rounds: tuple = (3, 5, 10), regs: tuple = (0.1, 0.01, 0.001), folds: int = 5, seed: int = 1):
    model = ALS(userCol="user_id", itemCol="item_id", ratingCol="stars", coldStartStrategy="drop", seed=seed)
    grid = ParamGridBuilder().addGrid(model.rank, list(ranks)).addGrid(model.maxIter, list(rounds)).addGrid(model.regParam, list(regs)).build()
    return CrossValidator(estimator=model, estimatorParamMaps=grid, evaluator=RegressionEvaluator(labelCol="stars"), numFolds=folds, seed=seed).fit(ratings)


def biased_factors(ratings: DataFrame, *, rank: int = 10, rounds: int = 8, reg: float = 0.1, damping: float = 5.0, seed: int = 1) -> dict:
    """Global mean, damped user and item biases, and factors of what they leave."""
    mean = ratings.agg(F.avg("stars")).first()[0] or 0.0
    items = ratings.groupBy("item_id").agg((F.sum(F.col("stars") - mean) / (F.count("*") + damping)).alias("item_bias"))
    rows = ratings.join(items, "item_id")
    users = rows.groupBy("user_id").agg((F.sum(F.col("stars") - mean - F.col("item_bias")) / (F.count("*") + damping)).alias("user_bias"))
    rest = rows.join(users, "user_id").select("user_id", "item_id", (F.col("stars") - mean - F.col("item_bias") - F.col("user_bias")).alias("stars"))
    return {"mean": mean, "users": users, "items": items, "factors": als(rest, rank=rank, rounds=rounds, reg=reg, seed=seed)}


def predict_biased(model: dict, pairs: DataFrame) -> DataFrame:
    """(user_id, item_id, prediction), clipped; what is unknown adds nothing."""
    factors = model["factors"]
    inner = factors.transform(pairs.select("user_id", "item_id")).select("user_id", "item_id", F.col("prediction").alias("rest"))
    rows = pairs.select("user_id", "item_id").join(model["users"], "user_id", "left").join(model["items"], "item_id", "left").join(inner, ["user_id", "item_id"], "left")
    total = F.lit(model["mean"]) + sum((F.coalesce(c, F.lit(0.0)) for c in ("user_bias", "item_bias", "rest")), F.lit(0.0))
    return rows.select("user_id", "item_id", scalar.clipped(total).alias("prediction"))


def linear(train: DataFrame, columns: list[str], label: str = "stars", *, reg: float = 0.01):
    """Scaled linear regression; kernels are not part of Spark ML."""
    stages = [VectorAssembler(inputCols=columns, outputCol="raw", handleInvalid="keep"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), LinearRegression(labelCol=label, regParam=reg)]
    return Pipeline(stages=stages).fit(train)


def content_boosted(ratings: DataFrame, users: DataFrame, items: DataFrame, percent: int, seed: int, predict) -> DataFrame:
    """The ratings and pseudo-ratings of sampled pairs that are not rated; `predict` adds a prediction to such pairs.

    A fresh item sample for each user: pairs are kept by their own hash, within the sampled users.
    """
    some = sample_fraction(users.select("user_id").distinct(), "user_id", percent, seed)
    rated = ratings.select("user_id", F.col("item_id").alias("rated")).join(some, "user_id", "left_semi").distinct()
    lists = some.join(rated.groupBy("user_id").agg(F.collect_list("rated").alias("rated")), "user_id", "left")
    # packs of users meet packs of items, and a pair is a row only once it is chosen
    left = lists.groupBy(F.pmod(F.xxhash64("user_id"), F.lit(PACKS)).alias("p")).agg(F.collect_list(F.struct("user_id", "rated")).alias("us")).drop("p")
    right = items.select("item_id").distinct().groupBy(F.pmod(F.xxhash64("item_id"), F.lit(4)).alias("q")).agg(F.array_sort(F.collect_list("item_id")).alias("its")).drop("q")
    prefix = f"{seed + 1}-"

    def chosen(batches):
        for batch in batches:
            for us, its in zip(batch["us"], batch["its"]):
                yield from unrated_sample(us, its, prefix, percent)

    kinds = f"user_id {users.schema['user_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}"
    packs = stored(left.repartition(PACKS)).crossJoin(F.broadcast(stored(right)))  # some ids, no rows of pairs
    pairs = packs.repartition(4 * PACKS).mapInPandas(chosen, kinds)
    return either(ratings.select("user_id", "item_id", "stars"), predict(pairs).select("user_id", "item_id", F.col("prediction").alias("stars")))


def unrated_sample(us, its, prefix: str, percent: int) -> Iterator[pd.DataFrame]:
    """Of the pairs of these users and items those that the hash of both chooses and that are not rated."""
    its = np.asarray(its)
    ends = [str(i).encode() for i in its.tolist()]
    size = np.array([len(e) for e in ends])
    groups = [(np.flatnonzero(size == n), int(n)) for n in np.unique(size)]
    blocks: dict[tuple[int, int], np.ndarray] = {}
    made, rows = [], 0
    for k, u in enumerate(us):
        begin = f"{prefix}{u['user_id']}-".encode()
        keep = []
        for places, n in groups:
            if len(begin) + n > hashing.SHORT:
                keep.append(places[[hashing.digits_of(begin, ends[i]) % 100 < percent for i in places]])
                continue
            key = len(begin), n
            if key not in blocks:
                blocks[key] = hashing.blocks_of([ends[i] for i in places], len(begin))
            keep.append(places[hashing.first_digits(begin, blocks[key]) % np.uint32(100) < percent])
        found = its[np.concatenate(keep)]
        if u["rated"] is not None and len(u["rated"]):
            found = found[~np.isin(found, np.asarray(u["rated"]))]
        made.append((u["user_id"], found))
        rows += len(found)
        if rows > 200_000 or k + 1 == len(us):
            yield pd.DataFrame({"user_id": np.repeat(np.asarray([v for v, _ in made]), [len(x) for _, x in made]), "item_id": np.concatenate([x for _, x in made])})
            made, rows = [], 0


def knn_regression(queries: DataFrame, train: DataFrame, columns: list[str], label: str, k: int, key: str, digits: int = 9) -> DataFrame:
    """(key, prediction): the mean label of each query's k nearest training rows by Euclidean distance, ties by key.

    A stated query set against all rows: each row keeps its k best in a
    partial aggregate, so that no query's distances meet in one task.
    """
    left = queries.select(F.col(key).alias("q"), F.array(*columns).alias("qx"))
    right = train.select(F.col(key).alias("t"), F.array(*columns).alias("tx"), F.col(label).alias("y"))
    distance = F.aggregate(F.zip_with("qx", "tx", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    pairs = left.crossJoin(right).where("q <> t").select("q", "t", "y", F.round(distance, digits).alias("d"))
    slot = F.pmod(F.xxhash64("t"), F.lit(16))
    part = Window.partitionBy("q", "slot").orderBy("d", "t")
    best = pairs.withColumn("slot", slot).withColumn("r", F.row_number().over(part)).where(F.col("r") <= k)
    last = Window.partitionBy("q").orderBy("d", "t")
    return best.withColumn("r", F.row_number().over(last)).where(F.col("r") <= k).groupBy("q").agg(F.avg("y").alias("prediction")).withColumnRenamed("q", key)
