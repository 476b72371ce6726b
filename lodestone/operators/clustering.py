"""Clustering of points (id, features) that arrive in loads, from summaries: discard, compression and retained sets.

A cluster is summarised by its number of points, sums and sums of squares.
Each round assigns the load against the summaries as they stood at its start;
`sequential` gives the point-by-point order instead, for one small load.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import scalar
from lodestone.plans.session import checkpoint, ship

from .relational import loads


#: Clusters that are sent to all tasks at once.
CLUSTERS = 1024


def summaries(assigned: DataFrame, cluster: str = "cluster") -> DataFrame:
    """(cluster, n, total, squares) of assigned points, by dimension, with partial sums before the shuffle."""
    each = assigned.select(cluster, F.posexplode("features").alias("d", "x"))
    sums = each.groupBy(cluster, "d").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    rows = sums.groupBy(cluster).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("d", "s", "q"))).alias("v"))
    return rows.select(F.col(cluster).alias("cluster"), "n", F.col("v.s").alias("total"), F.col("v.q").alias("squares"))


def added(a: DataFrame, b: DataFrame) -> DataFrame:
    """The summaries of both together."""
    plus = lambda x, y: F.zip_with(F.coalesce(x, y), F.coalesce(y, F.transform(x, lambda v: F.lit(0.0))), lambda p, q: p + q)
    j = a.alias("a").join(b.alias("b"), F.col("a.cluster") == F.col("b.cluster"), "full")
    total = F.when(F.col("a.n").isNull(), F.col("b.total")).otherwise(plus(F.col("a.total"), F.col("b.total")))
    squares = F.when(F.col("a.n").isNull(), F.col("b.squares")).otherwise(plus(F.col("a.squares"), F.col("b.squares")))
    return j.select(F.coalesce("a.cluster", "b.cluster").alias("cluster"), (F.coalesce("a.n", F.lit(0)) + F.coalesce("b.n", F.lit(0))).alias("n"), total.alias("total"), squares.alias("squares"))


def with_shape(summary: DataFrame) -> DataFrame:
    """Means and standard deviations."""
    mean = F.transform("total", lambda s: s / F.col("n"))
    return summary.select("cluster", "n", mean.alias("mean"), scalar.spread(F.col("n"), F.col("total"), F.col("squares")).alias("std"))


def nearest(points: DataFrame, summary: DataFrame, within: float | None = None) -> DataFrame:
    """(id, features, cluster, distance): the nearest cluster of each point, the least number of ties; only below `within`.

    Clusters are sent to all tasks in groups of CLUSTERS, each group as one
    array: a point finds its nearest in one expression, and only where there
    are more groups a shuffle finds the best of them (ids must not repeat).
    """
    n = summary.count()
    groups = max(1, -(-n // CLUSTERS))
    shaped = with_shape(summary).groupBy(F.pmod(F.hash("cluster"), F.lit(groups)).alias("group")).agg(F.collect_list(F.struct("cluster", "mean", "std")).alias("all"))
    near = F.array_min(F.transform("all", lambda c: F.struct(F.round(scalar.mahalanobis(F.col("features"), c["mean"], c["std"]), 9).alias("distance"), c["cluster"].alias("cluster"))))
    rows = points.crossJoin(F.broadcast(shaped) if groups == 1 else shaped).select("id", "features", near.alias("b"))
    if groups > 1:
        rows = rows.groupBy("id").agg(F.first("features").alias("features"), F.min("b").alias("b"))
    out = rows.where("b is not null").select("id", "features", "b.cluster", "b.distance")
    return out if within is None else out.where(F.col("distance") < within)


def mergeable(a: DataFrame, b: DataFrame, within: float, same: bool = True) -> DataFrame:
    """(a, b, distance): pairs of clusters whose Mahalanobis distance, the lesser of both directions, is below `within`."""
    x = with_shape(a).select(F.col("cluster").alias("a"), F.col("mean").alias("ma"), F.col("std").alias("sa"))
    y = with_shape(b).select(F.col("cluster").alias("b"), F.col("mean").alias("mb"), F.col("std").alias("sb"))
    d = F.least(scalar.mahalanobis(F.col("ma"), F.col("mb"), F.col("sb")), scalar.mahalanobis(F.col("ma"), F.col("mb"), F.col("sa")))
    pairs = x.join(y, F.col("a") < F.col("b") if same else F.lit(True)).select("a", "b", F.round(d, 9).alias("distance"))
    return pairs.where(F.col("distance") < within)


def greedy(pairs: list[tuple], one_sided: bool = False) -> dict:
    """Of pairs by rising distance those whose first (and second) is still free: a -> b."""
    out, used = {}, set()
    for a, b, _ in sorted(pairs, key=lambda p: (p[2], p[0], p[1])):
        if a not in used and (one_sided or b not in used):
            out[a] = b
            used |= {a} if one_sided else {a, b}
    return out


def kmeans(points: DataFrame, k: int, seed: int) -> DataFrame:
    """(id, features, cluster) by Spark ML; as many clusters as there are points, if fewer."""
    rows = points.withColumn("v", array_to_vector("features"))
    n = rows.count()
    if n <= 1 or k <= 1:
        return points.select("id", "features", F.lit(0).alias("cluster"))
    model = KMeans(k=min(k, n), seed=seed, featuresCol="v", predictionCol="cluster", maxIter=10).fit(rows)
    return model.transform(rows).select("id", "features", "cluster")


def crowded(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points of clusters with more than one, and single ones."""
    sizes = found.groupBy("cluster").count()
    many = found.join(sizes.where("count > 1").select("cluster"), "cluster", "left_semi")
    return many, found.join(sizes.where("count = 1").select("cluster"), "cluster", "left_semi").select("id", "features")


def fit(points: DataFrame, k: int, *, rounds: int = 5, seed: int = 1, factor: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """(id, state, cluster) with state DS, CS or RS, and (round, ds_points, cs_clusters, cs_points, rs_points).

    A first load is clustered into 5 k, single points set aside, the rest into
    k: the discard set. In each round a point joins the nearest discard
    cluster, else the nearest compression cluster, within factor * sqrt(d);
    the rest is retained and clustered anew; compression clusters that are
    close merge, and in the last round into discard clusters.
    """
    spark = points.sparkSession
    parted = checkpoint(loads(points.select("id", "features"), "id", rounds, seed))
    dims = len((parted.select("features").first() or [[]])[0])
    within = factor * float(np.sqrt(max(1, dims)))
    first = parted.where("load = 0").drop("load")
    many, single = crowded(kmeans(first, 5 * k, seed))
    ds_members = checkpoint(kmeans(many.select("id", "features"), k, seed))
    ds = checkpoint(summaries(ds_members))
    found, rs = crowded(kmeans(single, 5 * k, seed)) if not single.isEmpty() else (ds_members.limit(0), single)
    fresh = 0

    def renumbered(found: DataFrame) -> DataFrame:
        nonlocal fresh
        ids = sorted(r.cluster for r in found.select("cluster").distinct().collect())
        names = spark.createDataFrame([(int(c), fresh + i) for i, c in enumerate(ids)], "cluster int, new int")
        fresh += len(ids)
        return checkpoint(found.join(names, "cluster").select("id", "features", F.col("new").alias("cluster")))

    cs_members = renumbered(found)
    cs = checkpoint(summaries(cs_members))
    rs = checkpoint(rs.select("id", "features"))
    stats = []

    def note(r: int) -> None:
        stats.append((r, ds_members.count(), cs.count(), cs_members.count(), rs.count()))

    note(1)
    for r in range(1, rounds):
        load = parted.where(F.col("load") == r).drop("load")
        new_ds = checkpoint(nearest(load, ds, within).select("id", "features", "cluster"))
        rest = load.join(new_ds.select("id"), "id", "left_anti")
        new_cs = checkpoint(nearest(rest, cs, within).select("id", "features", "cluster"))
        rs = checkpoint(rs.unionByName(rest.join(new_cs.select("id"), "id", "left_anti")))
        ds, ds_members = checkpoint(added(ds, summaries(new_ds))), checkpoint(ds_members.unionByName(new_ds))
        cs, cs_members = checkpoint(added(cs, summaries(new_cs))), checkpoint(cs_members.unionByName(new_cs))
        n = rs.count()
        if n > 1:
            found, rest = crowded(kmeans(rs, n // 2 + 1, seed))
            made = renumbered(found)
            rs = checkpoint(rest.select("id", "features"))
            cs, cs_members = checkpoint(cs.unionByName(summaries(made))), checkpoint(cs_members.unionByName(made))
        # each cluster merges once a round at most
        close = greedy([tuple(x) for x in mergeable(cs, cs, within).collect()])
        if close:
            names = spark.createDataFrame([(int(b), int(a)) for a, b in close.items()], "cluster int, into int")
            cs_members = checkpoint(cs_members.join(names, "cluster", "left").select("id", "features", F.coalesce("into", "cluster").alias("cluster")))
            cs = checkpoint(summaries(cs_members))
        if r == rounds - 1:
            close = greedy([tuple(x) for x in mergeable(cs, ds, within, same=False).collect()], one_sided=True)
            names = spark.createDataFrame([(int(a), int(b)) for a, b in close.items()], "cluster int, into int")
            moved = cs_members.join(names, "cluster").select("id", "features", F.col("into").alias("cluster"))
            cs_members = checkpoint(cs_members.join(names, "cluster", "left_anti"))
            ds_members = checkpoint(ds_members.unionByName(moved.select("id", "features", "cluster")))
            cs = checkpoint(summaries(cs_members))
        note(r + 1)
    states = ds_members.select("id", F.lit("DS").alias("state"), "cluster").unionByName(cs_members.select("id", F.lit("CS").alias("state"), "cluster"))
    states = states.unionByName(rs.select("id", F.lit("RS").alias("state"), F.lit(-1).alias("cluster")))
    return states, spark.createDataFrame(stats, "round int, ds_points long, cs_clusters long, cs_points long, rs_points long")


def sequential(load: DataFrame, summary: DataFrame, within: float) -> DataFrame:
    """(id, cluster) with summaries that change after each point, in id order; -1 for none. One task, for a load that fits in it."""
    ship(load.sparkSession)
    start = [(r.cluster, r.n, np.array(r.total), np.array(r.squares)) for r in summary.orderBy("cluster").collect()]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state = [[c, n, s.copy(), q.copy()] for c, n, s, q in start]
        out = []
        for i, x in sorted(zip(pdf.id, pdf.features), key=lambda p: p[0]):
            x = np.asarray(x)
            best = None
            for own in state:
                mean = own[2] / own[1]
                std = np.maximum(np.sqrt(np.maximum(own[3] / own[1] - mean**2, 0)), 1e-9)
                d = round(float(np.sqrt((((x - mean) / std) ** 2).sum())), 9)
                if best is None or d < best[0]:
                    best = (d, own)
            if best and best[0] < within:
                best[1][1] += 1
                best[1][2] += x
                best[1][3] += x * x
                out.append((i, best[1][0]))
            else:
                out.append((i, -1))
        return pd.DataFrame(out, columns=["id", "cluster"])

    return load.select("id", "features").groupBy(F.lit("all")).applyInPandas(run, "id long, cluster int")
