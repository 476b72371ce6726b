"""Collaborative filtering over (user_id, item_id, stars) rows."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import scalar
from lodestone.plans.session import forget_shuffles, ship, stored

from .relational import numbered

#: Ratings of the items of one block, about.
BLOCK = 100_000


def averages(ratings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(user_id, user_mean) and (item_id, item_mean)."""
    return ratings.groupBy("user_id").agg(F.avg("stars").alias("user_mean")), ratings.groupBy("item_id").agg(F.avg("stars").alias("item_mean"))


def blocks(ratings: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(item_id, block), (user_id, items, stars, blocks) of all users, and the number of blocks.

    A block has items of neighbouring ids. Whoever works on a block's items
    gets the lists of their users, once each, instead of a row for each pair
    of a user's items.
    """
    known = ratings.select("user_id", "item_id", F.col("stars").cast("double").alias("stars")).dropna()
    number = stored(numbered(known.groupBy("item_id").agg(F.count("*").alias("n")), "item_id", "number"))
    items, rows = number.agg(F.count("*"), F.sum("n")).first()
    n = max(1, min(items, -(-(rows or 0) // BLOCK)))
    block = number.select("item_id", F.floor(F.col("number") * n / max(1, items)).cast("int").alias("block"))
    own = F.array_sort(F.collect_list(F.struct("item_id", "stars", "block")))
    lists = known.join(block, "item_id").groupBy("user_id").agg(own.alias("l"))
    return block, lists.select("user_id", F.col("l.item_id").alias("items"), F.col("l.stars").alias("stars"), F.col("l.block").alias("blocks")), n


def flat(t: pa.Table, column: str) -> np.ndarray:
    """The entries of a column of lists, one after the other."""
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in t[column].chunks] or [np.zeros(0)])


def lengths(t: pa.Table, column: str) -> np.ndarray:
    return np.concatenate([c.value_lengths().to_numpy(zero_copy_only=False) for c in t[column].chunks] or [np.zeros(0)]).astype(np.int64)


def runs(x: np.ndarray) -> Iterator[tuple[object, np.ndarray]]:
    """Each value with its places."""
    order = np.argsort(x, kind="stable")
    at = np.flatnonzero(np.concatenate([[True], x[order[1:]] != x[order[:-1]]])) if len(x) else []
    for i, places in zip(at, np.split(order, at[1:])):
        yield x[order[i]], places


def within(begin: np.ndarray, size: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all entries of these lists, and for each the list's place among them."""
    count = size[lists]
    return np.repeat(begin[lists] - np.cumsum(count) + count, count) + np.arange(count.sum()), np.repeat(np.arange(len(lists)), count)


def item_pairs(ratings: DataFrame, least: int = 3) -> DataFrame:
    """(a, b, n, correlation): Pearson's correlation over common users, for items with at least so many; 0 without variance.

    Item by item, over the lists of its users; both means are over the common
    users. Rows without a user, an item or stars take no part.
    """
    _, lists, n = blocks(ratings)

    def pairs(key: tuple, t: pa.Table) -> pa.Table:
        size = lengths(t, "items")
        begin, row = np.cumsum(size) - size, np.repeat(np.arange(len(size)), size)
        items, code = np.unique(flat(t, "items"), return_inverse=True)
        stars, own = flat(t, "stars"), np.flatnonzero(flat(t, "blocks") == key[0].as_py())
        found = []
        for a, places in runs(code[own]):
            at, which = within(begin, size, row[own[places]])
            later = code[at] > a
            at, which = at[later], which[later]
            some, count, r = correlated(stars[own[places]][which], stars[at], code[at] - a, least)
            found.append((np.full(len(some), a), some + a, count, r))
        a, b, c, r = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int),) * 4
        return pa.table({"a": pa.array(items[a], kind_), "b": pa.array(items[b], kind_), "n": pa.array(c, pa.int64()), "correlation": pa.array(r, pa.float64())})

    kind, kind_ = types(ratings, "item_id")
    rows = lists.select("items", "stars", "blocks", F.explode(F.array_distinct("blocks")).alias("block"))
    return rows.repartition(n, "block").groupBy("block").applyInArrow(pairs, f"a {kind}, b {kind}, n long, correlation double")


def correlated(x: np.ndarray, y: np.ndarray, b: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs of ratings, grouped by b: groups with at least so many, their numbers of pairs, and their correlations."""
    count = np.bincount(b)
    some = np.flatnonzero(count >= max(1, least))
    c = count[some].astype(float)
    sx, sy, sxy, sxx, syy = (np.bincount(b, v)[some] if len(b) else c for v in (x, y, x * y, x * x, y * y))
    vx, vy = sxx - sx * sx / c, syy - sy * sy / c
    level = (vx <= 1e-9) | (vy <= 1e-9)
    return some, count[some], np.where(level, 0.0, (sxy - sx * sy / c) / np.where(level, 1.0, np.sqrt(np.abs(vx)) * np.sqrt(np.abs(vy))))


def ranked(c: np.ndarray, code: np.ndarray, which: np.ndarray, n: int, digits: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the n highest positive c for each value of which, ties by code, and their ranks."""
    some = np.flatnonzero(c > 0)
    some = some[np.lexsort((code[some], -np.round(c[some], digits), which[some]))]
    own = which[some]
    first = np.concatenate([[True], own[1:] != own[:-1]]) if len(own) else np.zeros(0, bool)
    rank = np.arange(len(own)) - np.maximum.accumulate(np.where(first, np.arange(len(own)), 0)) + 1
    return some[rank <= n], rank[rank <= n]


def types(df: DataFrame, column: str) -> tuple[str, pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    kind = df.schema[column].dataType
    return kind.simpleString(), to_arrow_type(kind)


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.unionByName(pairs.select(*(F.col({"a": "b", "b": "a"}.get(c, c)).alias(c) for c in pairs.columns)))


def nearest(targets: DataFrame, ratings: DataFrame, pairs: DataFrame, n: int, digits: int, schema: str, made: Callable) -> DataFrame:
    """What `made` gives, as columns of this schema, from a block's neighbours: columns as those of `neighbours`, ordered by target and rank."""
    block, lists, count = blocks(ratings)
    wanted = targets.select("user_id", "item_id").join(block, "item_id").groupBy("user_id", "block").agg(F.collect_set("item_id").alias("wanted"))
    asked = wanted.join(lists.select("user_id", "items", "stars"), "user_id")
    similar = both_ways(pairs.select("a", "b", "correlation").where("correlation > 0")).join(block, F.col("a") == F.col("item_id")).select((F.col("block") + 0).alias("block"), "a", "b", "correlation")
    _, user_type = types(targets, "user_id")
    _, item_type = types(ratings, "item_id")

    def found(t: pa.Table, s: pa.Table) -> dict[str, np.ndarray]:
        users, size, asks = t["user_id"].to_numpy(), lengths(t, "items"), lengths(t, "wanted")
        begin, asker = np.cumsum(size) - size, np.repeat(np.arange(len(asks)), asks)
        items, code = np.unique(flat(t, "items"), return_inverse=True)
        stars, out = flat(t, "stars"), []
        a, b, correlation = (s[c].to_numpy() for c in ("a", "b", "correlation"))
        like = {x: places for x, places in runs(a)}
        near = np.zeros(len(items))
        for item, places in runs(flat(t, "wanted")):
            if item not in like or not len(items):
                continue
            other = np.minimum(np.searchsorted(items, b[like[item]]), len(items) - 1)
            there = items[other] == b[like[item]]
            near[other[there]] = correlation[like[item]][there]
            lists_ = asker[places]
            at, which = within(begin, size, lists_)
            c = near[code[at]]
            near[other] = 0.0
            some, rank = ranked(c, code[at], which, n, digits)
            own = which[some]
            out.append((users[lists_[own]], np.full(len(own), item), items[code[at[some]]], c[some], stars[at[some]], rank))
        empty = (users[:0], items[:0], items[:0], np.zeros(0), np.zeros(0), np.zeros(0, int))
        return dict(zip(("user_id", "item_id", "other", "correlation", "stars", "rank"), (np.concatenate(x) for x in zip(*out)) if out else empty))

    def columns(t: pa.Table, s: pa.Table) -> pa.Table:
        kinds = {"user_id": user_type, "item_id": item_type, "other": item_type, "rank": pa.int32()}
        return pa.table({k: pa.array(v, kinds.get(k, pa.float64())) for k, v in made(found(t, s)).items()})

    left, right = asked.repartition(count, "block").groupBy("block"), similar.repartition(count, "block").groupBy("block")
    return left.cogroup(right).applyInArrow(columns, schema)


def small(x: np.ndarray) -> np.ndarray:
    """The same whole numbers in the narrowest type."""
    kind = np.promote_types(np.min_scalar_type(x.min()), np.min_scalar_type(x.max())) if len(x) else np.int8
    return x.astype(kind)


def squeezed(lists: np.ndarray, stars: np.ndarray, *others: object) -> bytes:
    """Lists of item numbers (as steps) and stars (as places among their values), and whatever else, compressed."""
    values, code = np.unique(stars, return_inverse=True)
    data = pickle.dumps((small(np.diff(lists, prepend=0)), values, small(code), *others), 5)
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unsqueezed(data: bytes) -> tuple:
    steps, values, code, *others = pickle.loads(pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True))
    return np.cumsum(steps, dtype=np.int64), values[code] if len(values) else values, *others


def packed(batches: Iterator[pa.RecordBatch], count: int, items: int) -> Iterator[pa.RecordBatch]:
    """From rows of whole users (user_id, number, stars; no stars: wanted) for each of their blocks all that it needs, once for all users here.

    That is the users with a rated or wanted item in the block, their means and
    whole lists, and which of the block's items they want.
    """
    batches = list(batches)
    if not sum(map(len, batches)):
        return
    t = pa.Table.from_batches(batches)
    coded = t["user_id"].combine_chunks().dictionary_encode()
    users, u = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    number, s = t["number"].fill_null(-1).to_numpy().astype(np.int64), t["stars"].fill_null(0.0).to_numpy()
    asked = t["stars"].is_null().to_numpy()
    rated = ~asked
    voices = np.bincount(u[rated], minlength=len(users))
    mean = np.bincount(u[rated], s[rated], minlength=len(users)) / np.maximum(voices, 1)
    rated &= number >= 0
    order = np.flatnonzero(rated)[np.lexsort((s[rated], number[rated], u[rated]))]
    lu, ln, ls = u[order], number[order], s[order]
    size = np.bincount(lu, minlength=len(users))
    begin = np.cumsum(size) - size
    order = np.flatnonzero(asked)
    block = number[order] * count // items
    order = order[np.lexsort((number[order], u[order], block))]
    wu, wn, wb = u[order], number[order], number[order] * count // items
    both = np.unique(np.concatenate([(ln * count // items) * len(users) + lu, wb * len(users) + wu]))
    for b, at in runs(both // len(users)):
        here = both[at] % len(users)
        places, _ = within(begin, size, here)
        lo, hi = np.searchsorted(wb, (b, b + 1))
        wants = np.searchsorted(here, wu[lo:hi])
        data = squeezed(ln[places], ls[places], small(size[here]), users.take(pa.array(here)), mean[here], voices[here] > 0, small(np.bincount(wants, minlength=len(here))), small(np.diff(wn[lo:hi], prepend=0)))
        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([data], pa.binary())], ["block", "data"])


def together(targets: DataFrame, ratings: DataFrame, number: DataFrame, least: int, n: int, digits: int, schema: str, made: Callable) -> DataFrame:
    """What `made` gives, as columns of this schema, of the targets among numbered items, block by block.

    A task has its items' users with their whole lists, so it finds the
    correlations of its items with all others itself: neither pairs of items nor
    lists as rows are shuffled. Lists go to blocks compressed, many users at once.
    `made` gets users, their means and whether they have one, (user's place, item's
    number) of all targets, and of their neighbours, ordered by target and rank:
    the target's place, number, correlation, stars and rank.
    """
    ship(ratings.sparkSession)
    items, rows = number.agg(F.count("*"), F.sum("n")).first()
    items, rows = max(1, items), rows or 0
    count = max(1, min(items, -(-rows // BLOCK)))
    place, stars = number.select("item_id", "number"), F.col("stars").cast("double")
    own = ratings.where("user_id is not null and stars is not null").join(place, "item_id", "left").select("user_id", F.when(~F.isnan(stars), F.col("number")).alias("number"), stars.alias("stars"))
    wanted = targets.where("user_id is not null").join(place, "item_id").select("user_id", "number", F.lit(None).cast("double").alias("stars"))
    both = own.unionByName(wanted)
    parts = both.repartition(max(16, -(-rows // (4 * BLOCK))), "user_id").mapInArrow(lambda it: packed(it, count, items), "block int, data binary")

    def found(t: pa.Table) -> pa.Table:
        lists, stars, size, users, mean, known, asks, wants = zip(*(unsqueezed(x.as_py()) for x in t["data"]))
        wants = np.concatenate([np.cumsum(x, dtype=np.int64) for x in wants])
        lists, stars, size, mean, known, asks = (np.concatenate(x) for x in (lists, stars, size, mean, known, asks))
        size, users = size.astype(np.int64), pa.concat_arrays(users)
        begin, row, asker = np.cumsum(size) - size, np.repeat(np.arange(len(size)), size), np.repeat(np.arange(len(asks)), asks)
        items, code = np.unique(lists, return_inverse=True)
        raters = dict(runs(code))
        near, out = np.zeros(len(items)), []
        for item, entries in runs(wants):
            a = int(np.searchsorted(items, item))
            at, which = within(begin, size, row[raters[a]])
            other = code[at] != a
            some, _, r = correlated(stars[raters[a]][which[other]], stars[at[other]], code[at[other]], least)
            near[some] = r
            at, which = within(begin, size, asker[entries])
            c = near[code[at]]
            near[some] = 0.0
            top, rank = ranked(c, code[at], which, n, digits)
            out.append((entries[which[top]], items[code[at[top]]], c[top], stars[at[top]], rank))
        empty = ((np.zeros(0, np.int64), items[:0], np.zeros(0), np.zeros(0), np.zeros(0, np.int64)),)
        return made(users, mean, known, asker, wants, *(np.concatenate(x) for x in zip(*(out or empty))))

    out = parts.repartition(count, "block").groupBy("block").applyInArrow(found, f"user_id {types(both, 'user_id')[0]}, {schema}")
    return out.withColumn("user_id", F.col("user_id").cast(types(targets, "user_id")[0]))


def items_of(ratings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item_id, number, n) of the items with ratings n, in their order, and (item_id, item_mean); both stored."""
    stars = F.col("stars").cast("double")
    some = F.col("user_id").isNotNull() & stars.isNotNull() & ~F.isnan(stars)
    counted = stored(ratings.where("item_id is not null").groupBy("item_id").agg(F.count_if(some).alias("n"), F.avg("stars").alias("item_mean")))
    return stored(numbered(counted.where("n > 0").select("item_id", "n"), "item_id", "number")), counted.select("item_id", "item_mean")


def neighbours(targets: DataFrame, ratings: DataFrame, pairs: DataFrame | int = 3, n: int = 8, digits: int = 9) -> DataFrame:
    """(user_id, item_id, other, correlation, stars, rank): of the items that a target's user rated, the n most similar ones of positive similarity.

    Pairs are rows of similarities, or a number: then those of `item_pairs` with at least so many common users.
    """
    user, item = types(targets, "user_id")[0], types(ratings, "item_id")[0]
    if not isinstance(pairs, int):
        schema = f"user_id {user}, item_id {item}, other {item}, correlation double, stars double, rank int"
        return nearest(targets, ratings, pairs, n, digits, schema, lambda rows: rows)
    forget_shuffles(ratings.sparkSession)
    number, _ = items_of(ratings)

    def rows(users, mean, known, asker, wants, entry, other, correlation, stars, rank):
        again = np.concatenate([[False], (asker[1:] == asker[:-1]) & (wants[1:] == wants[:-1])]) if len(wants) else np.zeros(0, bool)
        once = ~again[entry]
        entry = entry[once]
        columns = (users.take(pa.array(asker[entry])), wants[entry], other[once], correlation[once], stars[once], rank[once].astype(np.int32))
        return pa.table(dict(zip(("user_id", "number", "to", "correlation", "stars", "rank"), columns)))

    found = together(targets, ratings, number, pairs, n, digits, "number long, to long, correlation double, stars double, rank int", rows)
    named = lambda n, i: number.select(F.col("number").cast("long").alias(n), F.col("item_id").alias(i))
    return found.join(named("number", "item_id"), "number").join(named("to", "other"), "to").select("user_id", "item_id", "other", "correlation", "stars", "rank")


def predict(targets: DataFrame, ratings: DataFrame, pairs: DataFrame | int = 3, n: int = 8, unknown: float = 3.0, power: int = 1) -> DataFrame:
    """(user_id, item_id, prediction, confidence), clipped to 1 to 5.

    The weighted mean of the neighbours' ratings. Without neighbours the mean
    of the user's and the item's averages; the known one where the other is
    missing; a constant where both are. Confidence is the similarity of the
    last neighbour; 0.1, 0.05 and 0 on the steps below. An item is no neighbour
    of its own, so the prediction of a rated pair does not come from its rating.
    Pairs are as in `neighbours`.
    """

    def means(correlation: np.ndarray, stars: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.flatnonzero(rank == 1)
        w = correlation**power
        return (at, np.add.reduceat(w * stars, at) / np.add.reduceat(w, at), np.minimum.reduceat(correlation, at)) if len(at) else (at, w, w)

    def weighted(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        at, total, last = means(rows["correlation"], rows["stars"], rows["rank"])
        return {"user_id": rows["user_id"][at], "item_id": rows["item_id"][at], "weighted": total, "last": last}

    user, item = types(targets, "user_id")[0], types(ratings, "item_id")[0]
    targets = targets.select("user_id", "item_id")
    if not isinstance(pairs, int):
        scored = nearest(targets, ratings, pairs, n, 9, f"user_id {user}, item_id {item}, weighted double, last double", weighted)
        users, items = averages(ratings)
        rows = targets.join(scored, ["user_id", "item_id"], "left").join(users, "user_id", "left").join(items, "item_id", "left")
        return predictions(rows, unknown)
    forget_shuffles(ratings.sparkSession)
    number, items = items_of(ratings)

    def all_targets(users, mean, known, asker, wants, entry, other, correlation, stars, rank):
        at, total, last = means(correlation, stars, rank)
        none, found = np.ones(len(wants), bool), np.zeros((2, len(wants)))
        none[entry[at]], found[:, entry[at]] = False, (total, last)
        return pa.table({"user_id": users.take(pa.array(asker)), "number": wants, "weighted": pa.array(found[0], mask=none), "last": pa.array(found[1], mask=none), "user_mean": pa.array(mean[asker], mask=~known[asker])})

    place = number.select("item_id", F.col("number").cast("long").alias("number"))
    found = together(targets, ratings, number, pairs, n, 9, "number long, weighted double, last double, user_mean double", all_targets)
    found = found.join(place.join(items, "item_id"), "number")
    # targets without a user or of items that nobody rated; averages of their users alone
    rest = stored(targets.where("user_id is null").unionByName(targets.where("user_id is not null").join(place, "item_id", "left_anti").select("user_id", "item_id")))
    users, _ = averages(ratings.join(rest.select("user_id").distinct(), "user_id", "left_semi"))
    none = F.lit(None).cast("double")
    rest = rest.join(users, "user_id", "left").join(items, "item_id", "left").select("user_id", "item_id", none.alias("weighted"), none.alias("last"), "user_mean", "item_mean")
    return predictions(found.select(*rest.columns).unionByName(rest), unknown)


def predictions(rows: DataFrame, unknown: float) -> DataFrame:
    return rows.select("user_id", "item_id", scalar.clipped(fallback(F.col("weighted"), unknown)).alias("prediction"), confidence(F.col("last")).alias("confidence"))


def fallback(value: Column, unknown: float) -> Column:
    """A prediction, or what is known without neighbours: columns user_mean and item_mean."""
    return F.coalesce(value, (F.col("user_mean") + F.col("item_mean")) / 2, F.col("user_mean"), F.col("item_mean"), F.lit(unknown))


def confidence(last: Column) -> Column:
    both = F.col("user_mean").isNotNull() & F.col("item_mean").isNotNull()
    return F.coalesce(last, F.when(both, 0.1).when(F.col("user_mean").isNotNull() | F.col("item_mean").isNotNull(), 0.05).otherwise(0.0))


def blended(pairs: DataFrame, items: DataFrame, weights: tuple[float, float, float] = (0.3, 0.4, 0.3)) -> DataFrame:
    """(a, b, similarity): a blend of rating similarity with content similarities of the pairs' items.

    items has item_id, x and y (its mean and its number of ratings) and tags.
    Weights are of the cosine of (x, y), of the tags' Jaccard and of the
    rating similarity; the sum takes the other sign where that is 0 or less.
    """
    side = lambda s: items.select(*(F.col(c).alias(f"{c}_{s}") for c in ("item_id", "x", "y", "tags"))).withColumnRenamed(f"item_id_{s}", s)
    rows = pairs.join(side("a"), "a").join(side("b"), "b")
    hot = scalar.cosine2(F.col("x_a"), F.col("y_a"), F.col("x_b"), F.col("y_b"))
    tags = scalar.jaccard("tags_a", "tags_b")
    return rows.select("a", "b", scalar.blend(F.col("correlation"), [(weights[0], hot), (weights[1], tags)], weights[2]).alias("similarity"))


def hybrid(cf: DataFrame, model: DataFrame, weight: float | str = 0.1) -> DataFrame:
    """weight * collaborative + (1 - weight) * model for pairs that both predict; a string names a confidence column to be divided by 3."""
    rows = cf.withColumnRenamed("prediction", "cf").join(model.select("user_id", "item_id", F.col("prediction").alias("model")), ["user_id", "item_id"])
    w = F.col(weight) / 3 if isinstance(weight, str) else F.lit(weight)
    return rows.select("user_id", "item_id", scalar.weighted(w, F.col("cf"), F.col("model")).alias("prediction"))


def voted(a: DataFrame, b: DataFrame, c: DataFrame) -> DataFrame:
    """Of three models' predictions the second, rounded where all agree."""
    on = ["user_id", "item_id"]
    rows = a.select(*on, F.col("prediction").alias("pa")).join(b.select(*on, F.col("prediction").alias("pb")), on).join(c.select(*on, F.col("prediction").alias("pc")), on)
    return rows.select(*on, scalar.vote(F.col("pa"), F.col("pb"), F.col("pc")).alias("prediction"))
