"""Feature tables for rating models. Missing users or items take the means of all, from one pass for each side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import scalar

from .relational import with_defaults, with_means

BASE_USER, BASE_ITEM = ["review_count", "useful", "fans", "average_stars"], ["stars", "review_count"]
RICH_USER = ["review_count", "history", "friends", "votes", "elite", "average_stars", "compliments"]
BASE = ["u_key", "i_key", *(f"u_{c}" for c in BASE_USER), *(f"i_{c}" for c in BASE_ITEM)]
RICH = ["u_key", "i_key", *(f"u_{c}" for c in RICH_USER), *(f"i_{c}" for c in BASE_ITEM), "i_checkins", "i_photos"]


def user_features(users: DataFrame, as_of: str) -> DataFrame:
    """History in days, list lengths, votes and compliments; the day that history ends on is a parameter."""
    compliments = [F.coalesce(c, F.lit(0)) for c in users.columns if c.startswith("compliment_")]
    return users.select(
        "user_id", "review_count", F.col("average_stars").alias("average_stars"), scalar.days_since("yelping_since", as_of).alias("history"),
        scalar.list_length("friends").alias("friends"), scalar.list_length("elite").alias("elite"), (F.col("useful") + F.col("funny") + F.col("cool")).alias("votes"),
        sum(compliments, F.lit(0)).alias("compliments"),
    )


def item_features(businesses: DataFrame, checkins: DataFrame, photos: DataFrame) -> DataFrame:
    """Stars, reviews, summed check-ins and counted photos; none count 0."""
    visits = checkins.select("business_id", scalar.map_sum("time").alias("checkins"))
    pictures = photos.groupBy("business_id").agg(F.count("*").alias("photos"))
    rows = businesses.select("business_id", "stars", "review_count").join(visits, "business_id", "left").join(pictures, "business_id", "left")
    return rows.withColumns({"checkins": F.coalesce("checkins", F.lit(0)), "photos": F.coalesce("photos", F.lit(0))})


def joined(pairs: DataFrame, users: DataFrame, items: DataFrame, user: str = "user_id", item: str = "item_id") -> DataFrame:
    """Each pair with the features of both sides (prefixes u_ and i_); their sizes decide how they are joined."""
    named = lambda df, key, p: df.select(key, *(F.col(c).cast("double").alias(f"{p}{c}") for c in df.columns if c != key))
    left, right = named(users, user, "u_"), named(items, item, "i_")
    out = with_means(pairs, left, user, [c for c in left.columns if c != user])
    return with_means(out, right, item, [c for c in right.columns if c != item])


def key(column: str) -> Column:
    """An id as a number, by a hash that is the same everywhere and always, in other engines too."""
    return F.conv(F.substring(F.md5(F.col(column).cast("string")), 1, 13), 16, 10).cast("double")


def with_keys(pairs: DataFrame, user: str = "user_id", item: str = "item_id") -> DataFrame:
    return pairs.withColumns({"u_key": key(user), "i_key": key(item)})


def base_features(pairs: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Eight columns of each pair: both ids as numbers, the user's reviews, useful votes, fans and mean, the item's stars and reviews.

    Unknown users have the mean number of reviews and mean rating, and no
    votes or fans; unknown items the means of both.
    """
    users = users.select("user_id", *(F.col(c).cast("double").alias(f"u_{c}") for c in BASE_USER))
    items = items.select("item_id", *(F.col(c).cast("double").alias(f"i_{c}") for c in BASE_ITEM))
    known = with_defaults(pairs, users.select("user_id", "u_useful", "u_fans"), "user_id", {"u_useful": 0.0, "u_fans": 0.0})
    rows = with_means(with_means(known, users, "user_id", ["u_review_count", "u_average_stars"]), items, "item_id", ["i_stars", "i_review_count"])
    return with_keys(rows).select(*pairs.columns, *BASE)


def rich_features(pairs: DataFrame, users: DataFrame, businesses: DataFrame, checkins: DataFrame, photos: DataFrame, as_of: str) -> DataFrame:
    """Thirteen columns of each pair: both ids as numbers, seven of the user, stars and reviews of the item, its check-ins and photos.

    What is unknown takes the mean of all that is known of its kind.
    """
    people = user_features(users, as_of).select("user_id", *(F.col(c).cast("double").alias(f"u_{c}") for c in RICH_USER))
    items = businesses.select(F.col("business_id").alias("item_id"), *(F.col(c).cast("double").alias(f"i_{c}") for c in BASE_ITEM))
    visits = checkins.select(F.col("business_id").alias("item_id"), scalar.map_sum("time").cast("double").alias("i_checkins"))
    pictures = photos.groupBy(F.col("business_id").alias("item_id")).agg(F.count("*").cast("double").alias("i_photos"))
    rows = with_means(pairs, people, "user_id", [f"u_{c}" for c in RICH_USER])
    for side, columns in ((items, [f"i_{c}" for c in BASE_ITEM]), (visits, ["i_checkins"]), (pictures, ["i_photos"])):
        rows = with_means(rows, side, "item_id", columns)
    return with_keys(rows).select(*pairs.columns, *RICH)


def with_collaborative(features: DataFrame, predictions: DataFrame) -> DataFrame:
    """A collaborative prediction as one more feature; `recommend.predict` makes it without the row's own rating as a neighbour."""
    return features.join(predictions.select("user_id", "item_id", F.col("prediction").alias("cf")), ["user_id", "item_id"], "left")
