"""Queries over the test tables for every operator family; `oracle` has their SQL."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import scalar
from lodestone.operators import clustering, features, graph, itemsets, models, recommend, relational, similarity
from lodestone.plans.session import need_local, stored
from lodestone.sources import readers
from lodestone.streaming import sketches

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    df = readers.parquet(spark, sf, name)
    return df.select(*columns) if columns else df


def reviews(spark: SparkSession, sf: str) -> DataFrame:
    """A row for each order line: user, item, stars, day."""
    lines = table(spark, sf, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    orders = table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    stars = F.least(F.lit(5.0), F.ceil(F.col("l_quantity") / 10).cast("double"))
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), F.col("l_suppkey").alias("supplier"), stars.alias("stars"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


def ratings(spark: SparkSession, sf: str) -> DataFrame:
    return readers.ratings(sf, spark)


# Relational


@query
def nation_avg_rating(spark, sf):
    users = table(spark, sf, "customer", "c_custkey", "c_nationkey").withColumnsRenamed({"c_custkey": "user_id", "c_nationkey": "n_nationkey"})
    named = users.join(table(spark, sf, "nation", "n_nationkey", "n_name"), "n_nationkey")
    rows = relational.average_by(named, reviews(spark, sf).select("user_id", "stars"), "user_id", "n_name", "stars")
    return rows.select("n_name", F.round("mean", 6).alias("avg_stars"))


@query
def topk_users(spark, sf):
    return relational.top_counts(reviews(spark, sf), "user_id", 10)


@query
def topk_items(spark, sf):
    return relational.top_counts(reviews(spark, sf), "item_id", 10)


@query
def review_counts(spark, sf):
    r = reviews(spark, sf)
    return relational.summary(r, n_review=F.count("*"), n_review_1995=F.count_if(F.substring("day", 1, 4) == "1995"), n_user=F.count_distinct("user_id"), n_item=F.count_distinct("item_id"))


@query
def year_filter_count(spark, sf):
    return relational.in_year(reviews(spark, sf), "day", 1996).agg(F.count("*").alias("n"))


@query
def distinct_counts(spark, sf):
    return relational.summary(reviews(spark, sf), users=F.count_distinct("user_id"), items=F.count_distinct("item_id"), suppliers=F.count_distinct("supplier"), pairs=F.count_distinct("user_id", "item_id"))


@query
def partition_profile(spark, sf):
    return relational.partition_profile(relational.repartitioned(reviews(spark, sf), 3, "item_id"))


@query
def lookup_join_impute(spark, sf):
    docs, labels = table(spark, sf, "documents", "doc_id", "source"), table(spark, sf, "labels")
    return relational.with_means(docs, labels, "doc_id", ["quality", "toxic"]).select("doc_id", "source", F.round("quality", 6).alias("quality"), F.round("toxic", 6).alias("toxic"))


@query
def semi_known(spark, sf):
    some = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    return relational.known(ratings(spark, sf), some, "user_id").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg("stars"), 6).alias("mean"))


def pairs_of(spark, sf):
    """Every rated pair, and each user with the item after every one that they rated."""
    rated = ratings(spark, sf).select("user_id", "item_id")
    return rated.unionByName(rated.select("user_id", (F.col("item_id") + 1).alias("item_id"))).distinct()


@query
def anti_unrated(spark, sf):
    return relational.unknown(pairs_of(spark, sf), ratings(spark, sf), ["user_id", "item_id"])


@query
def union_pseudo(spark, sf):
    pseudo = anti_unrated(spark, sf).withColumn("stars", F.lit(3.0))
    both = relational.either(ratings(spark, sf), pseudo)
    return both.groupBy("item_id").agg(F.count("*").alias("n"), F.round(F.avg("stars"), 6).alias("mean"))


@query
def self_join_corated(spark, sf):
    return relational.sharing(ratings(spark, sf), "item_id", "user_id", 3)


@query
def json_map_sum(spark, sf):
    e = table(spark, sf, "events", "event_type", "props").withColumn("m", F.from_json("props", "map<string,bigint>"))
    return e.groupBy("event_type").agg(F.sum(scalar.map_sum("m")).alias("total"), F.count("*").alias("n"))


@query
def split_array_len(spark, sf):
    p = table(spark, sf, "part", "p_partkey", "p_type").withColumn("s", F.regexp_replace("p_type", " ", ","))
    s = F.when(F.col("p_partkey") % 7 == 0, "None").otherwise(F.col("s"))
    return p.select("p_partkey", scalar.list_length(s).alias("n"), F.size(scalar.comma_list(F.when(F.col("p_partkey") % 5 == 0, None).otherwise(F.col("s")))).alias("m"))


@query
def days_since(spark, sf):
    o = table(spark, sf, "orders", "o_custkey", "o_orderdate").groupBy("o_custkey").agg(F.min("o_orderdate").alias("first"))
    return o.select("o_custkey", scalar.days_since("first", "2000-01-01").alias("days"))


@query
def string_keys(spark, sf):
    o = table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    day = F.concat_ws("/", F.month("o_orderdate").cast("string"), F.dayofmonth("o_orderdate").cast("string"), F.year("o_orderdate").cast("string"))
    padded = F.concat(F.lit('"000'), F.col("o_orderkey").cast("string"), F.lit('"'))
    return o.select("o_orderkey", scalar.basket_key(day, "o_custkey").alias("basket"), scalar.without_zeros(scalar.unquoted(padded)).alias("product"), scalar.text_mod(F.col("o_orderkey").cast("string"), 69997).alias("h"))


@query
def encode_ids(spark, sf):
    users = table(spark, sf, "customer").select("c_mktsegment", "c_custkey")
    rows, _ = relational.encoded(users, "c_mktsegment", "segment")
    return rows.groupBy("segment", "c_mktsegment").agg(F.count("*").alias("n"))


@query
def number_rows(spark, sf):
    return relational.numbered(table(spark, sf, "customer", "c_custkey"), "c_custkey", "number")


@query
def seeded_sample(spark, sf):
    return relational.sample(table(spark, sf, "customer", "c_custkey", "c_name"), "c_custkey", 50, 7)


@query
def five_loads(spark, sf):
    return relational.loads(table(spark, sf, "embeddings", "vec_id"), "vec_id", 5, 1).groupBy("load").agg(F.count("*").alias("n"), F.sum("vec_id").alias("s"))


@query
def dearest_parts(spark, sf):
    """All parts that tie at the highest price."""
    return relational.largest(table(spark, sf, "part", "p_partkey", "p_retailprice"), "p_retailprice")


# Itemsets


@query
def basket_build(spark, sf):
    return itemsets.baskets(readers.brand_baskets(spark, sf), 2).select("basket", F.array_join("items", ",").alias("items"), F.size("items").alias("n"))


def flat(df):
    return df.select(F.array_join("items", ",").alias("items"), "freq")


@query
def frequent_items(spark, sf):
    return flat(itemsets.frequent_items(readers.brand_baskets(spark, sf), 20))


@query
def frequent_pairs(spark, sf):
    rows = readers.brand_baskets(spark, sf)
    return flat(itemsets.next_level(rows, itemsets.frequent_items(rows, 20), 2, 20))


@query
def frequent_triples(spark, sf):
    rows = readers.brand_baskets(spark, sf)
    return flat(itemsets.apriori(rows, 20, 3).where(F.size("items") == 3))


@query
def frequent_itemsets_fpgrowth(spark, sf):
    return flat(itemsets.fp_growth(readers.brand_baskets(spark, sf), 20))


@query
def two_phase_pairs(spark, sf):
    return flat(itemsets.two_phase(readers.brand_baskets(spark, sf), 20, most=2))


@query
def two_phase_itemsets(spark, sf):
    return flat(itemsets.two_phase(readers.brand_baskets(spark, sf), 20))


def brand_number():
    return F.regexp_replace("item", "[^0-9]", "").cast("long")


@query
def son_pcy_buckets(spark, sf):
    return itemsets.pair_buckets(readers.brand_baskets(spark, sf), 500, brand_number())


@query
def pcy_pairs(spark, sf):
    return flat(itemsets.pairs_by_buckets(readers.brand_baskets(spark, sf), 20, 500, brand_number()))


# Similarity


def buyers(spark, sf):
    """Suppliers and their customers."""
    return ratings(spark, sf).select(F.col("item_id").alias("item"), F.col("user_id").alias("user"))


@query
def minhash_signatures(spark, sf):
    signed = similarity.signatures(buyers(spark, sf), similarity.coefficients(60))
    return signed.select("item", *(F.col("signature")[i].alias(f"h{i}") for i in range(60)))


@query
def lsh_candidates(spark, sf):
    return similarity.candidates(similarity.signatures(buyers(spark, sf), similarity.coefficients(60)), 30, 2)


@query
def jaccard_exact(spark, sf):
    return similarity.jaccard(buyers(spark, sf), 0.1).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query
def lsh_verified(spark, sf):
    rows = buyers(spark, sf)
    pairs = similarity.candidates(similarity.signatures(rows, similarity.coefficients(60)), 30, 2)
    return similarity.jaccard(rows, 0.1, pairs).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query
def similar_items(spark, sf):
    """60 hashes, 30 bands of 2 rows, pairs of Jaccard 0.5 or more."""
    return similarity.similar_items(buyers(spark, sf)).select("a", "b", F.round("similarity", 6).alias("similarity"))


# Recommenders


@query
def user_item_avgs(spark, sf):
    users, items = recommend.averages(ratings(spark, sf))
    named = lambda df, kind, key, mean: df.select(F.lit(kind).alias("side"), F.col(key).alias("id"), F.round(mean, 6).alias("mean"))
    return named(users, "user", "user_id", "user_mean").unionByName(named(items, "item", "item_id", "item_mean"))


@query
def pearson_pairs(spark, sf):
    return recommend.item_pairs(ratings(spark, sf), 3).select("a", "b", "n", F.round("correlation", 6).alias("correlation"))


def targets(spark, sf, rows=None):
    """Every rated pair, and two that nobody knows."""
    return (ratings(spark, sf) if rows is None else rows).select("user_id", "item_id").unionByName(spark.createDataFrame([(-1, 1), (-1, -1)], "user_id long, item_id long"))


def steady(c, digits):
    """Rounded twice, so that a last bit does not decide a tie."""
    return F.round(F.round(c, 9), digits)


@query
def topn_neighbours(spark, sf):
    rows = stored(ratings(spark, sf))
    near = recommend.neighbours(targets(spark, sf, rows), rows, 3, 3)
    return near.select("user_id", "item_id", "rank", F.round("correlation", 6).alias("correlation"))


@query
def cf_predict(spark, sf):
    rows = stored(ratings(spark, sf))
    return recommend.predict(targets(spark, sf, rows), rows, 3, 8).select("user_id", "item_id", steady("prediction", 5).alias("prediction"), steady("confidence", 5).alias("confidence"))


@query
def cold_start(spark, sf):
    users, items = recommend.averages(ratings(spark, sf))
    rows = targets(spark, sf).join(users, "user_id", "left").join(items, "item_id", "left")
    return rows.select("user_id", "item_id", steady(recommend.fallback(F.lit(None).cast("double"), 2.5), 6).alias("prediction"))


def supplier_profiles(spark, sf):
    means = ratings(spark, sf).groupBy("item_id").agg(F.avg("stars").alias("x"), F.count("*").cast("double").alias("y"))
    tags = table(spark, sf, "lineitem", "l_suppkey", "l_returnflag", "l_linestatus").select(F.col("l_suppkey").alias("item_id"), F.explode(F.array("l_returnflag", "l_linestatus")).alias("t"))
    return means.join(tags.groupBy("item_id").agg(F.collect_set("t").alias("tags")), "item_id")


@query
def blend_similarity(spark, sf):
    pairs = recommend.item_pairs(ratings(spark, sf), 3)
    return recommend.blended(pairs, supplier_profiles(spark, sf)).select("a", "b", F.round("similarity", 5).alias("similarity"))


def means_model(spark, sf, side):
    users, items = recommend.averages(ratings(spark, sf))
    rows = ratings(spark, sf).select("user_id", "item_id")
    return rows.join(users, "user_id").select("user_id", "item_id", F.col("user_mean").alias("prediction")) if side == "user" else rows.join(items, "item_id").select("user_id", "item_id", F.col("item_mean").alias("prediction"))


@query
def hybrid_blend(spark, sf):
    return recommend.hybrid(means_model(spark, sf, "user"), means_model(spark, sf, "item"), 0.1).select("user_id", "item_id", steady("prediction", 6).alias("prediction"))


@query
def vote_blend(spark, sf):
    a, b = means_model(spark, sf, "user"), means_model(spark, sf, "item")
    c = b.withColumn("prediction", F.lit(3.25))
    return recommend.voted(a, b, c).select("user_id", "item_id", steady("prediction", 6).alias("prediction"))


# Features and evaluation


def rating_features(spark, sf):
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("acctbal"))
    counts = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.count("*").alias("orders"), F.avg("o_totalprice").alias("price"))
    items = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("item_id"), F.col("s_acctbal").alias("acctbal"))
    return users.join(counts, "user_id"), items


def people(spark, sf):
    """Customers with what their orders tell, named as users' fields are."""
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(
        F.count("*").alias("review_count"), F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("yelping_since"), F.count_if(F.col("o_orderstatus") == "F").alias("useful"), F.count_if(F.col("o_orderstatus") == "O").alias("funny"),
        F.count_if(F.col("o_orderstatus") == "P").alias("cool"), F.count_if(F.col("o_orderpriority") == "5-LOW").alias("fans"), F.avg("o_totalprice").alias("average_stars"),
        F.count_if(F.substring("o_orderpriority", 1, 1) == "1").alias("compliment_hot"), F.count_if(F.substring("o_orderpriority", 1, 1) == "2").alias("compliment_more"),
    )
    text = F.when(F.col("user_id") % 4 == 0, "None").otherwise(F.repeat(F.lit("x,"), (F.col("user_id") % 3).cast("int")))
    return o.withColumn("friends", F.concat(text, F.when(F.col("user_id") % 4 == 0, "").otherwise("x"))).withColumn("elite", F.lit("2010,2011"))


def rounded(df, columns, digits=6):
    return df.select("user_id", "item_id", *(steady(c, digits).alias(c) for c in columns))


@query
def features_base(spark, sf):
    """Eight columns of every rated pair and two unknown ones."""
    items = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("item_id"), F.col("s_acctbal").alias("stars"), F.col("s_nationkey").alias("review_count"))
    return rounded(features.base_features(targets(spark, sf), people(spark, sf), items), features.BASE)


@query
def features_rich(spark, sf):
    rich = features.user_features(people(spark, sf), "2000-01-01")
    return rich.select("user_id", "review_count", "history", "friends", "elite", "votes", "compliments", F.round("average_stars", 6).alias("average_stars"))


def rich_rows(spark, sf, pairs):
    businesses, checkins, photos = (df.withColumn("business_id", F.col("business_id").cast("long")) for df in places(spark, sf))
    return features.rich_features(pairs, people(spark, sf), businesses, checkins, photos, "2000-01-01")


@query
def features_rich_13(spark, sf):
    """Thirteen columns of every rated pair and two unknown ones."""
    return rounded(rich_rows(spark, sf, targets(spark, sf)), features.RICH)


def places(spark, sf):
    """Suppliers as businesses, summed maps as check-ins, returned lines as photos."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("business_id"), F.col("s_acctbal").alias("stars"), F.col("s_nationkey").alias("review_count"))
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("business_id"), F.from_json("props", "map<string,bigint>").alias("time"))
    once = e.groupBy("business_id").agg(F.sum(scalar.map_sum("time")).alias("t")).select("business_id", F.create_map(F.lit("all"), F.col("t")).alias("time"))
    photos = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").cast("string").alias("business_id"), F.col("l_orderkey").alias("photo_id"))
    return s, once, photos


@query
def item_features(spark, sf):
    return features.item_features(*places(spark, sf))


@query
def cf_feature(spark, sf):
    rows = stored(ratings(spark, sf))
    cf = recommend.predict(targets(spark, sf, rows), rows, 3, 8).select("user_id", "item_id", F.col("prediction").alias("cf"))
    # a row for each target already, so features join it and not the targets once more
    out = features.joined(cf, *rating_features(spark, sf))
    return out.select("user_id", "item_id", steady("u_orders", 4).alias("u_orders"), steady("i_acctbal", 4).alias("i_acctbal"), steady("cf", 5).alias("cf"))


def predicted(spark, sf):
    """Ratings and a prediction: the mean of the user's and the item's averages."""
    users, items = recommend.averages(ratings(spark, sf))
    return ratings(spark, sf).join(users, "user_id").join(items, "item_id").select("user_id", "item_id", "stars", ((F.col("user_mean") + F.col("item_mean")) / 2).alias("prediction"))


@query
def error_histogram(spark, sf):
    return relational.error_histogram(predicted(spark, sf).withColumn("prediction", F.round("prediction", 6)), "stars", "prediction")


@query
def rmse(spark, sf):
    return relational.rmse(predicted(spark, sf), "stars", "prediction").select(F.round("rmse", 5).alias("rmse"), F.round("mse", 5).alias("mse"), "n")


@query
def clip(spark, sf):
    x = (F.col("c_acctbal") / 1000).alias("x")
    return table(spark, sf, "customer").select("c_custkey", F.round(scalar.clipped(x), 6).alias("clipped"), scalar.quantized(x).alias("step"))


# Models: the result depends on the library's own arithmetic


def labelled(spark, sf):
    """Ratings with the thirteen columns."""
    return rich_rows(spark, sf, ratings(spark, sf))


def split(df, percent=10):
    """Training and test rows, by a seeded hash of user and item."""
    keyed = df.withColumn("key", F.concat_ws("-", F.col("user_id").cast("string"), F.col("item_id").cast("string")))
    test = relational.sample_fraction(keyed, "key", percent, 5)
    return keyed.join(test.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti").drop("key"), test.drop("key")


@query
def gbt_predict(spark, sf):
    train, test = split(labelled(spark, sf))
    model = models.boosted_trees(train, features.RICH)
    return models.clipped_predictions(model, test).select("user_id", "item_id", "stars", "prediction")


@query
def cv_grid(spark, sf):
    return models.grid_search(labelled(spark, sf), features.RICH, trees=5)[1]


@query
def als_predict(spark, sf):
    rows = ratings(spark, sf).select(F.col("user_id").cast("int"), F.col("item_id").cast("int"), F.col("stars").cast("float"))
    train, test = split(rows)
    return models.als(train).transform(test).select("user_id", "item_id", F.col("prediction").cast("double"))


@query
def svd_predict(spark, sf):
    rows = ratings(spark, sf).select(F.col("user_id").cast("int"), F.col("item_id").cast("int"), "stars")
    train, test = split(rows)
    return models.predict_biased(models.biased_factors(train), test)


@query
def linear_regress(spark, sf):
    train, test = split(labelled(spark, sf))
    return models.linear(train, features.RICH).transform(test).select("user_id", "item_id", "prediction")


@query
def content_boost(spark, sf):
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    items = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("item_id"))
    boosted = models.content_boosted(ratings(spark, sf), users, items, 10, 3, lambda df: df.withColumn("prediction", F.lit(2.5)))
    return boosted.groupBy("item_id").agg(F.count("*").alias("n"), F.round(F.avg("stars"), 6).alias("mean"))


@query
def knn_regress(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("double").alias("label"), *(F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(64)))
    found = models.knn_regression(e.where("vec_id % 100 = 0"), e, [f"x{i}" for i in range(64)], "label", 5, "vec_id")
    return found.select("vec_id", F.round("prediction", 6).alias("prediction"))


# Graphs: users who share at least 29 active days


def active_days(spark, sf):
    return table(spark, sf, "events").select("user_id", F.to_date("ts").alias("day")).distinct()


def shared_days(spark, sf, least=29):
    return graph.corating(active_days(spark, sf), "user_id", "day", least)


@query
def corating_edges(spark, sf):
    return shared_days(spark, sf)


@query
def connected_components(spark, sf):
    return graph.components(shared_days(spark, sf))


@query
def label_propagation_5(spark, sf):
    return graph.label_propagation(shared_days(spark, sf), 5)


@query
def edge_betweenness(spark, sf):
    return graph.betweenness(shared_days(spark, sf)).select("src", "dst", F.round("betweenness", 6).alias("betweenness"))


@query
def modularity(spark, sf):
    edges = shared_days(spark, sf)
    return graph.modularity(edges, graph.components(edges)).select(F.round("modularity", 6).alias("modularity"))


@query
def girvan_newman(spark, sf):
    found, _ = graph.girvan_newman(shared_days(spark, sf))
    return found


# Sketches over events in their order


def sequence(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("key"))


@query
def bloom_fpr(spark, sf):
    return sketches.bloom(sequence(spark, sf), 1000).select("batch", "n_new", "n_false", F.round("fpr", 6).alias("fpr"), F.round("reported_fpr", 6).alias("reported_fpr"))


@query
def fm_estimate(spark, sf):
    return sketches.distinct_estimate(sequence(spark, sf), 1000)


@query
def exact_distinct(spark, sf):
    return sketches.exact_distinct(sequence(spark, sf), 1000)


@query
def reservoir_hash(spark, sf):
    return sketches.reservoir(sequence(spark, sf), 1000, 20)


@query
def stream_totals(spark, sf):
    return sketches.totals(sketches.distinct_estimate(sequence(spark, sf), 1000)).select("batch", "actual_total", "estimate_total", F.round("ratio", 6).alias("ratio"))


def shared(spark: SparkSession, name: str) -> str:
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        need_local(spark)
        root = tempfile.mkdtemp(prefix="lodestone-stream-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:10]}"


def event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf).select(F.col("event_id").alias("seq"), F.col("user_id").alias("key"))


@query
def streaming_fm_estimate(spark, sf):
    root = shared(spark, "fm")
    sketches.stream_distinct(event_stream(spark, sf), 1000, f"{root}/rows", f"{root}/log")
    return sketches.distinct_estimate(spark.read.parquet(f"{root}/rows"), 1000)


@query
def streaming_bloom_fpr(spark, sf):
    root = shared(spark, "bloom")
    sketches.stream_bloom(event_stream(spark, sf), 1000, f"{root}/rows", f"{root}/log")
    return sketches.bloom_counts(spark, f"{root}/rows").select("batch", "n_new", "n_false", F.round("fpr", 6).alias("fpr"), F.round("reported_fpr", 6).alias("reported_fpr"))


@query
def streaming_reservoir_hash(spark, sf):
    root = shared(spark, "reservoir")
    sketches.stream_reservoir(event_stream(spark, sf), 1000, 20, f"{root}/rows", f"{root}/log")
    return sketches.reservoir_rows(spark, f"{root}/rows")


@query
def streaming_exact_distinct(spark, sf):
    root = shared(spark, "distinct")
    sketches.stream_distinct(event_stream(spark, sf), 1000, f"{root}/rows", f"{root}/log")
    return sketches.exact_distinct(spark.read.parquet(f"{root}/rows"), 1000)


@query
def streaming_key_counts(spark, sf):
    root = shared(spark, "counts")
    sketches.stream_counts(event_stream(spark, sf), f"{root}/rows", f"{root}/log")
    latest = Window.partitionBy("key").orderBy(F.col("epoch").desc())
    return spark.read.parquet(f"{root}/rows").withColumn("r", F.row_number().over(latest)).where("r = 1").select("key", "n", "last")


# Clustering


def points(spark, sf):
    """The vectors as points with a label."""
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("features"))


@query
def cluster_summary(spark, sf):
    rows = clustering.with_shape(clustering.summaries(points(spark, sf), "label"))
    return rows.select("cluster", "n", F.round(F.col("mean")[0], 5).alias("mean0"), F.round(F.col("mean")[63], 5).alias("mean63"), F.round(F.col("std")[0], 5).alias("std0"))


@query
def mahalanobis_assign(spark, sf):
    p = points(spark, sf)
    near = clustering.nearest(p, clustering.summaries(p, "label"), 2 * 64**0.5)
    return near.select("id", "cluster", F.round("distance", 5).alias("distance"))


@query
def cs_merge_pairs(spark, sf):
    s = clustering.summaries(points(spark, sf), "label")
    return clustering.mergeable(s, s, 2 * 64**0.5).select("a", "b", F.round("distance", 5).alias("distance"))


@query
def bfr_states(spark, sf):
    return clustering.fit(points(spark, sf), 10)[0]
