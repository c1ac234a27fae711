"""Rating prediction: item and user neighbourhoods, fallbacks, features and the blended model."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pair_ratings(ratings: DataFrame) -> DataFrame:
    """user_id, business_id, stars: the mean rating of each pair."""
    return ratings.groupBy("user_id", "business_id").agg(F.avg("stars").alias("stars"))


def both_ways(model: DataFrame, sim: str = "sim") -> DataFrame:
    """A symmetric lookup of a model of unordered pairs: x, y, sim."""
    return model.select(F.col("a").alias("x"), F.col("b").alias("y"), F.col(sim).alias("sim")).unionByName(model.select(F.col("b").alias("x"), F.col("a").alias("y"), F.col(sim).alias("sim")))


def _wanted(test: DataFrame) -> DataFrame:
    return test.select("user_id", "business_id").where(F.col("user_id").isNotNull() & F.col("business_id").isNotNull()).distinct()


def item_predictions(rated: DataFrame, model: DataFrame, test: DataFrame, neighbours: int = 5) -> DataFrame:
    """user_id, business_id, stars: mean of the user's ratings of the most similar items, weighted by similarity.

    No neighbour, no row. Ties in similarity by item.
    """
    pairs = both_ways(model).withColumnsRenamed({"x": "business_id", "y": "other"})
    near = _wanted(test).join(rated.select("user_id", F.col("business_id").alias("other"), "stars"), "user_id").join(pairs, ["business_id", "other"])
    rank = F.row_number().over(Window.partitionBy("user_id", "business_id").orderBy(F.desc("sim"), "other"))
    top = near.withColumn("rank", rank).where(F.col("rank") <= neighbours)
    return top.groupBy("user_id", "business_id").agg(F.round(F.sum(F.col("sim") * F.col("stars")) / F.sum("sim"), 6).alias("stars"))


def user_predictions(ratings: DataFrame, rated: DataFrame, model: DataFrame, test: DataFrame, sim: str = "sim") -> DataFrame:
    """user_id, business_id, stars: the user's mean plus the weighted deviations of all similar users who rated the item.

    The deviation of a neighbour is from the mean of the neighbour's other raw ratings (its own
    mean where there is none other). No neighbours, no row; a result above 5 gives no row.
    """
    totals = ratings.groupBy("user_id").agg(F.sum("stars").alias("s"), F.count("*").alias("c"))
    pairs = both_ways(model, sim).withColumnsRenamed({"x": "user_id", "y": "other"})
    # similar users first: a wanted item that a tenth of all users rated would meet them all
    near = _wanted(test).join(pairs, "user_id").join(rated.select(F.col("user_id").alias("other"), "business_id", F.col("stars").alias("r")), ["business_id", "other"])
    near = near.join(totals.select(F.col("user_id").alias("other"), "s", "c"), "other")
    rest = F.when(F.col("c") > 1, (F.col("s") - F.col("r")) / F.nullif(F.col("c") - 1, F.lit(0))).otherwise(F.col("s"))
    moved = near.groupBy("user_id", "business_id").agg((F.sum((F.col("r") - rest) * F.col("sim")) / F.sum("sim")).alias("move"))
    out = moved.join(totals, "user_id").select("user_id", "business_id", F.round(F.col("s") / F.col("c") + F.col("move"), 6).alias("stars"))
    return out.where(F.col("stars") <= 5)


def rating_features(ratings: DataFrame) -> DataFrame:
    """Each rating with the counts and means of its user and business."""
    users = ratings.groupBy("user_id").agg(F.count("*").alias("user_review_count"), F.round(F.avg("stars"), 6).alias("user_avg_stars"))
    items = ratings.groupBy("business_id").agg(F.count("*").alias("biz_review_count"), F.round(F.avg("stars"), 6).alias("biz_avg_stars"))
    return ratings.join(users, "user_id").join(items, "business_id")


def with_fallback(rated: DataFrame, predictions: DataFrame, test: DataFrame) -> DataFrame:
    """user_id, business_id, stars for every wanted pair with a known user or business.

    The prediction, else the user's mean, else (unknown user) the business's mean, else the
    mean of the business means.
    """
    users = rated.groupBy("user_id").agg(F.avg("stars").alias("u"))
    items = rated.groupBy("business_id").agg(F.avg("stars").alias("i"))
    overall = items.agg(F.avg("i")).head()[0]
    joined = _wanted(test).join(predictions.select("user_id", "business_id", F.col("stars").alias("p")), ["user_id", "business_id"], "left").join(users, "user_id", "left").join(items, "business_id", "left")
    return joined.select("user_id", "business_id", F.round(F.coalesce("p", "u", "i", F.lit(overall)), 6).alias("stars"))


def test_features(test: DataFrame, user_data: DataFrame, biz_data: DataFrame) -> DataFrame:
    """The wanted pairs with the four features; missing ones get the mean over the wanted pairs."""
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")) & F.col(c).cast("double").between(1.0, 5.0), F.col(c).cast("double"))
    users = user_data.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(F.max(F.col("user_review_count").cast("double")).alias("user_review_count"), F.max(number("user_avg_stars")).alias("user_avg_stars"))
    items = biz_data.where(F.col("business_id").isNotNull()).groupBy("business_id").agg(F.max(F.col("biz_review_count").cast("double")).alias("biz_review_count"), F.max(number("biz_avg_stars")).alias("biz_avg_stars"))
    joined = _wanted(test).join(users, "user_id", "left").join(items, "business_id", "left")
    names = ["user_review_count", "user_avg_stars", "biz_review_count", "biz_avg_stars"]
    means = joined.agg(*[F.avg(c).alias(f"__{c}") for c in names])
    # one row against the wanted pairs: the means as literals, no join
    row = means.head()
    return joined.select("user_id", "business_id", *[F.round(F.coalesce(F.col(c), F.lit(row[f"__{c}"]).cast("double")), 6).alias(c) for c in names])


def blended_predictions(ratings: DataFrame, fallback: DataFrame, features: DataFrame, *, weight: float = 0.2, seed: int = 7) -> DataFrame:
    """user_id, business_id, stars: weight * neighbourhood + (1 - weight) * 100 boosted trees over the four features, blended by `blend`."""
    names = ["user_review_count", "user_avg_stars", "biz_review_count", "biz_avg_stars"]
    vector = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="skip")
    model = GBTRegressor(labelCol="stars", maxIter=100, maxDepth=6, seed=seed).fit(vector.transform(rating_features(ratings)))
    tree = model.transform(vector.transform(features)).select("user_id", "business_id", "prediction")
    return blend(fallback, tree, weight).select("user_id", "business_id", F.round("stars", 4).alias("stars"))


def blend(fallback: DataFrame, tree: DataFrame, weight: float = 0.2) -> DataFrame:
    """user_id, business_id, stars for each row of `tree` (.., prediction): weight * neighbourhood stars + (1 - weight) * prediction.

    A right join on the pair. Pairs that `fallback` repeats count once, with their mean, so they
    don't multiply the rows; a pair it lacks has the tree's prediction alone.
    """
    near = fallback.groupBy("user_id", "business_id").agg(F.avg("stars").alias("near"))
    mixed = F.coalesce(weight * F.col("near") + (1 - weight) * F.col("prediction"), "prediction")
    return near.join(tree, ["user_id", "business_id"], "right").select("user_id", "business_id", mixed.alias("stars"))
