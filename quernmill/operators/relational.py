"""Counts, averages, top rows and partition reports over reviews and businesses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernmill.functions.text import count_words, strip_blank


def category_average(reviews: DataFrame, business: DataFrame, n: int | None = None) -> DataFrame:
    """category, avg_stars of the reviews of the businesses that list it in a comma list; best first, then by name.

    Null lists drop out; a name listed twice counts twice; duplicate rows stay on both sides.
    Reviews are averaged per business before the join, so the shuffle carries one row a business.
    """
    per_business = reviews.groupBy("business_id").agg(F.sum("stars").alias("s"), F.count("stars").alias("k"))
    named = business.where(F.col("categories").isNotNull()).select("business_id", F.explode(F.split("categories", ",")).alias("c")).select("business_id", strip_blank(F.col("c")).alias("category"))
    out = named.join(per_business, "business_id").groupBy("category").agg(F.round(F.sum("s") / F.nullif(F.sum("k"), F.lit(0)), 6).alias("avg_stars"))
    ranked = out.orderBy(F.desc("avg_stars"), "category")
    return ranked.limit(n) if n is not None else ranked


def review_stats(reviews: DataFrame, year: str) -> DataFrame:
    """n_reviews, n_year (year found in the first four signs of date), n_users (null counts as one), in one pass."""
    return reviews.agg(
        F.count(F.lit(1)).alias("n_reviews"),
        F.count_if(F.substring("date", 1, 4).contains(year)).alias("n_year"),
        (F.count_distinct("user_id") + F.max(F.when(F.col("user_id").isNull(), 1).otherwise(0))).alias("n_users"),
    )


def top_keys(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n most frequent values of a column and their counts; ties by value."""
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(n)


def top_words(reviews: DataFrame, stop_words: DataFrame, n: int) -> DataFrame:
    """The n most frequent words outside the stop list (and the empty word); ties by word."""
    counted = reviews.where(F.col("text").isNotNull()).select(F.explode(count_words(F.col("text"))).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))
    return counted.join(stop_words.select("word"), "word", "left_anti").orderBy(F.desc("n"), "word").limit(n)


def keys_over(df: DataFrame, key: str, n: int) -> DataFrame:
    """Values that occur in more than n rows, with their counts."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > n)


def partition_report(df: DataFrame, key: str, n_partitions: int | None = None) -> DataFrame:
    """partition, n_items of each partition, empty ones included; by default as read, else hashed on `key` into n_partitions."""
    parts = df.repartition(n_partitions, key) if n_partitions else df
    sizes = parts.groupBy(F.spark_partition_id().alias("partition")).agg(F.count("*").alias("n_items"))
    every = df.sparkSession.range(parts.rdd.getNumPartitions()).select(F.col("id").cast("int").alias("partition"))
    return every.join(sizes, "partition", "left").withColumn("n_items", F.coalesce("n_items", F.lit(0)).cast("bigint"))


def keys_in(df: DataFrame, other: DataFrame, key: str, condition: Column, columns: list[str]) -> DataFrame:
    """Columns of the rows of df for every row of `other` with the key that meets the condition; duplicates stay."""
    return df.join(other.where(condition).select(key), key).select(*columns)
