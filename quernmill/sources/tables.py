"""Logical tables over the parquet folder: schemas, readers, and the cleaned relations queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernmill.session import cut

_BITS, _BUCKETS = 32_768, 4_096  # of a bitmap; at most 16 MB in all

SCHEMAS = {
    "review": "review_id string, user_id string, business_id string, stars double, date string, text string, ingested_at timestamp_ntz",
    "business": "business_id string, categories string, state string, city string",
    "user_data": "user_id string, user_review_count bigint, user_avg_stars double, home_state string, since_month string",
    "biz_data": "business_id string, biz_review_count bigint, biz_avg_stars double",
    "test_pairs": "user_id string, business_id string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint, business_id string, posted_at timestamp_ntz",
    "mix_targets": "source string, target_weight double, max_repeats int",
    "stop_words": "word string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table of the folder; columns are pruned and filters pushed by the reader."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def distinct_reviews(review: DataFrame, *columns: str) -> DataFrame:
    """One row per review_id with the named columns; repeated deliveries agree in them.

    Where text is asked for, only rows that may be repeated are shuffled: a bitmap of the hashes
    of repeated ids, built from the ids alone, splits the rows. Its size is bounded (at most
    `_BUCKETS` bitmaps of 4 kB); ids that share a bit with a repeated one are shuffled too, so
    with very many repeats more rows take that way, and none is lost. Partial
    aggregation drops repeats before the shuffle, so one review_id delivered very often
    doesn't gather in one task. Rows without review_id are no reviews.
    """
    kept = [c for c in columns if c != "review_id"]
    rows = review.select("review_id", *kept).where(F.col("review_id").isNotNull())
    # few partitions hold little, and the shuffle spreads them over the cores
    if "text" not in kept or rows.rdd.getNumPartitions() < review.sparkSession.sparkContext.defaultParallelism:
        return rows.dropDuplicates(["review_id"])
    repeated = cut(rows.groupBy("review_id").agg(F.count("*").alias("n")).where(F.col("n") > 1).select(F.xxhash64("review_id").alias("h")))
    wanted = repeated.count()
    if not wanted:
        return rows
    buckets = max(1, min(_BUCKETS, wanted * 16 // _BITS))
    # a plain bitmap of the low bits; its buckets are numbered from 1
    place = lambda h: F.pmod(h, F.lit(buckets * _BITS))
    bits = repeated.groupBy((F.floor(place(F.col("h")) / _BITS)).alias("__bucket")).agg(F.bitmap_construct_agg(F.pmod(place(F.col("h")), F.lit(_BITS))).alias("__bits"))
    at = F.pmod(place(F.xxhash64("review_id")), F.lit(_BITS)).cast("int")
    byte = F.ascii(F.decode(F.substring("__bits", F.shiftright(at, 3) + 1, F.lit(1)), "ISO-8859-1"))
    marked = rows.withColumn("__bucket", F.floor(place(F.xxhash64("review_id")) / _BITS)).join(F.broadcast(bits), "__bucket", "left")
    marked = marked.withColumn("__maybe", F.coalesce(F.getbit(byte, at.bitwiseAND(7)) == 1, F.lit(False)))
    once, maybe = (marked.where(c).select("review_id", *kept) for c in (~F.col("__maybe"), F.col("__maybe")))
    return once.unionByName(maybe.dropDuplicates(["review_id"]))


def valid_stars(column: str = "stars"):
    """True for a number from 1 to 5; null, NaN and infinities are none."""
    c = F.col(column)
    return c.isNotNull() & ~F.isnan(c) & c.between(1.0, 5.0)


def ratings(review: DataFrame) -> DataFrame:
    """user_id, business_id, stars of each review with a valid star value and both keys."""
    return distinct_reviews(review, "user_id", "business_id", "stars").where(valid_stars() & F.col("user_id").isNotNull() & F.col("business_id").isNotNull()).select("user_id", "business_id", "stars")
