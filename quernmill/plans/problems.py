"""Queries of the core problems: packed fields (p1) and missing values (p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernmill.operators.impute import chained_impute, usable
from quernmill.operators.packed import split_packed
from quernmill.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """business_id, pos, category of each name packed in business.categories; repeated deliveries count once."""
    business = table(spark, folder, "business").where(F.col("business_id").isNotNull())
    return split_packed(business, "categories", ["business_id"], value="category").distinct()


def _month_number(column: str):
    """Months since year 0 of a yyyy-MM string; null for anything else."""
    return F.when(F.col(column).rlike(r"^\d{4}-(0[1-9]|1[0-2])$"), F.substring(column, 1, 4).cast("double") * 12 + F.substring(column, 6, 2).cast("double"))


def _hidden(df: DataFrame, key: str, column: str, share: int | None) -> DataFrame:
    """df with `truth`: the values of `column` taken away from one in `share` of the keys, by hash."""
    if share is None:
        return df.withColumn("truth", F.lit(None).cast("double"))
    taken = (F.pmod(F.xxhash64(key, F.lit("hidden")), F.lit(share)) == 0) & usable(column, 1.0, 5.0)
    return df.withColumns({"truth": F.when(taken, F.col(column)), column: F.when(~taken, F.col(column))})


def filled_users(spark: SparkSession, folder: str, hide: int | None = None) -> DataFrame:
    """user_data, one row a user, with average, state and month complete (month as a number, since), and what `_hidden` took away."""
    users = table(spark, folder, "user_data").where(F.col("user_id").isNotNull()).dropDuplicates(["user_id"])
    users = _hidden(users, "user_id", "user_avg_stars", hide)
    users = users.withColumns({"since": _month_number("since_month"), "weight": F.log1p(F.greatest("user_review_count", F.lit(0)))})
    return chained_impute(users, "user_id", numeric={"user_avg_stars": (1.0, 5.0), "since": (0.0, 120_000.0)}, categorical=["home_state"], predictors=["weight"], expected=hide is not None)


def filled_businesses(spark: SparkSession, folder: str, hide: int | None = None) -> DataFrame:
    """biz_data, one row a business, with average and state complete; the other businesses of its categories count, too."""
    records = table(spark, folder, "biz_data").where(F.col("business_id").isNotNull()).dropDuplicates(["business_id"])
    records = _hidden(records, "business_id", "biz_avg_stars", hide)
    business = table(spark, folder, "business").where(F.col("business_id").isNotNull())
    place = business.groupBy("business_id").agg(F.max("state").alias("state"))
    names = split_packed(business, "categories", ["business_id"], value="category").select("business_id", "category").distinct()
    valid = usable("biz_avg_stars", 1.0, 5.0)
    rated = names.join(records.select("business_id", F.when(valid, F.col("biz_avg_stars")).alias("stars")), "business_id")
    per_category = rated.groupBy("category").agg(F.sum("stars").alias("s"), F.count("stars").alias("k"))
    # mean over a business's categories of what their other businesses have
    own = F.when(F.col("stars").isNotNull(), 1).otherwise(0)
    others = F.when(F.col("k") > own, (F.col("s") - F.coalesce("stars", F.lit(0.0))) / (F.col("k") - own))
    like = rated.join(per_category, "category").groupBy("business_id").agg(F.avg(others).alias("category_stars"))
    joined = records.join(place, "business_id", "left").join(like, "business_id", "left").withColumn("weight", F.log1p(F.greatest("biz_review_count", F.lit(0))))
    return chained_impute(joined, "business_id", numeric={"biz_avg_stars": (1.0, 5.0)}, categorical=["state"], predictors=["category_stars", "weight"], expected=hide is not None)


def p5_filled(spark: SparkSession, folder: str) -> DataFrame:
    """record_kind, record_id, avg_stars, filled for every record of user_data and biz_data."""
    users = filled_users(spark, folder).select(F.lit("user").alias("record_kind"), F.col("user_id").alias("record_id"), F.col("user_avg_stars").alias("avg_stars"), F.col("user_avg_stars_filled").alias("filled"))
    biz = filled_businesses(spark, folder).select(F.lit("biz").alias("record_kind"), F.col("business_id").alias("record_id"), F.col("biz_avg_stars").alias("avg_stars"), F.col("biz_avg_stars_filled").alias("filled"))
    return users.unionByName(biz)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """record_kind, record_id of the records whose average was missing and has been drawn."""
    return p5_filled(spark, folder).where("filled AND avg_stars BETWEEN 1 AND 5").select("record_kind", "record_id")


def p5_quality(spark: SparkSession, folder: str) -> DataFrame:
    """How well the chain fills averages that are known but were hidden from it, a fifth of them by hash.

    record_kind, n_hidden, error_mean and error_fit (root mean square error of the mean of the
    other known averages, and of the fit before its draw), spread_true and spread_drawn
    (standard deviations), correlation of draws and truth.
    """

    def judged(kind: str, filled: DataFrame, column: str) -> DataFrame:
        known = filled.where(~F.col(f"{column}_filled")).agg(F.avg(column)).head()[0]
        hidden = filled.where("truth IS NOT NULL")
        error = lambda guess: F.round(F.sqrt(F.avg((guess - F.col("truth")) * (guess - F.col("truth")))), 6)
        return hidden.agg(
            F.lit(kind).alias("record_kind"), F.count("*").alias("n_hidden"), error(F.lit(known)).alias("error_mean"), error(F.col(f"{column}_expected")).alias("error_fit"),
            F.round(F.stddev("truth"), 6).alias("spread_true"), F.round(F.stddev(column), 6).alias("spread_drawn"), F.round(F.corr(column, "truth"), 6).alias("correlation"),
        )

    return judged("user", filled_users(spark, folder, 5), "user_avg_stars").unionByName(judged("biz", filled_businesses(spark, folder, 5), "biz_avg_stars"))


QUERIES = {"p1_found": p1_found, "p5_found": p5_found, "p5_filled": p5_filled, "p5_quality": p5_quality}
ORACLE = {
    "p5_found": """
SELECT DISTINCT 'user' AS record_kind, user_id AS record_id FROM user_data
WHERE user_id IS NOT NULL AND NOT coalesce(user_avg_stars BETWEEN 1 AND 5, false)
UNION ALL SELECT DISTINCT 'biz', business_id FROM biz_data
WHERE business_id IS NOT NULL AND NOT coalesce(biz_avg_stars BETWEEN 1 AND 5, false)""",
}
