"""Readers: typed JSON lines, CSV with and without header, text lines, models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernmill.sources.tables import SCHEMAS

ITEM_MODEL = "b1 string, b2 string, sim double"
USER_MODEL = "u1 string, u2 string, sim double"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """value: one row a line."""
    return spark.read.text(path)


def read_json(spark: SparkSession, path: str, table: str | None = None, schema: str | None = None) -> DataFrame:
    """JSON lines under an explicit schema, of a known table or given; absent fields are null, broken lines all null."""
    return spark.read.schema(schema or SCHEMAS[table]).json(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header line; quotes are honoured, and a data line equal to the header stays."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """round, id, features of header-less numeric CSV files under a folder, one round a file in order of path.

    Files of any width; lines whose id is no number drop out.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.split("value", ",").alias("v"))
    # one row a file
    order = lines.select("file").distinct().withColumn("round", F.dense_rank().over(Window.orderBy("file")))
    cells = F.transform(F.slice("v", 2, F.greatest(F.size("v") - 1, F.lit(0))), lambda x: x.try_cast("double"))
    return lines.join(order, "file").select("round", F.col("v")[0].try_cast("double").cast("bigint").alias("id"), cells.alias("features")).where(F.col("id").isNotNull())


def read_item_model(spark: SparkSession, path: str) -> DataFrame:
    """a, b, sim of a written item model."""
    return spark.read.schema(ITEM_MODEL).json(path).select(F.col("b1").alias("a"), F.col("b2").alias("b"), "sim")


def read_profile_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(doc, word), (user, word) of a written profile model."""
    maps = [spark.read.schema("key string, word string").json(f"{path}/{part}") for part in ("documents", "users")]
    return maps[0].withColumnRenamed("key", "doc"), maps[1].withColumnRenamed("key", "user")


def read_user_model(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(USER_MODEL).json(path).select(F.col("u1").alias("a"), F.col("u2").alias("b"), "sim")
