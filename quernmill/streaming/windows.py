"""Streaming forms of the window counts, the sample and the tag report."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from quernmill.functions.hashing import DISTINCT_PRIME, string_mod
from quernmill.operators.sketches import distinct_aggregates, distinct_estimate, reservoir, top_count_ranks
from quernmill.session import remove, shared_dir


def socket_lines(spark: SparkSession, port: int, host: str = "localhost") -> DataFrame:
    """A socket text stream with its arrival time: value, timestamp."""
    return spark.readStream.format("socket").option("host", host).option("port", port).option("includeTimestamp", True).load()


def json_stream(spark: SparkSession, path: str, schema: str, files_at_once: int = 1) -> DataFrame:
    """A stream of the JSON-lines files of a folder, typed."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).json(path)


def parquet_stream(spark: SparkSession, path: str, schema, files_at_once: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def tracked(stream: DataFrame, column: str, words: list[str]) -> DataFrame:
    """The rows whose text holds any of the words, in any letter case."""
    return stream.where(F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(F.lower(column), w)))


def window_distinct(df: DataFrame, ts: str, value: str, length: str = "30 seconds", slide: str = "10 seconds", late: str | None = None, compat: bool = False) -> DataFrame:
    """window_start, window_end, truth, estimate of the distinct values in each sliding window.

    For a batch and, with the lateness given, for a stream. Null and empty values don't count;
    a window without values has no row. A batch drops a window's repeated values first and
    then counts them, so no set of values is ever gathered. A stream's exact count keeps a set
    of values a window in its state; use `window_estimate` where that is too large.
    """
    if not df.isStreaming:
        rows = df.select(F.window(F.col(ts).cast("timestamp"), length, slide).alias("w"), F.col(value).cast("string").alias("__v")).where((F.col("__v") != "") & F.col("w").isNotNull()).distinct()
        grouped = rows.withColumn("__x", string_mod(F.col("__v"), DISTINCT_PRIME)).groupBy("w").agg(F.count("*").alias("truth"), *distinct_aggregates(F.col("__x")))
        return grouped.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), F.col("truth").cast("int").alias("truth"), F.round(distinct_estimate(compat), 6).alias("estimate"))
    rows = _windowed(df, ts, value, late)
    grouped = rows.groupBy(F.window("__ts", length, slide).alias("w")).agg(F.size(F.collect_set("__v")).alias("truth"), *distinct_aggregates(F.col("__x")))
    return grouped.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "truth", F.round(distinct_estimate(compat), 6).alias("estimate"))


def window_estimate(df: DataFrame, ts: str, value: str, length: str = "30 seconds", slide: str = "10 seconds", late: str | None = None) -> DataFrame:
    """The same without the exact count: state of fixed size a window; approx is the built-in sketch."""
    rows = _windowed(df, ts, value, late)
    grouped = rows.groupBy(F.window("__ts", length, slide).alias("w")).agg(F.approx_count_distinct("__v").alias("approx"), *distinct_aggregates(F.col("__x")))
    return grouped.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "approx", F.round(distinct_estimate(), 6).alias("estimate"))


def _windowed(df: DataFrame, ts: str, value: str, late: str | None) -> DataFrame:
    rows = df.select(F.col(ts).cast("timestamp").alias("__ts"), F.col(value).cast("string").alias("__v")).where(F.col("__v") != "")
    rows = rows.withColumn("__x", string_mod(F.col("__v"), DISTINCT_PRIME))
    return rows.withWatermark("__ts", late) if late else rows


def reservoir_stream(stream: DataFrame, order: str, size: int, keep: Callable[[DataFrame, int], None], checkpoint: str | None = None) -> StreamingQuery:
    """Keeps the `size` rows with the least hashes over all micro-batches and hands the sample to `keep` after each.

    The sample is merged from the written one and the batch, and a repeated batch gives the
    same sample, so a restart with the same `checkpoint` is safe; without one each stream has a
    folder of its own. The sample of the epoch before the last is removed.
    """
    spark = stream.sparkSession
    home = checkpoint or f"{shared_dir(spark)}/reservoir-{uuid.uuid4().hex}"

    def merge(batch: DataFrame, epoch: int) -> None:
        path = lambda e: f"{home}/sample/{e}"
        both = batch if epoch == 0 else batch.unionByName(spark.read.schema(batch.schema).parquet(path(epoch - 1)))
        reservoir(both, order, size).write.mode("overwrite").parquet(path(epoch))
        keep(spark.read.schema(batch.schema).parquet(path(epoch)), epoch)
        if epoch > 1:
            remove(spark, path(epoch - 2))

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{home}/offsets").trigger(availableNow=True).start()


def tag_report(sample: DataFrame, tag: str, ranks: int = 3) -> DataFrame:
    """tag, n of the sample's tags with one of the largest counts."""
    return top_count_ranks(sample, tag, ranks)


def per_window(stream: DataFrame, action: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Hands the windows that each micro-batch finished (append) or changed (update) to `action`."""
    return stream.writeStream.outputMode(mode).foreachBatch(action).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class FailureLog(StreamingQueryListener):
    """Collects the errors of ended queries."""

    def __init__(self) -> None:
        self.errors: list[str] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self.errors.append(event.exception)
