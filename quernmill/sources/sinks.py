"""Writers: JSON objects and lines, CSV, and the line reports of item-sets, communities, edges and bits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_json_lines(df: DataFrame, path: str, names: dict[str, str] | None = None) -> None:
    df.withColumnsRenamed(names or {}).write.mode("overwrite").json(path)


def write_json_object(df: DataFrame, path: str) -> None:
    """The one row of a report as a JSON object in one file."""
    df.limit(1).select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def quoted(items: Column, always_tuple: bool = True) -> Column:
    """('a', 'b') of an array of strings; ('a') of a single one."""
    inner = F.array_join(F.transform(items, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", ")
    return F.concat(F.lit("("), inner, F.lit(")")) if always_tuple else inner


def itemset_report(candidates: DataFrame, frequent: DataFrame) -> DataFrame:
    """value lines: 'Candidates:', a line a size, an empty line, 'Frequent Itemsets:', a line a size; sets in order."""
    spark = frequent.sparkSession

    def block(sets: DataFrame, at: int) -> DataFrame:
        lines = sets.groupBy("k").agg(F.array_join(F.transform(F.sort_array(F.collect_list("items")), lambda x: quoted(x)), ",").alias("value"))
        return lines.select(F.lit(at).alias("part"), F.col("k").cast("int").alias("k"), "value")

    titles = spark.createDataFrame([(0, 0, "Candidates:"), (1, 1 << 30, ""), (2, 0, "Frequent Itemsets:")], "part int, k int, value string")
    return titles.unionByName(block(candidates, 0)).unionByName(block(frequent, 2)).orderBy("part", "k").select("value")


def community_lines(communities: DataFrame) -> DataFrame:
    """value lines of quoted members, by size and first member."""
    return communities.orderBy("size", F.col("members")[0]).select(quoted(F.col("members"), False).alias("value"))


def edge_lines(edges: DataFrame) -> DataFrame:
    """value lines ('u', 'v'),betweenness, largest first, then by endpoints."""
    return edges.orderBy(F.desc("betweenness"), "src", "dst").select(F.format_string("('%s', '%s'),%s", "src", "dst", F.col("betweenness").cast("string")).alias("value"))


def bit_line(probed: DataFrame, order: str) -> DataFrame:
    """One value line of the hits, blank-separated, in order."""
    return probed.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "hit"))), lambda x: x["hit"].cast("string")), " ").alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    """Ordered lines, in one file: reports, not data."""
    lines.coalesce(1).write.mode("overwrite").text(path)


WINDOW_HEADER = "Time,Gound Truth,Estimation"  # fixed value, spelt as the report has it


def window_lines(windows: DataFrame) -> DataFrame:
    """value lines end of window, truth, estimate, by time."""
    return windows.orderBy("window_end").select(F.concat_ws(",", F.date_format("window_end", "yyyy-MM-dd HH:mm:ss"), F.col("truth").cast("string"), F.col("estimate").cast("string")).alias("value"))


def append_window_csv(path: str):
    """An action for `streaming.windows.per_window`: writes each batch's windows as CSV with a header, in a folder an epoch, so a repeated batch replaces itself."""

    def write(batch: DataFrame, epoch: int) -> None:
        head = batch.sparkSession.createDataFrame([(0, WINDOW_HEADER)], "at int, value string")
        lines = window_lines(batch).select(F.lit(1).alias("at"), "value")
        write_lines(head.unionByName(lines).orderBy("at", "value").select("value"), f"{path}/{epoch:08}")

    return write


def write_profile_model(profile: DataFrame, users: DataFrame, path: str) -> None:
    """The two maps of a term profile, documents and users to words, as JSON lines key, word."""
    write_json_lines(profile.select(F.col("doc").alias("key"), "word"), f"{path}/documents")
    write_json_lines(users.select(F.col("user").alias("key"), "word"), f"{path}/users")


def append_batches(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Starts a query that appends each finished window or event as JSON lines."""
    return stream.writeStream.outputMode(mode).format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
