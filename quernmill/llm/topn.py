"""The N best rows of every group, by descending score bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernmill.operators.names import fresh
from quernmill.session import cut


def top_n(df: DataFrame, groups: list[str], score: str, n: int, *, ties: list[Column], shares: tuple[float, ...] = (0.05, 0.2, 0.5)) -> DataFrame:
    """The first `n` rows of each group by `score` descending, then `ties`; with their `rank` from 1.

    Bands of the score, cut at the upper `shares` of its distribution, are processed from the
    top. A band drops the groups that earlier bands filled (anti join) and keeps the n best of
    each other group; only the band in which a group fills up matters for its tie order, and
    there the rank is exact. Within a band Spark ranks before the shuffle as well
    (WindowGroupLimit), so a group of millions of rows sends at most n rows a task.

    Null and NaN scores rank after all others (NaN before null). Rows with a null group form
    no group and drop out. Rows equal in score and ties are ranked in any order among
    themselves; the result is the same where they are alike in all columns. Where df has a
    column `rank`, the new one gets underscores appended. An empty table gives no rows.
    """
    rank = fresh("rank", df.columns)
    known = F.col(f"`{score}`").isNotNull() & ~F.isnan(F.col(f"`{score}`").cast("double"))
    rows = cut(df.where(F.forall(F.array(*[F.col(f"`{g}`").isNotNull() for g in groups]), lambda x: x)))
    value = F.col(f"`{score}`").cast("double")
    edges = rows.where(known).select(value.alias("__s")).approxQuantile("__s", [1 - s for s in shares], 0.01)
    order = [F.when(known, 0).when(F.col(f"`{score}`").isNotNull(), 1).otherwise(2), F.col(f"`{score}`").desc(), *ties]
    window = Window.partitionBy(*[F.col(f"`{g}`") for g in groups]).orderBy(*order)

    def best(part: DataFrame) -> DataFrame:
        return part.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)

    found: DataFrame | None = None
    upper: float | None = None
    for lower in [*sorted(set(edges), reverse=True), None]:
        inside = F.lit(True) if upper is None else ~known | (value < upper)
        if lower is not None:
            inside = inside & known & (value >= lower)
        band = rows.where(inside)
        if found is not None:
            full = found.groupBy(*[F.col(f"`{g}`").alias(f"g{i}") for i, g in enumerate(groups)]).agg(F.count("*").alias("k")).where(F.col("k") >= n).alias("full")
            band = band.alias("band").join(full, [F.col(f"band.`{g}`") == F.col(f"full.g{i}") for i, g in enumerate(groups)], "left_anti")
        part = best(band).drop(rank)
        found = cut(part if found is None else found.unionByName(part))
        upper = lower
    return best(found)
