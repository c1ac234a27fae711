"""Dense integer codes for distinct values, without a global sort or window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernmill.session import cut

_BITS = 33  # monotonically_increasing_id keeps the row's place in its partition in the low 33 bits


def dense_codes(distinct: DataFrame, code: str = "code") -> DataFrame:
    """The rows of `distinct` with a bigint `code` from 0 without gaps.

    The rows are written once with their partition and place; only one count per written
    partition goes to the driver. The codes are in the order of the rows, so they carry a
    meaning only where `distinct` is sorted.
    """
    placed = cut(distinct.withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", _BITS)
    sizes = sorted((r[0], r[1]) for r in placed.groupBy(part.alias("p")).count().collect())
    starts, total = [], 0
    for p, n in sizes:
        starts.append((p, total))
        total += n
    offsets = distinct.sparkSession.createDataFrame(starts, "__p bigint, __start bigint")
    return placed.join(F.broadcast(offsets), part == F.col("__p")).withColumn(code, F.col("__start") + F.col("__at").bitwiseAND((1 << _BITS) - 1)).drop("__at", "__p", "__start")


def ordered_codes(distinct: DataFrame, column: str, code: str = "code") -> DataFrame:
    """`column` and its rank from 0 among the distinct values, by a range-partitioned sort.

    The same numbers as dense_rank() - 1 over all rows, without gathering them in one task.
    """
    spread = distinct.select(F.col(column)).repartitionByRange(F.col(column)).sortWithinPartitions(column)
    placed = cut(spread.withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", _BITS)
    total, starts = 0, []
    for p, n in sorted((r[0], r[1]) for r in placed.groupBy(part.alias("p")).count().collect()):
        starts.append((p, total))
        total += n
    offsets = distinct.sparkSession.createDataFrame(starts, "__p bigint, __start bigint")
    return placed.join(F.broadcast(offsets), part == F.col("__p")).select(column, (F.col("__start") + F.col("__at").bitwiseAND((1 << _BITS) - 1)).alias(code))
