"""Sketches: Bloom filter, distinct counts by trailing zeros, and a reproducible sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernmill.functions.hashing import DISTINCT_PARAMETERS, DISTINCT_PRIME, string_mod, trailing_zeros, universal

BLOOM_PARAMETERS = [(37, 101), (53, 117), (71, 149), (83, 163), (97, 191)]


def bloom_size(n_distinct: int, n_hashes: int = 5) -> int:
    """floor(hashes * members / ln 2) bits, at least 1."""
    return max(1, int(n_hashes * n_distinct / 0.6931471805599453))


def _positions(c: Column, n: int) -> Column:
    x = string_mod(c, n)
    return F.array(*[universal(x, a, b, n) for a, b in BLOOM_PARAMETERS])


def bloom_bits(members: DataFrame, column: str, n: int) -> DataFrame:
    """position: the set bits of the filter; null and empty members don't count."""
    return members.where(F.col(column) != "").select(column).distinct().select(F.explode(_positions(F.col(column), n)).alias("position")).distinct()


def bloom_probe(probes: DataFrame, column: str, bits: DataFrame, n: int) -> DataFrame:
    """The probes with `hit` 1 where all positions are set, else 0; null and empty ones are 0.

    Distinct values are probed, by an equi-join with the bits, and joined back; the filter may
    be larger than any task.
    """
    values = probes.where(F.col(column) != "").select(column).distinct()
    spread = values.select(column, F.explode(F.array_distinct(_positions(F.col(column), n))).alias("position"))
    found = spread.join(bits, "position", "left_semi").groupBy(column).agg(F.count("*").alias("k"))
    wanted = values.select(column, F.size(F.array_distinct(_positions(F.col(column), n))).alias("w"))
    hits = wanted.join(found, column).where(F.col("k") == F.col("w")).select(column, F.lit(1).alias("__hit"))
    return probes.join(hits, column, "left").withColumn("hit", F.coalesce("__hit", F.lit(0))).drop("__hit")


def distinct_aggregates(x: Column) -> list[Column]:
    """Largest number of trailing zeros under each hash, one plain aggregate each: usable in batch and on streams."""
    return [F.max(trailing_zeros(universal(x, a, b, DISTINCT_PRIME))).alias(f"r{k}") for k, (a, b) in enumerate(DISTINCT_PARAMETERS)]


def distinct_estimate(compat: bool = False) -> Column:
    """Estimate from r0..r49: 2 ** r, neighbours averaged in pairs, the median of the pairs (compat: mean of elements 11 and 12)."""
    pairs = [(F.pow(F.lit(2.0), F.col(f"r{k}")) + F.pow(F.lit(2.0), F.col(f"r{k + 1}"))) / 2 for k in range(0, len(DISTINCT_PARAMETERS), 2)]
    ordered = F.sort_array(F.array(*pairs))
    middle = len(pairs) // 2
    return (F.element_at(ordered, middle) + F.element_at(ordered, middle + 1)) / 2 if compat else F.element_at(ordered, middle + 1)


def reservoir(df: DataFrame, order: str, size: int = 100, seed: int = 12345) -> DataFrame:
    """A sample of `size` rows without replacement, the same in any partitioning: the least values of a hash of `order`.

    The hash is taken of `order` modulo 2 ** 31, so it is defined for every BIGINT; rows without `order` take no part.
    """
    draw = (F.lit(1103515245).cast("bigint") * F.pmod(F.col(order), F.lit(2147483648)) + seed) % 2147483648
    return df.where(F.col(order).isNotNull()).withColumn("__draw", draw).orderBy("__draw", order).limit(size).drop("__draw")


def top_count_ranks(df: DataFrame, column: str, ranks: int = 3) -> DataFrame:
    """column, n: the values whose count is among the `ranks` largest different counts."""
    counts = df.where(F.col(column) != "").groupBy(column).agg(F.count("*").alias("n"))
    levels = counts.select("n").distinct().orderBy(F.desc("n")).limit(ranks).agg(F.min("n").alias("__least"))
    return counts.join(F.broadcast(levels), F.col("n") >= F.col("__least")).drop("__least")
