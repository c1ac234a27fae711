"""Frequent item-sets: complete level-wise search, two-pass partition search, and FP-growth."""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernmill.operators.similarity import common_counts
from quernmill.session import cut


def basket_items(df: DataFrame, basket: str, item: str) -> DataFrame:
    """Distinct (basket, item) rows; null keys take no part."""
    return df.select(F.col(basket).alias("basket"), F.col(item).alias("item")).where(F.col("basket").isNotNull() & F.col("item").isNotNull()).distinct()


def baskets(df: DataFrame, basket: str, item: str, larger_than: int = 0) -> DataFrame:
    """basket, items (a sorted array) of the baskets with more than `larger_than` distinct items."""
    return basket_items(df, basket, item).groupBy("basket").agg(F.sort_array(F.collect_list("item")).alias("items")).where(F.size("items") > larger_than)


def frequent_itemsets(pairs: DataFrame, support: int, max_size: int | None = None) -> DataFrame:
    """items (sorted array), k, freq of every set in at least `support` baskets; pairs: distinct (basket, item).

    Pairs come from `common_counts` of items over baskets: the support - 1 largest baskets of
    an item make no candidates, so one huge basket doesn't emit all its pairs. A larger
    candidate joins two frequent sets that differ in the last item, all of whose other subsets
    are frequent; it is counted over the baskets known to hold the first of the two.
    """
    single = cut(pairs.groupBy("item").agg(F.count("*").alias("freq")).where(F.col("freq") >= support))
    held = cut(pairs.join(single.select("item"), "item").select("basket", "item"))
    found = single.select(F.array("item").alias("items"), F.lit(1).alias("k"), "freq")
    if max_size == 1:
        return found
    frequent = cut(common_counts(held, "item", "basket", support).select(F.array("a", "b").alias("items"), F.lit(2).alias("k"), F.col("n_common").alias("freq")))
    level, k = None, 2
    while frequent.head(1):
        found = found.unionByName(frequent)
        k += 1
        if max_size is not None and k > max_size:
            break
        sets = frequent.select(F.slice("items", 1, k - 2).alias("head"), F.element_at("items", -1).alias("tail"))
        grown = sets.join(sets.withColumnRenamed("tail", "new"), "head").where(F.col("tail") < F.col("new"))
        grown = grown.select(F.concat("head", F.array("tail")).alias("base"), "new", F.concat("head", F.array("tail", "new")).alias("items"))
        for p in range(k - 2):
            subset = F.concat(F.slice("items", 1, p), F.slice("items", p + 2, k - p - 1)) if p else F.slice("items", 2, k - 1)
            grown = grown.withColumn("sub", subset).join(frequent.select(F.col("items").alias("sub")), "sub", "left_semi").drop("sub")
        grown = cut(grown)
        if not grown.head(1):
            break
        if level is None:
            level = frequent.select("items", F.col("items")[0].alias("item"), F.col("items")[1].alias("other")).join(held, "item").select("items", "basket", F.col("other").alias("item")).join(held, ["basket", "item"]).select("basket", "items")
        level = cut(level.join(grown, level["items"] == grown["base"]).select("basket", F.col("new").alias("item"), grown["items"]).join(held, ["basket", "item"]).select("basket", "items"))
        frequent = cut(level.groupBy("items").agg(F.count("*").alias("freq")).where(F.col("freq") >= support).select("items", F.lit(k).alias("k"), "freq"))
    return found


def _local_sets(rows: list[list[str]], least: float) -> list[tuple[str, ...]]:
    """All sets in at least `least` of the rows, by levels."""
    counts = Counter(i for row in rows for i in row)
    level = {(i,) for i, c in counts.items() if c >= least}
    out = sorted(level)
    single = {x[0] for x in level}
    rows = [sorted(set(r) & single) for r in rows]
    while level:
        k = len(next(iter(level)))
        counts = Counter()
        for row in rows:
            for base in (itertools.combinations(row, k) if math.comb(len(row), k) <= len(level) else (s for s in level if set(s) <= set(row))):
                if base in level:
                    counts.update((*base, i) for i in row if i > base[-1] and (k == 1 or (*base[:-1], i) in level))
        level = {s for s, c in counts.items() if c >= least}
        out += sorted(level)
    return out


def son_itemsets(pairs: DataFrame, support: int, *, least_local: int = 5, most_baskets: int = 1_000_000) -> DataFrame:
    """The same sets in two passes: candidates that are frequent in some partition at its share of the support, then an exact recount.

    Baskets are spread over so many partitions that each one's share of the support is at least
    `least_local`; with less, every subset of a basket would be a candidate. A support that would
    need more than `most_baskets` baskets in a partition, which are held there, is refused.
    """
    grouped = cut(pairs.groupBy("basket").agg(F.sort_array(F.collect_list("item")).alias("items")))
    total = grouped.count()
    parts = max(1, min(support // least_local, math.ceil(total / 10_000)))
    if total / parts > most_baskets:
        raise ValueError(f"support {support} of {total} baskets needs {total // parts} baskets in a partition; son_itemsets takes {most_baskets}")

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in batch.column(0).to_pylist()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([list(s) for s in _local_sets(rows, support * len(rows) / total)], pa.list_(pa.string()))], ["items"])

    candidates = cut(grouped.select("items").repartition(parts).mapInArrow(local, "items array<string>").distinct()).withColumn("k", F.size("items"))
    # a basket meets the candidates through their first item only
    keyed = candidates.withColumn("first", F.col("items")[0]).withColumnRenamed("items", "wanted")
    met = grouped.select("basket", "items", F.explode("items").alias("first")).join(keyed, "first").where(F.size(F.array_except("wanted", "items")) == 0)
    return met.groupBy(F.col("wanted").alias("items"), "k").agg(F.count("*").alias("freq")).where(F.col("freq") >= support)


def fpgrowth_itemsets(pairs: DataFrame, support: int) -> DataFrame:
    """The same sets by MLlib's FP-growth; its fraction is set so that its inner ceiling is the support."""
    grouped = cut(pairs.groupBy("basket").agg(F.collect_list("item").alias("items")))
    total = max(grouped.count(), 1)
    model = FPGrowth(itemsCol="items", minSupport=max(0.0, min(1.0, (support - 0.5) / total)))
    return model.fit(grouped).freqItemsets.select(F.sort_array("items").alias("items"), F.size("items").alias("k"), "freq")
