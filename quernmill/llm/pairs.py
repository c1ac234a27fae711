"""Items that appear together more often than chance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernmill.operators.codes import dense_codes
from quernmill.session import cut

_CODES = "code bigint, n bigint"
_LOW = (1 << 32) - 1


def _runs(codes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Run lengths (or sums of counts) of sorted codes."""
    begins = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    if counts is None:
        return codes[begins], np.diff(np.concatenate((begins, [len(codes)])))
    return codes[begins], np.add.reduceat(counts, begins)


def _as_batch(codes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(counts, pa.int64())], ["code", "n"])


def _pair_runs(batches: Iterator[pa.RecordBatch], most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Packed codes of the item pairs of each basket (a sorted list of item codes), as sorted run lengths of at most about `most` pairs."""
    held: list[np.ndarray] = []
    size = 0

    def flush() -> pa.RecordBatch:
        nonlocal size
        codes = np.concatenate(held)
        codes.sort()
        held.clear()
        size = 0
        return _as_batch(*_runs(codes))

    for batch in batches:
        lists = batch.column(0)
        values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        for k in np.unique(sizes[sizes > 1]):
            i, j = np.triu_indices(k, 1)
            rows = starts[sizes == k]
            step = max(1, most // len(i))
            for at in range(0, len(rows), step):
                items = values[rows[at : at + step, None] + np.arange(k)]
                held.append(((items[:, i] << 32) | items[:, j]).ravel())
                size += held[-1].size
                if size >= most:
                    yield flush()
    if held:
        yield flush()


def _merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the counts of equal codes over a partition sorted by code."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        codes, counts = _runs(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        if last is not None:
            if codes[0] == last[0]:
                counts[0] += last[1]
            else:
                codes, counts = np.concatenate(([last[0]], codes)), np.concatenate(([last[1]], counts))
        last = (codes[-1], counts[-1])
        if len(codes) > 1:
            yield _as_batch(codes[:-1], counts[:-1])
    if last is not None:
        yield _as_batch(np.array([last[0]]), np.array([last[1]]))


def co_occurrences(records: DataFrame, record: str, item: str, *, min_together: int = 1, min_lift: float = 0.0, largest_basket: int = 2_000, most_pairs: int = 10_000_000_000) -> DataFrame:
    """Pairs of items of the same records: item_a < item_b, n_both, n_a, n_b, n_records, lift, log_odds.

    n_a, n_b and n_both count distinct records; n_records all records with an item. lift is
    n_both * n_records / (n_a * n_b); log_odds the logarithm of the odds ratio with 0.5 added
    to each cell. Rows: n_both >= min_together and lift >= min_lift.

    Packed 64-bit pair codes are made per record, sorted and run-length counted before the
    shuffle; after it each partition is sorted (Spark's external sort spills sorted runs and
    merges them) and its runs are summed in one pass.

    Two bounds drop items without losing a pair: n_both <= n_a gives n_a >= min_together, and
    lift >= min_lift gives n_a <= n_records / min_lift. Records of more than `largest_basket`
    items make pairs by prefix filtering only: of each item the min_together - 1 largest such
    records make none, and items of fewer than min_together of them make none at all. The
    pairs so met, and those met in other records, are counted by looking up the large records
    of the rarer item under the other, by (item, record); no list of records is gathered. With
    min_together = 1 every pair of a large record is a result: more than `most_pairs` of them are refused.
    More than 2 ** 32 items are refused as well, as two codes are packed into 64 bits.

    Null records and items take no part, repeated rows count once, an empty table gives no
    rows, other columns are not read.
    """
    rows = cut(records.select(F.col(f"`{record}`").alias("rec"), F.col(f"`{item}`").alias("item")).where(F.col("rec").isNotNull() & F.col("item").isNotNull()).distinct())
    n_records = rows.select("rec").distinct().count()
    per_item = rows.groupBy("item").agg(F.count("*").alias("n")).where((F.col("n") >= min_together) & (F.col("n") * F.lit(float(min_lift)) <= n_records))
    items = cut(dense_codes(per_item))
    if items.count() > 1 << 32:
        raise ValueError("more than 2 ** 32 items; co_occurrences packs two codes into 64 bits")
    kept = cut(rows.join(items.select("item", "code"), "item").select("rec", "code"))
    degree = kept.groupBy("rec").agg(F.count("*").alias("degree")).where(F.col("degree") > 1)
    large = cut(degree.where(F.col("degree") > largest_basket))
    any_large = bool(large.head(1))
    small = kept.join(large, "rec", "left_anti") if any_large else kept
    baskets = small.groupBy("rec").agg(F.sort_array(F.collect_list("code")).alias("codes")).where(F.size("codes") > 1).select("codes")
    met = baskets.mapInArrow(_pair_runs, _CODES).repartition("code").sortWithinPartitions("code").mapInArrow(_merge_runs, _CODES)
    if any_large:
        pairs = large.agg(F.sum(F.col("degree").cast("double") * (F.col("degree") - 1) / 2)).head()[0]
        if min_together == 1 and pairs > most_pairs:
            raise ValueError(f"large records have {pairs:.0f} pairs, each a result at min_together=1; co_occurrences takes {most_pairs}")
        met = _with_large(met, kept.join(large, "rec"), min_together)
    met = met.where(F.col("n") >= min_together).select(*_unpacked(), F.col("n").alias("n_both"))
    side = lambda x: items.select(F.col("code").alias(f"c{x}"), F.col("item").alias(f"i{x}"), F.col("n").alias(f"n{x}"))
    joined = met.join(side("a"), "ca").where(F.col("n_both") * F.lit(float(n_records)) >= F.lit(float(min_lift)) * F.col("na")).join(side("b"), "cb")
    lift = F.col("n_both") * F.lit(float(n_records)) / (F.col("na").cast("double") * F.col("nb"))
    swap = F.col("ia") > F.col("ib")
    both = F.col("n_both")
    odds = (both + 0.5) * (n_records - F.col("n_a") - F.col("n_b") + both + 0.5) / ((F.col("n_a") - both + 0.5) * (F.col("n_b") - both + 0.5))
    return (
        joined.where(both * F.lit(float(n_records)) >= F.lit(float(min_lift)) * F.col("na") * F.col("nb"))
        .select(
            F.least("ia", "ib").alias("item_a"),
            F.greatest("ia", "ib").alias("item_b"),
            "n_both",
            F.when(swap, F.col("nb")).otherwise(F.col("na")).alias("n_a"),
            F.when(swap, F.col("na")).otherwise(F.col("nb")).alias("n_b"),
            F.lit(n_records).cast("bigint").alias("n_records"),
            lift.alias("lift"),
        )
        .withColumn("log_odds", F.log(odds))
    )


def _unpacked() -> list[Column]:
    """ca, cb of a packed code; the first code fills the sign bit from 2 ** 31 on."""
    return [F.shiftrightunsigned("code", 32).alias("ca"), F.col("code").bitwiseAND(_LOW).alias("cb")]


def _with_large(met: DataFrame, rows: DataFrame, min_together: int) -> DataFrame:
    """Adds to the pair counts of small records those of the large ones (rows: rec, degree, code)."""
    met, rows = cut(met), cut(rows)
    held = cut(rows.groupBy("code").agg(F.count("*").alias("n_large")))
    # the first common record, by degree, of two items that share min_together lies before the last min_together - 1 of either
    often = rows.join(held.where(F.col("n_large") >= min_together), "code")
    last = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("degree"), F.desc("rec")))
    kept_out = often.withColumn("r", last).where(F.col("r") < min_together).select("code", "rec")
    prefix = often.select("code", "rec").join(kept_out, ["code", "rec"], "left_anti")
    a, b = (prefix.select("rec", F.col("code").alias(f"c{x}")) for x in "ab")
    alone = a.join(b, "rec").where(F.col("ca") < F.col("cb")).select(F.shiftleft("ca", 32).bitwiseOR(F.col("cb")).alias("code")).distinct().join(met, "code", "left_anti").withColumn("n", F.lit(0).cast("bigint"))
    pairs = cut(met.unionByName(alone))
    na, nb = (held.select(F.col("code").alias(f"c{x}"), F.col("n_large").alias(f"n_{x}")) for x in "ab")
    sized = pairs.select("code", *_unpacked()).join(na, "ca").join(nb, "cb")
    rarer = F.col("n_a") <= F.col("n_b")
    lookup = sized.select("code", F.when(rarer, F.col("ca")).otherwise(F.col("cb")).alias("small"), F.when(rarer, F.col("cb")).otherwise(F.col("ca")).alias("large"))
    lo, hi = (rows.select("rec", F.col("code").alias(x)) for x in ("small", "large"))
    shared = lookup.join(lo, "small").join(hi, ["large", "rec"]).groupBy("code").agg(F.count("*").alias("n"))
    return pairs.unionByName(shared).groupBy("code").agg(F.sum("n").alias("n"))
