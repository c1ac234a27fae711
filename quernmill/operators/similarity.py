"""Keys that share items: common counts, Jaccard, min-hash signatures and banding, Pearson and slope."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernmill.functions.hashing import MINHASH_PARAMETERS, MINHASH_PRIME, universal
from quernmill.functions.shared import LeastHashes, shared_items
from quernmill.operators.codes import dense_codes, ordered_codes
from quernmill.session import cut


def _needed(min_common: int, threshold: float) -> Column:
    """How many items a key of n has in common with every partner at least: a Jaccard similarity of t takes t * n."""
    return F.greatest(F.lit(min_common), F.ceil(F.lit(threshold) * F.col("n") - 1e-9).cast("int"))


def _prefixes(held: DataFrame, min_common: int, threshold: float = 0.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of written rows (k, i, ..): sizes (k, n), the rows that can be shared, and their prefixes (k, i).

    With a key's items in order of frequency, the rarest item that two keys share lies before
    the last `needed - 1` of either, so only those places need to meet.
    """
    sizes = cut(held.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") >= min_common))
    often = held.join(sizes.select("k"), "k").groupBy("i").agg(F.count("*").alias("f")).where(F.col("f") > 1)
    kept = cut(held.join(often, "i").join(sizes, "k"))
    last = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("f"), F.desc("i")))
    common_ones = kept.withColumn("r", last).where(F.col("r") < _needed(min_common, threshold)).select("k", "i")
    prefix = kept.select("k", "i") if min_common == 1 and not threshold else kept.join(common_ones, ["k", "i"], "left_anti").select("k", "i")
    return sizes, kept.drop("f", "n"), cut(prefix)


def _sized(candidates: DataFrame, sizes: DataFrame, threshold: float) -> DataFrame:
    """Candidates (a, b) with n_a, n_b; those whose sizes rule the similarity out are left out."""
    sa, sb = (sizes.select(F.col("k").alias(x), F.col("n").alias(f"n_{x}")) for x in "ab")
    sized = candidates.join(sa, "a").join(sb, "b")
    return sized.where(F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b")) if threshold else sized


def _met(rows: DataFrame, on: list[str]) -> DataFrame:
    """Distinct a < b of the keys k that agree in `on`."""
    a, b = (rows.select(*on, F.col("k").alias(x)) for x in "ab")
    return a.join(b, on).where(F.col("a") < F.col("b")).select("a", "b").distinct()


def _holdings(pairs: DataFrame, key: str, item: str) -> DataFrame:
    return cut(pairs.select(F.col(key).alias("k"), F.col(item).alias("i")).where(F.col("k").isNotNull() & F.col("i").isNotNull()).distinct())


def common_counts(pairs: DataFrame, key: str, item: str, min_common: int, threshold: float = 0.0) -> DataFrame:
    """a < b, n_common, n_a, n_b of the keys with at least `min_common` items in common and a Jaccard similarity >= threshold; repeated rows count once.

    Either the self-join on the item counts by itself, where `_cheap` finds it of the order of
    the rows, or only the items of the prefixes make candidates, so that an item which a third
    of all keys hold makes none by itself where more than one common item is needed. Candidates
    are counted by looking up the items of the smaller key under the larger one, by (key, item);
    no group is gathered and no join runs on a hot key alone. The result is the same. Where one
    common item is enough for every pair, each row of the self-join belongs to a result.
    """
    held = _holdings(pairs, key, item)
    if (min_common == 1 and not threshold) or _cheap(held):
        sizes = cut(held.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") >= min_common))
        a, b = (held.select("i", F.col("k").alias(x)) for x in "ab")
        met = a.join(b, "i").where(F.col("a") < F.col("b")).groupBy("a", "b").agg(F.count("*").alias("n_common")).where(F.col("n_common") >= min_common)
        met = _sized(met, sizes, threshold)
        return (met.where(jaccard() >= threshold) if threshold else met).select("a", "b", "n_common", "n_a", "n_b")
    sizes, kept, prefix = _prefixes(held, min_common, threshold)
    return _verified(_sized(_met(prefix, ["i"]), sizes, threshold), kept, min_common, threshold)


def _cheap(held: DataFrame, factor: int = 32) -> bool:
    """Whether the self-join on the item makes at most `factor` rows for each row held."""
    n, met = held.groupBy("i").agg(F.count("*").cast("double").alias("f")).agg(F.sum("f"), F.sum(F.col("f") * (F.col("f") - 1) / 2)).head()
    return (met or 0) <= factor * (n or 0)


def _verified(sized: DataFrame, kept: DataFrame, min_common: int, threshold: float) -> DataFrame:
    met = _shared(sized, kept).groupBy("a", "b", "n_a", "n_b").agg(F.count("*").alias("n_common")).where(F.col("n_common") >= min_common)
    return (met.where(jaccard() >= threshold) if threshold else met).select("a", "b", "n_common", "n_a", "n_b")


def _shared(sized: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows (k, i, ..) of the smaller key of each pair that have a row of the larger key with the same i; further columns come as lo_.., hi_.."""
    more = [c for c in rows.columns if c not in ("k", "i")]
    small = F.when(F.col("n_a") <= F.col("n_b"), F.col("a")).otherwise(F.col("b"))
    large = F.when(F.col("n_a") <= F.col("n_b"), F.col("b")).otherwise(F.col("a"))
    lo = rows.select(F.col("k").alias("small"), "i", *[F.col(c).alias(f"lo_{c}") for c in more])
    hi = rows.select(F.col("k").alias("large"), "i", *[F.col(c).alias(f"hi_{c}") for c in more])
    return sized.withColumns({"small": small, "large": large}).join(lo, "small").join(hi, ["large", "i"])


def jaccard() -> Column:
    return F.col("n_common") / (F.col("n_a") + F.col("n_b") - F.col("n_common"))


def jaccard_pairs(pairs: DataFrame, key: str, item: str, threshold: float, min_common: int = 1) -> DataFrame:
    """a < b, similarity of all keys with a common item whose item sets have Jaccard similarity >= threshold."""
    return common_counts(pairs, key, item, min_common, threshold).select("a", "b", jaccard().alias("similarity"))


def minhash_signatures(pairs: DataFrame, key: str, item: str, parameters: list[tuple[int, int]] = MINHASH_PARAMETERS, prime: int = MINHASH_PRIME) -> DataFrame:
    """key, n_items, h1.. : the least (a * x + b) % prime over the ranks x of a key's items, in one aggregate."""
    held = pairs.select(F.col(key).alias(key), F.col(item).alias("__i")).where(F.col(key).isNotNull() & F.col("__i").isNotNull()).distinct()
    ranked = held.join(ordered_codes(held.select("__i").distinct(), "__i", "__x"), "__i")
    return ranked.groupBy(key).agg(F.count("*").alias("n_items"), *[F.min(universal(F.col("__x"), a, b, prime)).alias(f"h{k}") for k, (a, b) in enumerate(parameters, 1)])


def _bands(signatures: DataFrame, key: str, n_hashes: int, rows: int) -> DataFrame:
    """k, n, band, value: one row for each band of `rows` hashes."""
    bands = [F.struct(F.lit(k).alias("band"), F.array(*[F.col(f"h{h}") for h in range(k + 1, k + rows + 1)]).alias("value")) for k in range(0, n_hashes - rows + 1, rows)]
    return signatures.select(F.col(key).alias("k"), F.col("n_items").alias("n"), F.explode(F.array(*bands)).alias("s")).select("k", "n", "s.band", "s.value")


def lsh_pairs(signatures: DataFrame, key: str, n_hashes: int, rows: int = 1) -> DataFrame:
    """a < b that agree in all `rows` hashes of some band. With rows = 1 a common value meets every other key that has it: its whole bucket is the result."""
    return _met(_bands(signatures, key, n_hashes, rows), ["band", "value"])


def lsh_jaccard(pairs: DataFrame, key: str, item: str, threshold: float, min_common: int = 1, rows: int = 1, hot: int = 50) -> DataFrame:
    """a < b, similarity of the banding candidates whose exact sets have at least `min_common` common items and a Jaccard similarity >= threshold.

    Candidates agree in a band of `rows` hashes; their sets are compared as in `common_counts`.
    One row a band, as at a threshold of 0.05, makes nearly all candidates there are: buckets
    grow with the keys, as there are no more values than the prime. There the exact pairs come first where they
    can be counted at the order of the rows or in blocks, and their bands are looked up; the result is the same.
    Otherwise candidates come from the buckets. A bucket of more than `hot` keys is split by the
    items of their prefixes: a pair that will be confirmed shares one, so no such pair is lost
    and the others of the bucket don't meet.
    With the threshold t and b bands, 1 - (1 - t ** rows) ** b of the pairs at it are found.
    """
    held = _holdings(pairs, key, item)
    if rows == 1 and (min_common > 2 or _cheap(held)):
        return _agreeing(held, threshold, min_common)
    sizes, kept, prefix = _prefixes(held, min_common, threshold)
    bands = cut(_bands(minhash_signatures(held, "k", "i"), "k", len(MINHASH_PARAMETERS), rows))
    buckets = bands.groupBy("band", "value").agg(F.count("*").alias("size")).where(F.col("size") > 1)
    placed = cut(bands.join(sizes.select("k"), "k").join(buckets, ["band", "value"]))
    split = placed.where(F.col("size") > hot).join(prefix, "k")
    met = _met(placed.where(F.col("size") <= hot), ["band", "value"]).unionByName(_met(split, ["band", "value", "i"])).distinct()
    return _verified(_sized(met, sizes, threshold), kept, min_common, threshold).select("a", "b", jaccard().alias("similarity"))


def _agreeing(held: DataFrame, threshold: float, min_common: int) -> DataFrame:
    """a < b, similarity of the pairs of `lsh_jaccard` at one row a band: those of the exact pairs that have a hash in common."""
    found, _ = shared_in_blocks(held, min_common, threshold, keyed=True, hashed=True)
    return found.select("a", "b", jaccard().alias("similarity"))


_SUMS = ("sx", "sy", "sxy", "sxx", "syy")
_BATCH = 65_536  # rows that go back to the JVM at a time


def _blocks(rows: int, least: int = 500_000, most: int = 3_000_000) -> int:
    """In how many blocks the keys are put: up to 8 for work in parallel, more only so that a block has at most `most` rows, as each row goes to every pair of its block."""
    return max(1, min(math.ceil(rows / least), max(8, math.ceil(rows / most))))


def shared_in_blocks(held: DataFrame, min_common: int, threshold: float = 0.0, blocks: int | None = None, *, keyed: bool = False, hashed: bool = False) -> tuple[DataFrame, DataFrame]:
    """Of distinct rows (k, i): a < b, n_common of the keys with at least `min_common` common items and a Jaccard similarity >= threshold, with a column v also sx, sy, sxy, sxx, syy over them; and k, x, n, as a, b are the codes x.

    The pairs meet and are counted in memory, one group for each two blocks of keys: what
    is moved is the rows, once for each block, and the pairs found, never the self-join's rows.
    `keyed`: a, b are the keys themselves, with n_a, n_b. The keys go to the groups once for each
    block, so that no pair is joined or moved after it is found, however many there are.
    `hashed`: only pairs whose `minhash_signatures` agree in some hash, which the groups make from the items' ranks.
    """
    values = "v" in held.columns
    sizes = cut(held.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") >= min_common))
    names = cut(ordered_codes(sizes.select("k"), "k", "x").join(sizes, "k"))
    kept = cut(held.join(names.select("k", "x"), "k").drop("k"))
    often = kept.groupBy("i").agg(F.count("*").alias("f"))
    often = often if threshold or hashed else often.where(F.col("f") > 1)  # a similarity and a hash take all items of a key
    items = dense_codes(often.orderBy(F.desc("f")).select("i"), "y")
    if hashed:
        items = items.join(ordered_codes(held.select("i").distinct(), "i", "r"), "i")
    rows = cut(kept.join(items, "i").drop("i"))
    blocks = blocks or _blocks(rows.count())
    sent = rows
    if keyed:  # a row for each key, with its size below 0 in place of an item
        own = names.select("x", (-F.col("n")).alias("y"), "k", *[F.lit(0).cast("bigint").alias("r")] * hashed, *[F.lit(0.0).alias("v")] * values)
        sent = rows.withColumn("k", F.lit(None).cast(names.schema["k"].dataType)).unionByName(own)
    mine, other = F.pmod("x", F.lit(blocks)), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("__o")
    dealt = sent.select("*", other).select((F.least(mine, "__o") * blocks + F.greatest(mine, "__o")).alias("g"), *sent.columns)
    key_type = names.schema["k"].dataType.simpleString() if keyed else "bigint"
    counts = ("n_common", "n_a", "n_b") if keyed else ("n_common",)
    schema = f"a {key_type}, b {key_type}" + "".join(f", {c} bigint" for c in counts) + "".join(f", {c} double" for c in _SUMS if values)

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = divmod(key[0].as_py(), blocks)
        table = pa.Table.from_batches(list(batches))
        if keyed:
            is_key = pa.array(table.column("y").to_numpy() < 0)
            own, table = table.select(["x", "y", "k"]).filter(is_key).sort_by("x"), table.drop_columns("k").filter(pc.invert(is_key))
            codes, n, keys = own.column("x").to_numpy(), -own.column("y").to_numpy(), own.column("k").combine_chunks()
        x, y = (table.column(c).to_numpy() for c in ("x", "y"))
        v = table.column("v").to_numpy() if values else None
        hashes = LeastHashes(x, table.column("r").to_numpy(), MINHASH_PARAMETERS, MINHASH_PRIME) if hashed else None
        del table
        side = lambda at: (x[at], y[at], v[at] if values else None)
        for found in shared_items(side(x % blocks == one), None if one == two else side(x % blocks == two), min_common, threshold):
            if hashed:
                agree = hashes.agree(*found[:2])
                found = [c[agree] for c in found]
            for k in range(0, len(found[0]), _BATCH):
                a, b, n_common, *sums = (c[k : k + _BATCH] for c in found)
                columns = [a, b, n_common, *sums]
                if keyed:
                    a, b = (np.searchsorted(codes, c) for c in (a, b))
                    columns = [keys.take(pa.array(a)), keys.take(pa.array(b)), n_common, n[a], n[b], *sums]
                yield pa.record_batch([pa.array(c) for c in columns], ["a", "b", *counts, *_SUMS[: len(sums)]])

    # four times the groups, as they come to the tasks by hash
    return dealt.repartition(2 * blocks * (blocks + 1), "g").groupBy("g").applyInArrow(run, schema), names


def _named(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """The pairs of codes a, b by their keys, with n_a, n_b and what else `names` has."""
    for c in "ab":
        own = names.select("x", F.col("k").alias(c), *[F.col(m).alias(f"{m}_{c}") for m in names.columns if m not in ("x", "k")])
        pairs = pairs.withColumnRenamed(c, "x").join(own, "x").drop("x")
    return pairs


def _measured(rated: DataFrame, key: str, by: str, value: str, min_common: int, above: float, name: str, measure: Column) -> DataFrame:
    """a < b, `name`: the measure of n, mx, my, xy, xx, yy over the `by` that both keys have, > above, where they have at least min_common.

    Several values of one (key, by) count as their mean.
    """
    held = cut(rated.select(F.col(key).alias("k"), F.col(by).alias("i"), F.col(value).alias("v")).where(F.col("k").isNotNull() & F.col("i").isNotNull() & F.col("v").isNotNull()).groupBy("k", "i").agg(F.avg("v").alias("v")))
    result = F.round(measure, 6).alias(name)
    if _cheap(held):
        a, b = (held.select("i", F.col("k").alias(x), F.col("v").alias(v)) for x, v in (("a", "x"), ("b", "y")))
        m = a.join(b, "i").where(F.col("a") < F.col("b")).groupBy("a", "b").agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg(F.col("x") * F.col("y")).alias("xy"), F.avg(F.col("x") * F.col("x")).alias("xx"), F.avg(F.col("y") * F.col("y")).alias("yy"))
        return m.where(F.col("n") >= min_common).select("a", "b", result).where(F.col(name) > above)
    found, _ = shared_in_blocks(held, min_common, keyed=True)
    m = found.select("a", "b", *[(F.col(s) / F.col("n_common")).alias(c) for s, c in zip(_SUMS, ("mx", "my", "xy", "xx", "yy"))])
    return m.select("a", "b", result).where(F.col(name) > above)


def pearson_pairs(rated: DataFrame, key: str, by: str, value: str, *, min_common: int = 3, above: float = 1e-9) -> DataFrame:
    """a < b, sim: Pearson correlation over the `by` both keys have, > above; no row without variance.

    Raw moments and guards instead of corr(), which fails on zero variance.
    """
    vx, vy = F.col("xx") - F.col("mx") * F.col("mx"), F.col("yy") - F.col("my") * F.col("my")
    sim = F.when((vx > 1e-9) & (vy > 1e-9), (F.col("xy") - F.col("mx") * F.col("my")) / F.sqrt(vx * vy))
    return _measured(rated, key, by, value, min_common, above, "sim", sim)


def slope_pairs(rated: DataFrame, key: str, by: str, value: str, *, min_common: int = 3, above: float = 1e-9) -> DataFrame:
    """a < b, slope of b's values on a's over what both have, > above; no row where a doesn't vary."""
    vx = F.col("xx") - F.col("mx") * F.col("mx")
    return _measured(rated, key, by, value, min_common, above, "slope", F.when(vx > 1e-9, (F.col("xy") - F.col("mx") * F.col("my")) / vx))
