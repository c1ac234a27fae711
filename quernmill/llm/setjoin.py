"""All pairs of set-valued records whose sets overlap, by recursive chosen-path splitting."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernmill.operators.codes import dense_codes
from quernmill.operators.similarity import common_counts
from quernmill.session import cut

_ONE = 1 << 53  # hashes are uniform in [0, _ONE)
_PAIR = "ca bigint, cb bigint, n_both bigint, n_a bigint, n_b bigint"


def _draw(*columns):
    return F.xxhash64(*columns).bitwiseAND(_ONE - 1)


def trees_for(recall: float, depth: int) -> int:
    """Trees after which a pair at the threshold is met with probability `recall`, if it takes `depth` splits.

    A shared node has at least one shared child in the mean at every depth (see `_bound`), Poisson
    at worst, so a pair lives through d splits with probability q(d) = 1 - exp(-q(d - 1)), q(0) = 1.
    """
    q = 1.0
    for _ in range(depth):
        q = 1 - math.exp(-q)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - q)))


def _bound(threshold: float, depth: int):
    """What the hash of a record's token must be below to lead from a node of that depth to a child.

    A pair above the threshold shares at least threshold * n tokens, n being the larger size, and
    `depth` of them are on the path; of the others each is taken with the inverse of how many there are at least.
    """
    return F.lit(float(_ONE)) / F.greatest(threshold * F.col("n") - depth, F.lit(1.0))


def _spent(large: DataFrame, depth: int, threshold: float) -> DataFrame:
    """ca, cb, n_a, n_b of the records of one node that are similar by the tokens of its path alone.

    A pair that shares nothing beyond the path has no child in common. All records of the node
    share the path, so sizes that suit each other are enough, and each pair met is a result.
    """
    fits = lambda m: depth / (F.col("n") + m - depth) >= threshold
    rows = large.select(F.xxhash64(F.array_sort("path")).alias("path"), "code", "n").where(fits(F.lit(depth))).distinct()
    sizes = F.sequence(F.lit(depth).cast("bigint"), F.lit(math.floor(depth / threshold) + 1).cast("bigint"))
    paired = cut(rows.withColumn("m", F.explode(F.filter(sizes, fits))))
    a = paired.where(F.col("n") <= F.col("m")).select("path", F.col("n").alias("lo"), F.col("m").alias("hi"), F.col("code").alias("x"))
    b = paired.where(F.col("n") >= F.col("m")).select("path", F.col("m").alias("lo"), F.col("n").alias("hi"), F.col("code").alias("y"))
    met = a.join(b, ["path", "lo", "hi"]).where((F.col("x") != F.col("y")) & ((F.col("lo") < F.col("hi")) | (F.col("x") < F.col("y"))))
    first = F.col("x") < F.col("y")
    ends = lambda p, q: F.when(first, F.col(p)).otherwise(F.col(q))
    return met.select(ends("x", "y").alias("ca"), ends("y", "x").alias("cb"), ends("lo", "hi").alias("n_a"), ends("hi", "lo").alias("n_b")).distinct()


def _compare(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Exact pairs of each node's records; rows (node, code, n, tokens) come sorted by node."""
    node = None
    held: list[tuple[int, int, frozenset]] = []
    found: list[tuple[int, int, int, int, int]] = []

    def close() -> None:
        held.sort(key=lambda r: r[0])
        for i, (n, code, tokens) in enumerate(held):
            most = n / threshold
            for m, other, others in held[i + 1 :]:
                if m > most:
                    break
                if other == code:
                    continue
                both = len(tokens & others)
                if both and both / (n + m - both) >= threshold:
                    found.append((code, other, both, n, m) if code < other else (other, code, both, m, n))
        held.clear()

    def flush() -> pa.RecordBatch:
        columns = list(zip(*set(found), strict=True)) or [[]] * 5
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["ca", "cb", "n_both", "n_a", "n_b"])

    for batch in batches:
        nodes, codes, sizes = (batch.column(k).to_pylist() for k in range(3))
        lists = batch.column(3)
        values, offsets = lists.flatten().to_numpy(), lists.offsets.to_numpy()
        base = offsets[0]
        for k in range(len(nodes)):
            if nodes[k] != node:
                close()
                node = nodes[k]
                if len(found) > 200_000:
                    yield flush()
            held.append((sizes[k], codes[k], frozenset(values[offsets[k] - base : offsets[k + 1] - base].tolist())))
    close()
    yield flush()


def similar_sets(records: DataFrame, key: str, value: str, *, threshold: float, min_size: int = 1, recall: float = 0.9999, depth: int = 3, leaf: int = 256, largest_set: int = 4_096) -> tuple[DataFrame, DataFrame]:
    """Pairs of keys whose value sets have Jaccard similarity >= threshold, as (pairs, members).

    pairs: ca, cb (class codes, ca <> cb), n_both, n_a, n_b between classes; members: key,
    code, n: the class of every key that can have a partner. Keys of one class hold the same
    set, and are pairs of similarity 1 among themselves. `expand_pairs` writes them all out.

    Splitting: in each of `trees_for(recall, depth)` trees a record x in a node goes to the
    child of each of its unused tokens t whose hash h(tree, node, t) is below 1 / (threshold *
    |x| - tokens used), so two records above the threshold share a child in the mean at least. A
    node of at most `leaf` records is compared pair by pair, exactly; larger ones split again, up
    to `depth` times, and are then compared in blocks. Pairs whose shared tokens are used up
    before that are joined within the large node, by size (`_spent`). First-level nodes of one token are nested over
    the trees, so only the largest is compared. Found pairs are exact; a pair at the threshold
    is found with probability `recall` or more.

    Exact bounds drop records without a partner of fitting size and values of one record.
    Sets larger than `largest_set` are never gathered in a row nor sent to nodes: pairs with such a
    set are counted exactly, by prefix join, over the few sets of comparable size.

    Null keys and values take no part, repeated rows count once, an empty table gives no
    rows, other columns are not read.
    """
    rows = cut(records.select(F.col(f"`{key}`").alias("key"), F.col(f"`{value}`").alias("value")).where(F.col("key").isNotNull() & F.col("value").isNotNull()).distinct())
    sizes = cut(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= min_size))
    # there are at most sqrt(2 * rows) sizes
    order = Window.orderBy("n")
    fitting = (
        sizes.groupBy("n").agg(F.count("*").alias("k")).withColumns({"below": F.lag("n").over(order), "above": F.lead("n").over(order)})
        .where((F.col("k") > 1) | (F.col("below") >= F.col("n") * threshold) | (F.col("above") * threshold <= F.col("n"))).select("n")
    )
    keys = cut(dense_codes(sizes.join(fitting, "n")))
    kept = rows.join(keys, "key")
    trees = trees_for(recall, depth)
    tokens = dense_codes(kept.groupBy("value").agg(F.count("*").alias("df")).where(F.col("df") > 1).select("value"), "tok")
    held = cut(kept.join(tokens, "value").select("code", "n", "tok"))

    # classes of equal sets: all values shared, and two 64-bit sums of hashes equal
    sums = held.groupBy("code", "n").agg(F.count("*").alias("k"), F.expr("bit_xor(xxhash64(tok, 1))").alias("x"), F.expr("bit_xor(xxhash64(tok, 2))").alias("y")).where(F.col("k") == F.col("n"))
    copies = sums.groupBy("n", "x", "y").agg(F.min("code").alias("class"), F.count("*").alias("k")).where(F.col("k") > 1)
    classes = cut(sums.join(copies.drop("k"), ["n", "x", "y"]).select("code", "class"))
    members = keys.join(classes, "code", "left").select("key", F.coalesce("class", "code").alias("code"), "n")
    lone = held.join(classes.where(F.col("code") != F.col("class")), "code", "left_anti")

    giants = bool(keys.where(F.col("n") > largest_set).head(1))
    listed = lone.where(F.col("n") <= largest_set) if giants else lone
    bound = _bound(threshold, 0)
    spent = []
    lowest = [_draw(F.col("tok"), F.lit(t)) for t in range(trees)]
    chosen = cut(listed.where((F.least(*lowest) if trees > 1 else lowest[0]) < bound))
    count = chosen.groupBy("tok").agg(F.count("*").alias("size")).where(F.col("size") > 1)
    count = cut(count)
    leaves = chosen.join(count.where(F.col("size") <= leaf), "tok").select(F.xxhash64("tok").alias("node"), "code")
    if count.where(F.col("size") > leaf).head(1):
        # only nodes that are too large in some tree come here, each tree for itself
        level = chosen.join(count.where(F.col("size") > leaf), "tok").select("code", "n", "tok", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
        level = level.where(_draw(F.col("tok"), F.col("tree")) < bound).select("tree", F.xxhash64("tok", "tree").alias("node"), F.array("tok").alias("path"), "code", "n")
        for d in range(1, depth + 1):
            level = cut(level)
            size = level.groupBy("node").agg(F.count("*").alias("size")).where(F.col("size") > 1)
            sized = level.join(size, "node")
            leaves = leaves.unionByName(sized.where(F.col("size") <= leaf).select("node", "code"))
            large = sized.where(F.col("size") > leaf)
            if d == depth:
                blocks = F.ceil(F.col("size") / (leaf // 2)).cast("int")
                own = F.pmod(F.xxhash64("code"), blocks).cast("int")
                other = F.explode(F.sequence(F.lit(0), blocks - 1))
                split = large.select("node", "code", own.alias("own"), other.alias("other"))
                leaves = leaves.unionByName(split.select(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("node"), "code"))
                break
            if d / (2 * max(d, min_size) - d) >= threshold:
                spent.append(_spent(large, d, threshold))
            step = large.select("tree", "node", "path", "code").join(listed, "code").where(~F.array_contains("path", F.col("tok")))
            level = step.where(_draw(F.col("tok"), F.col("node")) < _bound(threshold, d)).select("tree", F.xxhash64("node", "tok").alias("node"), F.concat("path", F.array("tok")).alias("path"), "code", "n")
    sets = listed.groupBy("code", "n").agg(F.collect_list("tok").alias("tokens"))
    compared = leaves.join(sets, "code").select("node", "code", "n", "tokens").repartition("node").sortWithinPartitions("node")
    pairs = compared.mapInArrow(lambda batches: _compare(batches, threshold), _PAIR)
    for met in spent:
        ends = [sets.select(F.col("code").alias(f"c{x}"), F.col("tokens").alias(f"tokens_{x}")) for x in "ab"]
        pairs = pairs.unionByName(met.join(ends[0], "ca").join(ends[1], "cb").select("ca", "cb", F.size(F.array_intersect("tokens_a", "tokens_b")).cast("bigint").alias("n_both"), "n_a", "n_b"))
    pairs = pairs.dropDuplicates(["ca", "cb"])
    if giants:
        # values of one record were dropped before, so sizes are those of the whole sets
        big = lone.where(F.col("n") >= largest_set * threshold)
        size = big.select("code", "n").distinct()
        sa, sb = (size.select(F.col("code").alias(f"c{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
        least = max(1, math.ceil(largest_set * threshold))
        counted = common_counts(big, "code", "tok", least).select(F.col("a").alias("ca"), F.col("b").alias("cb"), F.col("n_common").alias("n_both")).join(sa, "ca").join(sb, "cb").where(F.greatest("n_a", "n_b") > largest_set)
        pairs = pairs.unionByName(counted.where(F.col("n_both") / (F.col("n_a") + F.col("n_b") - F.col("n_both")) >= threshold).select("ca", "cb", "n_both", "n_a", "n_b"))
    return pairs, members


def expand_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """key_a < key_b, n_both, n_a, n_b, similarity of every pair of keys, copies included."""
    members = cut(members)
    side = lambda x: members.select(F.col("code").alias(f"c{x}"), F.col("key").alias(f"k{x}"))
    between = pairs.join(side("a"), "ca").join(side("b"), "cb").select("ka", "kb", "n_both", "n_a", "n_b")
    several = members.groupBy("code").count().where(F.col("count") > 1).select("code")
    alike = members.join(several, "code")
    within = alike.select("code", F.col("key").alias("ka"), F.col("n").alias("n_both")).join(alike.select("code", F.col("key").alias("kb")), "code").where(F.col("ka") < F.col("kb")).select("ka", "kb", "n_both", F.col("n_both").alias("n_a"), F.col("n_both").alias("n_b"))
    swap = F.col("ka") > F.col("kb")
    return between.unionByName(within).select(
        F.least("ka", "kb").alias("key_a"),
        F.greatest("ka", "kb").alias("key_b"),
        "n_both",
        F.when(swap, F.col("n_b")).otherwise(F.col("n_a")).alias("n_a"),
        F.when(swap, F.col("n_a")).otherwise(F.col("n_b")).alias("n_b"),
        (F.col("n_both") / (F.col("n_a") + F.col("n_b") - F.col("n_both"))).alias("similarity"),
    )
