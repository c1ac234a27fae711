"""Clustering of points: farthest-first k-means, cluster summaries, and rounds with discard, compression and retained sets.

Points stay distributed; what the driver holds are cluster summaries, whose number depends on
k and not on the data. An assignment is one narrow pass of matrix arithmetic over Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernmill.session import cut


_ASSIGNED = "id bigint, features array<double>, cluster int, distance double"


def _matrix(batch: pa.RecordBatch, column: int) -> np.ndarray:
    lists = batch.column(column)
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def distances(x: np.ndarray, centres: np.ndarray, spreads: np.ndarray | None = None) -> np.ndarray:
    """Euclidean distances of rows to centres; with spreads in standard deviations, a dimension without any counting its plain difference."""
    out = np.empty((len(x), len(centres)))
    for k, c in enumerate(centres):
        d = x - c
        if spreads is not None:
            d = d / np.where(spreads[k] > 0, spreads[k], 1.0)
        out[:, k] = np.sqrt((d * d).sum(1))
    return out


def assign(pts: DataFrame, centres: dict[int, np.ndarray], spreads: dict[int, np.ndarray] | None = None) -> DataFrame:
    """id, features, cluster, distance: the nearest centre of each point, the smallest id of several; one narrow pass."""
    ids = sorted(centres)
    c = np.array([centres[k] for k in ids], float)
    s = None if spreads is None else np.array([spreads[k] for k in ids], float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = distances(_matrix(batch, 1), c, s)
                best = d.argmin(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(ids, np.int32)[best]), pa.array(d[np.arange(len(d)), best])], ["id", "features", "cluster", "distance"])

    return pts.select("id", "features").mapInArrow(run, _ASSIGNED)


def summaries(assigned: DataFrame, dims: int) -> DataFrame:
    """cluster, n, sum, sumsq of each cluster, in one partially aggregated pass."""
    f = [F.col("features")[i] for i in range(dims)]
    return assigned.groupBy("cluster").agg(F.count("*").alias("n"), F.array(*[F.sum(x) for x in f]).alias("sum"), F.array(*[F.sum(x * x) for x in f]).alias("sumsq"))


def points(df: DataFrame, key: str, vector: str) -> DataFrame:
    """id, features (array<double>); rows without id or vector drop out."""
    return df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("features"))


def _farthest(ids: np.ndarray, x: np.ndarray, k: int) -> list[int]:
    """Rows of the smallest id and then of the point farthest from all so far, the smallest id of several."""
    order = np.argsort(ids, kind="stable")
    x = x[order]
    chosen, least = [0], np.sqrt(((x - x[0]) ** 2).sum(1))
    while len(chosen) < k and least.max() > 0:
        chosen.append(int(least.argmax()))
        least = np.minimum(least, np.sqrt(((x - x[chosen[-1]]) ** 2).sum(1)))
    return [int(order[i]) for i in chosen]


def farthest_first(pts: DataFrame, k: int) -> np.ndarray:
    """At most k centres, each the farthest from those before it, the first of the smallest id.

    One pass: each partition chooses k of its own points, and the driver chooses among those,
    at most k a partition (the composable core-set of the method, within a constant factor of
    k passes over all points; the same where there is one partition). Of equal points fewer come.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = np.empty(0, np.int64), None
        for batch in batches:
            if batch.num_rows:
                ids = np.concatenate((ids, batch.column(0).to_numpy()))
                x = _matrix(batch, 1) if x is None else np.concatenate((x, _matrix(batch, 1)))
                keep = _farthest(ids, x, k)
                ids, x = ids[keep], x[keep]
        if x is not None:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(list(x), pa.list_(pa.float64()))], ["id", "features"])

    rows = pts.select("id", "features").mapInArrow(run, "id bigint, features array<double>").collect()
    if not rows:
        return np.empty((0, 0))
    x = np.array([r["features"] for r in rows])
    return x[_farthest(np.array([r["id"] for r in rows]), x, k)]


def kmeans(pts: DataFrame, k: int, *, most_rounds: int = 100, shift: float = 1e-6) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """(id, features, cluster), centres: Lloyd's rounds from farthest-first centres until none moves by `shift`, or after `most_rounds`, as the method has it."""
    pts = cut(pts.select("id", "features"))
    centres = dict(enumerate(farthest_first(pts, k)))
    if not centres:
        return pts.withColumn("cluster", F.lit(0)), {}
    dims = len(centres[0])
    for _ in range(most_rounds):
        new = {r["cluster"]: np.array(r["sum"]) / r["n"] for r in summaries(assign(pts, centres), dims).collect()}
        moved = max(float(np.linalg.norm(new[c] - centres[c])) for c in new)
        centres = {**centres, **new}
        if moved < shift:
            break
    return cut(assign(pts, centres).drop("distance")), centres


class Summary:
    """Count, sum and sum of squares of a cluster."""

    def __init__(self, n: int, total: np.ndarray, squares: np.ndarray):
        self.n, self.sum, self.sumsq = n, total, squares

    @property
    def centre(self) -> np.ndarray:
        return self.sum / self.n

    @property
    def spread(self) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, self.sumsq / self.n - self.centre**2))

    def merged(self, other: Summary) -> Summary:
        return Summary(self.n + other.n, self.sum + other.sum, self.sumsq + other.sumsq)

    def distance(self, other: Summary) -> float:
        s = self.spread
        return float(np.sqrt((((other.centre - self.centre) / np.where(s > 0, s, 1.0)) ** 2).sum()))


def held_summaries(assigned: DataFrame, dims: int) -> dict[int, Summary]:
    return {r["cluster"]: Summary(r["n"], np.array(r["sum"]), np.array(r["sumsq"])) for r in summaries(assigned, dims).collect()}


def merge_compression(cs: dict[int, Summary], limit: float) -> dict[int, int]:
    """x -> y: x goes into the nearest larger y of a higher index, if that is within the limit and has absorbed none yet; no second choice, no chains."""
    into: dict[int, int] = {}
    for x in sorted(cs):
        if x in into.values():
            continue
        distance, y = min(((cs[y].distance(cs[x]), y) for y in cs if y > x and cs[y].n > cs[x].n), default=(limit, x))
        if distance < limit and y not in into.values():
            into[x] = y
    return into


def bfr(pts: DataFrame, rounds: list[DataFrame], k: int, *, sample: float = 0.7, seed: int = 11) -> tuple[DataFrame, list[dict[str, int]]]:
    """(id, cluster) of every point, outliers -1, and the counters of each round.

    rounds: the points in batches. Round one finds the discard clusters on a hashed sample
    after single points have gone to the retained set; each later batch goes to the nearest
    discard cluster within 2 sqrt(d) standard deviations, else the nearest compression
    cluster, else the retained set, and summaries change after the batch. The retained set is
    clustered again when it holds more than 3k points; compression clusters merge at the end
    of a round and into discard clusters at the end of the last.
    """
    head = pts.select(F.size("features")).head()
    if head is None:
        return pts.select("id", F.lit(-1).alias("cluster")), []
    dims = head[0]
    limit = 2 * math.sqrt(dims)
    ds: dict[int, Summary] = {}
    cs: dict[int, Summary] = {}
    home: dict[int, int] = {}  # compression cluster -> the one it went into
    fresh = 0
    counters: list[dict[str, int]] = []
    schema = pts.select("id", "features", F.lit(0).alias("cluster")).limit(0)
    discard, compressed, retained = schema, schema, pts.limit(0)

    def compress(part: DataFrame, clusters: int) -> tuple[DataFrame, DataFrame]:
        """Clusters of several points become compression clusters; the points of the others are returned."""
        nonlocal fresh
        assigned, _ = kmeans(part, clusters)
        found = {c: s for c, s in held_summaries(assigned, dims).items() if s.n > 1}
        number = {c: fresh + i for i, c in enumerate(sorted(found))}
        fresh += len(found)
        cs.update({number[c]: s for c, s in found.items()})
        if not number:
            return schema, assigned.drop("cluster")
        new = F.create_map(*[F.lit(x) for pair in number.items() for x in pair])[F.col("cluster")]
        renamed = assigned.withColumn("cluster", new)
        return renamed.where("cluster IS NOT NULL"), renamed.where("cluster IS NULL").drop("cluster")

    for i, batch in enumerate(rounds):
        batch = cut(batch.select("id", "features"))
        if i == 0:
            assigned, _ = kmeans(batch, 2 * k)
            single = [c for c, s in held_summaries(assigned, dims).items() if s.n == 1]
            alone = F.col("cluster").isin(single) if single else F.lit(False)
            retained = assigned.where(alone).drop("cluster")
            rest = assigned.where(~alone).drop("cluster")
            draw = F.xxhash64("id", F.lit(seed)).bitwiseAND((1 << 30) - 1) < int(sample * (1 << 30))
            discard, _ = kmeans(rest.where(draw), k)
            ds = held_summaries(discard, dims)
            compressed, left = compress(rest.where(~draw), 3 * k)
            retained = cut(retained.unionByName(left))
        else:
            left, taken = batch, []
            for held in (ds, cs):
                if held:
                    judged = cut(assign(left, {c: s.centre for c, s in held.items()}, {c: s.spread for c, s in held.items()}))
                    taken.append(judged.where(F.col("distance") < limit).drop("distance"))
                    left = judged.where(F.col("distance") >= limit).select("id", "features")
                else:
                    taken.append(schema)
            to_ds, to_cs = taken
            for held, part in ((ds, to_ds), (cs, to_cs)):
                for c, s in held_summaries(part, dims).items():
                    held[c] = held[c].merged(s)
            discard, compressed = discard.unionByName(to_ds), compressed.unionByName(to_cs)
            retained = cut(retained.unionByName(left))
        if retained.count() >= 3 * k + 1:
            more, left = compress(retained, 3 * k)
            compressed, retained = compressed.unionByName(more), cut(left)
        for x, y in merge_compression(cs, limit).items():
            cs[y] = cs[y].merged(cs.pop(x))
            home[x] = y
        if i == len(rounds) - 1 and ds:
            for x in sorted(cs):
                d, y = min((ds[y].distance(cs[x]), y) for y in ds)
                if d < limit:
                    ds[y] = ds[y].merged(cs.pop(x))
                    home[x] = -2 - y  # a discard cluster
        counters.append({"round": i + 1, "discard_clusters": len(ds), "discard_points": sum(s.n for s in ds.values()), "compression_clusters": len(cs), "compression_points": sum(s.n for s in cs.values()), "retained_points": retained.count()})
    final = {}
    for x in range(fresh):
        y = x
        while y in home:
            y = home[y]
        final[x] = -2 - y if y < -1 else -1
    label = F.create_map(*[F.lit(v) for pair in final.items() for v in pair])[F.col("cluster")] if final else F.lit(-1)
    out = discard.select("id", F.col("cluster").cast("int")).unionByName(compressed.select("id", F.coalesce(label, F.lit(-1)).cast("int").alias("cluster"))).unionByName(retained.select("id", F.lit(-1).alias("cluster")))
    return out, counters
