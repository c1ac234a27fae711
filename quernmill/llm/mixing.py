"""Mixing sources to target weights, with capped repeats, by pivotal dependent rounding."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernmill.session import cut

_UNITS = "source string, bucket bigint, id string, p double, size double, draw double, settled boolean"


def _step(p: float, x: float, q: float, y: float, draw: float) -> tuple[float, float]:
    """Moves mass between two copy probabilities so that p*x + q*y stays, both means stay, and one becomes 0 or 1."""
    up = min((1 - p) * x, q * y)
    down = min(p * x, (1 - q) * y)
    d = up if draw * (up + down) < down else -down
    p, q = p + d / x, q - d / y
    settle = lambda v: 0.0 if v < 1e-9 else 1.0 if v > 1 - 1e-9 else v
    return settle(p), settle(q)


def _pivot(batches: Iterator[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
    """Settles all units of a (source, bucket) but one at most; `last` settles that by its own draw."""
    group, rest = None, None
    for batch in batches:
        out: list[tuple] = []
        for source, bucket, id_, p, size, draw, _ in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
            if (source, bucket) != group:
                if rest:
                    out.append(_left(rest, last))
                group, rest = (source, bucket), None
            if rest is None:
                rest = [source, bucket, id_, p, size, draw, False]
                continue
            a, b = _step(rest[3], rest[4], p, size, draw)
            unit = [source, bucket, id_, b, size, draw, False]
            rest[3] = a
            open_units = []
            for u in (rest, unit):
                if u[3] in (0.0, 1.0):
                    out.append((*u[:6], True))
                else:
                    open_units.append(u)
            rest = open_units[0] if open_units else None
            if len(open_units) == 2:  # can't be but for rounding
                out.append(_left(unit, True))
        if out:
            yield _units(out)
    if rest:
        yield _units([_left(rest, last)])


def _left(u: list, last: bool) -> tuple:
    return (*u[:3], float(u[5] < u[3]), *u[4:6], True) if last else tuple(u)


def _units(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["source", "bucket", "id", "p", "size", "draw", "settled"])


def normal_source(column: str = "source"):
    """A source is trimmed and in lower case; empty ones are none."""
    c = F.lower(F.trim(F.col(column)))
    return F.when(c != "", c)


def mix_sources(records: DataFrame, targets: DataFrame, *, key: str = "doc_id", bucket_size: int = 20_000, fan_in: int = 32, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Copies of each record and a report by source, as (copies, report).

    records: `key` (unique), source, tokens; targets: source, target_weight, max_repeats.
    Weights that are null, NaN, infinite or not above 0 count as 0; several rows of one source
    add their weights and take the least max_repeats; a null max_repeats sets no cap, one
    below 0 counts as 0. Sources without positive weight, and records without source, aren't mixed.

    w is the share of the positive weights, t a source's tokens, T their sum over sources with
    positive weight. A source is wanted w * T / t times, at most max_repeats times; it is
    capped where t * max_repeats < w * T (so a source without records is). Each record gets
    the whole part of that as copies; the fraction is rounded to 0 or 1 by weighted pivotal
    steps that keep the source's tokens. They run in buckets of about `bucket_size` records, as many as
    a source needs; what each leaves open meets in a reduction tree of `fan_in`, and one draw a source settles the rest,
    so a source is off its target by less than one record. The same seed gives the same copies.

    copies: key, source, tokens, copies. report: source, weight, max_repeats, tokens,
    target_tokens, capped, mixed_tokens, target_share, actual_share. Empty tables give no copies. Records without key or tokens get whole parts
    only; rows that repeat a key get the same copies, which may be one too many.
    """
    weight = F.when(F.col("target_weight").isNotNull() & ~F.isnan("target_weight") & (F.col("target_weight") > 0) & (F.col("target_weight") < float("inf")), F.col("target_weight")).otherwise(0.0)
    wanted = targets.select(normal_source().alias("source"), weight.alias("weight"), F.greatest("max_repeats", F.lit(0)).alias("max_repeats"), F.col("max_repeats").isNull().alias("free")).where(F.col("source").isNotNull())
    wanted = wanted.groupBy("source").agg(F.sum("weight").alias("weight"), F.when(F.every("free"), F.lit(None)).otherwise(F.min("max_repeats")).alias("max_repeats")).where(F.col("weight") > 0)
    own = records.select(F.col(f"`{key}`"), normal_source().alias("source"), F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens")).where(F.col("source").isNotNull())
    per_source = wanted.join(own.groupBy("source").agg(F.sum("tokens").alias("t"), F.count("*").alias("k")), "source", "left").withColumns({"t": F.coalesce("t", F.lit(0)), "k": F.coalesce("k", F.lit(0))})
    # one row a row of targets, and no more: a setting, not data
    rows = [r.asDict() for r in per_source.collect()]
    spark = records.sparkSession
    all_weight, all_tokens = sum(r["weight"] for r in rows), sum(r["t"] for r in rows)
    plan = []
    for r in rows:
        target = r["weight"] / all_weight * all_tokens
        most = r["max_repeats"]
        rate = 0.0 if not r["t"] else target / r["t"]
        capped = most is not None and r["t"] * most < target
        plan.append((r["source"], r["weight"], most, r["t"], target, capped, float(min(rate, most) if most is not None else rate), -(-r["k"] // bucket_size) or 1))
    widths = plan
    plan = spark.createDataFrame(plan, "source string, weight double, max_repeats int, tokens bigint, target_tokens double, capped boolean, rate double, width bigint")
    rated = own.join(F.broadcast(plan.select("source", "rate", "width")), "source")
    whole = F.floor(F.col("rate") + 1e-9)
    rated = cut(rated.select(F.col(f"`{key}`").alias("__key"), "source", "tokens", "width", whole.alias("whole"), F.greatest(F.col("rate") - whole, F.lit(0.0)).alias("p")))
    uniform = lambda *c: F.xxhash64(*c, F.lit(seed)).bitwiseAND((1 << 53) - 1) / F.lit(float(1 << 53))
    some = (F.col("p") > 1e-9) & (F.col("tokens") > 0) & F.col("__key").isNotNull()
    units = rated.where(some).select("source", F.pmod(F.xxhash64("__key", F.lit(seed + 1)), F.col("width")).alias("bucket"), F.col("__key").cast("string").alias("id"), "p", F.col("tokens").cast("double").alias("size"), uniform("__key").alias("draw"), F.lit(False).alias("settled"))
    done, width = None, max((p[7] for p in widths), default=1)
    while True:
        last = width == 1
        stage = cut(units.repartition("source", "bucket").sortWithinPartitions("source", "bucket", "id").mapInArrow(lambda b, last=last: _pivot(b, last), _UNITS))
        settled = stage.where("settled AND p = 1").select("id")
        done = settled if done is None else done.unionByName(settled)
        if last:
            break
        width = max(1, width // fan_in)
        units = stage.where(~F.col("settled")).withColumn("bucket", F.pmod("bucket", F.lit(width)))
    done = done.distinct().withColumn("one", F.lit(1))
    copies = cut(rated.join(done, F.col("__key").cast("string") == F.col("id"), "left").select(F.col("__key").alias(key), "source", "tokens", (F.col("whole") + F.coalesce("one", F.lit(0))).cast("bigint").alias("copies")))
    mixed = copies.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"))
    report = plan.drop("rate", "width").join(F.broadcast(mixed), "source", "left").withColumn("mixed_tokens", F.coalesce("mixed_tokens", F.lit(0)).cast("bigint"))
    total = copies.agg(F.sum(F.col("tokens") * F.col("copies"))).head()[0] or 0
    report = report.withColumns({"target_share": F.col("weight") / F.lit(float(all_weight or 1)), "actual_share": F.col("mixed_tokens") / F.lit(float(total or 1))})
    return copies, report
