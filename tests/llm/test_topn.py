import math

import numpy as np
from pyspark.sql import functions as F

from quernmill.llm.topn import top_n


def test_against_sorting(spark):
    rng = np.random.default_rng(5)
    rows = [(f"g{int(g)}", float(s) / 2, i, "old") for i, (g, s) in enumerate(zip(rng.zipf(1.5, 600) % 9, rng.integers(0, 12, 600)))]
    rows += [("g1", None, 9001, "old"), ("few", math.nan, 9002, "old"), ("few", None, 9003, "old"), ("few", 1.0, 9004, "old"), (None, 5.0, 9005, "old")]
    df = spark.createDataFrame(rows, "g string, score double, id bigint, rank string").repartition(4)
    got = top_n(df, ["g"], "score", 3, ties=[F.col("id").asc()])
    assert got.columns == [*df.columns, "rank_"]
    wanted = set()
    for g in {r[0] for r in rows if r[0]}:
        own = [r for r in rows if r[0] == g]
        own.sort(key=lambda r: (2 if r[1] is None else 1 if math.isnan(r[1]) else 0, 0 if r[1] is None or math.isnan(r[1]) else -r[1], r[2]))
        wanted |= {(g, r[2], k) for k, r in enumerate(own[:3], 1)}
    assert {(r["g"], r["id"], r["rank_"]) for r in got.collect()} == wanted


def test_edges(spark):
    df = spark.createDataFrame([], "g string, score double")
    assert top_n(df, ["g"], "score", 2, ties=[]).count() == 0
    alike = spark.createDataFrame([("g", 1.0)] * 50, "g string, score double")
    assert top_n(alike, ["g"], "score", 2, ties=[]).count() == 2
