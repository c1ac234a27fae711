import os

import pytest

from quernmill.functions.packed import split_scalar
from quernmill.llm import queries
from tests.helpers import FOLDER, check

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, name):
    check(spark, queries.QUERIES[name], queries.ORACLE[name])


def test_best_of_each_category(spark):
    folder = FOLDER.replace("0.001", "0.01")
    reviews = spark.read.parquet(f"{folder}/review.parquet").select("review_id", "business_id", "stars").distinct().toPandas()
    stars = {}
    for r in reviews.itertuples():
        if r.business_id and r.stars is not None and 1 <= r.stars <= 5:
            stars.setdefault(r.business_id, {})[r.review_id] = r.stars
    groups = {}
    for r in spark.read.parquet(f"{folder}/business.parquet").collect():
        for c in split_scalar(r["categories"]):
            if len(stars.get(r["business_id"], ())) >= 3:
                v = list(stars[r["business_id"]].values())
                groups.setdefault(c, set()).add((-sum(v) / len(v), -len(v), r["business_id"]))
    wanted = {(c, b) for c, g in groups.items() for _, _, b in sorted(g)[:3]}
    assert {tuple(r) for r in queries.p7_found(spark, folder).collect()} == wanted


def test_mix_and_ids(spark):
    ids = {r["doc_id"]: r["ids"] for r in queries.p8_ids(spark, FOLDER).collect()}
    report = {r["source"]: r for r in queries.p9_report(spark, FOLDER).collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    assert len(ids) == len(docs)
    tokens = {}
    for d in docs:
        s = (d["source"] or "").strip().lower()
        tokens[s] = tokens.get(s, 0) + len(ids[d["doc_id"]])
    assert all(r["tokens"] == tokens.get(s, 0) for s, r in report.items())
    targets = [r for r in spark.read.parquet(f"{FOLDER}/mix_targets.parquet").collect() if r["target_weight"] and r["target_weight"] > 0]
    weight, total = sum(r["target_weight"] for r in targets), sum(tokens.get(r["source"], 0) for r in targets)
    wanted = {r["source"] for r in targets if tokens.get(r["source"], 0) * r["max_repeats"] < r["target_weight"] / weight * total}
    assert {r["source"] for r in queries.p9_found(spark, FOLDER).collect()} == wanted
