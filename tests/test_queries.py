"""Every query with SQL against DuckDB, and the others for their invariants."""

import os

import pytest

from quernmill.plans import problems, reference
from tests.helpers import FOLDER, check

SQL = {**reference.ORACLE, **problems.ORACLE}
QUERIES = {**reference.QUERIES, **problems.QUERIES}
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    check(spark, QUERIES[name], SQL[name])


def test_the_rest(spark):
    points = spark.read.parquet(f"{FOLDER}/embeddings.parquet").count()
    assert reference.bfr_assignment(spark, FOLDER).select("id").distinct().count() == points
    found = problems.p1_found(spark, FOLDER)
    assert found.columns == ["business_id", "pos", "category"] and found.count() > 0
    filled = problems.p5_filled(spark, FOLDER)
    for r in problems.p5_quality(spark, FOLDER.replace("0.001", "0.1")).collect():
        assert r["error_fit"] < r["error_mean"] and r["correlation"] > 0 and r["n_hidden"] > 100
        assert abs(r["spread_drawn"] - r["spread_true"]) < 0.05 * r["spread_true"]
    assert filled.where("avg_stars is null or isnan(avg_stars) or avg_stars not between 1 and 5").count() == 0
    assert reference.hybrid_blend(spark, FOLDER).where("stars is null").count() == 0


def test_candidates_hold_all_that_lsh_confirms(spark):
    folder = FOLDER.replace("0.001", "0.01")
    confirmed = {(r["a"], r["b"]) for r in reference.lsh_jaccard(spark, folder).collect()}
    candidates = {(r["a"], r["b"]) for r in reference.lsh_candidates(spark, folder).collect()}
    assert confirmed <= candidates and len(confirmed) > 1000


def test_entry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_points_with_negative_ids_come_into_a_round(spark, monkeypatch):
    rows = [(i, [float(i % 3), float(i % 7)]) for i in range(-20, 20)]
    monkeypatch.setattr(reference, "_points", lambda s, _: s.createDataFrame(rows, "id long, features array<double>"))
    monkeypatch.setattr(reference.clustering, "bfr", lambda pts, rounds, k: (rounds, k))
    ids = [r["id"] for part in reference._bfr(spark, "")[0] for r in part.collect()]
    assert sorted(ids) == list(range(-20, 20))
