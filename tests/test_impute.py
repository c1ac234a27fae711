import math

from pyspark.sql import functions as F

from quernmill.operators.impute import chained_impute


def test_fills_from_like_records(spark):
    rows = []
    for i in range(1200):
        state = "AB"[i % 2]
        value = (2.0 if state == "A" else 4.0) + ((i * 37) % 11 - 5) / 50
        bad = [None, float("nan"), float("inf"), 99.0, -1.0][i % 5] if i % 10 == 3 or i % 10 == 6 else value
        rows.append((f"u{i}", bad, None if i % 17 == 0 else state, i % 7, "kept", state))
    df = spark.createDataFrame(rows, "id string, stars double, state string, n bigint, stars_filled string, truth string")
    got = chained_impute(df, "id", numeric={"stars": (1.0, 5.0)}, categorical=["state"], predictors=["n"]).cache()
    assert got.columns == [*df.columns, "stars_filled_", "state_filled"]
    assert got.count() == 1200 and got.where("stars is null or isnan(stars) or stars < 1 or stars > 5 or state is null").count() == 0
    assert got.where("stars_filled_").count() == sum(not (r[1] is not None and 1 <= r[1] <= 5) for r in rows)
    means = dict(got.where("stars_filled_ and not state_filled").groupBy("truth").agg(F.avg("stars")).collect())
    assert abs(means["A"] - 2) < 0.3 and abs(means["B"] - 4) < 0.3
    assert got.where("stars_filled_").select(F.stddev("stars")).head()[0] > 0.1
    states = got.where("state_filled and not stars_filled_")
    assert states.where("state = truth").count() >= 0.9 * states.count()
    # given values stay
    again = {r["id"]: r["stars"] for r in got.where("not stars_filled_").collect()}
    assert all(again[r[0]] == r[1] for r in rows if r[0] in again)


def test_edges(spark):
    schema = "id string, stars double, state string, __key string"
    empty = spark.createDataFrame([], schema)
    assert chained_impute(empty, "id", numeric={"stars": (1.0, 5.0)}, categorical=["state"]).count() == 0
    nothing = spark.createDataFrame([("a", None, None, "x"), ("a", math.nan, " ", "y"), (None, None, "", None)], schema)
    got = chained_impute(nothing, "id", numeric={"stars": (1.0, 5.0)}, categorical=["state"]).collect()
    assert [r["stars"] for r in got] == [3.0] * 3 and all(r["state"] is None for r in got)
    assert sorted(str(r["__key"]) for r in got) == ["None", "x", "y"]
    one = spark.createDataFrame([("a", 2.0, "S", "x"), ("b", None, None, "y")], schema)
    got = {r["id"]: r for r in chained_impute(one, "id", numeric={"stars": (1.0, 5.0)}, categorical=["state"]).collect()}
    assert got["b"]["state"] == "S" and 1 <= got["b"]["stars"] <= 5
