"""What is moved: rows, not the pairs that meet on a common item. And the same results from the blocks."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernmill.operators import profiles, recommend, similarity


def moved(spark, run):
    """Rows written to shuffles while `run()` works."""
    sc = spark.sparkContext._jsc.sc()
    gateway = spark.sparkContext._gateway

    def total():
        sc.listenerBus().waitUntilEmpty()
        stages = sc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    before = total()
    run()
    return total() - before


@pytest.fixture(scope="module")
def rated():
    """300 users of 9 items: one that all have, 8 of 40."""
    rng = np.random.default_rng(5)
    return [(f"u{u:03d}", i, float(s)) for u in range(300) for i, s in zip(["hub", *(f"i{k}" for k in rng.choice(40, 8, replace=False))], rng.integers(1, 6, 9))]


def by_user(rated):
    held = {}
    for u, i, s in rated:
        held.setdefault(u, {})[i] = s
    return held


def measured(rated, least, slope):
    for (a, x), (b, y) in itertools.combinations(sorted(by_user(rated).items()), 2):
        if len(both := sorted(x.keys() & y.keys())) >= least:
            v, w = (np.array([z[i] for i in both]) for z in (x, y))
            if v.var() > 1e-9 and (slope or w.var() > 1e-9):
                c = (v * w).mean() - v.mean() * w.mean()
                if (m := c / (v.var() if slope else v.std() * w.std())) > 1e-6:
                    yield a, b, m


@pytest.mark.parametrize("slope", [False, True])
def test_measures_move_rows_only(spark, rated, slope):
    df = spark.createDataFrame(rated, "u string, i string, s double")
    out = {}
    f = similarity.slope_pairs if slope else similarity.pearson_pairs
    n = moved(spark, lambda: out.update({(a, b): m for a, b, m in f(df, "u", "i", "s", min_common=5).collect()}))
    assert out == pytest.approx({(a, b): m for a, b, m in measured(rated, 5, slope)}, abs=1e-6) and out
    assert n < 12 * len(rated) + 6 * len(out)


@pytest.mark.parametrize("key, least", [("u", 5), ("i", 1)])
def test_banded_pairs_move_rows_only(spark, rated, key, least):
    """Users with an item that all have; many keys on few hash values."""
    rows = [(u, i) for u, i, _ in rated] if key == "u" else [(f"k{n:04d}", f"v{(n * m) % 701}") for n in range(3000) for m in (1, 2)]
    df = spark.createDataFrame(rows, "k string, v string")
    out = []
    n = moved(spark, lambda: out.extend(similarity.lsh_jaccard(df, "k", "v", 0.2, least).select("a", "b").collect()))
    exact = similarity.common_counts(df, "k", "v", least, 0.2).select("a", "b")
    bands = similarity.lsh_pairs(similarity.minhash_signatures(df, "k", "v"), "k", 35)
    assert sorted(out) == sorted(exact.join(bands, ["a", "b"], "left_semi").collect()) and out
    assert n < 15 * len(rows) + 6 * len(out)


@pytest.mark.parametrize("threshold", [0.0, 0.3])
def test_blocks_brute_force(spark, rated, threshold):
    held = by_user(rated[:540])
    df = spark.createDataFrame([(u, i) for u, items in held.items() for i in items], "k string, i string")
    for least, blocks in ((1, 1), (3, 4)):
        found, names = similarity.shared_in_blocks(df, least, threshold, blocks)
        got = {tuple(r) for r in similarity._named(found, names).select("a", "b", "n_common", "n_a", "n_b").collect()}
        sets = {u: set(items) for u, items in held.items()}
        pairs = ((a, b, len(sets[a] & sets[b])) for a, b in itertools.combinations(sorted(sets), 2))
        assert got == {(a, b, n, 9, 9) for a, b, n in pairs if n >= least and n / (18 - n) >= threshold}


@pytest.mark.parametrize("what", ["lsh", "slope"])
def test_found_pairs_are_not_moved(spark, what):
    """300 users of 9 out of 14 items: all 44,850 pairs have 4 or more in common, 17 times the rows."""
    rng = np.random.default_rng(7)
    rows = [(f"u{u:03d}", f"i{k}", float(s)) for u in range(300) for k, s in zip(rng.choice(14, 9, replace=False), rng.integers(1, 6, 9))]
    df = spark.createDataFrame(rows, "k string, v string, s double")
    f = {"lsh": lambda: similarity.lsh_jaccard(df, "k", "v", 0.01, 3), "slope": lambda: similarity.slope_pairs(df, "k", "v", "s")}[what]
    out = []
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        n = moved(spark, lambda: out.extend(map(tuple, f().collect())))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    if what == "lsh":
        exact = similarity.common_counts(df, "k", "v", 3, 0.01).select("a", "b", similarity.jaccard().alias("similarity"))
        bands = similarity.lsh_pairs(similarity.minhash_signatures(df, "k", "v"), "k", 35)
        assert sorted(out) == sorted(map(tuple, exact.join(bands, ["a", "b"], "left_semi").collect()))
    else:
        assert {(a, b): m for a, b, m in out} == pytest.approx({(a, b): m for a, b, m in measured(rows, 3, True)}, abs=1e-6)
    assert len(out) > 15_000 and n < 15 * len(rows)


def test_prediction_meets_similar_users_only(spark):
    """An item that all of 2,000 users rated, wanted by 100, with one similar user each."""
    rated = spark.range(2000).select(F.format_string("u%04d", "id").alias("user_id"), F.lit("hub").alias("business_id"), (1.0 + F.col("id") % 4).alias("stars"))
    model = spark.createDataFrame([(f"u{2 * k:04d}", f"u{2 * k + 1:04d}", 0.5) for k in range(100)], "a string, b string, sim double")
    wanted = spark.createDataFrame([(f"u{2 * k:04d}", "hub") for k in range(100)], "user_id string, business_id string")
    out = []
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        n = moved(spark, lambda: out.extend(recommend.user_predictions(rated, rated, model, wanted).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # a neighbour's only rating is compared with itself: no move
    assert sorted(map(tuple, out)) == [(f"u{2 * k:04d}", "hub", 1.0 + 2 * k % 4) for k in range(100)]
    assert n < 20000


def test_profile_sizes_move_no_profiles(spark):
    """200 users of 30 documents each of 50 words: 300,000 (user, word) rows before they are made distinct."""
    rng = np.random.default_rng(3)
    words = {f"d{k}": {f"w{j}" for j in rng.choice(2000, 50, replace=False)} for k in range(60)}
    has = {f"u{k}": {f"d{j}" for j in rng.choice(62, 30, replace=False)} for k in range(200)}
    profile = spark.createDataFrame([(d, w) for d, held in words.items() for w in held], "doc string, word string")
    seen = spark.createDataFrame([(u, d) for u, held in has.items() for d in held], "user string, doc string")
    out = []
    n = moved(spark, lambda: out.extend(map(tuple, profiles.profile_sizes(profile, seen, "user", "doc", most_rows=4000).collect())))
    own = {u: set().union(*(words.get(d, ()) for d in held)) for u, held in has.items()}
    assert sorted(out) == sorted((u, len(w), min(w), max(w)) for u, w in own.items())
    assert n < 100_000
