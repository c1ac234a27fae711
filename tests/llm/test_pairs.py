import itertools

import numpy as np
import pytest

from quernmill.llm.pairs import co_occurrences
from quernmill.llm.setjoin import expand_pairs, similar_sets, trees_for


def sets_to_frame(spark, sets):
    rows = [(k, v, "x", 1) for k, s in sets.items() for v in s]
    return spark.createDataFrame([*rows, *rows[:50], (None, "v1", "x", 1), ("k1", None, "x", 1)], "key string, value string, code string, n int").repartition(5)


def random_sets(n=120, seed=3):
    rng = np.random.default_rng(seed)
    sets = {f"k{i}": {f"v{v}" for v in rng.integers(0, 60, rng.integers(1, 14))} for i in range(n)}
    for i in range(0, n, 3):
        sets[f"k{i}"].add("hot")
    for i in range(0, n - 1, 4):  # near copies and copies
        sets[f"k{i + 1}"] = set(sets[f"k{i}"]) | ({"extra"} if i % 8 else set())
    return sets


@pytest.mark.parametrize("largest", [2000, 6])
def test_co_occurrences(spark, largest):
    baskets = random_sets()
    items = sorted(set().union(*baskets.values()))
    held = {i: {b for b, s in baskets.items() if i in s} for i in items}
    n = len(baskets)
    wanted = {}
    for a, b in itertools.combinations(items, 2):
        both = len(held[a] & held[b])
        if both >= 3 and both * n >= 1.1 * len(held[a]) * len(held[b]):
            wanted[a, b] = (both, len(held[a]), len(held[b]))
    got = co_occurrences(sets_to_frame(spark, baskets), "key", "value", min_together=3, min_lift=1.1, largest_basket=largest).collect()
    assert len(got) == len(wanted) > 10
    assert {(r["item_a"], r["item_b"]): (r["n_both"], r["n_a"], r["n_b"]) for r in got} == wanted
    for r in got:
        ab, na, nb = wanted[r["item_a"], r["item_b"]]
        assert r["lift"] == pytest.approx(ab * n / (na * nb))
        assert r["log_odds"] == pytest.approx(np.log((ab + 0.5) * (n - na - nb + ab + 0.5) / ((na - ab + 0.5) * (nb - ab + 0.5))))


def test_codes_beyond_31_bits(spark):
    """The first of two packed codes fills the sign bit from 2 ** 31 on."""
    import pyarrow as pa

    from quernmill.llm import pairs

    codes = [5, 1 << 31, (1 << 32) - 1]
    batch = pa.RecordBatch.from_arrays([pa.array([codes, codes], pa.list_(pa.int64()))], ["codes"])
    runs = [(c, n) for b in pairs._pair_runs(iter([batch])) for c, n in zip(*(x.to_pylist() for x in b.columns))]
    got = spark.createDataFrame(runs, "code bigint, n bigint").select(*pairs._unpacked(), "n").collect()
    assert sorted(map(tuple, got)) == [(a, b, 2) for a, b in itertools.combinations(codes, 2)]


def test_large_records(spark):
    """Records beyond largest_basket alone and with small ones, at every least count; one of 100,000 items."""
    baskets = {f"b{i}": {f"i{j}" for j in range(i, i + (30 if i % 2 else 4))} for i in range(12)}
    items = sorted(set().union(*baskets.values()))
    for least in (1, 2):
        wanted = {(a, b, n) for a, b in itertools.combinations(items, 2) if (n := sum(a in s and b in s for s in baskets.values())) >= least}
        got = co_occurrences(sets_to_frame(spark, baskets), "key", "value", min_together=least, largest_basket=10)
        assert {(r["item_a"], r["item_b"], r["n_both"]) for r in got.collect()} == wanted
    huge = spark.range(100_000).selectExpr("'huge' AS key", "concat('i', id) AS value").union(spark.createDataFrame([("small", "i1"), ("small", "i2"), ("huge2", "i1"), ("huge2", "i2")], "key string, value string"))
    assert [(r["item_a"], r["item_b"], r["n_both"]) for r in co_occurrences(huge, "key", "value", min_together=2).collect()] == [("i1", "i2", 3)]
    with pytest.raises(ValueError, match="pairs"):
        co_occurrences(huge, "key", "value", most_pairs=1_000_000)


def test_co_occurrences_of_nothing(spark):
    df = spark.createDataFrame([], "key string, value string")
    assert co_occurrences(df, "key", "value").count() == 0
    one = spark.createDataFrame([("a", "x"), ("a", "x")], "key string, value string")
    assert co_occurrences(one, "key", "value").count() == 0


@pytest.mark.parametrize("options", [{}, {"leaf": 8}, {"leaf": 4, "depth": 1}, {"largest_set": 7}])
def test_similar_sets(spark, options):
    sets = random_sets()
    wanted = set()
    for a, b in itertools.combinations(sorted(sets), 2):
        if min(len(sets[a]), len(sets[b])) >= 3 and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.4:
            wanted.add((a, b, len(sets[a] & sets[b])))
    pairs, members = similar_sets(sets_to_frame(spark, sets), "key", "value", threshold=0.4, min_size=3, **options)
    got = {(r["key_a"], r["key_b"], r["n_both"]) for r in expand_pairs(pairs, members).collect()}
    assert got <= wanted and len(got) >= 0.99 * len(wanted) > 10


@pytest.mark.parametrize("threshold", [0.4, 0.5])
def test_similar_sets_that_run_out_of_tokens(spark, threshold):
    """Few shared tokens, all of them in large nodes, with the default min_size: every pair must come."""
    sets = {"a": {"a"}, "ab": {"a", "b"}, "abc": {"a", "b", "c"}, "copy": {"a"}}
    for i in range(25):
        sets[f"one{i}"] = {"a", f"x{i}"}
        sets[f"two{i}"] = {"a", "b", f"y{i}"}
        sets[f"more{i}"] = {"a", "b", f"x{i}", f"y{(i + 1) % 25}"}
    wanted = {(a, b, len(sets[a] & sets[b])) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}
    pairs, members = similar_sets(sets_to_frame(spark, sets), "key", "value", threshold=threshold, leaf=6)
    got = [(r["key_a"], r["key_b"], r["n_both"]) for r in expand_pairs(pairs, members).collect()]
    assert len(got) == len(set(got)) and set(got) == wanted and len(wanted) > 100


def test_similar_sets_of_nothing(spark):
    df = spark.createDataFrame([], "key string, value string")
    assert expand_pairs(*similar_sets(df, "key", "value", threshold=0.5)).count() == 0
    same = spark.createDataFrame([(k, v) for k in "abc" for v in "xy"], "key string, value string")
    assert expand_pairs(*similar_sets(same, "key", "value", threshold=1.0)).count() == 3


def test_trees():
    assert trees_for(0.9999, 3) > trees_for(0.9999, 1) > trees_for(0.9, 1) >= 1
