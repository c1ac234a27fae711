"""Small cases with answers worked out by hand."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernmill.functions.hashing import string_mod, trailing_zeros
from quernmill.operators import clustering, codes, graph, itemsets, profiles, recommend, relational, similarity, sketches


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_category_average(spark):
    business = spark.createDataFrame([("b1", "A, B"), ("b2", None), ("b3", "A")], "business_id string, categories string")
    reviews = spark.createDataFrame([("b1", 5.0), ("b2", 1.0), ("b3", 3.0)], "business_id string, stars double")
    assert [tuple(r) for r in relational.category_average(reviews, business).collect()] == [("B", 5.0), ("A", 4.0)]
    assert relational.category_average(reviews.limit(0), business).count() == 0


def test_review_stats_and_words(spark):
    reviews = spark.createDataFrame([("u", "2018-01-01", "The cat! (the hat)"), (None, "1999-01-01", None), ("u", None, "")], "user_id string, date string, text string")
    assert got(relational.review_stats(reviews, "20")) == [(3, 1, 2)]
    stop = spark.createDataFrame([("hat",)], "word string")
    assert [tuple(r) for r in relational.top_words(reviews, stop, 5).collect()] == [("the", 2), ("cat", 1)]


def test_partition_report(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("business_id"))
    report = relational.partition_report(df, "business_id", 7).collect()
    assert len(report) == 7 and sum(r["n_items"] for r in report) == 100


def test_codes(spark):
    df = spark.createDataFrame([(x,) for x in "dacbe"], "v string")
    assert sorted(r["code"] for r in codes.dense_codes(df).collect()) == [0, 1, 2, 3, 4]
    assert got(codes.ordered_codes(df, "v")) == [("a", 0), ("b", 1), ("c", 2), ("d", 3), ("e", 4)]
    assert codes.dense_codes(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def baskets(spark):
    sets = {"p": [1, 2, 3, 4], "q": [1, 2, 3, 4], "r": [1, 2, 3, 4], "s": [1, 5], "t": [5]}
    return spark.createDataFrame([(b, str(i)) for b, items in sets.items() for i in items], "basket string, item string")


@pytest.mark.parametrize("search", [itemsets.frequent_itemsets, itemsets.son_itemsets, itemsets.fpgrowth_itemsets])
def test_itemsets(baskets, search):
    found = {tuple(r["items"]): r["freq"] for r in search(baskets, 3).collect()}
    wanted = {c: 4 if c == ("1",) else 3 for k in range(1, 5) for c in itertools.combinations("1234", k)}
    assert found == wanted


@pytest.mark.parametrize("direct", [True, False])
def test_common_counts_brute_force(spark, monkeypatch, direct):
    monkeypatch.setattr(similarity, "_cheap", lambda held: direct)
    rng = np.random.default_rng(1)
    sets = {f"k{i}": {f"i{j}" for j in rng.integers(0, 12, rng.integers(1, 9))} | ({"hot"} if i % 3 else set()) for i in range(40)}
    df = spark.createDataFrame([(k, i) for k, s in sets.items() for i in s] * 2 + [(None, "i1"), ("k1", None)], "k string, i string")
    for least in (1, 3):
        wanted = sorted((a, b, len(sets[a] & sets[b])) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= least)
        assert got(similarity.common_counts(df, "k", "i", least).select("a", "b", "n_common")) == wanted
        for t in (0.07, 0.4):
            near = [(a, b, n) for a, b, n in wanted if n / len(sets[a] | sets[b]) >= t]
            assert got(similarity.common_counts(df, "k", "i", least, t).select("a", "b", "n_common")) == near


@pytest.mark.parametrize("direct", [True, False])
def test_pearson_and_slope(spark, monkeypatch, direct):
    monkeypatch.setattr(similarity, "_cheap", lambda held: direct)
    flat = spark.createDataFrame([(u, b, float(s)) for u, b, s in [("x", 1, 1), ("x", 2, 1), ("x", 3, 1), ("y", 1, 2), ("y", 2, 3), ("y", 3, 4)]], "u string, b int, s double")
    assert similarity.pearson_pairs(flat, "u", "b", "s").count() == 0
    rows = [("u1", 1, 1.0), ("u1", 2, 2.0), ("u1", 3, 4.0), ("u2", 1, 2.0), ("u2", 2, 5.0), ("u2", 3, 4.0)]
    df = spark.createDataFrame(rows, "u string, b int, s double")
    assert got(similarity.slope_pairs(df, "u", "b", "s")) == [("u1", "u2", 0.5)]
    assert got(similarity.pearson_pairs(df, "u", "b", "s")) == [("u1", "u2", 0.5)]


def test_lsh_is_part_of_exact(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(f"k{i}", f"v{v}") for i in range(30) for v in rng.integers(0, 25, 8)], "k string, v string")
    lsh, exact = (set(got(f(df, "k", "v", 0.2).select("a", "b"))) for f in (similarity.lsh_jaccard, similarity.jaccard_pairs))
    bands = set(got(similarity.lsh_pairs(similarity.minhash_signatures(df, "k", "v"), "k", 35)))
    assert lsh == exact & bands and lsh
    # the same where every bucket is hot and is split by prefix items
    for hot in (1, 3):
        assert lsh == set(got(similarity.lsh_jaccard(df, "k", "v", 0.2, hot=hot).select("a", "b")))
    two = set(got(similarity.lsh_jaccard(df, "k", "v", 0.5, rows=2).select("a", "b")))
    strict = set(got(similarity.jaccard_pairs(df, "k", "v", 0.5).select("a", "b")))
    assert two == strict & set(got(similarity.lsh_pairs(similarity.minhash_signatures(df, "k", "v"), "k", 35, 2))) and two


def test_profiles(spark):
    docs = spark.createDataFrame([("d1", "apple apple pear"), ("d2", "plum"), ("d2", "pear!"), ("d3", None), (None, "x")], "doc string, text string")
    top = profiles.tfidf_top(docs, "doc", "text")
    assert got(top) == [("d1", "apple", 1.0), ("d1", "pear", 0.0), ("d2", "pear", 0.0), ("d2", "plum", 1.0)]
    seen = spark.createDataFrame([("u", "d1"), ("u", "d1"), ("v", "d2")], "user string, d string")
    users = profiles.user_profiles(top, seen, "user", "d")
    wanted = spark.createDataFrame([("u", "d2"), ("u", "none"), ("w", "d1")], "user string, d string")
    assert got(profiles.profile_cosine(users, top, wanted, "user", "d")) == [("u", "d2", 0.5)]


def test_joined_texts(spark):
    docs = spark.createDataFrame([("d", "b", 2), ("d", "a", 1), ("d", None, 3), (None, "x", 1), ("e", "", 1)], "doc string, text string, at int")
    assert got(profiles.joined_texts(docs, "doc", "text", "at")) == [("d", "a b"), ("e", "")]
    assert got(profiles.joined_texts(docs, "doc", "text", "at", compat=True)) == [("d", "ab"), ("e", "")]


def test_blend_keeps_the_trees_rows(spark):
    near = spark.createDataFrame([("u", "a", 5.0), ("u", "a", 5.0), ("x", "y", 1.0)], "user_id string, business_id string, stars double")
    tree = spark.createDataFrame([("u", "a", 2.5), ("v", "a", 3.0)], "user_id string, business_id string, prediction double")
    assert got(recommend.blend(near, tree)) == [("u", "a", 3.0), ("v", "a", 3.0)]


def test_merge_takes_the_nearest_only():
    at = lambda n, x: clustering.Summary(n, np.array([n * x]), np.array([n * (x * x + 1.0)]))
    # 0 and 1 are nearest to 3; 3 absorbs one, and 1 takes no second choice though 2 is within the limit
    assert clustering.merge_compression({0: at(2, 0.0), 1: at(2, 0.2), 2: at(5, 2.0), 3: at(5, 0.5)}, 4.0) == {0: 3}


def test_small_components_are_spread(spark, monkeypatch):
    edges = spark.createDataFrame([(f"a{i}", f"b{i}") for i in range(400)], "src string, dst string")
    places = []
    spread = type(edges).repartition

    def watched(self, *columns):
        out = spread(self, *columns)
        if "slice" in columns:
            places.append(len({r[0] for r in out.select(F.spark_partition_id()).collect()}))
        return out

    monkeypatch.setattr(type(edges), "repartition", watched)
    assert graph.edge_betweenness(edges).where("betweenness = 1").count() == 400 and places[0] > 100


def test_predictions(spark):
    rated = spark.createDataFrame([("u", "a", 4.0), ("u", "b", 2.0), ("v", "a", 5.0), ("v", "b", 3.0), ("v", "c", 4.0)], "user_id string, business_id string, stars double")
    model = spark.createDataFrame([("a", "c", 0.5), ("b", "c", 0.25)], "a string, b string, sim double")
    test = spark.createDataFrame([("u", "c"), ("u", "c"), ("x", "c"), ("u", None), ("x", "zzz")], "user_id string, business_id string")
    items = recommend.item_predictions(rated, model, test)
    assert got(items) == [("u", "c", round((0.5 * 4 + 0.25 * 2) / 0.75, 6))]
    assert got(recommend.with_fallback(rated, items, test)) == [("u", "c", 3.333333), ("x", "c", 4.0), ("x", "zzz", 3.666667)]  # the mean of the means 4.5, 2.5 and 4 of the businesses
    near = spark.createDataFrame([("u", "v", 1.0)], "a string, b string, sim double")
    assert got(recommend.user_predictions(rated, rated, near, test)) == [("u", "c", 3.0)]


def clique(names):
    return list(itertools.combinations(names, 2))


def test_two_cliques(spark):
    edges = spark.createDataFrame([*clique("abcd"), *clique("efgh"), ("d", "e")], "src string, dst string")
    between = {(r["src"], r["dst"]): r["betweenness"] for r in graph.edge_betweenness(edges).collect()}
    assert max(between, key=between.get) == ("d", "e") and between["d", "e"] == 16
    split = dict(got(graph.girvan_newman(edges)))
    assert split == {**dict.fromkeys("abcd", "a"), **dict.fromkeys("efgh", "e")}
    labels = spark.createDataFrame(list(split.items()), "id string, label string")
    assert got(graph.modularity(edges, labels)) == [(round(12 / 13 - 2 * 13 * 13 / (26 * 26), 6),)]
    assert graph.label_propagation(edges.limit(0)).count() == 0


def test_betweenness_brute_force(spark):
    links = [(str(a), str(b)) for a, b in [(0, 1), (0, 2), (0, 3), (1, 4), (2, 4), (3, 5), (4, 6), (5, 7), (6, 8), (7, 8)]]
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def paths(a, b):
        level = [[a]]
        while not any(p[-1] == b for p in level):
            level = [[*p, w] for p in level for w in near[p[-1]] if w not in p]
        return [p for p in level if p[-1] == b]

    wanted = dict.fromkeys(links, 0.0)
    for a, b in itertools.combinations(sorted(near), 2):
        ways = paths(a, b)
        for p in ways:
            for e in zip(p, p[1:]):
                wanted[tuple(sorted(e))] += 1 / len(ways)
    found = {(r["src"], r["dst"]): r["betweenness"] for r in graph.edge_betweenness(spark.createDataFrame(links, "src string, dst string")).collect()}
    assert found == {e: pytest.approx(v, abs=1e-5) for e, v in wanted.items()}


def test_components(spark):
    chain = [(f"n{i:02}", f"n{i + 1:02}") for i in range(20)]
    edges = spark.createDataFrame([*chain, ("z", "y"), ("y", "x")], "src string, dst string")
    found = dict(got(graph.connected_components(edges)))
    assert set(found.values()) == {"n00", "x"} and found["n20"] == "n00" and found["z"] == "x"


def test_clusters(spark):
    rng = np.random.default_rng(3)
    xs = np.concatenate([rng.normal(0, 0.1, (40, 2)), rng.normal(5, 0.1, (40, 2))])
    pts = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(xs)], "id bigint, features array<double>")
    labels = dict(got(clustering.kmeans(pts, 2)[0].select("id", "cluster")))
    assert len({labels[i] for i in range(40)}) == 1 and labels[0] != labels[79]
    assigned, counters = clustering.bfr(pts, [pts.where("id % 4 < 2"), pts.where("id % 4 >= 2")], 2)
    rows = assigned.collect()
    assert sorted(r["id"] for r in rows) == list(range(80)) and len(counters) == 2
    assert sum(counters[-1][k] for k in ("discard_points", "compression_points", "retained_points")) == 80
    two = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [3.0, 4.0], 0)], "id bigint, features array<double>, cluster int")
    held = clustering.held_summaries(two, 2)[0]
    assert (held.n, list(held.sum), list(held.sumsq), list(held.spread)) == (2, [4, 6], [10, 20], [1, 1])


def test_hashes(spark):
    df = spark.createDataFrame([("Las Vegas", 0), ("Montréal", 8), ("", 12288)], "s string, h bigint")
    assert [tuple(r) for r in df.select(string_mod(F.col("s"), 12289), trailing_zeros(F.col("h"))).collect()] == [(3522, 9), (8718, 3), (0, 12)]


def test_sketches(spark):
    members = spark.createDataFrame([(f"m{i}",) for i in range(50)] + [(None,), ("",)], "v string")
    n = sketches.bloom_size(50)
    bits = sketches.bloom_bits(members, "v", n)
    assert sketches.bloom_probe(members.where("v <> ''"), "v", bits, n).where("hit = 0").count() == 0
    others = spark.createDataFrame([(f"other{i}",) for i in range(300)] + [(None,), ("",)], "v string")
    hits = sketches.bloom_probe(others, "v", bits, n)
    assert hits.count() == 302 and hits.where("hit = 1").count() < 60 and hits.where("(v is null or v = '') and hit = 1").count() == 0
    assert sketches.reservoir(spark.range(1000), "id", 100).distinct().count() == 100
    far = spark.createDataFrame([(10**10 + i,) for i in range(50)] + [(None,), (-5,)], "id bigint")
    assert sketches.reservoir(far, "id", 100).count() == 51
    counts = spark.createDataFrame([(t,) for t, k in zip("abcde", (17, 9, 5, 1, 9)) for _ in range(k)], "t string")
    assert got(sketches.top_count_ranks(counts, "t")) == [("a", 17), ("b", 9), ("c", 5), ("e", 9)]


def test_blend_boosts_a_hundred_rounds(spark, monkeypatch):
    trees = []

    class Watched(recommend.GBTRegressor):
        def _fit(self, dataset):
            model = super()._fit(dataset)
            trees.append((model.getNumTrees, model.getMaxDepth()))
            return model

    monkeypatch.setattr(recommend, "GBTRegressor", Watched)
    ratings = spark.createDataFrame([(f"u{i % 5}", f"b{i % 7}", float(i % 5 + 1)) for i in range(35)], "user_id string, business_id string, stars double")
    features = recommend.rating_features(ratings).drop("stars").limit(3)
    wanted = features.select("user_id", "business_id", F.lit(3.0).alias("stars"))
    assert recommend.blended_predictions(ratings, wanted, features).where("stars between 1 and 5").count() == 3
    assert trees == [(100, 6)]


def test_components_without_enough_rounds(spark):
    edges = spark.createDataFrame([(f"v{i:02}", f"v{i + 1:02}") for i in range(20)], "src string, dst string")
    with pytest.raises(ValueError, match="rounds"):
        graph.connected_components(edges, most_rounds=1)
