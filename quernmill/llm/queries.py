"""Queries of the llm problems over the parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernmill.llm.bpe import count_tokens, encode
from quernmill.llm.mixing import mix_sources
from quernmill.llm.pairs import co_occurrences
from quernmill.llm.setjoin import expand_pairs, similar_sets
from quernmill.llm.terms import term_frequencies, typical_terms
from quernmill.llm.topn import top_n
from quernmill.llm.truncation import truncated_texts
from quernmill.operators.packed import split_packed
from quernmill.session import cut
from quernmill.sources.tables import distinct_reviews, table, valid_stars


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """business_id, term: terms of at least 3 reviews of the business that are at least half of all reviews with the term."""
    reviews = distinct_reviews(table(spark, folder, "review"), "business_id", "text")
    return typical_terms(reviews, "business_id", "text", min_records=3, min_share=0.5).select("business_id", "term")


def p2_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The residuals of every term of at least 3 reviews of a business."""
    reviews = distinct_reviews(table(spark, folder, "review"), "business_id", "text")
    scored = typical_terms(reviews, "business_id", "text", min_records=3)
    return scored.select("business_id", "term", "n_both", "n_group", "n_term", F.round("residual", 6).alias("residual"), F.round("adjusted", 6).alias("adjusted"))


def p3_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Counts, lift and log odds of the pairs of p3_found."""
    pairs = co_occurrences(table(spark, folder, "review"), "user_id", "business_id", min_together=5, min_lift=8.0)
    return pairs.select(F.col("item_a").alias("business_a"), F.col("item_b").alias("business_b"), "n_both", "n_a", "n_b", F.round("lift", 6).alias("lift"), F.round("log_odds", 6).alias("log_odds"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """business_a, business_b with at least 5 common users, at least 8 times as many as by chance."""
    pairs = co_occurrences(table(spark, folder, "review"), "user_id", "business_id", min_together=5, min_lift=8.0)
    return pairs.select(F.col("item_a").alias("business_a"), F.col("item_b").alias("business_b"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """business_a, business_b with at least 4 users each whose users overlap by 0.4 of either's or more."""
    pairs, members = similar_sets(table(spark, folder, "review"), "business_id", "user_id", threshold=0.4, min_size=4)
    return expand_pairs(pairs, members).select(F.col("key_a").alias("business_a"), F.col("key_b").alias("business_b"))


def p4_users(spark: SparkSession, folder: str) -> DataFrame:
    """user_a, user_b with at least 4 businesses each, alike by 0.4 or more: nodes far larger than a leaf, which split down the tree."""
    pairs, members = similar_sets(table(spark, folder, "review"), "user_id", "business_id", threshold=0.4, min_size=4)
    return expand_pairs(pairs, members).select(F.col("key_a").alias("user_a"), F.col("key_b").alias("user_b"), F.round("similarity", 6).alias("similarity"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """term, mark: 'rare' in fewer than 3 reviews, 'common' in more than a fifth of those that hold any term."""
    terms = term_frequencies(distinct_reviews(table(spark, folder, "review"), "text"), rare_below=3, common_above=0.2)
    marks = F.array_compact(F.array(F.when(F.col("is_rare"), "rare"), F.when(F.col("is_common"), "common")))
    return terms.select("term", F.explode(marks).alias("mark"))


def category_means(spark: SparkSession, folder: str) -> DataFrame:
    """category, business_id, mean_stars, n_stars for businesses with at least 3 reviews with valid stars."""
    stars = distinct_reviews(table(spark, folder, "review"), "business_id", "stars").where(valid_stars() & F.col("business_id").isNotNull())
    means = stars.groupBy("business_id").agg(F.avg("stars").alias("mean_stars"), F.count("*").alias("n_stars")).where(F.col("n_stars") >= 3)
    categories = split_packed(table(spark, folder, "business").where(F.col("business_id").isNotNull()), "categories", ["business_id"], value="category")
    return categories.select("category", "business_id").distinct().join(means, "business_id")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """category, business_id: the first 3 of each category by mean of valid stars, number of them, id."""
    best = top_n(category_means(spark, folder), ["category"], "mean_stars", 3, ties=[F.col("n_stars").desc(), F.col("business_id").asc()])
    return best.select("category", "business_id")


def p7_states(spark: SparkSession, folder: str) -> DataFrame:
    """state, business_id, rank: the first 3 businesses of each state, in the order of p7_found."""
    stars = distinct_reviews(table(spark, folder, "review"), "business_id", "stars").where(valid_stars() & F.col("business_id").isNotNull())
    means = stars.groupBy("business_id").agg(F.avg("stars").alias("mean_stars"), F.count("*").alias("n_stars")).where(F.col("n_stars") >= 3)
    placed = table(spark, folder, "business").select("state", "business_id").distinct().join(means, "business_id")
    best = top_n(placed, ["state"], "mean_stars", 3, ties=[F.col("n_stars").desc(), F.col("business_id").asc()])
    return best.select("state", "business_id", F.col("rank").cast("bigint").alias("rank"))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id and the token ids of each document by byte_bpe_50k."""
    return encode(table(spark, folder, "documents"), "text", ["doc_id"])


def _mix(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    counted = count_tokens(table(spark, folder, "documents"), "text", ["doc_id", "source"])
    return mix_sources(cut(counted), table(spark, folder, "mix_targets"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """source: those whose records all come max_repeats times in the mix and still fall short of the target tokens."""
    return _mix(spark, folder)[1].where("mixed_tokens = tokens * max_repeats AND mixed_tokens < target_tokens").select("source")


def p9_report(spark: SparkSession, folder: str) -> DataFrame:
    """Per source: target and actual tokens and shares of the mix."""
    return _mix(spark, folder)[1]


def p9_by_length(spark: SparkSession, folder: str) -> DataFrame:
    """The mix with sizes in code points: per source its weight, size, target, whether it is capped, and whether the mix is at the cap or within one record of the target."""
    sizes = table(spark, folder, "documents").select("doc_id", "source", F.col("n_chars").alias("tokens"))
    copies, report = mix_sources(sizes, table(spark, folder, "mix_targets"))
    largest = copies.groupBy("source").agg(F.max("tokens").alias("largest"))
    wanted = F.when(F.col("capped"), F.col("mixed_tokens") == F.col("tokens") * F.col("max_repeats")).otherwise(F.abs(F.col("mixed_tokens") - F.col("target_tokens")) <= F.coalesce("largest", F.lit(0)))
    return report.join(largest, "source", "left").select("source", F.round("target_share", 9).alias("target_share"), F.col("tokens").alias("size"), F.round("target_tokens", 3).alias("target"), "capped", wanted.alias("as_wanted"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id of the documents that were cut off."""
    return truncated_texts(table(spark, folder, "documents")).where("is_truncated").select("doc_id")


def p10_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Per source: documents, how many were cut off, and their rate."""
    judged = truncated_texts(table(spark, folder, "documents"))
    return judged.groupBy("source").agg(F.count("*").alias("n_documents"), F.count_if("is_truncated").alias("n_truncated"), F.avg(F.col("is_truncated").cast("double")).alias("rate"))


QUERIES = {"p2_found": p2_found, "p2_scores": p2_scores, "p3_found": p3_found, "p3_scores": p3_scores, "p4_found": p4_found, "p4_users": p4_users, "p6_found": p6_found, "p7_found": p7_found, "p7_states": p7_states, "p8_ids": p8_ids, "p9_found": p9_found, "p9_report": p9_report, "p9_by_length": p9_by_length, "p10_found": p10_found, "p10_rates": p10_rates}

_REVIEWS = "reviews AS (SELECT review_id, any_value(business_id) AS business_id, any_value(user_id) AS user_id, any_value(stars) AS stars, any_value(text) AS text FROM review WHERE review_id IS NOT NULL GROUP BY review_id)"
_TERMS = r"terms AS (SELECT review_id, business_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS term FROM reviews)"

ORACLE = {
    "p2_found": f"""
WITH {_REVIEWS}, {_TERMS},
pairs AS (SELECT DISTINCT review_id, business_id, term FROM terms),
all_of AS (SELECT term, count(*) AS n_term FROM pairs GROUP BY term),
own AS (SELECT business_id, term, count(*) AS n_both FROM pairs WHERE business_id IS NOT NULL GROUP BY 1, 2)
SELECT business_id, term FROM own JOIN all_of USING (term) WHERE n_both >= 3 AND 2 * n_both >= n_term""",
    "p2_scores": f"""
WITH {_REVIEWS}, {_TERMS},
pairs AS (SELECT DISTINCT review_id, business_id, term FROM terms),
all_of AS (SELECT term, count(*) AS n_term FROM pairs GROUP BY term),
groups AS (SELECT business_id, count(DISTINCT review_id) AS n_group, count(*)::DOUBLE AS row_total FROM pairs GROUP BY business_id),
total AS (SELECT count(*)::DOUBLE AS t FROM pairs),
own AS (SELECT business_id, term, count(*) AS n_both FROM pairs WHERE business_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3),
e AS (SELECT *, row_total * n_term / t AS e, (1 - row_total / t) * (1 - n_term / t) AS v FROM own JOIN all_of USING (term) JOIN groups USING (business_id), total)
SELECT business_id, term, n_both, n_group, n_term, round((n_both - e) / sqrt(e), 6) AS residual, round(CASE WHEN v > 0 THEN (n_both - e) / sqrt(e) / sqrt(v) END, 6) AS adjusted FROM e""",
    "p3_scores": """
WITH pairs AS (SELECT DISTINCT user_id, business_id FROM review WHERE user_id IS NOT NULL AND business_id IS NOT NULL),
n AS (SELECT business_id, count(*) AS k FROM pairs GROUP BY 1),
total AS (SELECT count(DISTINCT user_id) AS m FROM pairs),
both_of AS (SELECT a.business_id AS business_a, b.business_id AS business_b, count(*) AS n_both
  FROM pairs a JOIN pairs b ON a.user_id = b.user_id AND a.business_id < b.business_id GROUP BY 1, 2)
SELECT business_a, business_b, n_both, x.k AS n_a, y.k AS n_b, round(n_both * m::DOUBLE / (x.k::DOUBLE * y.k), 6) AS lift,
  round(ln((n_both + 0.5::DOUBLE) * (m - x.k - y.k + n_both + 0.5::DOUBLE) / ((x.k - n_both + 0.5::DOUBLE) * (y.k - n_both + 0.5::DOUBLE))), 6) AS log_odds
FROM both_of JOIN n x ON x.business_id = business_a JOIN n y ON y.business_id = business_b, total
WHERE n_both >= 5 AND n_both * m >= 8 * x.k * y.k""",
    "p4_users": """
WITH pairs AS (SELECT DISTINCT user_id, business_id FROM review WHERE user_id IS NOT NULL AND business_id IS NOT NULL),
n AS (SELECT user_id, count(*) AS k FROM pairs GROUP BY 1 HAVING count(*) >= 4),
both_of AS (SELECT a.user_id AS user_a, b.user_id AS user_b, count(*) AS k
  FROM pairs a JOIN pairs b ON a.business_id = b.business_id AND a.user_id < b.user_id GROUP BY 1, 2)
SELECT user_a, user_b, round(both_of.k / (x.k + y.k - both_of.k), 6) AS similarity FROM both_of JOIN n x ON x.user_id = user_a JOIN n y ON y.user_id = user_b
WHERE both_of.k / (x.k + y.k - both_of.k) >= 0.4""",
    "p7_states": f"""
WITH {_REVIEWS}, means AS (SELECT business_id, avg(stars) AS m, count(*) AS n FROM reviews WHERE stars BETWEEN 1 AND 5 AND business_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 3),
placed AS (SELECT DISTINCT state, business_id FROM business WHERE state IS NOT NULL)
SELECT state, business_id, rank FROM (SELECT state, business_id, row_number() OVER (PARTITION BY state ORDER BY m DESC, n DESC, business_id) AS rank FROM placed JOIN means USING (business_id)) WHERE rank <= 3""",
    "p9_by_length": """
WITH sized AS (SELECT nullif(lower(trim(source)), '') AS source, n_chars FROM documents),
t AS (SELECT source, sum(n_chars)::BIGINT AS size FROM sized WHERE source IS NOT NULL GROUP BY 1),
wanted AS (SELECT nullif(lower(trim(source)), '') AS source, sum(target_weight) AS w, min(max_repeats) AS r FROM mix_targets WHERE target_weight > 0 AND isfinite(target_weight) AND source IS NOT NULL GROUP BY 1),
plan AS (SELECT source, w, r, coalesce(size, 0) AS size FROM wanted LEFT JOIN t USING (source)),
whole AS (SELECT sum(w) AS all_w, sum(size)::DOUBLE AS all_size FROM plan)
SELECT source, round(w / all_w, 9) AS target_share, size, round(w / all_w * all_size, 3) AS target, size * r < w / all_w * all_size AS capped, true AS as_wanted FROM plan, whole""",
    "p3_found": """
WITH pairs AS (SELECT DISTINCT user_id, business_id FROM review WHERE user_id IS NOT NULL AND business_id IS NOT NULL),
n AS (SELECT business_id, count(*) AS k FROM pairs GROUP BY 1),
total AS (SELECT count(DISTINCT user_id) AS m FROM pairs),
both_of AS (SELECT a.business_id AS business_a, b.business_id AS business_b, count(*) AS k
  FROM pairs a JOIN pairs b ON a.user_id = b.user_id AND a.business_id < b.business_id GROUP BY 1, 2)
SELECT business_a, business_b FROM both_of JOIN n x ON x.business_id = business_a JOIN n y ON y.business_id = business_b, total
WHERE both_of.k >= 5 AND both_of.k * m >= 8 * x.k * y.k""",
    "p4_found": """
WITH pairs AS (SELECT DISTINCT user_id, business_id FROM review WHERE user_id IS NOT NULL AND business_id IS NOT NULL),
n AS (SELECT business_id, count(*) AS k FROM pairs GROUP BY 1 HAVING count(*) >= 4),
both_of AS (SELECT a.business_id AS business_a, b.business_id AS business_b, count(*) AS k
  FROM pairs a JOIN pairs b ON a.user_id = b.user_id AND a.business_id < b.business_id GROUP BY 1, 2)
SELECT business_a, business_b FROM both_of JOIN n x ON x.business_id = business_a JOIN n y ON y.business_id = business_b
WHERE both_of.k / (x.k + y.k - both_of.k) >= 0.4""",
    "p6_found": f"""
WITH {_REVIEWS}, {_TERMS},
counts AS (SELECT term, count(DISTINCT review_id) AS k FROM terms GROUP BY term),
total AS (SELECT count(DISTINCT review_id) AS m FROM terms)
SELECT term, 'rare' AS mark FROM counts WHERE k < 3
UNION ALL SELECT term, 'common' FROM counts, total WHERE 5 * k > m""",
}
