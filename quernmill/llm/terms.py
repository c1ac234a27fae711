"""Terms of text records: corpus frequencies, and how typical a term is of a group of records.

Terms are maximal runs of Unicode letters of the lower-cased text. Null texts and texts
without letters hold no term. Every input row is one record; repeated rows are that many
records, so callers drop repeated deliveries first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernmill.session import cut

_COUNTS = "term string, occurrences bigint, records bigint"


def _count_terms(batches: Iterator[pa.RecordBatch], most_terms: int) -> Iterator[pa.RecordBatch]:
    """Partial counts of a partition's terms; a row without term has the tokens and the records that hold any."""
    import regex

    letters, ascii_letters = regex.compile(r"\p{L}+").findall, re.compile("[a-z]+").findall
    counters: dict[str, list[int]] = {}  # occurrences, records, last record seen
    record = tokens = holders = 0

    def flush() -> pa.RecordBatch:
        held = list(counters.values())
        out = pa.RecordBatch.from_arrays([pa.array(counters.keys(), pa.string()), pa.array([c[0] for c in held], pa.int64()), pa.array([c[1] for c in held], pa.int64())], ["term", "occurrences", "records"])
        counters.clear()
        return out

    for batch in batches:
        for text in batch.column(0).to_pylist():
            if not text:
                continue
            text = text.lower()
            found = (ascii_letters if text.isascii() else letters)(text)
            if not found:
                continue
            record += 1
            holders += 1
            tokens += len(found)
            for term in found:
                c = counters.get(term)
                if c is None:
                    counters[term] = [1, 1, record]
                else:
                    c[0] += 1
                    if c[2] != record:
                        c[1] += 1
                        c[2] = record
        # only between records, so that no record is split over two flushes
        if len(counters) > most_terms:
            yield flush()
    yield flush()
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([tokens], pa.int64()), pa.array([holders], pa.int64())], ["term", "occurrences", "records"])


def term_frequencies(records: DataFrame, text: str = "text", *, rare_below: int = 3, common_above: float = 0.2, most_terms: int = 400_000) -> DataFrame:
    """term, occurrences, records, is_rare, is_common for every distinct term of `records`.

    Last-seen counters run over each partition's records in order: a term holds its
    occurrences, its records and the last record it was seen in, never a set. A record lies in
    one partition, so the partial counts add up after a shuffle of vocabulary size. At most
    about `most_terms` counters are held; beyond that they are passed on and start anew.

    is_rare: fewer than `rare_below` records; is_common: more than `common_above` of the
    records that hold any term. An empty table gives no rows; other columns are not read.
    """
    partial = records.select(F.col(f"`{text}`").cast("string").alias("text")).where(F.col("text") != "").mapInArrow(lambda batches: _count_terms(batches, most_terms), _COUNTS)
    counts = cut(partial.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records")))
    head = counts.where(F.col("term").isNull()).select("records").head()
    holders = head[0] if head and head[0] else 0
    return counts.where(F.col("term").isNotNull()).withColumns({"is_rare": F.col("records") < rare_below, "is_common": F.col("records") > F.lit(common_above) * holders})


def term_sets(text: str = "text"):
    """Column: the distinct terms of a text, in order of first appearance; null gives none."""
    return F.array_distinct(F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}]+"), ""))


def typical_terms(records: DataFrame, group: str, text: str = "text", *, min_records: int = 1, min_share: float = 0.0, hot_groups: int = 5_000) -> DataFrame:
    """How typical each term is of each group, by correspondence-analysis residuals.

    Rows: the group column, term, n_both (records of the group with the term), n_group
    (records of the group that hold a term), n_term (records of the collection with the
    term), residual = (n_both - e) / sqrt(e) with e from the margins of the group x term
    table, and adjusted = residual / sqrt((1 - row share) * (1 - column share)), which has
    unit variance under independence. Margins count (record, term) incidences.

    Only rows with n_both >= min_records and n_both >= min_share * n_term are made. The second
    is a threshold on the residual: with q the group's share of all incidences, a term of which
    the group has the share s has residual (s - q) * sqrt(n_term / q), so rows are chosen by
    theirs, and the exact counts settle what rounding leaves open. As
    n_both <= n_group, a term with n_term > n_group / min_share can't qualify; that drops
    common terms before the shuffle. What is broadcast for it is bounded: at most
    `hot_groups` groups, and the terms that occur in more records than the largest other
    group could carry, of which there are at most hot_groups * (terms a record) * min_share.

    Records without group count in the collection only. Nulls and empty texts hold no term;
    an empty table gives no rows; columns other than the two are not read.
    """
    held = cut(records.select(F.col(f"`{group}`").alias("__g"), term_sets(f"`{text}`").alias("__terms")).where(F.size("__terms") > 0))
    per_term = cut(held.select(F.explode("__terms").alias("term")).groupBy("term").agg(F.count("*").alias("n_term")))
    per_group = cut(held.groupBy("__g").agg(F.count("*").alias("n_group"), F.sum(F.size("__terms")).cast("double").alias("row_total")))
    n_records, total = per_group.agg(F.sum("n_group"), F.sum("row_total")).head()
    total = float(total or 0)
    pairs = held.where(F.col("__g").isNotNull()).select("__g", F.explode("__terms").alias("term"))
    if min_share > 0:
        large = max(int((n_records or 0) / hot_groups), min_records)
        common = per_term.where(F.col("n_term") * min_share > large)
        hot = per_group.where(F.col("__g").isNotNull() & (F.col("n_group") > large)).select("__g", F.col("n_group").alias("__n"))
        pairs = pairs.join(F.broadcast(common), "term", "left").join(F.broadcast(hot), "__g", "left").where(F.col("n_term").isNull() | (F.col("n_term") * min_share <= F.coalesce("__n", F.lit(large)))).select("__g", "term")
    both = pairs.groupBy("__g", "term").agg(F.count("*").alias("n_both")).where(F.col("n_both") >= min_records)
    scored = both.join(per_term, "term").join(per_group, "__g")
    expected = F.col("row_total") * F.col("n_term") / F.lit(total)
    variance = (1 - F.col("row_total") / F.lit(total)) * (1 - F.col("n_term") / F.lit(total))
    scored = scored.withColumn("residual", (F.col("n_both") - expected) / F.sqrt(expected))
    if min_share > 0:
        q = F.col("row_total") / F.lit(total)
        least = (F.lit(min_share) - q) * F.sqrt(F.col("n_term") / q)
        scored = scored.where(F.col("residual") >= least - 1e-6 * (1 + F.abs(least))).where(F.col("n_both") >= F.col("n_term") * min_share)
    return (
        scored
        .withColumn("adjusted", F.when(variance > 0, F.col("residual") / F.sqrt(variance)))
        .select(F.col("__g").alias(group), "term", "n_both", "n_group", "n_term", "residual", "adjusted")
    )
