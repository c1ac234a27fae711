import collections

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from quernmill.llm.terms import term_frequencies, typical_terms

TEXTS = ["The cat, the CAT!", None, "", "  ", "123 _ ²", "Ünïcode straße ÉCOLE", "naïve日本語 text", "dog dog\tdog", "a" * 50_000 + " b" * 50_000, "the end"]


def brute(texts):
    terms = [regex.findall(r"\p{L}+", (t or "").lower()) for t in texts]
    occurrences, records = collections.Counter(), collections.Counter()
    for t in terms:
        occurrences.update(t)
        records.update(set(t))
    return {t: (occurrences[t], records[t]) for t in occurrences}, sum(map(bool, terms))


@pytest.mark.parametrize("most", [3, 400_000])
def test_frequencies(spark, most):
    df = spark.createDataFrame([(t, "term", i) for i, t in enumerate(TEXTS * 2)], "text string, term string, occurrences int").repartition(3)
    wanted, holders = brute(TEXTS * 2)
    got = term_frequencies(df, rare_below=3, common_above=0.2, most_terms=most).collect()
    assert {r["term"]: (r["occurrences"], r["records"]) for r in got} == wanted
    assert all(r["is_rare"] == (r["records"] < 3) and r["is_common"] == (r["records"] > 0.2 * holders) for r in got)
    assert term_frequencies(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="abÄß é.1\n", max_size=12)), max_size=12))
def test_counters(texts):
    import pyarrow as pa

    from quernmill.llm.terms import _count_terms

    totals = collections.defaultdict(lambda: [0, 0])
    for batch in _count_terms(iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])]), 2):
        for r in batch.to_pylist():
            totals[r["term"]][0] += r["occurrences"]
            totals[r["term"]][1] += r["records"]
    wanted, holders = brute(texts)
    assert totals.pop(None)[1] == holders
    assert {t: tuple(v) for t, v in totals.items()} == wanted


def test_typical(spark):
    rows = [("a", "sun sand sea")] * 3 + [("b", "sea rain")] * 4 + [(None, "sand")] * 2 + [("a", None), ("c", "")]
    df = spark.createDataFrame([(g, t, 1) for g, t in rows], "g string, t string, n_both int")
    got = {(r["g"], r["term"]): r for r in typical_terms(df, "g", "t").collect()}
    assert set(got) == {("a", "sun"), ("a", "sand"), ("a", "sea"), ("b", "sea"), ("b", "rain")}
    r = got["a", "sand"]
    total, row, col = 3 * 3 + 4 * 2 + 2, 9, 5
    e = row * col / total
    assert (r["n_both"], r["n_group"], r["n_term"]) == (3, 3, 5)
    assert r["residual"] == pytest.approx((3 - e) / e**0.5)
    assert r["adjusted"] == pytest.approx((3 - e) / e**0.5 / ((1 - row / total) * (1 - col / total)) ** 0.5)
    few = typical_terms(df, "g", "t", min_records=3, min_share=0.5, hot_groups=1)
    assert {(r["g"], r["term"]) for r in few.collect()} == {("a", "sun"), ("a", "sand"), ("b", "sea"), ("b", "rain")}
    assert typical_terms(df.limit(0), "g", "t", min_records=3, min_share=0.5).count() == 0
