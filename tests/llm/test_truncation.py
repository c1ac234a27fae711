import os
import random

import pytest
from pyspark.sql import functions as F

from quernmill.llm.truncation import _ending, _marks, share_of_cut, truncated_texts
from tests.helpers import FOLDER

SUBJECTS = "the cook,our waiter,a friend,the small cafe,my sister,the old garden,every guest,the new menu".split(",")
VERBS = "likes,serves,remembers,brings,praises,shows,needs,offers".split(",")
OBJECTS = "warm bread,the quiet corner,fresh soup,a long evening,good music,the blue door,some lemon cake,a table outside".split(",")


def sentence(rng):
    return f"{rng.choice(SUBJECTS).capitalize()} {rng.choice(VERBS)} {rng.choice(OBJECTS)} {rng.choice(['today', 'again', 'with pleasure', 'every week'])}."


def test_finds_cut_texts(spark):
    rng = random.Random(9)
    rows = []
    for i in range(1500):
        text = " ".join(sentence(rng) for _ in range(rng.randint(3, 6)))
        kind = rng.random()
        cut = kind < 0.05 or (i % 3 == 0 and len(text) > 180)
        if cut:
            text = text[: 180 if i % 3 == 0 and len(text) > 180 else rng.randint(40, len(text) - 8)]
            if text.endswith(".") or text[-2:] == ". ":
                text = text.rstrip()[:-4]
        elif kind < 0.25:
            text = text.rstrip(".") + rng.choice(["", "", " :)", "...", " Thanks", " #yum"])
        rows.append((i, text, "tips" if i % 3 == 0 else "notes", cut))
    rows += [(5000, None, "tips", False), (5001, "", None, False), (5002, "   ", "tips", False), (None, "Fine.", "tips", False)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, score boolean")
    got = {r["doc_id"]: r for r in truncated_texts(df).collect()}
    assert len(got) == len(rows)
    found, true = {i for i, r in got.items() if r["is_truncated"]}, {r[0] for r in rows if r[3]}
    assert len(found & true) >= 0.85 * len(true) and len(found & true) >= 0.9 * len(found)
    assert all(got[i]["score"] == 0 for i in (5000, 5001, 5002))


def test_edges(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert truncated_texts(df).count() == 0
    few = spark.createDataFrame([(1, "One text only.", "s"), (1, "One text only.", "s"), (2, "x" * 100_000, None)], df.schema)
    assert truncated_texts(few).count() == 3


def test_endings():
    assert _ending("A nice place [...]")[:2] == ("place", "nice place")
    assert _ending("ok")[0] == "ok" and _ending("👍")[0] is None


def test_share():
    import numpy as np

    cut_ones = np.linspace(2, 6, 100)
    natural = np.concatenate((np.linspace(-6, 0, 950), np.linspace(2, 6, 50)))
    assert share_of_cut(natural, np.ones(1000), cut_ones)[0] == pytest.approx(0.05, abs=0.01)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
def test_held_out_cuts(spark):
    """Of intact documents cut at random here, most are found; of those left alone, few."""
    folder = FOLDER.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("text rlike '[.!?]$' and length(text) > 120").select("doc_id", "text", "source")
    cut_here = (F.col("doc_id") % 10) == 3
    at = (F.lit(60) + F.pmod(F.xxhash64("doc_id"), F.length("text") - 70)).cast("int")
    df = docs.select("doc_id", "source", F.when(cut_here, F.substring("text", F.lit(1), at)).otherwise(F.col("text")).alias("text"))
    judged = truncated_texts(df).join(df.withColumn("truth", cut_here & ~F.col("text").rlike(r"[.!?]\s*$")).select("doc_id", "truth"), "doc_id")
    n = {(r["truth"], r["is_truncated"]): r["count"] for r in judged.groupBy("truth", "is_truncated").count().collect()}
    assert n.get((True, True), 0) >= 0.75 * (n.get((True, True), 0) + n.get((True, False), 0))
    assert n.get((False, True), 0) <= 0.02 * (n.get((False, True), 0) + n.get((False, False), 0))


def test_marks_of_a_long_last_sentence():
    """What a sentence opens counts, however long ago."""
    for opened, mark in (("(", "open bracket"), ("¿", "open ¿")):
        text = f"Done. It was {opened}then " + "and on " * 100
        assert mark in _marks(text, text, "", ["on"], " ")
        assert mark not in _marks(text, f"{text}. And", "", ["and"], "")
