import pytest

from quernmill import session
from quernmill.sources import tables


def test_distinct_reviews(spark):
    rows = [(f"r{i}", f"u{i % 7}", f"text {i}", at) for i in range(400) for at in range(1 + (i % 5 == 0) * (i % 4 + 1))] + [(None, "u", "none", 0)]
    df = spark.createDataFrame(rows, "review_id string, user_id string, text string, ingested_at int").repartition(6)
    wanted = sorted({(r[0], r[2]) for r in rows if r[0]})
    assert sorted(map(tuple, tables.distinct_reviews(df, "text").collect())) == wanted
    # with bitmaps that are far too small, more rows are shuffled and none is lost
    assert sorted(map(tuple, tables.distinct_reviews(df.limit(0), "text").collect())) == []
    assert sorted(map(tuple, tables.distinct_reviews(df.coalesce(1), "text").collect())) == wanted


def test_crowded_bitmap(spark, monkeypatch):
    monkeypatch.setattr(tables, "_BUCKETS", 1)
    rows = [(f"r{i % 30_000}", "t") for i in range(60_000)] + [(f"once{i}", "t") for i in range(5_000)]
    df = spark.createDataFrame(rows, "review_id string, text string").repartition(6)
    assert tables.distinct_reviews(df, "text").count() == 35_000


def test_shared_folder_must_be_named(monkeypatch):
    class Context:
        master, applicationId = "spark://host:7077", "app"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())
    Context.master = "local[2]"
    assert session.shared_dir(Session()).startswith("file:///")
