import json

from quernmill.sources import readers, sinks
from quernmill.streaming import windows


def test_readers(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"review_id": "r", "stars": 4.5}) + "\nbroken\n")
    got = readers.read_json(spark, str(tmp_path / "r.json"), "review").where("review_id is not null").collect()
    assert got[0]["stars"] == 4.5 and got[0]["text"] is None
    (tmp_path / "b.csv").write_text('user_id,business_id\n"u, v",b\nuser_id,business_id\n')
    assert sorted(map(tuple, readers.read_csv(spark, str(tmp_path / "b.csv"), "user_id string, business_id string").collect())) == [("u, v", "b"), ("user_id", "business_id")]
    (tmp_path / "points" / "deep").mkdir(parents=True)
    (tmp_path / "points" / "a.txt").write_text("1,0.5,2\n")
    (tmp_path / "points" / "deep" / "b.txt").write_text("2,1,3\nx,1,2\n")
    assert sorted(map(tuple, readers.read_points(spark, str(tmp_path / "points")).collect())) == [(1, 1, [0.5, 2.0]), (2, 2, [1.0, 3.0])]
    model = spark.createDataFrame([("a", "b", 0.5)], "a string, b string, sim double")
    sinks.write_json_lines(model, str(tmp_path / "m"), {"a": "b1", "b": "b2"})
    assert list(map(tuple, readers.read_item_model(spark, str(tmp_path / "m")).collect())) == [("a", "b", 0.5)]


def test_reports(spark, tmp_path):
    sets = spark.createDataFrame([(["b"], 1), (["a"], 1), (["a", "b"], 2)], "items array<string>, k int")
    lines = [r[0] for r in sinks.itemset_report(sets, sets.where("k = 1")).collect()]
    assert lines == ["Candidates:", "('a'),('b')", "('a', 'b')", "", "Frequent Itemsets:", "('a'),('b')"]
    listed = spark.createDataFrame([(["c", "d"], 2), (["a"], 1)], "members array<string>, size int")
    assert [r[0] for r in sinks.community_lines(listed).collect()] == ["'a'", "'c', 'd'"]
    edges = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 2.5)], "src string, dst string, betweenness double")
    assert [r[0] for r in sinks.edge_lines(edges).collect()] == ["('a', 'c'),2.5", "('a', 'b'),1.0"]
    assert sinks.bit_line(spark.createDataFrame([(2, 0), (1, 1)], "at int, hit int"), "at").head()[0] == "1 0"
    sinks.write_json_object(spark.createDataFrame([(1, "x")], "a int, b string"), str(tmp_path / "o"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "o")).collect()] == ['{"a":1,"b":"x"}']


def test_windows_on_a_stream(spark, tmp_path):
    batch = spark.sql("SELECT timestamp_seconds(id * 7) AS ts, concat('v', id % 9) AS v FROM range(60)")
    batch.write.parquet(str(tmp_path / "in"))
    wanted = windows.window_distinct(batch, "ts", "v").collect()
    stream = windows.parquet_stream(spark, str(tmp_path / "in"), batch.schema)
    query = windows.window_distinct(stream, "ts", "v", late="1 hour").writeStream.outputMode("complete").format("memory").queryName("win").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("win").collect())) == sorted(map(tuple, wanted))
    assert all(r["truth"] <= 9 for r in wanted)
    assert windows.window_estimate(batch, "ts", "v").count() == len(wanted)


def test_reservoir_on_a_stream(spark, tmp_path):
    spark.range(500).repartition(3).write.parquet(str(tmp_path / "in"))
    kept = []
    stream = windows.parquet_stream(spark, str(tmp_path / "in"), "id bigint")
    windows.reservoir_stream(stream, "id", 20, lambda df, epoch: kept.append(sorted(r[0] for r in df.collect())), str(tmp_path / "state")).awaitTermination()
    from quernmill.operators.sketches import reservoir

    assert kept[-1] == sorted(r[0] for r in reservoir(spark.range(500), "id", 20).collect())
    tags = windows.tracked(spark.createDataFrame([("a CAT",), ("dog",), (None,)], "text string"), "text", ["cat"])
    assert [r[0] for r in tags.collect()] == ["a CAT"]


def test_models_and_lines(spark, tmp_path):
    (tmp_path / "lines").write_text("a b\n\nc\n")
    assert [r["value"] for r in readers.read_lines(spark, str(tmp_path / "lines")).collect()] == ["a b", "", "c"]
    model = spark.createDataFrame([("u", "v", 0.25)], "a string, b string, sim double")
    sinks.write_json_lines(model, str(tmp_path / "users"), {"a": "u1", "b": "u2"})
    assert list(map(tuple, readers.read_user_model(spark, str(tmp_path / "users")).collect())) == [("u", "v", 0.25)]
    sinks.write_csv(model, str(tmp_path / "csv"))
    assert list(map(tuple, readers.read_csv(spark, str(tmp_path / "csv"), "a string, b string, sim double").collect())) == [("u", "v", 0.25)]
    profile = spark.createDataFrame([("d1", "pear"), ("d1", "plum"), ("d2", "fig")], "doc string, word string")
    users = spark.createDataFrame([("u", "pear"), ("u", "plum")], "user string, word string")
    sinks.write_profile_model(profile, users, str(tmp_path / "profile"))
    docs, read = readers.read_profile_model(spark, str(tmp_path / "profile"))
    wanted = spark.createDataFrame([("u", "d1"), ("u", "d2")], "user string, doc string")
    from quernmill.operators import profiles

    assert list(map(tuple, profiles.profile_cosine(read, docs, wanted, "user", "doc").collect())) == [("u", "d1", 1.0)]


def test_windows_are_appended_by_batch(spark, tmp_path):
    batch = spark.sql("SELECT timestamp_seconds(id * 7) AS ts, concat('v', id % 9) AS v FROM range(60)")
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = windows.window_distinct(windows.parquet_stream(spark, str(tmp_path / "in"), batch.schema), "ts", "v", late="1 hour")
    windows.per_window(stream, sinks.append_window_csv(str(tmp_path / "out")), str(tmp_path / "state"), "update").awaitTermination()
    lines = [x for p in sorted((tmp_path / "out").rglob("part-*")) for x in p.read_text().splitlines()]
    wanted = [r["value"] for r in sinks.window_lines(windows.window_distinct(batch, "ts", "v")).collect()]
    assert lines[0] == "Time,Gound Truth,Estimation" and [x for x in lines if x != lines[0]] == wanted


def test_json_stream_to_json_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"id": 1}\n{"id": 2}\n')
    stream = windows.json_stream(spark, str(tmp_path / "in"), "id bigint").where("id > 1")
    sinks.append_batches(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert [r["id"] for r in spark.read.schema("id bigint").json(str(tmp_path / "out")).collect()] == [2]


def test_socket_and_failures(spark, tmp_path):
    import socket
    import threading
    import time

    server = socket.create_server(("localhost", 0))

    def serve():
        link, _ = server.accept()
        link.sendall(b"boom\n")
        time.sleep(20)
        link.close()

    threading.Thread(target=serve, daemon=True).start()
    log = windows.FailureLog()
    spark.streams.addListener(log)
    seen = []

    def fail(df, epoch):
        seen.extend(r["value"] for r in df.collect())
        if seen:
            raise ValueError("disconnected")

    query = windows.socket_lines(spark, server.getsockname()[1]).writeStream.foreachBatch(fail).start()
    try:
        query.awaitTermination(60)
    except Exception as error:
        assert "disconnected" in str(error)
    for _ in range(50):
        if log.errors:
            break
        time.sleep(0.2)
    spark.streams.removeListener(log)
    assert seen == ["boom"] and len(log.errors) == 1 and "disconnected" in log.errors[0]
