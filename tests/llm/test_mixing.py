import pytest

from quernmill.llm.mixing import _step, mix_sources


def test_step_keeps_means_and_mass():
    for p, x, q, y in ((0.3, 10.0, 0.6, 4.0), (0.5, 1.0, 0.5, 1.0), (0.9, 3.0, 0.2, 50.0)):
        up = min((1 - p) * x, q * y)
        down = min(p * x, (1 - q) * y)
        a, b = _step(p, x, q, y, 0.0), _step(p, x, q, y, 0.999999)
        for r, s in (a, b):
            assert r * x + s * y == pytest.approx(p * x + q * y) and (r in (0.0, 1.0) or s in (0.0, 1.0))
        share = down / (up + down)
        assert share * a[0] + (1 - share) * b[0] == pytest.approx(p)


def test_mix(spark):
    docs = [(f"a{i}", " Big ", 50 + i % 90) for i in range(900)] + [(f"s{i}", "small", 20 + i % 7) for i in range(30)] + [(f"x{i}", "unlisted", 9) for i in range(9)]
    docs += [("n0", None, 5), ("n1", "big", None), ("n2", "", 5), (None, "big", 10)]
    records = spark.createDataFrame([(*d, "c") for d in docs], "doc_id string, source string, tokens bigint, copies string")
    targets = spark.createDataFrame([("big", 0.55, 1), ("SMALL ", 0.25, 3), ("none", 0.2, 2), ("zero", 0.0, 2), ("nan", float("nan"), 1), (None, 0.4, 1)], "source string, target_weight double, max_repeats int")
    copies, report = mix_sources(records, targets, bucket_size=60, fan_in=4)
    rows = {r["source"]: r for r in report.collect()}
    assert set(rows) == {"big", "small", "none"}
    big, small = sum(d[2] or 0 for d in docs if d[1] and d[1].strip().lower() == "big"), sum(d[2] for d in docs if d[1] == "small")
    total = big + small
    assert {s: r["tokens"] for s, r in rows.items()} == {"big": big, "small": small, "none": 0}
    assert {s: r["capped"] for s, r in rows.items()} == {"big": False, "small": small * 3 < 0.25 * total, "none": True}
    assert abs(rows["big"]["mixed_tokens"] - 0.55 * total) < 200
    assert rows["small"]["mixed_tokens"] == 3 * small and sum(r["actual_share"] for r in rows.values()) == pytest.approx(1)
    held = {r["doc_id"]: r["copies"] for r in copies.collect()}
    assert set(held) == {d[0] for d in docs if d[1] and d[1].strip().lower() in ("big", "small")} and set(held[f"a{i}"] for i in range(900)) == {0, 1}
    again = {r["doc_id"]: r["copies"] for r in mix_sources(records.repartition(7), targets, bucket_size=60, fan_in=4)[0].collect()}
    assert again == held


def test_of_nothing(spark):
    records = spark.createDataFrame([], "doc_id string, source string, tokens bigint")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_weight double, max_repeats int")
    copies, report = mix_sources(records, targets, bucket_size=4, fan_in=4)
    assert copies.count() == 0 and [(r["source"], r["capped"], r["actual_share"]) for r in report.collect()] == [("a", False, 0.0)]
    copies, report = mix_sources(records, targets.limit(0), bucket_size=4, fan_in=4)
    assert copies.count() == 0 and report.count() == 0
