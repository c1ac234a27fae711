import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quernmill.functions.packed import split_arrow, split_scalar
from quernmill.operators.packed import split_packed

CASES = [
    (None, []),
    ("", []),
    ("  \t", []),
    (", ,", []),
    ('""', []),
    ("[]", []),
    ("{}", []),
    ("Tea", ["Tea"]),
    ("Tea, Farmer's Stalls", ["Tea", "Farmer's Stalls"]),
    ('"Sofas, Beds & Chairs", Tea', ["Sofas, Beds & Chairs", "Tea"]),
    ('"The ""Quiet"" Rooms";;Play|"Pick|Pack"', ['The "Quiet" Rooms', "Play", "Pick|Pack"]),
    ("Salads\\, Bowls, Tea", ["Salads, Bowls", "Tea"]),
    ("['Tea', \"Farmer's Stalls\", 'The \"Quiet\" Rooms']", ["Tea", "Farmer's Stalls", 'The "Quiet" Rooms']),
    ('["Caf\\u00e9s", "The \\"Quiet\\" Rooms"]', ["Cafés", 'The "Quiet" Rooms']),
    ('{Tea,"Salads, Bowls"}', ["Tea", "Salads, Bowls"]),
    (" Tea ,  Tea ", ["Tea", "Tea"]),
    ("A、B，C • D · E\r\nF\tG", ["A", "B", "C", "D", "E", "F", "G"]),
    ("l·l", ["l·l"]),
    ('6" Subs, Tea', ['6" Subs', "Tea"]),
    ('a "b, c" d', ['a "b', 'c" d']),
    ("Saunas (Dry/Steam)", ["Saunas (Dry/Steam)"]),
]


@pytest.mark.parametrize("field, wanted", CASES)
def test_grammar(field, wanted):
    assert split_scalar(field) == wanted


def test_arrow_is_scalar_on_cases():
    fields = [c[0] for c in CASES]
    assert split_arrow(pa.array(fields, pa.string())).to_pylist() == [c[1] for c in CASES]
    assert split_arrow(pa.array(fields, pa.string()).slice(5, 7)).to_pylist() == [c[1] for c in CASES[5:12]]
    assert split_arrow(pa.array([], pa.string())).to_pylist() == []


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab,;|\"'\\[]{}  ·、\né👍u0", max_size=14)), max_size=6))
def test_arrow_is_scalar(fields):
    assert split_arrow(pa.array(fields, pa.string())).to_pylist() == [split_scalar(f) for f in fields]


def test_operator(spark):
    df = spark.createDataFrame([("x", "a, b, a", 1), (None, "c", 2), ("y", None, 3), ("z", "", 4), ("x", "a, b, a", 1), ("w", "v," * 20000, 5)], "key string, packed string, pos int")
    got = split_packed(df.where("key <> 'w' or key is null"), "packed", ["key"]).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([("x", 1, "a"), ("x", 2, "b"), ("x", 3, "a")] * 2 + [(None, 1, "c")], key=repr)
    assert split_packed(df.where("key = 'w'"), "packed", ["key"]).count() == 20000
    assert split_packed(df.limit(0), "packed", ["key"]).count() == 0
    assert split_packed(df, "packed", ["key", "pos"]).columns == ["key", "pos", "pos_", "value"]
