"""Small hand-worked cases of searches, readings and links."""

from __future__ import annotations

import datetime as dt

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.functions import reading as R
from skein.operators import linking as L
from skein.operators import search as S


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def one(spark, expr, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(expr).collect()]


def listings(spark):
    data = [(1, 10.0, 1, ["a", "b"], "street", [1, 2], [5, 30], "Sunny flat, Vake", "g"), (2, 20.0, 5, ["a"], "pin", [3], [5], "Dark flat", "g"), (3, None, 7, [], "none", [], [], "", None), (4, 5.0, None, None, None, None, None, None, None)]
    return spark.createDataFrame(data, "id int, price double, rooms int, tags array<string>, prec string, codes array<int>, mins array<int>, title string, grp string")


FIELDS = S.Fields(price_to=("at_most", "price"), rooms=("counts", "rooms", 5), tags=("all_of", "tags"), prec=("rank", "prec", ["none", "street", "pin"]), near=("within", "codes", "mins"), words=("words", "title"), kinds=("one_of", "prec"))


@pytest.mark.parametrize("asked,ids", [({}, [1, 2, 3, 4]), ({"price_to": 10.0}, [1, 4]), ({"rooms": [1, 5]}, [1, 2, 3]), ({"rooms": [2]}, []), ({"tags": ["a"]}, [1, 2]), ({"tags": ["a", "b"]}, [1]), ({"prec": "street"}, [1, 2]), ({"near": ([2, 3], 10)}, [2]), ({"near": ([], 5)}, [1, 2]), ({"words": "fla sun"}, [1]), ({"kinds": [], "price_to": None}, [1, 2, 3, 4])])
def test_predicates(spark, asked, ids):
    assert sorted(r["id"] for r in listings(spark).where(FIELDS.predicate(asked)).collect()) == ids


def test_unknown_filter(spark):
    with pytest.raises(KeyError):
        FIELDS.predicate({"no": 1})


def test_pages(spark):
    df = listings(spark)
    assert [r["id"] for r in S.page(df, F.lit(True), [F.col("id")], 2, 1).collect()] == [2, 3]
    assert [(r["id"], r["alike"]) for r in S.grouped_page(df, F.lit(True), "grp", [F.col("id")]).collect()] == [(1, 2), (3, 1), (4, 1)]
    assert S.capped_count(df, F.lit(True), 3).first() == (3, True)
    assert S.unknown_estimate(df.withColumn("area", F.lit("x")), "area", "rooms", F.col("rooms") > 4).first() == (3, 2, 1, 1)
    assert rows(S.shares(df, "grp", "rooms")) == [("g", 2, '{"1":1,"5":1}'), (None, 1, '{"7":1}')]


def test_contacts(spark):
    assert one(spark, R.emails(F.col("v")), "a@B.ge, A@b.ge; x@y", None) == [["a@b.ge"], None]
    assert one(spark, R.phones(F.col("v")), "599 12 34 56 or +995 599-12-34-56", "599 100 200 GEL", "599 12 34 xx", "032 2 12 34 56") == [["+995599123456"], [], [], []]


def test_house_and_street(spark):
    assert one(spark, R.house_number(F.col("v")), "№12ა", "12-14", "0", "x", "007 b", None) == ["12ა", "12", None, None, "7b", None]
    assert one(spark, R.street_key(F.col("v")), "I. Chavchavadze Ave. (left)", "ჭავჭავაძის გამზირი", "st", None) == ["chavchavadze", "ჭავჭავაძის", None, None]


def test_yearless(spark):
    df = spark.createDataFrame([(28, 12, dt.date(2026, 1, 3)), (29, 2, dt.date(2025, 6, 1)), (31, 2, dt.date(2025, 6, 1))], "d int, m int, at date")
    got = df.select(*(f(F.col("d"), F.col("m"), F.col("at")) for f in (R.nearest_date, R.published_date, R.deadline_date))).collect()
    assert list(map(tuple, got)) == [(dt.date(2025, 12, 28), dt.date(2025, 12, 28), dt.date(2026, 12, 28)), (dt.date(2024, 2, 29), dt.date(2024, 2, 29), None), (None, None, None)]


@given(st.text("abc", max_size=6), st.text("abc", max_size=6))
def test_edit_distance_is_symmetric_and_capped(a, b):
    d = R.edit_distance(a, b, 10)
    assert d == R.edit_distance(b, a, 10) and (d == 0) == (a == b)
    assert R.edit_distance(a, b, 1) == min(d, 2)


def test_segmenter():
    split = R.segmenter({"▁": -1.0, "▁he": -1.0, "llo": -1.0, "l": -3.0, "o": -3.0, "he": -2.0}, -20.0)
    assert split("hello") == ["▁he", "llo"] and split("hex") == ["▁he", "x"] and "".join(split("a b")) == "▁a▁b"


def test_named_places(spark):
    texts = spark.createDataFrame([(1, "In Upper Town and Baku"), (2, "towns: a b c d"), (3, None)], "id int, t string")
    places = spark.createDataFrame([(1, "Upper Town"), (2, "Town"), (3, "Baku"), (4, "a"), (5, "b"), (6, "c"), (7, "d"), (8, None)], "ref int, n string")
    assert rows(R.named_places(texts, "id", "t", places, "ref", "n")) == [(1, 1), (1, 3)]


def test_one_of_a_source(spark):
    members = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (1, 3, "x"), (2, 8, "x"), (2, 9, "y")], "c int, k int, s string")
    edges = spark.createDataFrame([(1, 1, 2, 0.5), (1, 3, 2, 0.9), (2, 8, 9, 0.1)], "c int, a int, b int, w double")
    assert rows(L.linked_once_a_source(edges, members, "c", "a", "b", "k", "s", "w")) == [(1, 1), (2, 2), (3, 2), (8, 8), (9, 8)]


def test_outcomes(spark):
    old = spark.createDataFrame([(1, "a", 1, True, 5), (2, "a", 1, True, 5), (3, "a", 1, False, 5), (4, "a", 1, True, 5), (5, "a", 1, False, 5)], "k int, c string, t int, o boolean, p int")
    new = spark.createDataFrame([(1, "a", 2, True, 6), (2, None, 1, True, 5), (3, "a", 1, True, 5), (6, "z", 1, True, 5)], "k int, c string, t int, o boolean, p int")
    assert rows(L.outcomes(old, new, "k", ["c"], "t", "o", ["p"])) == [(1, "bumped", True), (2, "changed", False), (3, "reopened", False), (4, "missing", False), (5, "gone", False), (6, "new", False)]


def test_packing_and_sampling(spark):
    assert L.packed({"a": 5, "b": 4, "c": 3, "d": 9}, 8) == [["d"], ["a", "c"], ["b"]]
    df = spark.range(10_000)
    n = L.sampled(df, "id", 0.1, "s").count()
    assert n == L.sampled(df.repartition(7), "id", 0.1, "s").count() and 800 < n < 1200


def test_tree_and_top(spark):
    tree = spark.createDataFrame([(1, None, "a"), (2, 1, "b"), (3, 2, "c"), (4, 9, "lost"), (5, 5, "loop")], "n int, p int, l string")
    assert rows(L.flattened(tree, "n", "p", "l")) == [(1, "a", 0), (2, "a / b", 1), (3, "a / b / c", 2)]
    df = spark.createDataFrame([(1, i % 5, i) for i in range(50)], "g int, v int, id int")
    assert [r["id"] for r in L.ordered_top(df, ["g"], [F.desc("v"), F.col("id")], 3).orderBy("place").collect()] == [4, 9, 14]
