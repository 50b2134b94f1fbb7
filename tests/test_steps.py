from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from skein.operators import steps as S


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_a_second_step_changes_nothing(spark):
    kept = spark.createDataFrame([(1, "a", None), (2, "a", 1), (3, None, None)], "k int, c string, n int")
    live = spark.createDataFrame([(1, "a", None), (2, "b", 1), (4, None, 2)], "k int, c string, n int")
    closed, opened = S.version_step(kept, live, "k", ["c", "n"], F.lit(9))
    assert rows(closed) == [(2, "a", 1, 9), (3, None, None, 9)] and rows(opened) == [(2, "b", 1, 9), (4, None, 2, 9)]
    now = kept.join(closed.select("k"), "k", "left_anti").unionByName(opened.drop("valid_from"))
    closed, opened = S.version_step(now, live, "k", ["c", "n"], F.lit(10))
    assert closed.count() == 0 and opened.count() == 0


def test_drift(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k int, d string")
    assert S.drift(a, a, "k", "d").first() == (0, 0, 0, 0.0)
    assert S.drift(a, spark.createDataFrame([(1, "z"), (3, None), (9, "n")], "k int, d string"), "k", "d").first() == (1, 1, 1, 0.666667)
    assert S.drift(a.limit(0), a.limit(0), "k", "d").first() == (0, 0, 0, 0.0)


def test_pins(spark):
    base = [(1, 41.700, 44.800, "t", "a"), (2, 41.701, 44.800, "t", "a"), (3, 41.720, 44.800, "t", "b"), (4, 49.0, 44.8, "t", "a"), (5, None, 44.8, "t", "a"), (6, 41.7005, 44.8, "t", None)]
    crowd = [(10 + i, 41.71, 44.81, "t", s) for i, s in enumerate("cde")]
    got = {r["id"]: (r["is_candidate"], r["is_trusted"]) for r in S.trusted_pins(spark.createDataFrame(base + crowd, "id int, a double, o double, city string, street string"), "id", "a", "o", "city", "street").collect()}
    assert got[1] == got[2] == (True, True) and got[3] == (True, False) and got[4] == (False, False) and got[5] == (False, False) and got[6] == (True, False) and got[10] == (False, False)


def test_word_score(spark):
    df = spark.createDataFrame([(["a", "b"],), (["x"],), (None,)], "w array<string>")
    wants = {"one": (0.5, ["a"], 1), "two": (0.5, ["b", "c"], 2), "none": (9.0, [], 1)}
    assert [r[0] for r in df.select(S.word_score(F.col("w"), wants)).collect()] == [0.75, 0.0, 0.0]
    assert [r[0] for r in df.select(S.word_score(F.col("w"), {})).collect()] == [0.0] * 3


def test_steps_between_reach_every_delivery(spark):
    states = spark.createDataFrame([(1, 10, "a"), (1, 11, "a"), (2, 10, "b"), (2, 11, "a"), (5, 10, "b"), (5, 12, "a"), (9, 12, "a")], "no int, k long, v string")
    before, after = S.steps_between(states, "no", "k")
    assert sorted(map(tuple, before.select("k.*", "v").collect())) == [(2, 10, "a"), (2, 11, "a"), (5, 10, "b"), (5, 11, "a"), (9, 10, "b"), (9, 12, "a")]
    assert sorted(map(tuple, after.select("k.*", "v").collect())) == [(2, 10, "b"), (2, 11, "a"), (5, 10, "b"), (5, 12, "a"), (9, 12, "a")]
    assert sorted(map(tuple, S.drift(before, after, "k", "v", by="no").collect())) == [(2, 0, 0, 1, 0.5), (5, 1, 1, 0, 0.5), (9, 1, 0, 0, 0.5)]


@pytest.mark.parametrize("name", ["link_outcomes_all", "link_refetch_all", "step_versions_all", "step_drift_all"])
def test_queries_of_steps_use_every_delivery(spark, name):
    sf = "/root/testdata/sf0.001"
    numbers = {r[0] for r in spark.read.parquet(f"{sf}/listing_snapshots.parquet").select("snapshot_no").distinct().collect()}
    assert {r[0] for r in entry.queries()[name](spark, sf).select("snapshot_no").distinct().collect()} == numbers - {min(numbers)}
