"""Edge cases of rollups: nulls, ties, empty tables, clashing names."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import rollups as R


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_busiest(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 1), ("a", "y", 1), ("a", "z", 1), ("b", None, 1), (None, "x", 1)], "o string, i string, n int")
    assert rows(R.busiest(df.select("o", "i"), "o", "i")) == [("a", "x", 1, 4, 2), ("a", "y", 2, 4, 1), ("a", "z", 1, 4, 3)]
    assert R.busiest(df.limit(0), "o", "i").count() == 0


def test_guards(spark):
    runs = spark.createDataFrame([("a", 1, True), ("a", 2, True), ("a", 3, False), ("a", 4, True), ("a", 5, True), ("a", 4, True)], "b string, r int, ok boolean")
    counts = spark.createDataFrame([("a", 1, 200), ("a", 2, 90), ("a", 3, 5), ("a", 4, 400)], "b string, r int, n long")
    got = rows(R.run_guards(runs, counts, "b", "r", F.col("ok"), floor=10))
    assert got == [("a", 1, 200, None, "ok"), ("a", 2, 90, 200, "collapse"), ("a", 4, 400, 90, "ok"), ("a", 5, 0, 400, "collapse")]
    assert R.run_guards(runs, counts, "b", "r", F.col("ok"), floor=10, baseline=50).where("flag = 'surge'").count() == 1


def test_runs_without_a_complete_one(spark):
    runs = spark.createDataFrame([("a", 1, 10, "failed"), ("a", 1, 11, "failed"), ("b", None, 5, "completed")], "b string, at int, id int, s string")
    assert rows(R.latest_runs(runs, "b", "at", "id", F.col("s") == "completed", ["id"])) == [("a", 11, None), ("b", 5, 5)]


def test_texts(spark):
    df = spark.createDataFrame([(1, "one\none\n  two  \n\nme@x.example\n" + "long " * 30), (2, None), (3, "")], "k int, t string")
    assert rows(R.short_lines(df, "k", "t", 20, 5)) == [(1, 0, "one"), (1, 1, "two")] and rows(R.short_lines(df, "k", "t", 20, 1)) == [(1, 0, "one")]
    keys = spark.createDataFrame([("ilia chav",), ("al chav",), ("chav",), (None,)], "k string")
    assert [r[0] for r in keys.select(R.initial_forms(F.col("k"))).collect()] == [["i chav", "il chav"], [], [], []]
    words = spark.createDataFrame([(["a", "b"],), ([],), (None,)], "w array<string>")
    text, share = R.translated(F.col("w"), {"a": "x"})
    assert [tuple(r) for r in words.select(text, share).collect()] == [("x b", 0.5), ("", 0.0), (None, 0.0)]
    facts = spark.createDataFrame([('{"a": 1, "b": {"c": "d"}}',), ("broken",), (None,)], "j string")
    assert [r[0] for r in facts.select(R.json_facts(F.col("j"), {"a": "$.a", "c": "$.b.c", "no": "$.no"})).collect()] == ['{"a":"1","c":"d"}', "{}", "{}"]


def test_leaders_against_brute_force(spark):
    import random

    from skein.operators.resolution import leader_clusters

    rng = random.Random(9)
    data = [(i, rng.choice(["a", "a", "b"]), rng.choice([None, float(rng.randrange(-30, 60))]), float(rng.randrange(5))) for i in range(300)]
    df = spark.createDataFrame(data, "id int, b string, v double, w double").repartition(3)
    for how, most in (("absolute", 4.0), ("relative", 0.2)):
        want = {}
        for block in "ab":
            leaders = []
            for i, _, v, w in sorted((x for x in data if x[1] == block), key=lambda x: (x[2] is None, x[2] or 0, x[0])):
                hit = next((k for k, lv, lw in leaders if v is not None and abs(v - lv) <= (most if how == "absolute" else most * abs(lv)) and abs(w - lw) <= 1), None)
                want[i] = i if hit is None else hit
                if hit is None and v is not None:
                    leaders.append((i, v, w))
        got = {r["id"]: r["leader"] for r in leader_clusters(df, "id", ["b"], ["v"], {"w": ("absolute", 1.0), "v": (how, most)}).collect()}
        assert got == want
