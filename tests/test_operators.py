"""Small hand-worked cases of the reference operators."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from skein.functions import geo, text
from skein.operators import facets, fixpoint, history, ranking, resolution, totals
from skein.sources import records
from skein.streaming import observations as streams


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def one(spark, expr, *values, schema="v string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).select(expr).collect()]


def test_title_key(spark):
    assert one(spark, text.title_key(F.col("v")), ' „Senior” Developer – (IT) ', "Ａ b", "...", None, "ა  Ბ") == ["senior developer it", "a b", None, None, "ა ბ"]


def test_organization_key(spark):
    assert one(spark, text.organization_key(F.col("v")), 'შპს "ალფა"', "ALFA, LLC", "სს", None) == ["ალფა", "alfa", None, None]


def test_trigram_similarity(spark):
    df = spark.createDataFrame([("abc", "abc"), ("abc", "abd"), ("a", "xyz")], "a string, b string")
    got = [round(r[0], 4) for r in df.select(text.jaccard(text.trigrams(F.col("a")), text.trigrams(F.col("b")))).collect()]
    assert got == [1.0, round(2 / 6, 4), 0.0]


def test_url_key(spark):
    assert one(spark, text.url_key(F.col("v")), "HTTPS://Jobs.Example/A/b/?utm_source=x&id=7#top", "http://x.example/", None) == ["https://jobs.example/A/b?id=7", "http://x.example", None]


def test_stems_and_phrases(spark):
    assert one(spark, text.stem(F.col("v")), "contracts", "boss", "ქალაქში", "და") == ["contract", "boss", "ქალაქ", "და"]


def test_facets_three_outcomes(spark):
    df = spark.createDataFrame([(1, "x", 5), (2, "x", None), (3, "y", 5), (4, "y", None), (5, "x", 1)], "id int, kind string, n int")
    fs = [facets.Filter("kind", F.lit(True), F.col("kind") == "x"), facets.Filter("n", F.col("n").isNotNull(), F.col("n") > 2)]
    got = {r["id"]: (r["n_fail"], r["n_unknown"], r["fail_key"]) for r in facets.evaluated(df, fs).collect()}
    assert got == {1: (0, 0, None), 2: (1, 1, "n"), 3: (1, 0, "kind"), 4: (2, 1, None), 5: (1, 0, "n")}
    kept = facets.evaluated(df, [fs[0], facets.Filter("n", fs[1].known, fs[1].test, keep=True)])
    assert facets.summary(kept).first() == (2, 1, 0, 5)
    assert rows(facets.option_counts(facets.evaluated(df, fs), {"kind": F.array("kind")})) == [("kind", "x", 1, 3), ("kind", "y", 1, 2)]
    assert facets.summary(facets.evaluated(df.limit(0), fs)).first() == (0, 0, 0, 0)
    assert facets.summary(facets.evaluated(df, [])).first() == (5, 0, 0, 5)


def test_histogram(spark):
    df = spark.createDataFrame([(float(x),) for x in [*range(1, 101), -1]] + [(None,)], "v double")
    got = dict(facets.log_histogram(df, "v", bins=4).collect())
    assert sum(got.values()) == 100 and set(got) <= {0, 1, 2, 3}
    assert facets.log_histogram(df.limit(3), "v").count() == 0


def test_leaders_and_units(spark):
    df = spark.createDataFrame([(1, "g", 5.0), (2, "g", 4.0), (3, None, 1.0), (4, None, 2.0)], "id int, g string, p double")
    led = totals.with_leaders(df, "g", [F.asc("p"), F.col("id")])
    assert sorted(r["id"] for r in led.where("leads").collect()) == [2, 3, 4]
    assert totals.units(led, "g", F.col("p") > 1, []).first() == (2,)
    assert rows(totals.most_common(df, "g", "id")) == [("g", 1, 1), (None, 3, 1)]


def t(n):
    return dt.datetime(2026, 1, 1) + dt.timedelta(hours=n)


def test_accepted(spark):
    df = spark.createDataFrame([(1, 1, t(1), "a"), (1, 2, t(3), "a"), (1, 3, t(2), "b"), (1, 4, t(3), None), (1, 5, t(4), "c"), (2, 1, None, "a")], "k int, n int, at timestamp, c string")
    got = [r["outcome"] for r in history.accepted(df, "k", ["n"], "at", ["c"]).orderBy("k", "n").collect()]
    assert got == ["new", "unchanged", "stale", "changed", "changed", "new"]


def test_versions_and_spells(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, None), (1, 4, "a")], "k int, at int, c string")
    assert rows(history.versions(df, "k", ["at"], ["c"])) == [(1, "a", 1, 3), (1, "a", 4, None), (1, None, 3, 4)]
    days = spark.createDataFrame([(1, dt.date(2026, 1, d)) for d in (1, 1, 2, 4, 9)], "k int, d date")
    assert [r[1:] for r in rows(history.spells(days, "k", "d", 2))] == [(dt.date(2026, 1, 1), dt.date(2026, 1, 4), 3), (dt.date(2026, 1, 9), dt.date(2026, 1, 9), 1)]


def test_as_of(spark):
    a = spark.createDataFrame([(1, 1, 5), (2, 1, 0), (3, 9, 5)], "id int, k int, at int")
    b = spark.createDataFrame([(1, 5, 1, "x"), (1, 5, 2, "y"), (1, 6, 3, "z")], "k int, since int, no int, v string")
    assert rows(history.as_of(a, b, "k", "at", "since", "no", ["v"])) == [(1, 1, 5, "y"), (2, 1, 0, None), (3, 9, 5, None)]


def test_streaks_and_cap(spark):
    runs = spark.createDataFrame([("b", n) for n in range(1, 6)], "b string, n int")
    seen = spark.createDataFrame([("b", 1, 1), ("b", 2, 5), ("b", 2, 1)], "b string, k int, n int")
    assert rows(history.missing_streaks(seen, runs, "b", "k", "n", 3, 25, 0.1)) == [("b", 1, 4, True), ("b", 2, 0, False)]
    assert rows(history.missing_streaks(seen, runs, "b", "k", "n", 3, 0, 0.1))[0] == ("b", 1, 4, False)


def test_blocks_and_clusters(spark):
    df = spark.createDataFrame([(i, b, 10.0 * i) for i, b in ((1, "x"), (2, "x"), (3, "x"), (4, "y"), (5, None), (6, None))], "id int, b string, v double")
    assert rows(resolution.block_pairs(df, "id", "b", [], 2, 3)) == [(1, 2), (1, 3), (2, 3)]
    assert rows(resolution.block_pairs(df, "id", "b", [], 2, 2)) == []
    assert rows(resolution.leader_clusters(df, "id", ["b"], ["v"], {"v": ("absolute", 10.0)})) == [(1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 5)]


def test_carried_keys(spark):
    df = spark.createDataFrame([(1, 1, 7), (2, 1, 7), (3, 2, 7), (4, 2, 8), (5, 3, None)], "m int, new int, old int")
    assert rows(resolution.carried_keys(df, "m", "new", "old")) == [(1, 7), (2, None), (3, None)]


def test_first_stated(spark):
    df = spark.createDataFrame([(1, 2, "b", ["y", "x"]), (1, 1, None, ["x"]), (1, 3, "c", None)], "g int, n int, a string, l array<string>")
    assert rows(resolution.first_stated(df, "g", "n", ["a"], ["l"])) == [(1, "b", ["x", "y"])]


def test_quality_and_fusion(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "a", 1)], "q int, k string, rank int")
    grades = spark.createDataFrame([(1, "b", 3), (1, "c", 1)], "q int, k string, grade int")
    got = {r["q"]: (r["ndcg"], r["recall"]) for r in ranking.ranking_quality(ranked, grades, "q", "k", "grade", 2).collect()}
    assert got[2] == (1.0, 1.0) and got[1] == (round(7 / 1.5849625 / (7 + 1 / 1.5849625), 6), 0.5)
    f = {(r["q"], r["k"]): r["score"] for r in ranking.fused([(ranked, 1.0), (ranked, 0.5)], "q", "k").collect()}
    assert f[1, "a"] == pytest.approx(1.5 / 61)


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, [0.0, 0.0])], "id int, v array<float>").withColumn("q", F.col("id"))
    assert [(r["q"], r["id"], r["rank"]) for r in ranking.similar(df.where("id = 1"), df, "q", "id", "v", 0.5, 5).collect()] == [(1, 2, 1)]
    assert ranking.quantised(F.col("v")) is not None and df.select(ranking.quantised(F.col("v")).alias("x")).select("x.codes").collect()[0][0] == [127, 0]


def test_bayes(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "b", "y")], "example int, label string, feature string").withColumn("w", F.lit(1.0))
    p, l = ranking.bayes_model(df, "label", "feature", "w")
    new = spark.createDataFrame([(9, "y"), (9, "never"), (8, "x")], "example int, feature string").withColumn("w", F.lit(1.0))
    assert {r["example"]: r["label"] for r in ranking.bayes_classify(new, p, l, "label", "feature", "w").collect()} == {9: "b", 8: "a"}


def test_geo(spark):
    d = spark.createDataFrame([(41.70, 44.80, 41.71, 44.80)], "a double, b double, c double, d double")
    assert d.select(geo.metres(*(F.col(c) for c in "abcd"))).first()[0] == pytest.approx(1111.95)
    at = spark.createDataFrame([(1, 41.70, 44.80), (2, None, 44.8), (3, 10.0, 10.0)], "id int, a double, b double")
    st = spark.createDataFrame([("s", 41.703, 44.80), ("t", 41.703, 44.80), ("u", 41.709, 44.80)], "c string, x double, y double")
    assert rows(geo.nearest(at, "id", "a", "b", st, "c", "x", "y", 1325.0)) == [(1, "s", 350, 10, 3), (2, None, None, None, 0), (3, None, None, None, 0)]


def test_removable(spark):
    links = spark.createDataFrame([(1, 10), (2, 10), (2, 11), (3, 12), (4, 13)], "l int, r int")
    lefts, rights = fixpoint.removable(links, "l", "r", spark.createDataFrame([(1,), (3,), (4,), (5,)], "l int"), spark.createDataFrame([(10,), (11,), (12,)], "r int"))
    assert rows(lefts) == [(3,), (5,)] and rows(rights) == [(12,)]


def test_records(spark, tmp_path):
    pages = spark.createDataFrame([('<script id="s">{"k": 3}</script>',), ("<p>",), ('<script id="s">broken</script>',)], "html string")
    assert [r["j"] and r["j"]["k"] for r in records.embedded_json(pages, "html", "s", "k int", "j").collect()] == [3, None, None]
    xml = spark.createDataFrame([("<urlset><url><loc>https://x/a?b=1&amp;c</loc><lastmod>2026-01-02T00:00</lastmod></url><url><loc>https://x/b</loc></url></urlset>",)], "x string")
    assert rows(records.sitemap(xml, "x", "2026-01-03")) == [("https://x/b", None)]
    good, bad = records.rate_days(spark.createDataFrame([('[{"date":"2026-01-01T00:00","currencies":[{"code":"usd","quantity":1,"rate":"2.7"},{"code":"eur","quantity":0,"rate":"3"},{"code":"x","quantity":1,"rate":"n"}]}]',)], "t string"), "t")
    assert good.count() == 1 and bad.count() == 2
    df = spark.range(5)
    told = records.export(df, str(tmp_path), "v1")
    assert told["n_rows"] == 5 and records.restore(spark, str(tmp_path)).count() == 5
    assert records.table_digest(df.orderBy(F.desc("id"))).first() == records.table_digest(df).first()


def test_stream_matches_batch(spark, tmp_path):
    data = [(1, 1, t(1), "a"), (1, 2, t(3), "a"), (1, 3, t(2), "b"), (2, 4, t(9), "a"), (1, 5, t(4), "c"), (2, 6, t(8), "z")]
    for i, part in enumerate((data[:3], data[3:])):
        spark.createDataFrame(part, "k int, n int, at timestamp, c string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    told = streams.run_to_end(streams.accepted_stream(streams.file_stream(spark, str(tmp_path / "in"), 1), "k", "n", "at", "c"))
    batch = history.accepted(spark.createDataFrame(data, "k int, n int, at timestamp, c string"), "k", ["n"], "at", ["c"]).select("k", "n", "outcome")
    assert rows(told) == rows(batch)
