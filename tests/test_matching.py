"""Small hand-worked cases of names, pair decisions, expansion and lookups; nulls, ties and empty tables."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from skein.functions import expansion as E
from skein.functions import names as N
from skein.functions import text as X
from skein.operators import facets
from skein.operators import matching as M
from skein.operators.lookup import lookup
from skein.plans import matches


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def one(spark, expr, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(expr).collect()]


def test_values_in_full(spark):
    said = ["Acme LLP", "Acme Limited", "ACME Ltda", "Acme Corporation", "ინდმეწარმე აკმე", "სსიპ აკმე", "NGO Acme", "LLC", None]
    assert one(spark, X.organization_key(F.col("v")), *said) == ["acme", "acme", "acme", "acme", "აკმე", "აკმე", "ngo acme", None, None]
    links = [f"https://x.example/a?id=1&{p}=2" for p in ("utm_source", "utm_id", "referrer", "ref", "source", "mc_eid", "yclid", "igshid", "utm_other")]
    assert one(spark, X.url_key(F.col("v")), *links) == ["https://x.example/a?id=1"] * 6 + [f"https://x.example/a?id=1&{p}=2" for p in ("yclid", "igshid", "utm_other")]
    assert one(spark, X.stem(F.col("v")), "სახლებიდან", "სახლისკენ", "სახლამდე", "სახლებმა", "სახლო", "cars", "glass", "its", "ვარ") == ["სახლ", "სახლ", "სახლ", "სახლ", "სახლ", "car", "glass", "its", "ვარ"]


def test_buyers(spark):
    assert one(spark, N.buyer_key(F.col("v")), "შ.პ.ს. აკმე", "ს.ს. აკმე – ჯგუფი", "UNICEF", "გაეროს ბავშვთა ფონდი", "", None) == ["აკმე", "აკმე ჯგუფი", "unicef", "unicef", None, None]
    pairs = spark.createDataFrame([("acme", "acme group"), ("acme", "acmeco"), ("company", "company x"), (None, "a"), ("a b", "a b")], "a string, b string")
    assert [r[0] for r in pairs.select(N.buyers_match(F.col("a"), F.col("b"))).collect()] == [True, False, False, False, True]
    assert one(spark, N.tender_subject(F.col("v")), "სსიპ აკმე აცხადებს ტენდერს ქაღალდის შესყიდვაზე", "Tender for the procurement of", None) == ["ქაღალდის", None, None]
    assert one(spark, N.reference_codes(F.col("v")), "№ 12/3 and NAT2300012/1, 1234567 but 1234", "", None) == [["№12/3", "nat2300012/1", "1234567"], [], None]
    assert one(spark, N.dominant_script(F.col("v")), "აბ ab", "abc ა", "12", None) == ["georgian", "latin", None, None]


@pytest.mark.parametrize("share", [0.3, 0.45, 0.8, 1.0])
def test_similar_pairs_against_brute_force(spark, share):
    rng = random.Random(7)
    data = [(i, "hot" if i % 3 else "cold", [rng.choice("abcdefgh") for _ in range(rng.randrange(0, 9))], "x") for i in range(120)] + [(900, None, ["a"], "x"), (901, "hot", None, "x")]
    df = spark.createDataFrame(data, "k long, b string, g array<string>, l string")
    got = rows(M.similar_pairs(df, "k", "b", "g", share).select("l", "r"))
    jac = lambda a, b: len(a & b) / len(a | b) if a and b else 0
    want = sorted((x[0], y[0]) for x in data for y in data if x[0] < y[0] and x[1] and x[1] == y[1] and jac(set(x[2] or []), set(y[2] or [])) >= share)
    assert got == sorted(want, key=repr) and want
    assert M.similar_pairs(df.limit(0), "k", "b", "g", share).count() == 0


def test_similar_pairs_and_members_send_nothing_to_the_driver(spark):
    df = spark.createDataFrame([(1, "x", ["a", "b"]), (2, "x", ["a", "b", None]), (3, "y", ["a"])], "k long, b string, g array<string>")
    near = M.similar_pairs(df, "k", "b", "g", 0.5)
    assert [(r["l"], r["r"], round(r["similarity"], 6)) for r in near.collect()] == [(1, 2, 0.666667)]
    members = spark.createDataFrame([(1, 7, "p"), (1, 3, "q"), (2, 5, "r")], "i long, id long, s string")
    groups = near.unionByName(spark.createDataFrame([(1, 1, 1.0)], "l long, r long, similarity double"))
    met = M.of_members(groups, members, "i", "id")
    assert sorted((r["l"]["id"], r["r"]["id"], r["r"]["s"]) for r in met.collect()) == [(3, 5, "r"), (3, 7, "p"), (5, 7, "p")]
    for made in (near, met):
        assert "Broadcast" not in made._jdf.queryExecution().sparkPlan().toString()


@pytest.mark.parametrize("name", ["match_titles", "match_jobs", "match_held", "match_recheck"])
def test_match_queries_broadcast_no_rows(spark, name):
    assert "Broadcast" not in matches.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()


def test_job_decision(spark):
    facts = [(True, 1.0, True, 1, True, True), (False, 0.4, True, 2, True, True), (False, 0.4, True, 3, True, True), (False, 0.9, True, 2, False, False), (False, 0.5, True, 1, None, None), (False, 0.9, True, 40, True, True), (False, 0.9, None, None, True, None), (False, 0.9, False, None, None, True), (False, 0.6, False, None, True, True)]
    df = spark.createDataFrame(facts, "s boolean, t double, v boolean, n long, o boolean, d boolean")
    got = [tuple(r[0]) for r in df.select(M.job_decision(*(F.col(c) for c in "stvnod"))).collect()]
    assert got == [("distinct", 0.0), ("needs_review", 0.5), ("distinct", 0.0), ("confirmed_same", 0.97), ("probable_same", 0.75), ("needs_review", 0.65), ("needs_review", 0.55), ("distinct", 0.0), ("distinct", 0.0)]


def test_held_and_standing(spark):
    pairs = spark.createDataFrame([(1, 2, "a", "b", "confirmed_same", 0.97), (1, 3, "a", "b", "confirmed_same", 0.97), (4, 5, "a", "b", "confirmed_same", 0.97), (1, 6, "a", "c", "needs_review", 0.5)], "l long, r long, ls string, rs string, decision string, confidence double")
    assert rows(M.held(pairs, "l", "r", "ls", "rs").select("l", "r", "decision", "confidence")) == [(1, 2, "needs_review", 0.6), (1, 3, "needs_review", 0.6), (1, 6, "needs_review", 0.5), (4, 5, "confirmed_same", 0.97)]
    t = lambda n: dt.datetime(2026, 1, n)
    log = spark.createDataFrame([(1, 2, "same", "rule", t(3), 1, None), (2, 1, "other", "human", t(1), 2, None), (1, 2, "gone", "human", t(9), 3, t(9)), (3, 3, "same", "rule", t(1), 4, None), (5, 4, "a", None, None, 5, None), (4, 5, "b", None, None, 6, None)], "a long, b long, d string, w string, at timestamp, id long, sup timestamp")
    got = M.standing(log, "a", "b", "d", F.col("w") == "human", "at", "id", F.col("sup").isNotNull())
    assert rows(got) == [(1, 2, "other"), (4, 5, "b")]
    assert M.standing(log.limit(0), "a", "b", "d", F.col("w") == "human", "at", "id", F.lit(False)).count() == 0


def test_canonical(spark):
    df = spark.createDataFrame([(1, 10, "closed", None, "x"), (1, 9, "active", "T", "x"), (1, 11, "expired", "U", "x"), (2, 1, None, None, "x"), (None, 5, "active", "V", "x")], "g long, k long, s string, title string, _k string")
    got = {r["g"]: r for r in M.canonical(df, "g", "k", "s", ["active", "expired", "closed"], {"title": F.col("title")}).collect()}
    assert (got[1]["status"], got[1]["title"], got[1]["conflicts"], got[1]["n_members"]) == ("active", "T", "title", 3)
    assert (got[2]["status"], got[2]["title"], got[2]["conflicts"]) == ("closed", None, "") and set(got) == {1, 2}


def test_expansion(spark):
    assert E.transliterated("saxli") == ["ს", "ა", "ხ", "ლ"] and E.transliterated("it") is None and E.transliterated("café") is None
    says = lambda q: E.says_all(F.col("v"), q, {"contract": ["ხელშეკრულებ"]})
    assert one(spark, says("contracts"), "ხელშეკრულებით", "a contract", "other", None) == [True, True, False, None]
    assert one(spark, says("IT"), "digital", "an it firm", "IT") == [False, True, True]
    assert one(spark, says("giz"), "agiz", "giz-group") == [False, True] and one(spark, says(""), "x") == [True]
    assert one(spark, says("მიწის saxli"), "მიწის სახლში") == [True]


def test_lookup(spark):
    places = spark.createDataFrame([(1, "city", "ჭანოდური", "Chanoduri", ["Bay Town"]), (2, "district", "ზემო ჭანოდური", None, None), (3, "city", None, None, None)], "ref int, lv string, ka string, en string, al array<string>")
    asked = spark.createDataFrame([("Chanoduri city",), ("ჭანოდურში",), ("bay",), ("village",), (None,), ("nowhere",)], "said string")
    got = rows(lookup(asked, "said", places, "ref", "lv", ["ka", "en"], "al", ["city", "district"], 5))
    assert got == sorted([("Chanoduri city", 1, 0, 1), ("Chanoduri city", 2, 1, 2), ("ჭანოდურში", 1, 0, 1), ("ჭანოდურში", 2, 1, 2), ("bay", 1, 0, 1)], key=repr)
    assert lookup(asked.limit(0), "said", places, "ref", "lv", ["ka", "en"], "al", ["city"], 5).count() == 0


def test_facet_helpers(spark):
    df = spark.createDataFrame([(1.0, None), (None, 5.0), (2.0, 9.0), (None, None)], "lo double, hi double")
    ask = lambda a, b: [r[0] for r in df.select(facets.overlapping(F.col("lo"), F.col("hi"), a, b)).collect()]
    assert ask(3.0, None) == [False, True, True, None] and ask(None, 3.0) == [True, False, True, None] and ask(None, None)[:3] == [True] * 3
    assert facets.canonical_form({"b": ["y", "x", "x"], "a": "", "c": 1, "other": 2}, ["a", "c", "b"]) == {"c": 1, "b": ["x", "y"]}
