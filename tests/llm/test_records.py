from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from skein.llm.survivors import status_stated, survivors, text_stated, time_stated, truth

RECORDS = "g long, id long, board string, rank int, title string, status string, due timestamp, at timestamp, _r string"


def t(n):
    return dt.datetime(2026, 1, 1) + dt.timedelta(hours=n)


def pick(spark, rows):
    df = spark.createDataFrame(rows, RECORDS)
    stated = {"title": text_stated("title"), "status": status_stated("status"), "due": time_stated("due")}
    return sorted(map(tuple, survivors(df, "g", "id", stated, [F.col("rank"), -F.unix_micros("at")]).collect()))


def test_survivors(spark):
    rows = [
        (1, 10, "a", 2, "Good", "OK", dt.datetime(1970, 1, 1), t(1), ""), (1, 11, "b", 1, "Cut off…", "ACTIVE", dt.datetime(2099, 12, 31, 5), t(2), ""), (1, 12, "b", 1, " n/a ", None, None, t(3), ""), (1, 13, "c", None, "Worse", "closed", t(9), None, ""),
        (2, 20, "a", 1, "Alone", "active", t(1), t(1), ""), (2, 20, "a", 1, "Alone", "active", t(1), t(1), ""), (None, 30, "a", 1, "x", "active", t(1), t(1), ""), (None, 31, "a", 1, "x", "active", t(1), t(1), ""),
        (3, 41, "a", 1, "x", "active", t(1), t(1), ""), (3, 40, "a", 1, "y" * 100_000, "active", None, t(1), ""), (4, 50, "a", 1, "", "", None, None, ""), (4, 51, "a", 1, None, None, None, None, ""),
    ]
    assert pick(spark, rows) == [(1, "due", 13), (1, "status", 11), (1, "title", 10), (3, "due", 41), (3, "status", 40), (3, "title", 40)]


def test_survivors_empty(spark):
    assert pick(spark, []) == []


def test_truth_trusts_the_source_that_agrees(spark):
    rows = [(g, s, v) for g in range(8) for s, v in (("good", f"v{g}"), ("also", f"v{g}"), ("bad", f"w{g}"))] + [(9, "good", "right"), (9, "bad", "wrong"), (10, "bad", None), (None, "good", "x"), (11, None, "x")]
    df = spark.createDataFrame(rows, "g long, s string, v string")
    got = {r["g"]: (r["value"], r["n_sources"]) for r in truth(df, "g", "s", {"f": F.col("v")}).collect()}
    assert got[9] == ("right", 1) and got[3] == ("v3", 2) and 10 not in got
    assert truth(df.limit(0), "g", "s", {"f": F.col("v")}).count() == 0
