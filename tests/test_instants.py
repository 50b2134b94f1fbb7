from __future__ import annotations

import datetime as dt
from zoneinfo import ZoneInfo

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from skein.operators.instants import parse_instants

UTC = dt.timezone.utc


def us(*a, zone="UTC", fold=0, micro=0):
    return int(dt.datetime(*a, tzinfo=ZoneInfo(zone), fold=fold).timestamp()) * 1_000_000 + micro


def read(spark, texts, zone="Asia/Tbilisi", order="DMY"):
    df = spark.createDataFrame([(i, x, zone, order, "kept") for i, x in enumerate(texts)], "i int, said string, z string, o string, _n_y string")
    out = parse_instants(df, "said", "z", "o", "utc_us")
    assert out.columns == ["i", "said", "z", "o", "_n_y", "utc_us"]
    return [r["utc_us"] for r in out.orderBy("i").collect()]


def test_formats(spark):
    noon = us(2026, 3, 4, 12, 5, zone="Asia/Tbilisi")
    same = ["2026-03-04 12:05", "2026-03-04T12:05:00", "04.03.2026 12:05", "4/3/2026, 12:05", "04-03-26 12:05", "4 მარტი 2026 12:05 სთ", "2026 წლის 4 მარტი 12:05", "4 მარტი, 2026 12:05", "4-Mar-2026 12:05", "March 4, 2026 12:05", "Mar. 4, 2026 12:05 PM", "20260304T120500", "Wed, 04 Mar 2026 12:05:00 +0400"]
    same += ["2026-03-04T08:05:00Z", "2026-03-04 09:05 CET", "2026-03-04 12:05 GMT+4", "2026-03-04 12:05 UTC+04:00", "2026-03-04T03:05:00-0500", " ​2026/03/04  12:05 ", str(noon // 1_000_000), str(noon // 1000), str(noon)]
    assert read(spark, same) == [noon] * len(same)


def test_none(spark):
    bad = [None, "", "-", "N/A", "12.05", "17 მარტი", "გუშინ", "1", "open until filled", "99.99.2026 10:00", "30.02.2026", "2026-02-29", "2026-13-01", "2026-01-01 25:00", "2026-01-01 24:01", "2026-01-01 10:60", "01/02/2026 13:00 PM", "x" * 100_000, "2026-01-01" * 5_000]
    assert read(spark, bad) == [None] * len(bad)


def test_days_and_midnights(spark):
    assert read(spark, ["2026-05-01", "30.04.2026 24:00", "1 მაი. 2026", "01.05.2026 12:00 AM"]) == [us(2026, 5, 1, zone="Asia/Tbilisi")] * 4
    assert read(spark, ["2024-02-29 00:00:00.000007Z", "1969-12-31T23:59:59Z", "2000-01-01T00:00:00,5Z"]) == [us(2024, 2, 29, micro=7), -1_000_000, us(2000, 1, 1, micro=500_000)]


def test_order_and_zone(spark):
    assert read(spark, ["3/4/2026"], "America/New_York", "MDY") == [us(2026, 3, 4, zone="America/New_York")]
    assert read(spark, ["25/4/2026"], "America/New_York", "MDY") == [None]
    assert read(spark, ["25/4/2026", "4/5/2026", "4/4/2026", "2026-04-05"], "UTC", None) == [us(2026, 4, 25), None, us(2026, 4, 4), us(2026, 4, 5)]
    assert read(spark, ["2026-04-05", "2026-04-05T00:00:00Z"], None) == [None, us(2026, 4, 5)]


@pytest.mark.parametrize("zone,twice,skipped", [("Europe/Brussels", (2026, 10, 25, 2, 30), (2026, 3, 29, 2, 30)), ("America/New_York", (2026, 11, 1, 1, 30), (2026, 3, 8, 2, 30))])
def test_daylight_saving(spark, zone, twice, skipped):
    text = lambda x: "%d-%02d-%02d %02d:%02d" % x
    assert read(spark, [text(twice), text(skipped)], zone) == [us(*twice, zone=zone, fold=0), us(*skipped, zone=zone, fold=0)]


def test_empty(spark):
    assert read(spark, []) == []


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.datetimes(dt.datetime(1583, 1, 1), dt.datetime(9998, 12, 31)), max_size=30))
def test_day_arithmetic(spark, times):
    want = [(x.replace(tzinfo=UTC) - dt.datetime(1970, 1, 1, tzinfo=UTC)) // dt.timedelta(microseconds=1) for x in times]
    assert read(spark, [x.isoformat(timespec="microseconds") + "Z" for x in times]) == want
