from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest

from skein.operators.units import daily_rates, parse_amounts, parse_unit, stated_amounts

D = dt.date


@pytest.mark.parametrize(
    "text,want",
    [
        ("1500 per month", (1500, 1500, None, "month")), ("3350-3900", (3350, 3900, None, None)), ("3700-?", (3700, None, None, None)), ("?-1200", (None, 1200, None, None)), ("4 850 lari", (4850, 4850, "GEL", None)),
        ("1.450 ლ. თვეში", (1450, 1450, "GEL", "month")), ("from $13.6 thousand to $14.6K per year", (13600, 14600, "USD", "year")), ("13-14k", (13000, 14000, None, None)), ("900 - 1.2k", (900, 1200, None, None)),
        ("5,1 ათასი-დან 5.5 thousand-მდე ლარი p.m. + bonus", (5100, 5500, "GEL", "month")), ("590-მდე EUR (ხელზე)", (None, 590, "EUR", None)), ("₾160+/day, plus 10% of sales", (160, None, "GEL", "day")), ("US$ 960-990/თვე", (960, 990, "USD", "month")),
        ("max 40.8K lari a year", (None, 40800, "GEL", "year")), ("14+ საათობრივად", (14, None, None, "hour")),
    ],
)
def test_amounts(text, want):
    assert parse_amounts(text) == tuple(Decimal(x) if isinstance(x, int) else x for x in want)


@pytest.mark.parametrize("text", [None, "", " ", "?-?", "negotiable", "იხ. განცხადება N 4", "ანაზღაურება 2-ჯერ თვეში", "10% from sales", "ხელფასი + ბონუსი"])
def test_no_amount(text):
    assert parse_amounts(text) is None


@pytest.mark.parametrize("text,want", [("GEL", ("GEL", 0)), (" kGEL ", ("GEL", 3)), ("1000 GEL", ("GEL", 3)), ("მლნ ლარი", ("GEL", 6)), ("tetri", ("GEL/100", 0)), ("EUR cents", ("EUR/100", 0)), ("ლარი დ.ღ.გ-ს ჩათვლით", ("GEL", 0)), ("pcs", None), ("???", None), ("", None), (None, None)])
def test_unit(text, want):
    assert parse_unit(text) == want


def rates(spark, rows):
    return daily_rates(spark.createDataFrame(rows, "currency string, valid_from date, quantity int, rate decimal(14,6), published_at timestamp"), "currency", "valid_from", "quantity", "rate")


def test_rates_hold_until_the_next(spark):
    rows = [("USD", D(2026, 1, 1), 1, Decimal(2), None), ("USD", D(2026, 1, 1), 1, Decimal(2), None), ("USD", D(2026, 1, 4), 1, Decimal(3), None), ("AMD", D(2026, 1, 2), 1000, Decimal(7), None), (None, D(2026, 1, 1), 1, Decimal(1), None), ("BAD", D(2026, 1, 1), 0, Decimal(1), None)]
    got = sorted((r["currency"], r["day"].day, float(r["per_unit"])) for r in rates(spark, rows).collect())
    assert got == [("AMD", 2, 0.007), ("USD", 1, 2.0), ("USD", 2, 2.0), ("USD", 3, 2.0), ("USD", 4, 3.0)]


def test_stated_amounts(spark):
    fx = rates(spark, [("USD", D(2026, 1, 1), 1, Decimal("2.5"), None), ("USD", D(2026, 1, 10), 1, Decimal(3), None)])
    periods = spark.createDataFrame([("hour", Decimal(168)), ("month", Decimal(1)), ("year", Decimal("0.083333"))], "period_code string, per_month decimal(14,6)")
    rows = [
        (1, "100-200 usd", None, None, D(2026, 1, 5), "x"), (2, "10 per hour", 5.0, "kGEL", D(2026, 1, 5), "x"), (3, "100 usd", None, None, D(2025, 12, 31), "x"), (4, "100 usd", None, None, D(2027, 1, 1), "x"), (5, "0", -1.0, "USD", D(2026, 1, 5), "x"),
        (6, None, float("nan"), "GEL", D(2026, 1, 5), "x"), (7, None, float("inf"), "GEL", None, "x"), (8, "5 per week", None, None, None, "x"), (9, "x" * 100_000, 1.5, "???", None, "x"), (10, None, 2.5, "GEL", None, "x"), (11, "up to 5 usd", None, None, None, "x"), (1, "100-200 usd", None, None, D(2026, 1, 5), "x"),
    ]
    df = spark.createDataFrame(rows, "id long, pay string, val double, unit string, day date, _key string")
    got = sorted((r["id"], r["field_name"], r["gel"]) for r in stated_amounts(df, "id", "pay", "val", "unit", "day", fx, periods).collect())
    assert got == sorted([(1, "salary_lo", 250), (1, "salary_hi", 500)] * 2 + [(2, "salary_lo", 1680), (2, "salary_hi", 1680), (2, "value", 5000), (4, "salary_lo", 300), (4, "salary_hi", 300), (10, "value", 3)])


def test_empty(spark):
    fx = rates(spark, [])
    periods = spark.createDataFrame([], "period_code string, per_month decimal(14,6)")
    df = spark.createDataFrame([(1, "100", None, None, None)], "id long, pay string, val double, unit string, day date")
    assert stated_amounts(df.limit(0), "id", "pay", "val", "unit", "day", fx, periods).count() == 0
    assert stated_amounts(df, "id", "pay", "val", "unit", "day", fx, periods).count() == 0
