"""Units and periods belong to the nearest amount of their clause; large amounts; generated texts against what they were made of."""

from __future__ import annotations

import datetime as dt
import itertools
from decimal import Decimal

import pytest

from skein.operators.units import daily_rates, parse_amounts, stated_amounts


@pytest.mark.parametrize(
    "text,want",
    [
        ("USD account; 800 GEL/month", (800, 800, "GEL", "month")), ("3 positions, 1200 GEL", (1200, 1200, "GEL", None)), ("from 9:00, 1500 lari", (1500, 1500, "GEL", None)), ("salary 1,200 GEL; 40 hours a week", (1200, 1200, "GEL", None)),
        ("40 hours a week, 1,200 GEL", (1200, 1200, "GEL", None)), ("pay 1500, USD, monthly", (1500, 1500, "USD", "month")), ("5 posts | up to 900 EUR a month", (None, 900, "EUR", "month")), ("10:00-19:00; 2 000 - 2 500 lari", (2000, 2500, "GEL", None)),
        ("40 hours and 1200 GEL", (1200, 1200, "GEL", None)), ("between 800 and 1,000 USD a year", (800, 1000, "USD", "year")), ("$ 700 – 900 / week, bonus 50 EUR", (700, 900, "USD", "week")), ("1200", (1200, 1200, None, None)),
    ],
)
def test_binding(text, want):
    assert parse_amounts(text) == tuple(Decimal(x) if isinstance(x, int) else x for x in want)


UNITS = {"GEL": ["lari", "ლარი", "₾"], "USD": ["USD", "$", "დოლარი"], "EUR": ["euro"]}
SPANS = {None: [""], "month": ["per month", "თვეში", "/mo"], "week": ["a week", "/კვირა"], "hour": ["an hour"]}
BEFORE = ["", "3 places; ", "from 10:00, ", "EUR account; ", "40 hours a week, "]
AFTER = ["", "; 40 hours a week", ", 5 days", " | bonus", "; tel. N 5"]


@pytest.mark.parametrize("shape", ["{a} {u} {p}", "{a} - {b} {u} {p}", "from {a} {u} to {b} {u} {p}", "up to {b} {u} {p}", "{u} {a}+ {p}"])
def test_generated(shape):
    for (unit, spellings), (span, periods), before, after in itertools.product(UNITS.items(), SPANS.items(), BEFORE, AFTER):
        for u, p, (a, b) in itertools.product(spellings, periods, [(1250, 1400), (90, 2750)]):
            text = before + shape.format(a=f"{a:,}", b=f"{b:,}", u=u, p=p).strip() + after
            low = None if "up to" in shape else Decimal(a)
            high = None if "+" in shape else Decimal(b) if "{b}" in shape else Decimal(a)
            assert parse_amounts(text) == (low, high, unit, span), text


def test_large_amounts(spark):
    fx = daily_rates(spark.createDataFrame([("USD", dt.date(2026, 1, 1), 1, Decimal("2.5"))], "currency string, valid_from date, quantity int, rate decimal(14,6)"), "currency", "valid_from", "quantity", "rate")
    periods = spark.createDataFrame([("month", Decimal(1)), ("hour", Decimal(168))], "period_code string, per_month decimal(14,6)")
    day = dt.date(2026, 1, 2)
    rows = [(1, "1000000000000001 GEL", None, None, day), (2, "2000000000000000 USD", 3e15, "GEL", day), (3, "9" * 40 + " GEL", 1e30, "GEL", day), (4, "9" * 18 + " GEL per hour", 1e18, "mln GEL", day), (5, "1" + "0" * 15 + " - 2" + "0" * 15 + " GEL", None, None, day)]
    df = spark.createDataFrame(rows, "id long, pay string, val double, unit string, day date")
    got = sorted((r["id"], r["field_name"], r["gel"]) for r in stated_amounts(df, "id", "pay", "val", "unit", "day", fx, periods).collect())
    assert got == sorted([(1, f, 10**15 + 1) for f in ("salary_lo", "salary_hi")] + [(2, f, 5 * 10**15) for f in ("salary_lo", "salary_hi")] + [(2, "value", 3 * 10**15), (5, "salary_lo", 10**15), (5, "salary_hi", 2 * 10**15)])
