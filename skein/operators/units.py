"""Amounts stated in different units, converted to one.

Method: one multi-pattern automaton (Aho-Corasick) marks every unit alias and bound word
of a text, numbers are read beside it, the longest match wins where aliases overlap and
the field's own defaults settle what the text leaves open; the conversion factors are then
joined from small tables, so a new rate never touches the parser.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Callable, Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Unit aliases in lower case. An alias with a trailing * may go on (case endings).
CURRENCIES = {
    "GEL": ["gel", "lari", "laris", "₾", "ლარ*", "ლ.", "ლ", "kgel", "mgel"],
    "GEL/100": ["tetri", "tetris", "თეთრ*"],
    "USD": ["usd", "us$", "$", "dollar", "dollars", "us dollars", "u.s. dollars", "დოლარ*", "აშშ დოლარ*"],
    "USD/100": ["us cent", "us cents", "usd cent", "usd cents"],
    "EUR": ["eur", "euro", "euros", "€", "ევრო*"],
    "EUR/100": ["euro cent", "euro cents", "eur cent", "eur cents", "eurocent", "eurocents", "ევროცენტ*"],
    "GBP": ["gbp", "£", "pound", "pounds", "pounds sterling", "ფუნტ*", "გირვანქ*"],
    "GBP/100": ["pence", "penny"],
    "TRY": ["try", "₺", "lira", "liras", "tl", "ლირ*"],
    "AMD": ["amd", "֏", "dram", "drams", "დრამ*"],
    "RUB": ["rub", "₽", "ruble", "rubles", "rouble", "roubles", "რუბლ*"],
    "AZN": ["azn", "₼", "manat", "manats", "მანათ*"],
    "UAH": ["uah", "₴", "hryvnia", "გრივნ*"],
    "CHF": ["chf", "francs", "ფრანკ*"],
}
SCALES = {3: ["k", "thousand", "thousands", "thd", "ათას*", "ათ.", "ათ", "kgel", "kusd", "keur"], 6: ["m", "mln", "mn", "million", "millions", "მლნ", "მლნ.", "მილიონ*", "mgel"], 9: ["bn", "billion", "მლრდ", "მილიარდ*"]}
PERIODS = {
    "hour": ["per hour", "an hour", "hourly", "/hr", "/hour", "/h", "p.h.", "/სთ", "საათში", "საათობრივ*", "საათ*", "სთ"],
    "day": ["per day", "a day", "daily", "/day", "/d", "per diem", "დღეში", "დღიურ*", "ყოველდღიურ*", "/დღე", "დღე"],
    "week": ["per week", "a week", "weekly", "/wk", "/week", "/w", "p.w.", "კვირაში", "კვირეულ*", "ყოველკვირეულ*", "/კვირა", "კვირა"],
    "month": ["per month", "a month", "monthly", "/month", "/mo", "/m", "p.m.", "pcm", "თვეში", "თვიურ*", "ყოველთვიურ*", "/თვე", "თვე"],
    "year": ["per year", "a year", "per annum", "annually", "annual", "yearly", "/yr", "/year", "/y", "p.a.", "წელიწადში", "წლიურ*", "ყოველწლიურ*", "/წ", "/წელი", "წელი", "წელში"],
}
LOWER = ["from", "min", "min.", "minimum", "at least", "starting", "over", "above", "-დან", "დან", "მინ.", "მინიმუმ", "არანაკლებ"]
UPPER = ["up to", "max", "max.", "maximum", "at most", "under", "below", "to", "-მდე", "მდე", "მაქს.", "მაქსიმუმ", "არაუმეტეს"]

#: Digits with thousands groups (a mark before exactly three digits), else with a decimal mark.
_NUMBER = re.compile(r"(?<![\d.,])(?:\d{1,3}(?:[ .,'’]\d{3})+(?!\d)|\d+)(?:[.,]\d{1,2}(?!\d)|[.,]\d{4,}(?!\d))?")
#: What makes a number no amount: a percentage, a count of times, a reference number, a time of day.
_AFTER_NO = re.compile(r"\s*(?:%|პროცენტ|percent|-?\s?ჯერ|times\b|x\b)")
_BEFORE_NO = re.compile(r"(?:(?<!\w)n|№|#|no\.)\s*$")
_TIME = re.compile(r"(?<!\d)\d{1,2}:\d{2}(?::\d{2})?(?!\d)")
#: What joins two amounts to a range, and what else may stand between them.
_JOINS = re.compile(r"[-–—−]|დან|(?<!\w)(?:to|and|until|till)(?!\w)|\.\.")
_BETWEEN = re.compile(r"(?:[\s\-–—−.()/+]|დან|(?<!\w)(?:to|and|until|till)(?!\w))*")
#: Where a clause ends, outside of numbers and aliases.
_CLAUSE = re.compile(r"[;|•]|[,.](?=\s)")

_automaton = None


def _matcher():
    """The automaton over all aliases; built once a process. Its values: (kind, value, alias, open end)."""
    global _automaton
    if _automaton is None:
        import ahocorasick

        found: dict[str, list] = {}
        for kind, table in (("unit", CURRENCIES), ("scale", SCALES), ("period", PERIODS), ("bound", {"lo": LOWER, "hi": UPPER})):
            for value, aliases in table.items():
                for alias in aliases:
                    found.setdefault(alias.rstrip("*"), []).append((kind, value, alias.endswith("*")))
        _automaton = ahocorasick.Automaton()
        for alias, meanings in found.items():
            _automaton.add_word(alias, (alias, meanings))
        _automaton.make_automaton()
    return _automaton


def folded(text: str) -> str:
    text = unicodedata.normalize("NFKC", text).lower()
    return re.sub(r"[​-‏⁠﻿­]", "", re.sub(r"\s+", " ", text)).strip()


def _marks(text: str) -> list[tuple[int, int, list]]:
    """Aliases as (start, end, meanings), longest first where they overlap, whole words only."""
    spans = []
    for last, (alias, meanings) in _matcher().iter(text):
        start, end = last - len(alias) + 1, last + 1
        before, after = text[start - 1 : start], text[end : end + 1]
        if alias[0].isalpha() and before.isalpha():
            continue
        meanings = [(k, v) for k, v, more in meanings if more or not (alias[-1].isalpha() and after.isalpha())]
        if meanings:
            spans.append((start, end, meanings))
    spans.sort(key=lambda s: (s[0] - s[1], s[0]))
    kept: list[tuple[int, int, list]] = []
    for s in spans:
        if all(s[1] <= k[0] or s[0] >= k[1] for k in kept):
            kept.append(s)
    return sorted(kept)


def _value(token: str) -> Decimal:
    grouped = re.fullmatch(r"(\d{1,3}(?:[ .,'’]\d{3})+)((?:[.,]\d+)?)", token)
    whole, rest = (re.sub(r"\D", "", grouped[1]), grouped[2]) if grouped else re.fullmatch(r"(\d+)((?:[.,]\d+)?)", token).groups()
    return Decimal(whole + (rest and "." + rest[1:]))


def parse_unit(text: str | None) -> tuple[str, int] | None:
    """Unit text of a value to (unit, power of ten), e.g. ("GEL", 3); None if it is no known money."""
    if not text or not (text := folded(text)):
        return None
    marks, power = _marks(text), 0
    units = [v for _, _, ms in marks for k, v in ms if k == "unit"]
    powers = [v for _, _, ms in marks for k, v in ms if k == "scale"]
    if not units or len(set(units)) > 1:
        return None
    scale = sum(powers[:1])
    if m := re.search(r"(?<!\d)(1000000|1000|100|10)(?!\d)", text):
        power = len(m[1]) - 1
    return units[0], scale + power


def parse_amounts(text: str | None) -> tuple[Decimal | None, Decimal | None, str | None, str | None] | None:
    """Pay text to (lower bound, upper bound, unit, period); None if it states no amount.

    A number or two joined as a range is an amount. Units and periods belong to the nearest amount of
    their clause, those of a clause without one to the amount that is taken: the first that has a
    unit of money, else the first with a period or scale, else the first (the field's context). A single amount is both bounds
    unless a bound word, a plus or a question mark leaves one side open.
    """
    if not text or not (text := re.sub(r" ?/ ?", "/", folded(text))):
        return None
    marks = _marks(text)
    numbers = _numbers(text, marks)
    if not numbers:
        return None
    amounts = _joined(text, numbers, marks)
    ends = [m.start() for m in _CLAUSE.finditer(text) if not any(s <= m.start() < e for s, e, _ in marks) and not any(n[0] <= m.start() < n[1] for n in numbers)]
    clause = lambda at: bisect.bisect_left(ends, at)
    clauses = [clause(a[0][0]) for a in amounts]
    own: list[dict[str, tuple[int, str]]] = [{} for _ in amounts]
    free: dict[str, list[tuple[int, int, str]]] = {"unit": [], "period": []}
    for start, end, meanings in marks:
        for kind, value in meanings:
            if kind in free:
                gaps = [(max(start - a[-1][1], a[0][0] - end, 0), start < a[0][0], i) for i, a in enumerate(amounts) if clauses[i] == clause(start)]
                if not gaps:
                    free[kind].append((start, end, value))
                elif (gap := min(gaps))[0] < own[gap[2]].get(kind, (len(text) + 1, ""))[0]:
                    own[gap[2]][kind] = (gap[0], value)
    taken = next((i for i, o in enumerate(own) if "unit" in o), None)
    if taken is None:
        taken = next((i for i, o in enumerate(own) if "period" in o or any(n[3] for n in amounts[i])), 0)
    at = amounts[taken]
    said = lambda kind: own[taken][kind][1] if kind in own[taken] else min(((max(s - at[-1][1], at[0][0] - e), v) for s, e, v in free[kind]), default=(0, None))[1]
    unit, period = said("unit"), said("period")
    amount = lambda n, scale: n[2] * 10 ** (scale or 0)
    if len(at) == 2:
        first, second = at
        shared = second[3] if first[3] is None and second[3] and first[2] <= second[2] else first[3]
        return amount(first, shared), amount(second, second[3]), unit, period
    value, open_ = amount(at[0], at[0][3]), _open_side(text, at[0], marks, clause)
    return None if open_ == "lo" else value, None if open_ == "hi" else value, unit, period


def _numbers(text: str, marks: list) -> list[tuple[int, int, Decimal, int | None]]:
    """(start, end, value, scale) of the numbers that may be amounts."""
    times = [m.span() for m in _TIME.finditer(text)]
    out = []
    for m in _NUMBER.finditer(text):
        if not _AFTER_NO.match(text, m.end()) and not _BEFORE_NO.search(text[max(0, m.start() - 8) : m.start()]) and not any(a <= m.start() < b for a, b in times):
            scale = next((v for s, _, ms in marks for k, v in ms if k == "scale" and s >= m.end() and not text[m.end() : s].strip()), None)
            out.append((m.start(), m.end(), _value(m[0]), scale))
    return out


def _joined(text: str, numbers: list, marks: list) -> list[list]:
    """The amounts: numbers, two together where only units and a joining word or dash stand between them."""
    out, i = [], 0
    while i < len(numbers):
        pair = numbers[i : i + 2]
        if len(pair) == 2:
            a, b = pair[0][1], pair[1][0]
            bare, at = [], a
            for s, e, _ in marks:
                if a <= s and e <= b:
                    bare.append(text[at:s])
                    at = max(at, re.compile(r"\w*").match(text, e).end() if text[e - 1].isalpha() else e)
            if not _JOINS.search(text[a:b]) or not _BETWEEN.fullmatch("".join([*bare, text[at:b]])):
                pair = pair[:1]
        out.append(pair)
        i += len(pair)
    return out


def _open_side(text: str, number: tuple, marks: list, clause: Callable[[int], int]) -> str | None:
    """Which side of a single amount is open: hi after "from" or before a plus, lo after "up to"; None if neither or both."""
    start, end = number[:2]
    tail = end
    for s, e, ms in marks:
        if s >= tail and not text[tail:s].strip() and any(k in ("scale", "unit") for k, _ in ms):
            tail = e
    if re.match(r"\s*\+|\s*[-–—−]\s*\?", text[end:]) or re.match(r"\s*\+(?!\s*[a-zა-ჰ])|\s*[-–—−]\s*\?", text[tail:]):
        return "hi"
    if re.search(r"\?\s*[-–—−]\s*[^\d]{0,4}$", text[:start]):
        return "lo"
    near = lambda s, e: clause(s) == clause(start) and not re.search(r"\d", text[e:start] if s < start else text[end:s])
    bounds = {v for s, e, ms in marks for k, v in ms if k == "bound" and near(s, e)}
    return {("lo",): "hi", ("hi",): "lo"}.get(tuple(bounds))


_PAY = T.StructType().add("lo", T.DecimalType(26, 4)).add("hi", T.DecimalType(26, 4)).add("unit", "string").add("period", "string")
_UNIT = T.StructType().add("unit", "string").add("power", "integer")
#: Amounts from which no number of whole lari fits BIGINT: they are no amounts.
_LIMIT = Decimal(10) ** 19


def _sane(x: Decimal | None) -> Decimal | None:
    return x.quantize(Decimal("0.0001")) if x is not None and 0 < x < _LIMIT else None


@F.pandas_udf(_PAY)
def pay_parts(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    memo: dict = {}
    for batch in texts:
        if len(memo) > 200_000:
            memo.clear()
        rows = []
        for t in batch:
            if t not in memo:
                p = parse_amounts(t)
                memo[t] = (None,) * 4 if p is None else (_sane(p[0]), _sane(p[1]), p[2], p[3])
            rows.append(memo[t])
        yield pd.DataFrame(rows, columns=["lo", "hi", "unit", "period"])


@F.pandas_udf(_UNIT)
def unit_parts(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    memo: dict = {}
    for batch in texts:
        for t in batch.unique():
            if t not in memo:
                memo[t] = parse_unit(t) or (None, None)
        out = pd.DataFrame([memo[t] for t in batch], columns=["unit", "power"])
        out["power"] = out["power"].astype("Int32")
        yield out


def daily_rates(rates: DataFrame, currency: str, valid_from: str, quantity: str, rate: str) -> DataFrame:
    """(currency, day, per_unit, last_day): one row for each day a rate holds, up to the currency's last row.

    The table is bounded by currencies times days of the rate history, whatever the data.
    Of repeated rows of one day the largest rate counts. Rows without a currency, day,
    rate or positive quantity are ignored.
    """
    clean = rates.where(F.col(currency).isNotNull() & F.col(valid_from).isNotNull() & F.col(rate).isNotNull() & (F.col(quantity) > 0))
    one = clean.groupBy(F.col(currency).alias("currency"), F.col(valid_from).alias("since")).agg(F.max((F.col(rate) / F.col(quantity)).cast("decimal(20,10)")).alias("per_unit"))
    w = Window.partitionBy("currency").orderBy("since")
    spans = one.select("currency", "per_unit", "since", F.lead("since").over(w).alias("until"), F.max("since").over(Window.partitionBy("currency")).alias("last_day"))
    days = F.sequence("since", F.coalesce(F.date_sub("until", 1), F.col("since")))
    return spans.select("currency", "per_unit", "last_day", F.explode(days).alias("day"))


def convert(amounts: DataFrame, unit: str, on: str, amount: str, rates: DataFrame, per_month: Column, out: str) -> DataFrame:
    """`out`: `amount` in whole base units (half up) by the rate in force on `on`; null where no rate is known.

    `unit` is a code of CURRENCIES; GEL is the base. Results that BIGINT doesn't hold are null. The rates join by currency and day,
    so the join is an equi-join, and one with the rate table's bounded size.
    """
    base = F.split(F.col(unit), "/")[0]
    part = F.when(F.col(unit).endswith("/100"), F.lit(Decimal("0.01"))).otherwise(F.lit(Decimal("1.00")))
    last = rates.groupBy("currency").agg(F.max("last_day").alias("_last")).withColumnRenamed("currency", "_lc")
    keyed = amounts.withColumn("_c", base).join(last, F.col("_c") == F.col("_lc"), "left").withColumn("_on", F.when(F.col(on).isNotNull(), F.least(F.col(on), F.col("_last"))))
    joined = keyed.join(rates.select(F.col("currency").alias("_rc"), F.col("day").alias("_rd"), F.col("per_unit").alias("_r")), (F.col("_c") == F.col("_rc")) & (F.col("_on") == F.col("_rd")), "left")
    rate = F.when(F.col("_c") == "GEL", F.lit(Decimal("1.0000000000"))).otherwise(F.col("_r"))
    monthly = (F.col(amount).try_cast("decimal(26,4)") * part * per_month.cast("decimal(10,6)")).try_cast("decimal(32,10)")
    whole = F.round((monthly * rate.cast("decimal(16,10)")), 0).try_cast("long")
    return joined.withColumn(out, whole).drop("_c", "_lc", "_last", "_on", "_rc", "_rd", "_r")


def stated_amounts(rows: DataFrame, key: str, pay: str, value: str, value_unit: str, on: str, rates: DataFrame, periods: DataFrame) -> DataFrame:
    """(`key`, field_name, gel): one row for each stated bound of `pay` (salary_lo, salary_hi) and each `value`.

    Pay without a unit is in GEL, without a period a month's; a period that `periods`
    doesn't know gives no row. A value needs a unit of money. No row: null or empty text,
    no amount, an amount of zero or less or from 1e19, one of more lari than BIGINT holds, null or infinite values, or a foreign currency on a day
    before its first rate or on no day at all. Rows repeat as often as `rows` repeat them;
    further columns are ignored whatever their names; an empty table gives none.
    """
    base = rows.select(F.col(key).alias("_key"), F.col(pay).alias("_pay"), F.col(value).cast("double").alias("_value"), F.col(value_unit).alias("_vu"), F.col(on).alias("_day"))
    read = base.where((F.trim(F.coalesce(F.col("_pay"), F.lit(""))) != "") | F.col("_value").isNotNull()).withColumn("_p", pay_parts("_pay")).withColumn("_u", unit_parts("_vu"))
    factor = periods.select(F.col("period_code").alias("_pc"), F.col("per_month").alias("_pm")).groupBy("_pc").agg(F.max("_pm").alias("_pm"))
    worth = F.when((F.col("_value") > 0) & (F.col("_value") < 1e19), F.try_multiply(F.col("_value").cast("decimal(26,6)"), F.pow(F.lit(10.0), F.col("_u.power")).cast("decimal(12,0)")))
    one = lambda name, amount, unit, period: F.struct(F.lit(name).alias("field"), amount.try_cast("decimal(32,6)").alias("amount"), unit.alias("unit"), period.alias("period"))
    unit, period = F.coalesce(F.col("_p.unit"), F.lit("GEL")), F.coalesce(F.col("_p.period"), F.lit("month"))
    parts = F.array(one("salary_lo", F.col("_p.lo"), unit, period), one("salary_hi", F.col("_p.hi"), unit, period), one("value", worth, F.col("_u.unit"), F.lit("total")))
    long = read.select("_key", "_day", F.explode(parts).alias("_a")).select("_key", "_day", "_a.*").where(F.col("amount").isNotNull() & F.col("unit").isNotNull())
    timed = long.join(factor, F.col("period") == F.col("_pc"), "left").withColumn("_pm", F.when(F.col("period") == "total", F.lit(Decimal("1.000000"))).otherwise(F.col("_pm")))
    out = convert(timed, "unit", "_day", "amount", rates, F.col("_pm"), "gel").where(F.col("gel").isNotNull())
    return out.select(F.col("_key").alias(key), F.col("field").alias("field_name"), "gel")
