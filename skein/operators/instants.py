"""Mixed date and time texts to one instant.

Method: all formats are one regular expression, an alternation with named groups that is
run once over each value; the components are then checked against the calendar as
integers and the instant is put together by integer day arithmetic. No UDF.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Month names by number. The first three letters tell them apart.
MONTHS_EN = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
MONTHS_KA = ["იანვარი", "თებერვალი", "მარტი", "აპრილი", "მაისი", "ივნისი", "ივლისი", "აგვისტო", "სექტემბერი", "ოქტომბერი", "ნოემბერი", "დეკემბერი"]

# Minutes east of UTC of zone abbreviations.
ZONES = {
    "z": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "eet": 120, "eest": 180, "msk": 180, "get": 240,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420,
}

_US = "\x1f"
_DAY_US = 86_400_000_000


def _month_alternation() -> str:
    """Every name, whole or cut to three letters or more, longest first, in any Georgian case ending."""
    out = set()
    for name in MONTHS_EN:
        out |= {name, name[:3], name[:4]}
    for name in MONTHS_KA:
        stem = name[:-1]
        out |= {name, name[:3], f"{stem}ს", f"{stem}ში"}
    return "|".join(sorted(out, key=lambda x: (-len(x), x)))


def _pattern() -> str:
    mon = _month_alternation()
    zone = r"z|(?:utc|gmt)?\s*[+\-−]\s*\d{1,2}(?::?\d{2})?|" + "|".join(sorted((z for z in ZONES if z != "z"), key=lambda z: (-len(z), z)))
    dates = [
        r"(?<ya>\d{4})([\-./])(?<ma>\d{1,2})\2(?<da>\d{1,2})",
        r"(?<yb>\d{4})(?<mb>\d{2})(?<db>\d{2})(?=t|\s|$)",
        r"(?<pc>\d{1,2})\s*([\-./])\s*(?<qc>\d{1,2})\s*\9\s*(?<yc>\d{4}|\d{2})(?!\d)",
        rf"(?:[a-z]{{3,9}}\.?,\s*)?(?<dd>\d{{1,2}})(?:st|nd|rd|th)?[\s\-.]*(?<nd>{mon})\.?,?[\s\-]+(?<yd>\d{{4}})(?:\s*წ(?:ელი|\.)?(?=\s|,|$))?",
        rf"(?:[a-z]{{3,9}}\.?,\s*)?(?<ne>{mon})\.?\s+(?<de>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?<ye>\d{{4}})",
        rf"(?<yf>\d{{4}})\s*(?:წლის|წ\.)?\s*(?<df>\d{{1,2}})\s+(?<nf>{mon})",
    ]
    clock = r"(?:(?<hh>\d{1,2}):(?<mi>\d{2})(?::(?<ss>\d{2})(?:[.,](?<ff>\d{1,9}))?)?|(?<hc>\d{2})(?<mc>\d{2})(?<sc>\d{2})?)(?:\s*(?<ap>[ap])\.?m\.?)?(?:\s*(?:სთ\.?|საათი|საათზე))?"
    return rf"^(?:(?:{'|'.join(dates)})(?:(?:t|[\s,]+){clock}(?:\s*\(?(?<zz>{zone})\)?)?)?|(?<ep>\d{{16}}|\d{{13}}|\d{{10}}))$"


PATTERN = _pattern()
_PARTS = {"y": "ya yb yc yd ye yf", "m": "ma mb", "d": "da db dd de df", "p": "pc", "q": "qc", "n": "nd ne nf", "h": "hh hc", "mi": "mi mc", "s": "ss sc", "f": "ff", "ap": "ap", "z": "zz", "e": "ep"}
_TEMPLATE = _US + _US.join("".join(f"${{{g}}}" for g in groups.split()) for groups in _PARTS.values())


def _days(y: str, m: str, d: str) -> str:
    """Days since 1970-01-01 of a proleptic Gregorian date, in whole numbers (SQL; y, m, d are names)."""
    yy = f"({y} - if({m} <= 2, 1, 0))"
    return f"({yy} * 365 + {yy} div 4 - {yy} div 100 + {yy} div 400 + (if({m} > 2, {m} - 3, {m} + 9) * 153 + 2) div 5 + {d} - 1 - 719468)"


def _once(df: DataFrame, **values: str) -> DataFrame:
    """`df` with each value computed once a row; a filter or projection above never copies the expression."""
    return df.selectExpr("*", "inline(array(struct(" + ", ".join(f"{v} as {k}" for k, v in values.items()) + ")))")


def _lookup(table: dict[str, int]) -> str:
    return "map(" + ", ".join(f"'{k}', {v}" for k, v in table.items()) + ")"


def parse_instants(df: DataFrame, text: str, zone: str, order: str, out: str = "utc_us") -> DataFrame:
    """`df` with `out`: microseconds since 1970-01-01 UTC of the column `text`, or null.

    `zone` and `order` name the columns with the time zone and the day/month order (DMY
    or MDY) that hold where the text says neither. A numeric date is read in its board's
    order only. A date alone is the day's first instant and 24:00 the next day's; a wall
    time that occurs twice is the first and one that is skipped takes the offset before
    the change. Two-digit years are 2000 to 2069 and 1970 to 1999. Epoch numbers of 10,
    13 or 16 digits are seconds, milliseconds and microseconds. Null: null, empty, any
    text that names no whole or no real date or clock time, a numeric date without known
    order unless only one reading exists, a local time without a zone name. Every other
    column is kept as it is; a column named `out` is replaced. Expressions are SQL text:
    a plan of this size is slow to build column by column.
    """
    keep = [c for c in df.columns if c != out]
    base = df.select(*[F.col(f"`{c}`").alias(f"_in{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").cast("string").alias("_text"), F.col(f"`{zone}`").alias("_zone"), F.upper(F.trim(F.col(f"`{order}`"))).alias("_order"))
    shown = F.regexp_replace("_text", "[\\x{200B}-\\x{200F}\\x{FEFF}\\x{2060}\\x{00AD}]", "")
    tidy = F.lower(F.trim(F.regexp_replace(shown, "[\\s\\p{Z}]+", " ")))
    split = base.select("*", F.explode(F.array(F.split(F.regexp_replace(tidy, PATTERN, _TEMPLATE), _US))).alias("_t"))
    texts = _once(split, **{f"_p_{name}": f"get(_t, {i + 1})" for i, name in enumerate(_PARTS)})
    num = lambda name: f"if(_p_{name} = '', null, cast(_p_{name} as int))"
    names = {n[:3]: i + 1 for table in (MONTHS_EN, MONTHS_KA) for i, n in enumerate(table)}
    digits = "regexp_replace(_p_z, '[^0-9]', '')"
    numbers = {
        "y": f"if(length(_p_y) = 2, {num('y')} + if({num('y')} < 70, 2000, 1900), {num('y')})",
        "m": f"if(_p_n = '', {num('m')}, {_lookup(names)}[substring(_p_n, 1, 3)])",
        "d": num("d"), "p": num("p"), "q": num("q"), "h": num("h"), "mi": f"coalesce({num('mi')}, 0)", "s": f"coalesce({num('s')}, 0)", "ap": "_p_ap",
        "us": "if(_p_f = '', 0L, cast(rpad(_p_f, 6, '0') as long))",
        "off": f"case when _p_z = '' then null when {digits} = '' then {_lookup(ZONES)}[_p_z] else if(_p_z rlike '[-−]', -1, 1) * if(length({digits}) <= 2, cast({digits} as int) * 60, cast({digits} as int) div 100 * 60 + cast({digits} as int) % 100) end",
        "e": "if(_p_e = '', null, cast(_p_e as long) * case length(_p_e) when 10 then 1000000L when 13 then 1000L else 1L end)",
    }
    ints = _once(texts, **{f"_n_{n}": e for n, e in numbers.items()})
    day_first = "case when _order = 'DMY' then true when _order = 'MDY' then false when _n_p > 12 and _n_q <= 12 then true when _n_q > 12 and _n_p <= 12 then false when _n_p = _n_q then true end"
    date = _once(
        _once(ints, _df=day_first), _d_y="_n_y", _d_m="coalesce(_n_m, if(_df, _n_q, if(not _df, _n_p, null)))", _d_d="coalesce(_n_d, if(_df, _n_p, if(not _df, _n_q, null)))", _d_h="case _n_ap when 'a' then _n_h % 12 when 'p' then _n_h % 12 + 12 else _n_h end"
    )
    length = "case when _d_m in (4, 6, 9, 11) then 30 when _d_m = 2 then if((_d_y % 4 = 0 and _d_y % 100 <> 0) or _d_y % 400 = 0, 29, 28) else 31 end"
    real = f"_d_y between 1 and 9999 and _d_m between 1 and 12 and _d_d between 1 and {length} and (_n_h is null or (_n_mi <= 59 and _n_s <= 59 and if(_n_ap <> '', _n_h between 1 and 12, _n_h <= 23 or (_n_h = 24 and _n_mi = 0 and _n_s = 0))))"
    wall = f"if({real}, {_days('_d_y', '_d_m', '_d_d')} * {_DAY_US}L + (coalesce(_d_h, 0) * 3600L + _n_mi * 60 + _n_s) * 1000000L + _n_us, null)"
    local = _once(date, _w=wall)
    named = "_zone rlike '^[A-Za-z]+(/[A-Za-z0-9_+-]+)*$|^[+-][0-9]{2}:[0-9]{2}$'"
    instant = f"case when _n_e is not null then _n_e when _p_z <> '' then if(abs(_n_off) <= 1080, _w - _n_off * 60000000L, null) when {named} then unix_micros(to_utc_timestamp(timestamp_micros(_w), _zone)) end"
    return _once(local, _u=instant).select(*[F.col(f"_in{i}").alias(c) for i, c in enumerate(keep)], F.col("_u").alias(out))
