"""Display formats: (value, format) -> text.

The format is a constant of the column, so the plan is chosen on the driver.  Dates are Column arithmetic.
Numbers need exact decimal digits and JavaScript's layout of them, which no built-in function gives; those run
as an Arrow UDF over whole columns.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from decimal import ROUND_HALF_UP, Context, Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Month names of dates (fixed values).
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_NUMBER = re.compile(r"(\d+)\.(\d+)([fge])(c?)\Z")
#: Periods of a year: weeks, months, quarters.
PERIODS = {"tw": (52, "w"), "tm": (12, "m"), "tq": (4, "q")}
#: Farthest day from 1970-01-01 that a date may have.
_FARTHEST = 100_000_000
_DAYS_1960_1970 = 3653


def plain(x: float) -> str:
    """Shortest digits that give x back: positional from 1e-6 to below 1e21, else with a signed exponent."""
    if x != x:
        return "NaN"
    if math.isinf(x):
        return "Infinity" if x > 0 else "-Infinity"
    if x == 0:
        return "0"
    sign, digits, exponent = Decimal(repr(float(x))).normalize().as_tuple()
    digits = "".join(map(str, digits))
    point = len(digits) + exponent  # digits before the decimal point
    if 0 < point <= 21:
        text = digits.ljust(point, "0") if exponent >= 0 else f"{digits[:point]}.{digits[point:]}"
    elif -6 < point <= 0:
        text = "0." + "0" * -point + digits
    else:
        e = point - 1
        text = digits[0] + ("." + digits[1:] if len(digits) > 1 else "") + f"e{'+' if e > 0 else '-'}{abs(e)}"
    return "-" * sign + text


def fixed(x: float, places: int) -> str:
    """The exact binary value rounded to places, ties away from zero; a negative value keeps its sign."""
    if not math.isfinite(x) or abs(x) >= 1e21:
        return plain(x)
    text = format(abs(Decimal(x)).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP, Context(prec=400)), "f")
    return "-" + text if x < 0 else text


def scientific(x: float, places: int) -> str:
    if not math.isfinite(x):
        return plain(x)
    d = abs(Decimal(x))
    if d == 0:
        return "0" + ("." + "0" * places if places else "") + "e+00"
    e = d.adjusted()
    d = d.quantize(Decimal(1).scaleb(e - places), ROUND_HALF_UP, Context(prec=1100))
    e, digits = d.adjusted(), "".join(map(str, d.as_tuple().digits))[: places + 1]
    return ("-" if x < 0 else "") + digits[0] + ("." + digits[1:] if places else "") + f"e{'-' if e < 0 else '+'}{abs(e):02d}"


def grouped(text: str, everywhere: bool = False) -> str:
    """Commas between groups of three of the digits before the point.  everywhere: of any characters there, as
    the original does even with exponents and Infinity."""
    sign, body = ("-", text[1:]) if text.startswith("-") else ("", text)
    whole, dot, rest = body.partition(".")
    if not (whole.isdigit() or everywhere):
        return text
    first = len(whole) % 3
    return sign + ",".join(filter(None, [whole[:first], *(whole[i : i + 3] for i in range(first, len(whole), 3))])) + dot + rest


def kind_of(fmt: str) -> tuple:
    """("plain",), ("td",), ("tc",), ("tw" | "tm" | "tq",) or ("f" | "g" | "e", places, commas)."""
    code = re.sub(r"^%", "", re.sub(r"^%-?[+0]?", "", fmt, count=1), count=1)
    if not code or code.endswith("s"):
        return ("plain",)
    if code.startswith("t"):
        return (code,) if code in ("td", "tc", *PERIODS) else ("plain",)
    m = _NUMBER.match(code)
    return (m[3], int(m[2]), bool(m[4])) if m else ("plain",)


def _day_text(days: float, js_compat: bool) -> str | None:
    """Day number of a date, from 1960-01-01."""
    if days != days or abs(days - _DAYS_1960_1970) > _FARTHEST:
        return "NaNundefinedNaN" if js_compat else None
    # Proleptic Gregorian calendar from the day number, by eras of 400 years.
    z = int(days) - _DAYS_1960_1970 + 719468
    era, doe = divmod(z, 146097)
    yoe = (doe - doe // 1460 + doe // 36524 - doe // 146096) // 365
    doy = doe - (365 * yoe + yoe // 4 - yoe // 100)
    mp = (5 * doy + 2) // 153
    month = mp + 3 if mp < 10 else mp - 9
    return f"{doy - (153 * mp + 2) // 5 + 1:02d}{MONTHS[month - 1]}{yoe + era * 400 + (month <= 2)}"


def period_text(x: float, per_year: int, letter: str) -> str:
    part = math.fmod(x, per_year) + 1
    return f"{plain(float(1960 + math.floor(x / per_year)) if math.isfinite(x) else math.nan)}{letter}{plain(part + per_year if part <= 0 else part)}" if math.isfinite(x) else f"NaN{letter}NaN"


def format_value(value, fmt: str, *, js_compat: bool = False) -> str | None:
    """The text of one value; None stays, and a text is its own."""
    if value is None or isinstance(value, str):
        return value
    return formatter(fmt, js_compat)(float(value))


def formatter(fmt: str, js_compat: bool = False) -> Callable[[float], str | None]:
    kind = kind_of(fmt)
    if kind[0] == "f":
        return (lambda x: grouped(fixed(x, kind[1]), js_compat)) if kind[2] else (lambda x: fixed(x, kind[1]))
    if kind[0] == "g":
        return (lambda x: grouped(plain(x), js_compat)) if kind[2] else plain
    if kind[0] == "e":
        return lambda x: scientific(x, kind[1])
    if kind[0] == "td":
        return lambda x: _day_text(math.trunc(1 + x) - 1 if math.isfinite(x) else math.nan, js_compat)
    if kind[0] == "tc":
        def moment(x: float) -> str | None:
            days = math.floor(x / 86_400_000) if math.isfinite(x) else math.nan
            day = _day_text(days, js_compat)
            if day is None or not math.isfinite(x):
                return day if not js_compat else "NaNundefinedNaN NaN:NaN:NaN"
            s = int((x - days * 86_400_000) // 1000)
            return f"{day} {s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}"

        return moment
    if kind[0] in PERIODS:
        return lambda x: period_text(x, *PERIODS[kind[0]])
    return plain


def _udf(fmt: str, js_compat: bool):
    def shown(values):
        import pyarrow as pa

        # Arrow tells null from NaN.  A float is widened to a double first, so 1.1f shows the digits of the double it is.
        text = formatter(fmt, js_compat)
        return pa.array([None if x is None else text(float(x)) for x in values.to_pylist()], pa.string())

    return F.arrow_udf(shown, T.StringType())


def _date(days: Column) -> Column:
    """days: whole days from 1960-01-01."""
    near = F.abs(days - _DAYS_1960_1970) <= _FARTHEST
    d = F.date_add(F.to_date(F.lit("1960-01-01")), F.when(near, days).cast("int"))
    return F.concat(F.lpad(F.dayofmonth(d).cast("string"), 2, "0"), F.element_at(F.array(*map(F.lit, MONTHS)), F.month(d)), F.year(d).cast("string"))


def display(value: Column, fmt: str, storage: str, *, js_compat: bool = False) -> Column:
    """Column of the texts of a decoded column; storage: its storage type.  Null stays null; strings are their own."""
    if storage in ("str", "strL"):
        return value
    kind = kind_of(fmt)
    exact = storage in ("byte", "int", "long")
    x = value.cast("double")
    if kind[0] == "td" and not js_compat:
        days = F.when(1 + x >= 0, F.floor(1 + x)).otherwise(F.ceil(1 + x)) - 1
        return _date(F.when(F.abs(x) < 1e12, days))
    if kind[0] == "tc" and not js_compat:
        x = F.when(F.abs(x) < 1e18, x)
        days = F.floor(x / 86_400_000)
        s = F.floor((x - days * 86_400_000) / 1000)
        two = lambda n: F.lpad(n.cast("int").cast("string"), 2, "0")
        return F.concat(_date(days), F.lit(" "), two(F.floor(s / 3600)), F.lit(":"), two(F.floor(s / 60) % 60), F.lit(":"), two(s % 60))
    if kind[0] in PERIODS and exact:
        per_year, letter = PERIODS[kind[0]]
        n = value.cast("long")
        part = n % per_year + 1
        return F.concat((1960 + F.floor(n / per_year)).cast("string"), F.lit(letter), F.when(part <= 0, part + per_year).otherwise(part).cast("string"))
    if exact and kind[0] in ("plain", "g") and not (len(kind) > 2 and kind[2]):
        return value.cast("string")
    return _udf(fmt, js_compat)(value if exact else x)
