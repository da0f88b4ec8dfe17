"""Dates in text of any usual form.

What is left of a text without its time of day and offset is a few numbers and a month's
name between marks. Which number is the year, the month and the day follows from sizes, from
the place of the name, and, where both orders fit, from the month coming first. A text that
holds anything else is no date, and one that lacks a part is a date to that part only.
"""

from __future__ import annotations

import calendar
import re
from datetime import date
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MONTHS = {name.lower(): k for names in (calendar.month_name, calendar.month_abbr) for k, name in enumerate(names) if name} | {"sept": 9}
_DAYS = {name.lower() for names in (calendar.day_name, calendar.day_abbr) for name in names} | {"tues", "wednes", "thur", "thurs"}
_FILLERS = {"of", "the", "on", "at", "and", "st", "nd", "rd", "th", "t", "ad"}
_ZONE = r"(?:\s*(?:Z|UTC|GMT|[A-Z]{2,4}T)\b)?(?:\s*(?:UTC|GMT)?\s*[+-]\d{1,2}(?::?\d{2})?)?(?:\s*\([A-Za-z ]+\))?"
_CLOCK = re.compile(
    rf"(?<!\d)(?:T|\s|,|^)*(?<![\d.:])(?:\d{{1,2}}:\d{{2}}(?::\d{{2}}(?:[.,]\d+)?)?\s*(?:[AaPp]\.?[Mm]\b\.?)?{_ZONE}|\d{{1,2}}\s*[AaPp]\.?[Mm]\b\.?{_ZONE}|\d{{1,2}}\s*h(?:\s*\d{{1,2}}\s*m(?:in)?(?:\s*\d{{1,2}}\s*s)?)?\b{_ZONE})"
)
_COMPACT = re.compile(r"(?<!\d)(\d{8})(?:T?(\d{4}|\d{6})(?:[.,]\d+)?" + _ZONE + r")?(?!\d)")
_TOKEN = re.compile(r"\d+|[^\W\d_]+|[^\s\w]|_")
_MARKS = set(",.-/'\\;:()")


def _year(n: int, digits: int) -> int:
    """Two digits are a year at most 50 years from now."""
    if digits > 2:
        return n
    now = date.today().year
    year = now // 100 * 100 + n
    return year - 100 if year >= now + 50 else year + 100 if year < now - 50 else year


def _order(numbers: list[tuple[int, int]], at: int | None) -> str | None:
    """Which of y, m and d each number is; ``at``: how many stand before a month's name."""
    big = [n > 31 or digits > 2 for n, digits in numbers]
    if len(numbers) > 3 - (at is not None) or sum(big) > 1:
        return None
    if at is None:
        if len(numbers) == 3:
            return "ymd" if big[0] else "dmy" if numbers[0][0] > 12 else "mdy" if not big[1] else None
        if len(numbers) == 2:
            return "ym" if big[0] else "my" if big[1] else None
        return "y" if big == [True] else None
    if len(numbers) == 2:
        if any(big):
            return "yd" if big[0] else "dy"
        return "yd" if at == 2 else "dy"
    return "y" if big == [True] else None


@lru_cache(maxsize=100_000)
def parsed(text: str) -> tuple[int, int | None, int | None] | None:
    """(year, month, day) of a text, the last ones None where it does not say; None if it is no date."""
    text = text.strip()
    if m := _COMPACT.fullmatch(text):
        return _whole(int(m[1][:4]), int(m[1][4:6]), int(m[1][6:]))
    rest, clocks = _CLOCK.subn(" ", text)
    if clocks > 1 or len(text) > 200:
        return None
    numbers: list[tuple[int, int]] = []
    month, at = None, None
    for token in _TOKEN.findall(rest):
        low = token.lower()
        if token.isdigit():
            if len(token) > 4 or len(token) == 3:
                return None
            numbers.append((int(token), len(token)))
        elif low in _MONTHS and month is None:
            month, at = _MONTHS[low], len(numbers)
        elif low not in _DAYS and low not in _FILLERS and token not in _MARKS:
            return None
    order = _order(numbers, at)
    if order is None:
        return None
    part = dict(zip(order, numbers, strict=True))
    day = part["d"][0] if "d" in part else None
    return _whole(_year(*part["y"]), month if month is not None else part["m"][0] if "m" in part else None, day)


def _whole(year: int, month: int | None, day: int | None) -> tuple[int, int | None, int | None] | None:
    try:
        date(year, month or 1, day or 1)
    except ValueError:
        return None
    return None if month == 0 or day == 0 else (year, month, day)


def period(text: str, parts: int) -> str | None:
    """The first ``parts`` of year, month and day; None if the text lacks one of them."""
    found = parsed(text)
    if found is None or None in found[:parts]:
        return None
    return "-".join(f"{x:0{4 if k == 0 else 2}d}" for k, x in enumerate(found[:parts]))


def periods(c: Column, parts: int) -> Column:
    """The same for a column of text: each different text of a batch is read once."""

    @F.pandas_udf(T.StringType())
    def read(s: pd.Series) -> pd.Series:
        codes, texts = pd.factorize(s)
        found = [*(period(t, parts) for t in texts), None]
        return pd.Series([found[k] for k in codes], dtype="object")

    return read(c)
