"""Dates and epochs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import col, strip

# Month names as accepted in "March 6, 2026" and "Mar 6, 2026".
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September",
          "October", "November", "December"]

_D = r"(\d{1,2}| [1-9])"
_MONTH = "|".join(dict.fromkeys(MONTHS + [m[:3] for m in MONTHS]))

# (pattern, group of year, month, day)
_SHAPES = [
    (rf"^(\d{{1,2}})/{_D}/(\d{{4}})\z", 3, 1, 2),
    (rf"^(\d{{4}})-(\d{{1,2}})-{_D}\z", 1, 2, 3),
    (rf"(?i)^({_MONTH})\s+(\d{{1,2}}),\s+(\d{{4}})\z", 3, 1, 2),
    (rf"^(\d{{1,2}})-{_D}-(\d{{4}})\z", 3, 1, 2),
    (rf"^(\d{{4}})/(\d{{1,2}})/{_D}\z", 1, 2, 3),
    (rf"^(\d{{1,2}})/{_D}/(\d{{2}})\z", 3, 1, 2),
]


def _month_number(name: Column) -> Column:
    table = "".join(m[:3].lower() for m in MONTHS)
    return F.floor((F.position(F.lower(F.substring(name, 1, 3)), F.lit(table)) + 2) / 3).cast("string")


def _valid_date(s: Column, shape) -> Column:
    pattern, y, m, d = shape
    year, month, day = (F.regexp_extract(s, pattern, g) for g in (y, m, d))
    if _MONTH in pattern:
        month = _month_number(month)
    if r"(\d{2})\z" in pattern:
        year = F.concat(F.when(year < "69", "20").otherwise("19"), year)
    text = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(F.trim(day), 2, "0"))
    return F.when(s.rlike(pattern) & (year != "0000"), text.try_cast("date"))


def typed_date(c, stripped: bool = False) -> Column:
    """The date in one of the seven accepted formats, else null."""
    s = col(c) if stripped else strip(c)
    return F.coalesce(*[_valid_date(s, shape) for shape in _SHAPES])


def parse_date(c, stripped: bool = False) -> Column:
    """`YYYY-MM-DD`; a leading `dddd-dd-dd` passes unchecked; else `''`.

    Pass `stripped` for a column that `strip` has gone over already.
    """
    s = col(c) if stripped else strip(c)
    return F.coalesce(F.date_format(typed_date(s, True), "yyyy-MM-dd"),
                      F.regexp_extract(s, r"^(\d{4}-\d{2}-\d{2})", 1))


def epoch_to_ts(c) -> Column:
    return F.timestamp_seconds(F.nullif(col(c), F.lit(0)))
