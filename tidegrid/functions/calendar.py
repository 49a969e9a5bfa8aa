"""Calendar keys: seasons, half months, anchors and date repair."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nulls import col

# Month names in calendar order.
MONTHS = [
    "January", "February", "March", "April", "May", "June", "July",
    "August", "September", "October", "November", "December",
]

# Order of the months inside a fishing season.
SEASON_MONTHS = [
    "December", "January", "February", "March", "April", "May", "June",
    "July", "August", "September",
]


def rollover_key(date: str | Column, first_month: int, sep: str) -> Column:
    """``start<sep>end`` of the year that begins with ``first_month``."""
    d = col(date)
    start = F.when(F.month(d) >= first_month, F.year(d)).otherwise(F.year(d) - 1)
    return F.concat_ws(sep, start.cast("string"), (start + 1).cast("string"))


def crab_year(date) -> Column:
    """November and December belong to the next year's season: ``2009_2010``."""
    return rollover_key(date, 11, "_")


def season(date) -> Column:
    """Only December rolls forward: ``2009-2010``."""
    return rollover_key(date, 12, "-")


def licence_season(date) -> Column:
    """Months up to September belong to the season that began the year before."""
    return rollover_key(date, 10, "-")


def year_month(date) -> Column:
    return F.date_format(col(date), "yyyy_MM")


def month_name(date) -> Column:
    return F.date_format(col(date), "MMMM")


def month_number(name: str | Column) -> Column:
    """Month name to number by position in the fixed list; null if unknown."""
    pos = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), col(name))
    return F.when(pos > 0, pos.cast("int"))


def season_month_index(name: str | Column) -> Column:
    """1 for December to 10 for September; null outside the season."""
    pos = F.array_position(F.array(*[F.lit(m) for m in SEASON_MONTHS]), col(name))
    return F.when(pos > 0, pos.cast("int"))


def month_of_crab_year(date) -> Column:
    """1 for November to 12 for October."""
    return ((F.month(col(date)) + 1) % 12 + 1).cast("int")


def week7(date) -> Column:
    """Week as a 7-day block counted from January 1."""
    return (F.floor((F.dayofyear(col(date)) - 1) / 7) + 1).cast("int")


def half(date) -> Column:
    return F.when(F.dayofmonth(col(date)) <= 15, 1).otherwise(2)


def half_month(date) -> Column:
    """``December_1`` for days 1 to 15, ``December_2`` after."""
    return F.concat_ws("_", month_name(date), half(date).cast("string"))


def time_keys(df, date: str):
    """Add year_month, month name and number, 7-day week and day of year."""
    return df.withColumns(
        {
            "year": F.year(date),
            "year_month": year_month(date),
            "month": month_name(date),
            "month_as_numeric": F.month(date),
            "week_of_year": week7(date),
            "day_of_year": F.dayofyear(date),
        }
    )


def bucket(c: str | Column, rules: list[tuple[Column, str]], default=None) -> Column:
    """First matching rule's label; ``rules`` is a list of (condition, label)."""
    out = None
    for cond, label in rules:
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise(F.lit(default))


def period_of(crab_year_col: str | Column) -> Column:
    """Analysis period by the year in which the crab year ends."""
    end = F.substring(col(crab_year_col), 6, 4).cast("int")
    return bucket(
        crab_year_col,
        [(end < 2015, "2009-2014"), (end < 2019, "2014-2018")],
        "2018-2019",
    )


def winter_summer(date) -> Column:
    """Winter is December to April, Summer May to September, else null."""
    m = F.month(col(date))
    return F.when(m.isin(12, 1, 2, 3, 4), "Winter").when(m.between(5, 9), "Summer")


def is_may_sep(date) -> Column:
    return F.month(col(date)).between(5, 9)


def doy_to_date(year: str | Column, doy: str | Column) -> Column:
    return F.date_add(F.make_date(col(year).cast("int"), F.lit(1), F.lit(1)), (col(doy) - 1).cast("int"))


def anchor_date(month: Column, day: Column, crab_year_col: str | Column) -> Column:
    """The month and day placed inside the crab year (null if month is null)."""
    cy = col(crab_year_col)
    yr = F.when(month >= 11, F.substring(cy, 1, 4)).otherwise(F.substring(cy, 6, 4)).cast("int")
    return F.make_date(yr, month, day)


def repair_year(date: str | Column, start_year: str | Column) -> Column:
    """Move a date back one year when its year is neither of the season's two years."""
    d, y = col(date), col(start_year)
    return F.when((F.year(d) != y) & (F.year(d) != y + 1), F.add_months(d, -12).cast("date")).otherwise(d)


def parse_season_start(text: str | Column, start_year: str | Column) -> Column:
    """``"Dec. 15"`` plus the season's first year to a date.

    Months October to December fall in the first year, the rest in the second.
    """
    parts = F.split(F.trim(col(text)), r"[. ]+")
    short = F.array(*[F.lit(m[:3]) for m in MONTHS])
    month = F.array_position(short, F.substring(F.try_element_at(parts, F.lit(1)), 1, 3)).cast("int")
    day = F.try_element_at(parts, F.lit(2)).try_cast("int")
    year = F.when(month >= 10, col(start_year)).otherwise(col(start_year) + 1).cast("int")
    iso = F.format_string("%04d-%02d-%02d", year, month, day)  # a day that the year lacks becomes null
    return F.when((month > 0) & day.isNotNull() & year.isNotNull(), iso.try_cast("date"))


def days_between(later, earlier) -> Column:
    return F.datediff(col(later), col(earlier))


def within(date, begin, end) -> Column:
    return col(date).between(col(begin), col(end))
