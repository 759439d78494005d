"""Fiscal periods, dates and time slots as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PERIOD = r"^(?:Q([1-4]))?FY([0-9]{4})$"


def fiscal_year(period: Column) -> Column:
    """Year of a strict code such as FY2026 or Q3FY2026; null for other texts."""
    return F.when(period.rlike(PERIOD), F.regexp_extract(period, PERIOD, 2).cast("int"))


def fiscal_quarter(period: Column) -> Column:
    """Quarter of a strict code, 0 for a full year; null for other texts."""
    quarter = F.regexp_extract(period, PERIOD, 1)
    return F.when(period.rlike(PERIOD), F.when(quarter == "", 0).otherwise(F.try_to_number(quarter, F.lit("9")).cast("int")))


def format_period(year: Column, quarter: Column) -> Column:
    return F.when(quarter == 0, F.concat(F.lit("FY"), year.cast("string"))).otherwise(
        F.concat(F.lit("Q"), quarter.cast("string"), F.lit("FY"), year.cast("string"))
    )


def fiscal_year_of(day: Column, first_month: int = 4) -> Column:
    """The fiscal year that a day is in; it is named after the year in which it ends."""
    return F.year(day) + (F.month(day) >= first_month).cast("int")


def fiscal_quarter_of(day: Column) -> Column:
    return F.pmod(F.floor((F.month(day) - 1) / 3) + 3, F.lit(4)).cast("int") + 1


def period_end(period: Column) -> Column:
    """Last day of the period: year n ends on 31 March n, its quarters every three months before."""
    year, quarter = fiscal_year(period), fiscal_quarter(period)
    end = F.make_date(year, F.lit(3), F.lit(1))
    return F.last_day(F.add_months(end, F.when(quarter == 0, 0).otherwise((quarter - 4) * 3)))


def period_sort_key(period: Column) -> Column:
    """Year times ten plus quarter, a full year after its quarters; null for other texts."""
    quarter = fiscal_quarter(period)
    return fiscal_year(period) * 10 + F.when(quarter == 0, 5).otherwise(quarter)


def filing_date(label: Column) -> Column:
    """First day of a "Jul 2026"; the middle of a year that is named alone; else null."""
    month = F.to_date(F.try_to_timestamp(F.when(label.rlike("^[A-Z][a-z]{2} [0-9]{4}$"), label), F.lit("MMM yyyy")))
    year = F.regexp_extract(label, r"\b([0-9]{4})\b", 1)
    return F.coalesce(month, F.when(year != "", F.make_date(F.nullif(year, F.lit("")).cast("int"), F.lit(6), F.lit(30))))


def recency(day: Column, today: Column) -> Column:
    """1 within a year, 0.5 within two, 0 for older or unknown days."""
    age = F.datediff(today, day)
    return F.when(age <= 365, 1.0).when(age <= 730, 0.5).otherwise(0.0)


def india_date(moment: Column) -> Column:
    """The calendar day in India, five and a half hours ahead of UTC."""
    return F.to_date(F.from_utc_timestamp(moment, "+05:30"))


def slot_start(moment: Column, minutes: int) -> Column:
    """Start of the time slot that holds a moment; slots count from the epoch."""
    step = minutes * 60
    return F.timestamp_seconds(F.floor(F.unix_timestamp(moment) / step) * step)


def backoff_seconds(attempts: Column, first: int = 30, most: int = 900) -> Column:
    """Wait before the next try: doubles with each attempt up to a ceiling."""
    return F.least(F.lit(first) * F.pow(F.lit(2.0), F.least(attempts, F.lit(30)) - 1), F.lit(float(most)))


def rfc822_timestamp(text: Column) -> Column:
    """Moment of a feed date such as "Tue, 15 Sep 2026 10:30:00 +0530"; null if it cannot be read."""
    plain = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", "")
    return F.coalesce(F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm:ss z")))


def is_trading_day(day: Column, holidays: Column) -> Column:
    """A weekday that is not among the holidays (an array of dates)."""
    return (F.weekday(day) < 5) & ~F.array_contains(holidays, day)
