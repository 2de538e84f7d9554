"""Calendar and business-day arithmetic as Column expressions. No holidays: a business day isn't Saturday or Sunday."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F


class DateFreq(Enum):
    """Frequencies with their codes (the first is canonical) and the side of the period they name."""

    # The codes.
    DAILY = (("D",), "start")
    WEEKLY_MONDAY = (("W", "WS"), "start")
    WEEKLY_FRIDAY = (("WF",), "end")
    MONTH_START = (("M", "MS"), "start")
    MONTH_END = (("ME",), "end")
    QUARTER_START = (("Q", "QS"), "start")
    QUARTER_END = (("QE",), "end")
    YEAR_START = (("Y", "A", "AS", "YS"), "start")
    YEAR_END = (("YE", "AE"), "end")

    @classmethod
    def parse(cls, code: str) -> DateFreq:
        for f in cls:
            if code in f.value[0]:
                return f
        raise ValueError(f"unknown frequency: {code!r}")

    @property
    def code(self) -> str:
        return self.value[0][0]

    @property
    def side(self) -> str:
        return self.value[1]

    @property
    def months(self) -> int:
        """Length of a period in months; 0 for days and weeks."""
        return {"M": 1, "Q": 3, "Y": 12}.get(self.code[0], 0)

    @property
    def unit(self) -> str:
        return {"D": "DAY", "W": "WEEK", "M": "MONTH", "Q": "QUARTER", "Y": "YEAR"}[self.code[0]]


def is_business_day(d: Column) -> Column:
    return F.weekday(d) < 5


def roll_forward(d: Column) -> Column:
    return F.date_add(d, F.when(F.weekday(d) == 5, 2).when(F.weekday(d) == 6, 1).otherwise(0))


def roll_back(d: Column) -> Column:
    return F.date_sub(d, F.when(F.weekday(d) == 5, 1).when(F.weekday(d) == 6, 2).otherwise(0))


def month_to_quarter(month: Column) -> Column:
    bad = F.raise_error(F.concat(F.lit("invalid month: "), month.cast("string")))
    return F.when(month.between(1, 12), F.floor((month - 1) / 3).cast("int") + 1).otherwise(bad.cast("int"))


def period_date(start: Column, freq: DateFreq) -> Column:
    """The date that names the period beginning at ``start``."""
    return start if freq.side == "start" else F.date_sub(F.add_months(start, freq.months), 1)


def first_on_or_after(d: Column, freq: DateFreq) -> Column:
    if freq is DateFreq.DAILY:
        return d
    if not freq.months:
        return F.next_day(F.date_sub(d, 1), "MON" if freq.side == "start" else "FRI")
    start = F.trunc(d, freq.unit).cast("date")
    if freq.side == "end":
        return period_date(start, freq)
    return F.when(start == d, d).otherwise(F.add_months(start, freq.months))


def next_date(d: Column, freq: DateFreq) -> Column:
    """The date one period after a date of the frequency."""
    if freq is DateFreq.DAILY:
        return F.date_add(d, 1)
    if not freq.months:
        return F.date_add(d, 7)
    return period_date(F.add_months(F.trunc(d, freq.unit).cast("date"), freq.months), freq)


def nth_date(start: Column, n: Column, freq: DateFreq) -> Column:
    """The n-th (from 0) date of the frequency on or after ``start``, in closed form."""
    first = first_on_or_after(start, freq)
    if freq is DateFreq.DAILY:
        return F.date_add(first, n.cast("int"))
    if not freq.months:
        return F.date_add(first, (n * 7).cast("int"))
    return period_date(F.add_months(F.trunc(first, freq.unit).cast("date"), (n * freq.months).cast("int")), freq)


def roll(d: Column, freq: DateFreq) -> Column:
    """Period starts roll forward, ends back; weekly dates stay."""
    if freq.unit == "WEEK":
        return d
    return roll_forward(d) if freq.side == "start" else roll_back(d)


def first_business_on_or_after(d: Column, freq: DateFreq) -> Column:
    """Rolled by side: an end may come to lie before ``d``."""
    return roll(first_on_or_after(d, freq), freq)


def next_business_date(d: Column, freq: DateFreq) -> Column:
    """The next calendar date, always rolled forward."""
    return roll_forward(next_date(d, freq))


def group_key(d: Column, freq: DateFreq) -> Column:
    """(year, part) of the period that a date falls in; weeks by ISO year."""
    year = F.year(d)
    part = {"DAY": F.dayofyear(d), "WEEK": F.weekofyear(d), "MONTH": F.month(d), "QUARTER": F.quarter(d), "YEAR": F.lit(0)}[freq.unit]
    if freq.unit == "WEEK":
        year = F.extract(F.lit("YEAROFWEEK"), d)
    return F.struct(year.cast("int").alias("year"), part.cast("int").alias("part"))
