"""Date and business-date sequences as DataFrames of one column ``date``."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as C
from ..functions.calendar import DateFreq


def parse_date(text: str | dt.date) -> dt.date:
    if isinstance(text, dt.date):
        return text
    try:
        return dt.date(*map(int, text.split("-")))
    except (ValueError, TypeError) as e:
        raise ValueError(f"not a date: {text!r}") from e


def generate(spark: SparkSession, start: str | dt.date, freq: DateFreq, n: int, business: bool = False, compat: bool = False) -> DataFrame:
    """Exactly ``n`` dates from the first on or after ``start``.

    Business period ends that roll back before ``start`` are skipped.  ``compat`` looks at n + 5 (daily) or n + 2
    calendar dates only, so that fewer may come.
    """
    begin = F.lit(parse_date(start))
    if not business:
        return spark.range(n).select(C.nth_date(begin, F.col("id"), freq).alias("date")).orderBy("date")
    look = (n + 5 if freq is DateFreq.DAILY else n + 2) if compat or freq is not DateFreq.DAILY else n // 5 * 7 + 14
    dates = spark.range(look).select(C.nth_date(begin, F.col("id"), freq).alias("date"))
    dates = dates.where(C.is_business_day(F.col("date"))) if freq is DateFreq.DAILY else dates.select(C.roll(F.col("date"), freq).alias("date")).where(F.col("date") >= begin)
    return dates.orderBy("date").limit(n)


@dataclass
class DatesList:
    """An inclusive range of dates at a frequency; nothing is parsed before it is used."""

    start: str | dt.date
    end: str | dt.date
    freq: DateFreq
    business = False

    @classmethod
    def from_n_periods(cls, spark: SparkSession, start: str, freq: DateFreq, n: int) -> DatesList:
        """The end is the n-th generated date; the start stays as it is."""
        if n <= 0:
            raise ValueError("n_periods must be greater than 0")
        last = generate(spark, start, freq, n, cls.business).agg(F.max("date")).first()[0]
        return cls(start, last.isoformat(), freq)

    @property
    def start_date(self) -> dt.date:
        return parse_date(self.start)

    @property
    def end_date(self) -> dt.date:
        return parse_date(self.end)

    @property
    def freq_str(self) -> str:
        return self.freq.code

    def _calendar(self, spark: SparkSession) -> DataFrame:
        a, b = self.start_date, self.end_date
        if a > b:
            return spark.createDataFrame([], "date date")
        days = (b - a).days
        n = {"DAY": days + 1, "WEEK": days // 7 + 1, "MONTH": days // 28 + 1, "QUARTER": days // 90 + 1, "YEAR": days // 365 + 1}[self.freq.unit]
        dates = spark.range(n).select(C.nth_date(F.lit(a), F.col("id"), self.freq).alias("date"))
        return dates.where(F.col("date").between(F.lit(a), F.lit(b)))

    def list(self, spark: SparkSession) -> DataFrame:
        return self._calendar(spark).orderBy("date")

    def count(self, spark: SparkSession) -> int:
        return self.list(spark).count()

    def groups(self, spark: SparkSession) -> DataFrame:
        """(year, part, dates): the dates of each period of the frequency, in order."""
        return self.list(spark).groupBy(C.group_key(F.col("date"), self.freq).alias("k")).agg(F.sort_array(F.collect_list("date")).alias("dates")).select("k.year", "k.part", "dates").orderBy("year", "part")


@dataclass
class BDatesList(DatesList):
    """Calendar dates of the range, then without weekends (daily) or rolled to business days, which may leave the range."""

    business = True

    def list(self, spark: SparkSession) -> DataFrame:
        dates = self._calendar(spark)
        if self.freq is DateFreq.DAILY:
            return dates.where(C.is_business_day(F.col("date"))).orderBy("date")
        return dates.select(C.roll(F.col("date"), self.freq).alias("date")).orderBy("date")
