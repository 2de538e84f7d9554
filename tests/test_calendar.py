from __future__ import annotations

import datetime as dt

import pytest

from columna.functions.calendar import DateFreq
from columna.operators.calendar import BDatesList, DatesList, generate

D = dt.date.fromisoformat


def listed(df):
    return [r[0] for r in df.collect()]


def test_codes():
    for codes, freq in (("D", DateFreq.DAILY), ("W WS", DateFreq.WEEKLY_MONDAY), ("WF", DateFreq.WEEKLY_FRIDAY), ("M MS", DateFreq.MONTH_START), ("ME", DateFreq.MONTH_END), ("Q QS", DateFreq.QUARTER_START), ("QE", DateFreq.QUARTER_END), ("Y A AS YS", DateFreq.YEAR_START), ("YE AE", DateFreq.YEAR_END)):
        for c in codes.split():
            assert DateFreq.parse(c) is freq
    for bad in ("d", "X", ""):
        with pytest.raises(ValueError):
            DateFreq.parse(bad)


@pytest.mark.parametrize(("start", "end", "code", "want"), [
    ("2023-01-01", "2023-12-31", "QE", ["2023-03-31", "2023-06-30", "2023-09-29", "2023-12-29"]),
    ("2023-11-01", "2023-11-05", "D", ["2023-11-01", "2023-11-02", "2023-11-03"]),
    ("2023-11-15", "2024-02-15", "M", ["2023-12-01", "2024-01-01", "2024-02-01"]),
    ("2024-02-15", "2023-11-15", "M", []),
    ("2023-12-31", "2023-12-31", "ME", ["2023-12-29"]),
])
def test_business_lists(spark, start, end, code, want):
    assert listed(BDatesList(start, end, DateFreq.parse(code)).list(spark)) == [D(x) for x in want]


@pytest.mark.parametrize(("start", "code", "n", "business", "want"), [
    ("2024-01-31", "ME", 3, False, ["2024-01-31", "2024-02-29", "2024-03-31"]),
    ("2023-11-08", "W", 3, False, ["2023-11-13", "2023-11-20", "2023-11-27"]),
    ("2023-09-30", "ME", 4, True, ["2023-10-31", "2023-11-30", "2023-12-29", "2024-01-31"]),
    ("2022-12-31", "YE", 3, True, ["2023-12-29", "2024-12-31", "2025-12-31"]),
])
def test_generators(spark, start, code, n, business, want):
    assert listed(generate(spark, start, DateFreq.parse(code), n, business)) == [D(x) for x in want]


def test_periods_groups_and_errors(spark):
    b = BDatesList.from_n_periods(spark, "2023-01-01", DateFreq.DAILY, 5)
    assert b.end == "2023-01-06" and b.count(spark) == 5 and b.freq_str == "D" and b.start_date == D("2023-01-01")
    assert BDatesList.from_n_periods(spark, "2024-01-01", DateFreq.MONTH_END, 3).count(spark) == 2
    groups = BDatesList("2022-01-01", "2024-03-31", DateFreq.YEAR_END).groups(spark).collect()
    assert [r["dates"] for r in groups] == [[D("2022-12-30")], [D("2023-12-29")]]
    weeks = DatesList("2020-12-28", "2021-01-04", DateFreq.WEEKLY_MONDAY).groups(spark).collect()
    assert [(r["year"], r["part"]) for r in weeks] == [(2020, 53), (2021, 1)]
    assert generate(spark, "2024-01-01", DateFreq.DAILY, 16, True, compat=True).count() == 15
    assert generate(spark, "2024-01-01", DateFreq.DAILY, 16, True).count() == 16
    with pytest.raises(ValueError):
        DatesList.from_n_periods(spark, "2024-01-01", DateFreq.DAILY, 0)
    with pytest.raises(ValueError):
        DatesList("2024-13-01", "2024-12-01", DateFreq.DAILY).list(spark)
