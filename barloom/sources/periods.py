"""Named periods of time, as commands take them: a year, ytd, so many months back, or a start and an end."""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Days that a name goes back; fixed values.
DAYS = {"1m": 30, "3m": 90, "6m": 180, "last_6m": 180, "1y": 365}


def named_period(name: str, today: date) -> tuple[datetime, datetime]:
    """Start (inclusive) and end (exclusive) of a period: `2024`, `ytd`, `1m`, `3m`, `6m`, `1y`, or `2024-01-05,2024-02-01`, whose last day is in it.

    What is none of these is taken for the last 180 days. Periods that go back from today end with today.
    """
    name = name.strip().lower()
    if re.fullmatch(r"\d{4}", name):
        first, last = date(int(name), 1, 1), date(int(name), 12, 31)
    elif name == "ytd":
        first, last = date(today.year, 1, 1), today
    elif "," in name:
        first, last = (date.fromisoformat(x.strip()) for x in name.split(",", 1))
    else:
        first, last = today - timedelta(days=DAYS.get(name, 180)), today
    if first > last:
        raise ValueError(f"the period {name} ends before it starts")
    start, end = (datetime(d.year, d.month, d.day) for d in (first, last + timedelta(days=1)))
    return start, end


def in_period(bars: DataFrame, name: str, today: date, column: str = "ts") -> DataFrame:
    """The rows of a named period. The bounds are literals, so they reach the scan."""
    start, end = named_period(name, today)
    at = F.col(column)
    return bars.where((at >= F.lit(start.isoformat(sep=" ")).cast("timestamp_ntz")) & (at < F.lit(end.isoformat(sep=" ")).cast("timestamp_ntz")))
