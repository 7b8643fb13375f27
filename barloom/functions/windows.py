"""Window columns over bars: all frames are rows, and every rolling value is null until its frame is full."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

KEYS = ("symbol",)
ORDER = "ts"


def ordered(keys: tuple[str, ...] = KEYS, order: str = ORDER) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def spec() -> WindowSpec:
    """By symbol, in time. Made when it is needed: a window needs a session."""
    return ordered()


def rows(a: int, b: int = 0, w: WindowSpec | None = None) -> WindowSpec:
    return (w or spec()).rowsBetween(a, b)


def upto(w: WindowSpec | None = None, last: int = 0) -> WindowSpec:
    return (w or spec()).rowsBetween(Window.unboundedPreceding, last)


def full(x: Column, n: int, aggregate: Callable[[Column], Column], first: int, last: int = 0, w: WindowSpec | None = None) -> Column:
    """aggregate(x) over the frame, where that has n values."""
    f = rows(first, last, w)
    return F.when(F.count(x).over(f) == n, aggregate(x).over(f))


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lag(x: Column | str, n: int = 1, w: WindowSpec | None = None) -> Column:
    return F.lag(_c(x), n).over(w or spec())


def simple_return(x: Column | str = "close", n: int = 1, w: WindowSpec | None = None) -> Column:
    return _c(x) / lag(x, n, w) - 1


def log_return(x: Column | str = "close", w: WindowSpec | None = None) -> Column:
    return F.log(_c(x) / lag(x, 1, w))


def difference(x: Column | str = "close", w: WindowSpec | None = None) -> Column:
    return _c(x) - lag(x, 1, w)


def sma(x: Column | str, n: int, w: WindowSpec | None = None) -> Column:
    return full(_c(x), n, F.avg, 1 - n, 0, w)


def std(x: Column | str, n: int, w: WindowSpec | None = None) -> Column:
    return full(_c(x), n, F.stddev_samp, 1 - n, 0, w)


def prior_avg(x: Column | str, n: int, w: WindowSpec | None = None) -> Column:
    return full(_c(x), n, F.avg, -n, -1, w)


def ema_span(n: int) -> int:
    """Rows after which a weight is below 1e-16 of the first."""
    return math.ceil(-16 / math.log10(1 - 2 / (n + 1)))


def rolling_sharpe(r: Column | str, n: int, periods: float, w: WindowSpec | None = None) -> Column:
    mean, sd = full(_c(r), n, F.avg, 1 - n, 0, w), std(r, n, w)
    return F.when(sd == 0, 0.0).otherwise(mean / F.nullif(sd, F.lit(0.0)) * periods**0.5)


def channel(n: int, w: WindowSpec | None = None) -> tuple[Column, Column]:
    """Highest high and lowest low of the n bars before this one."""
    return full(F.col("high"), n, F.max, -n, -1, w), full(F.col("low"), n, F.min, -n, -1, w)


def volume_ratio(n: int, w: WindowSpec | None = None) -> Column:
    """Volume over the mean of the n bars before."""
    mean = prior_avg("volume", n, w)
    return F.col("volume") / F.nullif(mean, F.lit(0.0))


def zscore_prior(x: Column | str, n: int, w: WindowSpec | None = None) -> Column:
    """Against the n values before, this one left out."""
    x = _c(x)
    sd = full(x, n, F.stddev_samp, -n, -1, w)
    return (x - full(x, n, F.avg, -n, -1, w)) / F.nullif(sd, F.lit(0.0))


def zscore(x: Column | str, n: int, aggregate: Callable[[Column], Column] = F.stddev_samp, w: WindowSpec | None = None) -> Column:
    """Against the last n values, this one included."""
    x = _c(x)
    sd = full(x, n, aggregate, 1 - n, 0, w)
    return (x - full(x, n, F.avg, 1 - n, 0, w)) / F.nullif(sd, F.lit(0.0))


def forward_fill(x: Column | str, w: WindowSpec | None = None) -> Column:
    return F.last(_c(x), ignorenulls=True).over(upto(w))


def running_equity(r: Column | str, w: WindowSpec | None = None) -> Column:
    """The product of 1 + r up to each row; nulls count as no return."""
    return F.product(F.coalesce(_c(r), F.lit(0.0)) + 1).over(upto(w))
