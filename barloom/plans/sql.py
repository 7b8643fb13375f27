"""Pieces of DuckDB SQL that the oracles share."""

from __future__ import annotations

_BARS = {
    "h": """select event_type as symbol, date_trunc('hour', ts) as ts, first(value order by ts, event_id) as open, max(value) as high, min(value) as low,
        last(value order by ts, event_id) as close, cast(count(*) as double) as volume from events where value > 0 group by 1, 2""",
    "d": """select l_returnflag as symbol, date_trunc('day', l_shipdate)::timestamp as ts,
        first(l_extendedprice / l_quantity order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as open,
        max(l_extendedprice / l_quantity) as high, min(l_extendedprice / l_quantity) as low,
        last(l_extendedprice / l_quantity order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as close,
        sum(l_quantity) as volume from lineitem group by 1, 2""",
    "w": """select l_returnflag as symbol, date_trunc('week', l_shipdate)::timestamp as ts,
        first(l_extendedprice / l_quantity order by l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as open,
        max(l_extendedprice / l_quantity) as high, min(l_extendedprice / l_quantity) as low,
        last(l_extendedprice / l_quantity order by l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as close,
        sum(l_quantity) as volume from lineitem group by 1, 2""",
}


# Damped: hourly (x) and weekly (y) bars whose moves are those of prices, not of noise.
for _damped, _raw in (("x", "h"), ("y", "w")):
    _BARS[_damped] = f"""select symbol, ts, 100 * pow(open, 0.02) as open, 100 * pow(high, 0.02) as high, 100 * pow(low, 0.02) as low, 100 * pow(close, 0.02) as close, volume from ({_BARS[_raw]})"""


def bars(kind: str = "h", more: str = "") -> str:
    """with bars, and r: the bars with t, ret, log_ret and d (the difference of closes); then further CTEs."""
    return f"""with bars as ({_BARS[kind]}),
    r as (select *, row_number() over w - 1 as t, close / lag(close) over w - 1 as ret, ln(close / lag(close) over w) as log_ret, close - lag(close) over w as d
        from bars window w as (partition by symbol order by ts)){', ' + more if more else ''} """


def over(a: str | int, b: str | int = 0) -> str:
    """A frame of rows, from a to b; u is unbounded."""
    end = lambda x: "unbounded preceding" if x == "u" else "current row" if x == 0 else f"{-x} preceding" if x < 0 else f"{x} following"
    return f"over (partition by symbol order by ts rows between {end(a)} and {end(b)})"


def full(agg: str, x: str, n: int, a: int, b: int = 0) -> str:
    """agg({}) of x over the frame, where that has n values."""
    o = over(a, b)
    call = agg.format(x) if "{}" in agg else f"{agg}({x})"
    return f"(case when count({x}) {o} = {n} then {call} {o} end)"


def sma(x: str, n: int) -> str:
    return full("avg", x, n, 1 - n)


def std(x: str, n: int) -> str:
    return full("stddev_samp", x, n, 1 - n)


def skew_pop(x: str) -> str:
    """Population skewness from raw values, as an aggregate over a group."""
    return f"(avg({x}^3) - 3*avg({x})*avg({x}^2) + 2*avg({x})^3) / nullif(stddev_pop({x}),0)^3"
