"""Registered queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with its SQL where there is one."""

    def add(f: Query) -> Query:
        if name in _queries:
            raise ValueError(f"{name} is registered twice")
        _queries[name] = f
        if sql is not None:
            _sql[name] = sql
        return f

    return add


#: The modules that register queries.
MODULES = ("q_windows", "q_metrics", "q_signals", "q_resample", "q_portfolio", "q_sources", "q_analysis", "q_blocks", "q_extensions")


def _load() -> None:
    for name in MODULES:
        import_module(f"{__package__}.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of the events, traded by momentum with costs: the account of every bar."""
    from ..operators.backtest import event_backtest
    from ..operators.signals import momentum
    from ..sources.bars import event_bars, table

    run = event_backtest(momentum(event_bars(table(spark, sf_dir, "events"))))
    return run.select("symbol", "ts", "close", "signal", "direction", "epoch", "equity")
