"""Rules and accounts folded over a stream of bars, bar by bar, in state by symbol.

A batch writes such rules as windows over whole symbols; a stream has to carry on from where it was. Bars wait in the state until the watermark has passed
them, so that a symbol's bars are folded in the order of their time however they arrive; what comes after that is too late and dropped. State
and waiting bars are in the query's checkpoint: a restarted stream goes on with them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The session setting that such streams need, and its value.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: One bound (500 MB if not set otherwise) on what the stores of an executor hold in memory, however many they are.
BOUNDED = ("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")

State = tuple


class Step(Protocol):
    """A fold over (high, low, close): its state and output as column definitions, its first state, and one step."""

    state: str
    output: str

    def start(self) -> State: ...

    def step(self, state: State, high: float, low: float, close: float) -> tuple[State, tuple]: ...


@dataclass(frozen=True)
class DonchianAccount:
    """Breaks of the long channel enter, breaks of the short one against the position reverse it; the account holds one position at a time, with costs.

    The state is the last bars of the channels, the position, and the account: cash, units, side, entry price and epoch.
    """

    entry: int = 20
    leave: int = 10
    cost: float = 0.001
    slippage: float = 0.0001
    share: float = 0.95
    capital: float = 100_000.0
    state = "highs array<double>, lows array<double>, n long, position int, cash double, units double, side int, entry double, epoch long"
    output = "position int, signal int, direction int, epoch long, equity double"

    def start(self) -> State:
        return [], [], 0, 0, self.capital, 0.0, 0, 0.0, 0

    def step(self, state: State, high: float, low: float, close: float) -> tuple[State, tuple]:
        highs, lows, n, was, *account = state
        position = was
        if n >= max(self.entry, self.leave):
            if was == 0:
                position = 1 if close > max(highs[-self.entry :]) else -1 if close < min(lows[-self.entry :]) else 0
            elif was == 1:
                position = -1 if close < min(lows[-self.leave :]) else 1
            else:
                position = 1 if close > max(highs[-self.leave :]) else -1
        signal = position if position != was else 0
        account, equity = self._booked(account, signal, close)
        kept = max(self.entry, self.leave)
        state = [*highs, high][-kept:], [*lows, low][-kept:], n + 1, position, *account
        return state, (position, signal, account[2], account[4], equity)

    def _booked(self, account: list, signal: int, price: float) -> tuple[list, float]:
        cash, units, side, entry, epoch = account
        k = self.cost + self.slippage
        closed = bool(signal and side and side != signal)
        if closed:
            cash += units * price * (1 - k) if side == 1 else (entry - price) * units - units * price * k
            units, side, epoch = 0.0, 0, epoch + 1
        new = abs(cash * self.share / (price * (1 + k)))
        if signal and not side and new >= 0.01 and (signal == -1 or cash > 0):
            units, side, entry = new, signal, price
            cash -= units * price * k + (units * price if side == 1 else 0.0)
            epoch += not closed
        held = units * price if side == 1 else units * (entry - price)
        return [cash, units, side, entry, epoch], cash + held


class _Fold(StatefulProcessor):
    def __init__(self, step: Step, forget_ms: int):
        self.how, self.forget_ms = step, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "ts long", "high double, low double, close double")
        self.folded = handle.getValueState("folded", f"last long, {self.how.state}")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.folded.get()[0] if self.folded.exists() else None
        first = None
        for frame in rows:
            for ts, high, low, close in zip(frame["ts"], frame["high"], frame["low"], frame["close"]):
                at = ts.value // 1000
                if last is None or at > last:  # what was folded already is not folded again
                    self.waiting.updateValue((at,), (float(high), float(low), float(close)))
                    first = at if first is None else min(first, at)
        if first is not None:
            self.handle.registerTimer(_ms(first))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        bars = sorted((k[0], v) for k, v in self.waiting.iterator())
        due = [b for b in bars if _ms(b[0]) <= now]
        last, *state = self.folded.get() if self.folded.exists() else (None, *self.how.start())
        out = []
        for at, bar in due:
            state, made = self.how.step(tuple(state), *bar)
            out.append((key[0], pd.Timestamp(at, unit="us"), bar[2], *made))
            last = at
            self.waiting.removeKey((at,))
        if due:
            self.folded.update((last, *state))
        if len(due) < len(bars):
            self.handle.registerTimer(_ms(bars[len(due)][0]))
        elif due:
            self.handle.registerTimer(_ms(last) + self.forget_ms)
        elif last is not None and now >= _ms(last) + self.forget_ms:
            self.folded.clear()
        if out:
            names = ["symbol", "ts", "close", *(c.split()[0] for c in self.how.output.split(", "))]
            yield pd.DataFrame(out, columns=names)

    def close(self) -> None:
        pass


def _ms(micros: int) -> int:
    """The first millisecond at or after it."""
    return -(-micros // 1000)


def fold_stream(bars: DataFrame, step: Step, late: str = "2 hours", forget_days: float = 400.0) -> DataFrame:
    """(symbol, ts, close, and the step's output) of every bar of a stream (symbol, ts, high, low, close), once the watermark has passed it.

    A symbol that has no bar for forget_days is forgotten, and begins anew if it comes back. The session must use the state store STORE. Waiting bars are as many as come within `late`; of
    bars of one symbol and time the last to arrive before they are folded counts.
    """
    timed = bars.select("symbol", F.col("ts").cast("timestamp").alias("ts"), *[F.col(c).cast("double") for c in ("high", "low", "close")]).withWatermark("ts", late)
    schema = f"symbol string, ts timestamp, close double, {step.output}"
    processor = _Fold(step, int(forget_days * 86_400_000))
    return timed.groupBy("symbol").transformWithStateInPandas(processor, schema, "Append", "EventTime")
