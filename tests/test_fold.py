"""A rule and its account over a stream: equal to the batch, through restarts, disorder and late rows."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from barloom.operators import backtest as bt
from barloom.operators import signals as sig
from barloom.streaming.fold import STORE, DonchianAccount, fold_stream

SCHEMA = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"
START = datetime(2024, 1, 1)


def bars(symbol, n, seed):
    r, price, out = random.Random(seed), 100.0, []
    for i in range(n):
        price *= 1 + r.gauss(0, 0.01)
        out.append((symbol, START + timedelta(hours=i), price, price * 1.004, price * 0.996, price, 1.0))
    return out


@pytest.fixture
def session(spark):
    one = spark.newSession()
    one.conf.set(*STORE)
    one.conf.set("spark.sql.shuffle.partitions", "2")
    return one


def run(session, tmp_path, rows):
    """One start of the stream, over what the folder holds by then."""
    session.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = session.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    query = fold_stream(stream, DonchianAccount(entry=10, leave=5)).writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/marks")
    query.option("path", f"{tmp_path}/out").format("parquet").trigger(availableNow=True).start().awaitTermination()


def test_stream_equals_batch(session, tmp_path):
    whole = {s: bars(s, n, k) for k, (s, n) in enumerate((("a", 160), ("b", 90), ("c", 12)))}
    late = ("a", START + timedelta(hours=3, minutes=30), 1.0, 500.0, 1.0, 500.0, 1.0)
    parts = [[b for s in whole for b in whole[s] if lo <= (b[1] - START) / timedelta(hours=1) < hi] for lo, hi in ((0, 40), (40, 41), (41, 100), (100, 200))]
    for k, part in enumerate(parts):
        random.Random(k).shuffle(part)  # bars of one file in any order
        run(session, tmp_path, part + ([late] if k == 2 else []))  # each is a restart; the late row comes long after its time
    run(session, tmp_path, [("end", START + timedelta(days=30), 1.0, 1.0, 1.0, 1.0, 1.0)])
    run(session, tmp_path, [("end", START + timedelta(days=31), 1.0, 1.0, 1.0, 1.0, 1.0)])
    found = {}
    for r in session.read.parquet(f"{tmp_path}/out").where("symbol <> 'end'").orderBy("symbol", "ts").collect():
        found.setdefault(r.symbol, []).append(r)
    batch = session.createDataFrame([b for s in whole for b in whole[s]], SCHEMA)
    batch = batch.withColumn("ts", batch.ts.cast("timestamp_ntz"))
    want = {}
    for r in bt.event_backtest(sig.donchian(batch, 10, 5)).orderBy("symbol", "ts").collect():
        want.setdefault(r.symbol, []).append(r)
    assert set(found) == set(want)
    for s in want:
        assert len(found[s]) == len(want[s])
        for x, y in zip(found[s], want[s]):
            assert (x.ts, x.position, x.signal, x.direction, x.epoch) == (y.ts, y.position, y.signal, y.direction, y.epoch)
            assert abs(x.equity / y.equity - 1) < 1e-9
    assert sum(abs(x.signal) for s in found for x in found[s]) > 5


def test_a_quiet_symbol_is_forgotten(session, tmp_path):
    step = DonchianAccount(entry=3, leave=2)
    rows = [("a", START + timedelta(hours=i), 1.0, p, p, p, 1.0) for i, p in enumerate((10.0, 10.0, 10.0, 12.0))]

    def go(rows):
        session.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = fold_stream(session.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), step, forget_days=10)
        out.writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/marks").option("path", f"{tmp_path}/out").format("parquet").trigger(availableNow=True).start().awaitTermination()

    go(rows)
    for day in (20, 21):
        go([("z", START + timedelta(days=day), 1.0, 1.0, 1.0, 1.0, 1.0)])
    go([("a", START + timedelta(days=22), 1.0, 9.0, 9.0, 9.0, 1.0)])
    for day in (40, 41):
        go([("z", START + timedelta(days=day), 1.0, 1.0, 1.0, 1.0, 1.0)])
    out = {r.ts: r for r in session.read.parquet(f"{tmp_path}/out").where("symbol = 'a'").collect()}
    assert out[START + timedelta(hours=3)].position == 1 and out[START + timedelta(days=22)].position == 0  # begun anew
