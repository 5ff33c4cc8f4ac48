"""The ratcheted strategy on a stream of settlements, with the same step as the batch fold; and incremental upserts of late data."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quantloom.operators.carry import Ratchet, RatchetParams
from quantloom.session import shipped
from quantloom.sources import archive


def targets(settlements: DataFrame, p: RatchetParams) -> DataFrame:
    """symbol, time, regime_state, target_notional, late for each settlement (symbol, time, funding_rate), in time order within a symbol.

    A settlement that comes after a later or an equal one of its symbol does not move the machine; it is given as late, without a state,
    so that what differs from the batch backtest can be found and replayed.
    A symbol's state is the last rates that the longer mean needs, the machine's state and its counter: bounded whatever the stream."""
    keep = max(p.ma_lookback, p.compression_lookback)
    capital = p.capital_per_leg

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        past, current, since, last = state.get if state.exists else ([], 0, 0, 0)
        machine, rates, out = Ratchet(current, since), list(past), []
        rows = pd.concat(list(batches)).sort_values("time")
        for t, rate in zip(rows["time"], rows["funding_rate"], strict=True):
            us = int(t.value // 1000)
            if us <= last:
                out.append((key[0], t, None, None, True))
                continue
            last = us
            rates = [*rates, float(rate)][-keep:]
            means = [round(sum(rates[-n:]) / n, 12) if len(rates) >= n else None for n in (p.ma_lookback, p.compression_lookback)]
            s = machine.step(*means, p)
            out.append((key[0], t, s, capital * s, False))
        state.update((rates, machine.state, machine.since, last))
        told = pd.DataFrame(out, columns=["symbol", "time", "regime_state", "target_notional", "late"])
        yield told.astype({"regime_state": "Int32", "target_notional": "Float64"})

    shipped(settlements.sparkSession)
    return settlements.groupBy("symbol").applyInPandasWithState(advance, "symbol string, time timestamp, regime_state int, target_notional double, late boolean", "rates array<double>, state int, since int, last bigint", "append", GroupStateTimeout.NoTimeout)


def upsert_stream(spark: SparkSession, bars: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Merge each micro-batch of bars into the archive, corrections beside it; a replayed batch changes nothing."""

    def merge(batch: DataFrame, _epoch: int) -> None:
        if batch.limit(1).count():
            archive.upsert_klines(spark, root, batch)

    return bars.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
