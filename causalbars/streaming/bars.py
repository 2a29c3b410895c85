"""Streams: bars from events under a watermark, and crossovers as state that a batch run must agree with.

An extension: the batch operators are the reference for both.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from causalbars.sources.tables import hourly_bars

CROSSES = "symbol string, ts timestamp, bull_cross boolean, bear_cross boolean"


def streaming_bars(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Hourly bars by event type; events later than the watermark are dropped."""
    return hourly_bars(events.withWatermark("ts", late))


def sliding_counts(events: DataFrame, size: str = "1 hour", step: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy("event_type", F.window("ts", size, step).alias("w")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))


def streaming_crosses(bars: DataFrame, short: int, long: int) -> DataFrame:
    """Crossovers of a stream of bars (symbol, ts, close) that comes in the order of time within a symbol.

    State per symbol: its last ``long`` closes and whether the short average was above; bounded by the window.
    """

    def step(key, frames, state):
        closes, above = (list(state.get[0]), state.get[1]) if state.exists else ([], None)
        rows = pd.concat(list(frames)).sort_values("ts")
        out = []
        for ts, close in zip(rows["ts"], rows["close"], strict=True):
            closes = [*closes, float(close)][-long:]
            if len(closes) == long:
                now = sum(closes[-short:]) * long > sum(closes) * short
                if above is not None and now != above:
                    out.append((key[0], ts, now, not now))
                above = now
        state.update((closes, above))
        yield pd.DataFrame(out, columns=["symbol", "ts", "bull_cross", "bear_cross"])

    return bars.groupBy("symbol").applyInPandasWithState(step, CROSSES, "closes array<double>, above boolean", "append", GroupStateTimeout.NoTimeout)
