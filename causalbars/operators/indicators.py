"""Trailing averages, crossovers, regimes and returns. Every frame ends at the current row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causalbars.operators.panel import own_clock, dense, trailing, with_rows


def sma(bars: DataFrame, short: int, long: int) -> DataFrame:
    """Bars with sma_short and sma_long on the symbol's own bars; NULL until a window is full."""
    full = lambda n: F.when(F.count("close").over(trailing(n)) == n, F.sum("close").over(trailing(n)) / n)
    return bars.withColumns({"sma_short": full(short), "sma_long": full(long)})


def crossovers(bars: DataFrame, short: int, long: int) -> DataFrame:
    """Bars with bull_cross, bear_cross and regime (1 above, -1 below or equal, NULL while unknown).

    "Previous" is the previous bar of the symbol on which both averages exist; the first such bar never crosses.
    Sums are compared across by whole numbers of bars, which is exact for whole cents.
    """
    above = F.when(F.col("sma_short").isNotNull() & F.col("sma_long").isNotNull(), F.sum("close").over(trailing(short)) * long > F.sum("close").over(trailing(long)) * short)
    marked = sma(bars, short, long).withColumn("above", above)
    before = F.lag("above").over(own_clock())
    return marked.withColumns({
        "bull_cross": F.coalesce(F.col("above") & ~before, F.lit(False)),
        "bear_cross": F.coalesce(~F.col("above") & before, F.lit(False)),
        "regime": F.when(F.col("above"), F.lit(1)).when(~F.col("above"), F.lit(-1)),
    }).drop("above")


def signals(bars: DataFrame, calendar: DataFrame, short: int, long: int) -> DataFrame:
    """Crossovers on the symbols' bars with bars_since_cross in rows of the union calendar (NULL before the first)."""
    marked = with_rows(crossovers(bars, short, long), calendar)
    cross = F.when(F.col("bull_cross") | F.col("bear_cross"), F.col("row_id"))
    return marked.withColumn("bars_since", F.col("row_id") - F.max(cross).over(own_clock().rowsBetween(Window.unboundedPreceding, 0)))


def signal_panel(bars: DataFrame, calendar: DataFrame, short: int, long: int) -> DataFrame:
    """Signals on every calendar row: flags false off the bars, regime carried forward (0 before it is known)."""
    marked = crossovers(bars, short, long).select("symbol", "date", "sma_short", "sma_long", "bull_cross", "bear_cross", "regime")
    past = own_clock().rowsBetween(Window.unboundedPreceding, 0)
    panel = dense(bars, calendar).join(marked, ["symbol", "date"], "left")
    cross = F.when(F.col("bull_cross") | F.col("bear_cross"), F.col("row_id"))
    return panel.withColumns({
        "regime": F.coalesce(F.last("regime", ignorenulls=True).over(past), F.lit(0)).cast("tinyint"),
        "bars_since": F.col("row_id") - F.max(cross).over(past),
        "bull_cross": F.coalesce("bull_cross", F.lit(False)),
        "bear_cross": F.coalesce("bear_cross", F.lit(False)),
    })


def bars_since(flags: DataFrame, order: str, flag: str) -> DataFrame:
    """Rows since the flag was last true, NULL before; for one series."""
    w = Window.orderBy(order)
    at = flags.withColumn("_at", F.row_number().over(w))
    return at.withColumn("bars_since", F.col("_at") - F.max(F.when(F.col(flag), F.col("_at"))).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_at")


def returns(series: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Simple returns to the previous row; gaps are not padded, and the first row has none."""
    return series.withColumn("ret", F.col(value) / F.lag(value).over(Window.partitionBy(by).orderBy(order)) - 1)


def scan_asof(bars: DataFrame, calendar: DataFrame, short: int, long: int, asof: str | None = None, lookback: int = 30) -> DataFrame:
    """One row per symbol whose last cross is at most ``lookback`` calendar rows before the last row up to ``asof``.

    Only rows up to ``asof`` are read. Prices are those of the symbol's own last bar, with its date.
    """
    if asof is not None:
        bars, calendar = bars.filter(F.col("date") <= F.lit(asof).cast("date")), calendar.filter(F.col("date") <= F.lit(asof).cast("date"))
    marked = with_rows(crossovers(bars, short, long), calendar)
    cross = F.when(F.col("bull_cross") | F.col("bear_cross"), F.struct("row_id", "bull_cross", "date"))
    last = marked.groupBy("symbol").agg(
        F.max(cross).alias("cross"),
        F.max_by(F.struct("close", "date"), "date").alias("bar"),
        F.max_by("sma_short", F.when(F.col("sma_short").isNotNull(), F.col("date"))).alias("ss"),
        F.max_by("sma_long", F.when(F.col("sma_long").isNotNull(), F.col("date"))).alias("sl"),
    )
    end = calendar.agg(F.max("row_id").alias("end"))
    return (
        last.filter("cross IS NOT NULL")
        .join(F.broadcast(end))
        .withColumn("bars_since", F.col("end") - F.col("cross.row_id"))
        .filter(F.col("bars_since") <= lookback)
        .select(
            "symbol",
            F.when(F.col("cross.bull_cross"), "BULLISH").otherwise("BEARISH").alias("signal"),
            F.col("cross.date").alias("crossover_date"),
            "bars_since",
            F.round("bar.close", 2).alias("close"),
            F.col("bar.date").alias("price_date"),
            F.round("ss", 2).alias("sma_short"),
            F.round("sl", 2).alias("sma_long"),
            F.round((F.col("ss") / F.col("sl") - 1) * 100, 2).alias("spread_pct"),
        )
        .orderBy("bars_since", "symbol")
    )
