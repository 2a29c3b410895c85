"""The two clocks: a symbol's own bars, and the union calendar on which a dense panel stands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def own_clock():
    """A symbol's rows in the order of time. One specification, so that windows share an exchange and a sort."""
    return Window.partitionBy("symbol").orderBy("date")



def union_calendar(bars: DataFrame) -> DataFrame:
    """(date, row_id): dates on which any symbol has a bar, numbered from 0. One row per date, however many bars."""
    dates = bars.filter("close IS NOT NULL").select("date").distinct()
    return dates.withColumn("row_id", (F.row_number().over(Window.orderBy("date")) - 1).cast("int"))


def with_rows(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Bars with their row on the union calendar (a table of dates: small beside the bars)."""
    return bars.join(F.broadcast(calendar), "date")


def dense(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """A row for each symbol and calendar date; fields are NULL where the symbol has no bar, never filled."""
    last = calendar.agg(F.max("row_id").alias("last"))
    grid = bars.select("symbol").distinct().join(F.broadcast(last)).select("symbol", F.explode(F.sequence(F.lit(0), "last")).alias("row_id"))
    dated = grid.join(F.broadcast(calendar), "row_id")
    return dated.join(bars.filter("close IS NOT NULL"), ["symbol", "date"], "left")


def between(rows: DataFrame, start: str | None = None, end: str | None = None, on: str = "date") -> DataFrame:
    """Rows of a range of dates, both ends included."""
    if start is not None:
        rows = rows.filter(F.col(on) >= F.lit(start).cast("date"))
    return rows if end is None else rows.filter(F.col(on) <= F.lit(end).cast("date"))


def trailing(rows: int):
    """The last ``rows`` rows of a symbol, the current one included."""
    return own_clock().rowsBetween(-(rows - 1), 0)


def rolling_median(value: Column, rows: int, least: int) -> Column:
    """Median of the non-null values of the last ``rows`` rows, NULL with fewer than ``least``."""
    w = trailing(rows)
    return F.when(F.count(value).over(w) >= least, F.percentile(value, 0.5).over(w))


def tradeable(open_: Column, volume: Column) -> Column:
    return F.coalesce((open_ > 0) & (volume > 0), F.lit(False))


def band_blocked(open_: Column, previous: Column, side: str, circuit_pct: float, tolerance: float) -> Column:
    """Whether an open gaps so far from the previous close that an order of that side cannot be filled."""
    edge, gap = circuit_pct - tolerance, open_ / F.when(previous > 0, previous) - 1
    return F.coalesce(gap >= edge if side == "BUY" else gap <= -edge, F.lit(False))
