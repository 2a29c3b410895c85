"""Joins over time: as-of, half-open intervals, effective-dated membership."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, on: str, values: list[str], by: str | None = None) -> DataFrame:
    """``left`` with the last non-null ``values`` of ``right`` at or before each row: one union, one sort, no range join."""
    keys = [by] if by else []
    order = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    tagged = right.select(*keys, on, *(F.col(v).alias(f"_r_{v}") for v in values), F.lit(0).alias("_side"))
    both = left.withColumn("_side", F.lit(1)).unionByName(tagged, allowMissingColumns=True)
    w = order.orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumns({v: F.last(f"_r_{v}", ignorenulls=True).over(w) for v in values})
    return filled.filter("_side = 1").drop("_side", *(f"_r_{v}" for v in values))


def dividends_over(trades: DataFrame, dividends: DataFrame, start: str = "entry_date", end: str = "exit_date") -> DataFrame:
    """Trades with dps_held: dividends per share with an ex-date after ``start`` and not after ``end``.

    Running totals of dividends turn the interval into two as-of look-ups by symbol.
    """
    running = dividends.groupBy("symbol", "ex_date").agg(F.sum("dps").alias("dps")).withColumn("upto", F.sum("dps").over(Window.partitionBy("symbol").orderBy("ex_date").rowsBetween(Window.unboundedPreceding, 0)))
    at = lambda col, name: running.select("symbol", F.col("ex_date").alias(col), F.col("upto").alias(name))
    opened = asof(trades, at(start, "_before"), start, ["_before"], "symbol")
    closed = asof(opened, at(end, "_through"), end, ["_through"], "symbol")
    return closed.withColumn("dps_held", F.when(F.col(end).isNotNull(), F.coalesce("_through", F.lit(0.0)) - F.coalesce("_before", F.lit(0.0))).otherwise(0.0)).drop("_before", "_through")


def effective_members(bars: DataFrame, spells: DataFrame) -> DataFrame:
    """Bars of symbols within a spell of membership, ``valid_from`` included and ``valid_to`` not (NULL: open)."""
    s = spells.select(F.col("symbol").alias("_s"), "valid_from", "valid_to")
    return bars.join(s, (F.col("symbol") == F.col("_s")) & (F.col("date") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("date") < F.col("valid_to"))), "left_semi")
