"""Universes: today's list held back through time, the point-in-time ranking by traded value, and what neither sees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causalbars.operators.panel import own_clock, dense, rolling_median


def static_membership(bars: DataFrame, listed: DataFrame) -> DataFrame:
    """(symbol, date) of each bar of a symbol on the list."""
    return bars.join(listed.select("symbol").distinct(), "symbol", "left_semi").select("symbol", "date")


def rebalance_dates(calendar: DataFrame, unit: str = "MM") -> DataFrame:
    """The last trading date of each period, a partial last one included: (rebal, row_id, next_rebal)."""
    ends = calendar.groupBy(F.trunc("date", unit).alias("period")).agg(F.max("date").alias("rebal"), F.max("row_id").alias("row_id"))
    return ends.withColumn("next_rebal", F.lead("rebal").over(Window.orderBy("rebal"))).drop("period")


def turnover_history(bars: DataFrame, calendar: DataFrame, lookback: int = 60) -> DataFrame:
    """The dense panel with the trailing median of close x volume and the number of bars so far."""
    panel = dense(bars, calendar)
    return panel.withColumns({
        "median_turnover": rolling_median(F.col("close") * F.col("volume"), lookback, lookback // 2),
        "history": F.count("close").over(own_clock().rowsBetween(Window.unboundedPreceding, 0)),
    })


def rankings(bars: DataFrame, calendar: DataFrame, top_n: int, lookback: int = 60, min_history: int = 250, unit: str = "MM", history: DataFrame | None = None) -> DataFrame:
    """The ``top_n`` symbols by median turnover of each rebalance date; ties go to the smaller symbol."""
    at = F.broadcast(rebalance_dates(calendar, unit).drop("row_id"))
    ranked = (history if history is not None else turnover_history(bars, calendar, lookback)).join(at, F.col("date") == F.col("rebal"))
    ranked = ranked.filter((F.col("median_turnover").isNotNull()) & (F.col("history") >= min_history))
    w = Window.partitionBy("rebal").orderBy(F.desc("median_turnover"), "symbol")
    return ranked.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top_n).select("rebal", "next_rebal", "symbol", "place", "median_turnover")


def pit_membership(bars: DataFrame, calendar: DataFrame, top_n: int, lookback: int = 60, min_history: int = 250, unit: str = "MM", history: DataFrame | None = None) -> DataFrame:
    """(symbol, date) of bars in the universe: a rebalance's choice holds after its date up to the next, included.

    Each calendar date gets the one rebalance in force on it, so that the range becomes an equi-join.
    """
    chosen = rankings(bars, calendar, top_n, lookback, min_history, unit, history).select("symbol", "rebal")
    marks = calendar.join(rebalance_dates(calendar, unit).select(F.col("rebal").alias("mark")), F.col("date") == F.col("mark"), "left")
    force = marks.withColumn("rebal", F.last("mark", ignorenulls=True).over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1))).filter("rebal IS NOT NULL").select("date", "rebal")
    return bars.join(F.broadcast(force), "date").join(chosen, ["symbol", "rebal"], "left_semi").select("symbol", "date")


def overlap(a: DataFrame, b: DataFrame, calendar: DataFrame) -> DataFrame:
    """Members a day of either universe and of both, over all calendar days."""
    n = calendar.agg(F.count("*").alias("days"))
    counts = a.agg(F.count("*").alias("na")).join(b.agg(F.count("*").alias("nb"))).join(a.join(b, ["symbol", "date"]).agg(F.count("*").alias("nab"))).join(n)
    return counts.select((F.col("na") / F.col("days")).alias("mean_a"), (F.col("nb") / F.col("days")).alias("mean_b"), (F.col("nab") / F.col("days")).alias("mean_both"))


def residual_bias(bars: DataFrame, asked: DataFrame, stopped_days: int = 30, late_days: int = 10) -> DataFrame:
    """One row: what a pool of symbols cannot see. Symbols without data, ended early, listed late."""
    ends = bars.agg(F.min("date").alias("start"), F.max("date").alias("end"))
    per = asked.select("symbol").distinct().join(bars.groupBy("symbol").agg(F.min("date").alias("first"), F.max("date").alias("last")), "symbol", "left").join(F.broadcast(ends))
    names = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("symbol"))))
    return per.agg(
        F.count("*").alias("requested"),
        F.count("first").alias("with_data"),
        names(F.col("first").isNull()).alias("no_data"),
        names(F.datediff("end", "last") > stopped_days).alias("stopped"),
        names(F.datediff("first", "start") > late_days).alias("listed_late"),
    )
