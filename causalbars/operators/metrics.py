"""Performance statistics of equity curves and trades, one row per curve or configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causalbars.operators.joins import asof

#: Trading days in a year, and the yearly risk-free rate.
DAYS, RISK_FREE = 252, 0.065


def _ordered(by: str):
    return Window.partitionBy(by).orderBy("date")


def drawdowns(curves: DataFrame, by: str = "config_id", value: str = "equity") -> DataFrame:
    """Curves with ret, peak and drawdown (below the running peak)."""
    w = _ordered(by)
    peak = F.max(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return curves.withColumns({"ret": F.col(value) / F.lag(value).over(w) - 1, "peak": peak, "drawdown": F.col(value) / peak - 1})


def longest_drawdown(curves: DataFrame, by: str = "config_id", value: str = "equity") -> DataFrame:
    """Rows in the longest run below the peak; 0 if there is none."""
    own = drawdowns(curves, by, value).withColumn("under", F.col("drawdown") < -1e-9)
    runs = own.withColumn("run", F.sum((~F.col("under")).cast("int")).over(_ordered(by).rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(by, "run").agg(F.count_if("under").alias("n")).groupBy(by).agg(F.max("n").alias("longest_drawdown"))


def performance(curves: DataFrame, by: str = "config_id", value: str = "equity", slots: int | None = None) -> DataFrame:
    """CAGR, volatility, Sharpe (above the risk-free rate), Sortino, worst drawdown, longest drawdown, exposure.

    Sortino divides by the deviation of the negative returns. Undefined ratios are NULL.
    """
    own = drawdowns(curves, by, value)
    excess = F.col("ret") - RISK_FREE / DAYS
    root = float(DAYS) ** 0.5
    years = F.datediff(F.max("date"), F.min("date")) / 365.25
    stats = own.groupBy(by).agg(
        F.count("*").alias("n_rows"),
        F.min("date").alias("start"),
        F.max("date").alias("end"),
        F.when(years > 0, F.pow(F.max_by(value, "date") / F.min_by(value, "date"), 1 / F.when(years > 0, years)) - 1).alias("cagr"),
        (F.max_by(value, "date") / F.min_by(value, "date") - 1).alias("total_return"),
        (F.stddev_samp("ret") * root).alias("volatility"),
        (F.try_divide(F.avg(excess), F.nullif(F.stddev_samp("ret"), F.lit(0.0))) * root).alias("sharpe_rf"),
        (F.try_divide(F.avg("ret"), F.nullif(F.stddev_samp("ret"), F.lit(0.0))) * root).alias("sharpe_raw"),
        (F.try_divide(F.avg(excess), F.nullif(F.stddev_samp(F.when(F.col("ret") < 0, F.col("ret"))), F.lit(0.0))) * root).alias("sortino"),
        F.min("drawdown").alias("max_drawdown"),
        *([F.avg(F.col("n_positions") / slots).alias("exposure")] if slots else []),
    )
    return stats.join(longest_drawdown(curves, by, value), by)


def trade_stats(trades: DataFrame, by: str = "config_id") -> DataFrame:
    """Counts, win rate, averages, profit factor (infinite without losses) and sums of closed trades."""
    win, net = F.col("net_pnl") > 0, F.col("net_return_pct")
    lost = F.coalesce(F.sum(F.when(~win, F.col("net_pnl"))), F.lit(0.0))
    return trades.groupBy(by).agg(
        F.count("*").alias("n_trades"),
        F.avg(win.cast("int")).alias("win_rate"),
        F.avg(net).alias("mean_trade_pct"),
        F.percentile(net, 0.5).alias("median_trade_pct"),
        F.coalesce(F.avg(F.when(win, net)), F.lit(0.0)).alias("avg_win_pct"),
        F.coalesce(F.avg(F.when(~win, net)), F.lit(0.0)).alias("avg_loss_pct"),
        F.when(lost == 0, F.lit(float("inf"))).otherwise(F.coalesce(F.sum(F.when(win, F.col("net_pnl"))), F.lit(0.0)) / -F.nullif(lost, F.lit(0.0))).alias("profit_factor"),
        F.avg("holding_days").alias("mean_holding_days"),
        F.percentile("holding_days", 0.5).alias("median_holding_days"),
        F.sum("charges").alias("charges"),
        F.sum("dividends").alias("dividends"),
        F.sum("net_pnl").alias("net_pnl"),
        F.max(net).alias("best_pct"),
        F.min(net).alias("worst_pct"),
    )


def benchmark_levels(levels: DataFrame, fee: float = 0.0025) -> DataFrame:
    """Levels less a yearly fee, which accrues by row position."""
    place = F.row_number().over(Window.orderBy("date")) - 1
    return levels.filter("level IS NOT NULL").withColumn("net_level", F.col("level") * F.pow(F.lit(1 - fee), place / DAYS))


def rebased(curves: DataFrame, value: str, to: float, by: str) -> DataFrame:
    first = F.first_value(value).over(_ordered(by).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return curves.withColumn("rebased", F.col(value) / first * to)


def against_benchmark(curves: DataFrame, levels: DataFrame, by: str = "config_id") -> DataFrame:
    """CAGR of each curve, of the benchmark as of the same dates, and their difference in points."""
    joined = asof(curves.select(by, "date", "equity"), levels.select("date", F.col("net_level").alias("_level")).withColumnRenamed("_level", "bench"), "date", ["bench"]).filter("bench IS NOT NULL")
    years = F.datediff(F.max("date"), F.min("date")) / 365.25
    grown = lambda c: F.pow(F.max_by(c, "date") / F.min_by(c, "date"), 1 / F.when(years > 0, years)) - 1
    return joined.groupBy(by).agg(grown("equity").alias("cagr"), grown("bench").alias("benchmark_cagr")).withColumn("alpha_points", (F.col("cagr") - F.col("benchmark_cagr")) * 100)


def horizon_cagr(levels: DataFrame, years: tuple[int, ...] = (5, 10, 15)) -> DataFrame:
    """CAGR of the last n years from the last level at or before that day."""
    end = levels.agg(F.max("date").alias("end"), F.max_by("level", "date").alias("now"))
    spans = end.select("end", "now", F.explode(F.array(*map(F.lit, years))).alias("years")).withColumn("day", F.add_months("end", -12 * F.col("years")))
    then = spans.join(levels.select("date", "level")).filter("date <= day").groupBy("years", "end", "now").agg(F.max_by("level", "date").alias("was"))
    return then.select("years", (F.pow(F.col("now") / F.col("was"), 1 / F.col("years")) - 1).alias("cagr"))
