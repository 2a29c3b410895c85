"""Second-tier research statistics: data masks, turnover and net returns, false discoveries, alpha, rolling windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causalbars.operators.panel import own_clock


def suspicious(bars: DataFrame, beyond: float = 0.30, rows: int = 30) -> DataFrame:
    """Bars with ``masked``: whether the symbol's return of this bar or of one of the ``rows`` before exceeds ``beyond``."""
    ret = F.col("close") / F.lag("close").over(own_clock()) - 1
    marked = bars.withColumn("_far", F.coalesce(F.abs(ret) > beyond, F.lit(False)))
    return marked.withColumn("masked", F.max("_far").over(own_clock().rowsBetween(-rows, 0))).drop("_far")


def turnover(weights: DataFrame, bps: float = 25.0) -> DataFrame:
    """(config_id, y, turnover, gross, net) of ``weights(config_id, date, weight, ret)``: the year's sum of absolute
    changes of weight, its growth, and its growth after ``bps`` on each change. The first weight is a change from 0."""
    w = Window.partitionBy("config_id").orderBy("date")
    change = F.abs(F.col("weight") - F.coalesce(F.lag("weight").over(w), F.lit(0.0)))
    moved = weights.withColumn("change", change).groupBy("config_id", F.year("date").alias("y"))
    return moved.agg(F.sum("change").alias("turnover"), (F.product(1 + F.col("ret")) - 1).alias("gross"), (F.product(1 + F.col("ret") - F.col("change") * (bps / 10_000)) - 1).alias("net"))


def two_sided(t: Column) -> Column:
    """Normal p-value of a statistic, by the rational approximation of the error function with five terms."""
    x = F.abs(t) / F.sqrt(F.lit(2.0))
    k = 1 / (1 + 0.3275911 * x)
    return (((((1.061405429 * k - 1.453152027) * k) + 1.421413741) * k - 0.284496736) * k + 0.254829592) * k * F.exp(-x * x)


def discoveries(tests: DataFrame, rate: float = 0.10) -> DataFrame:
    """``tests(config_id, p)`` with place, q (Benjamini-Hochberg) and found, q within ``rate``; ties by name. One row
    per test, ranked in one task."""
    order = Window.orderBy("p", "config_id")
    placed = tests.withColumn("place", F.row_number().over(order)).join(F.broadcast(tests.agg(F.count("*").alias("_n"))))
    behind = Window.orderBy("place").rowsBetween(0, Window.unboundedFollowing)
    return placed.withColumn("q", F.least(F.lit(1.0), F.min(F.col("p") * F.col("_n") / F.col("place")).over(behind))).withColumn("found", F.col("q") <= rate).drop("_n")


def alpha_beta(returns: DataFrame, lags: int = 5) -> DataFrame:
    """(config_id, n, alpha, beta, t_alpha) of ``returns(config_id, date, ret, bench)``: least squares of ret on bench,
    with the t-statistic of alpha after Newey and West: its influence per date, with Bartlett weights of its lags."""
    known = returns.filter("ret IS NOT NULL AND bench IS NOT NULL")
    fit = known.groupBy("config_id").agg(F.count("*").alias("n"), F.regr_slope("ret", "bench").alias("beta"), F.regr_intercept("ret", "bench").alias("alpha"), F.avg("bench").alias("_m"), F.regr_sxx("ret", "bench").alias("_sxx"))
    share = 1 / F.col("n") - F.col("_m") * (F.col("bench") - F.col("_m")) / F.col("_sxx")
    each = known.join(fit, "config_id").withColumn("_g", share * (F.col("ret") - F.col("alpha") - F.col("beta") * F.col("bench")))
    w = Window.partitionBy("config_id").orderBy("date")
    near = sum((2 * (1 - k / (lags + 1)) * F.coalesce(F.lag("_g", k).over(w), F.lit(0.0)) for k in range(1, lags + 1)), F.col("_g"))
    summed = each.withColumn("_v", F.col("_g") * near).groupBy("config_id", "n", "alpha", "beta").agg(F.sum("_v").alias("_v"))
    return summed.select("config_id", "n", "alpha", "beta", F.try_divide("alpha", F.sqrt(F.nullif(F.greatest("_v", F.lit(0.0)), F.lit(0.0)))).alias("t_alpha"))


def rolling_growth(levels: DataFrame, rows: int, shares: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """Quantiles of the growth over all windows of ``rows`` rows of ``levels(date, level)``, and the share that lost."""
    grown = levels.withColumn("g", F.col("level") / F.lag("level", rows).over(Window.orderBy("date")) - 1).filter("g IS NOT NULL")
    found = grown.agg(F.count("*").alias("n"), F.avg((F.col("g") < 0).cast("double")).alias("lost"), F.percentile("g", F.array(*map(F.lit, shares))).alias("_p"))
    return found.select("n", "lost", *(F.col("_p")[i].alias(f"p{round(100 * x):02d}") for i, x in enumerate(shares)))
