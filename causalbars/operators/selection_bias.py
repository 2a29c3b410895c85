"""How much of a best result is selection: PBO by CSCV, deflated Sharpe, minimum backtest length, SPA."""

from __future__ import annotations

import math
from itertools import combinations
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

EULER = 0.5772156649015329


def splits(blocks: int = 12, most: int | None = 400, seed: int = 7) -> list[tuple[int, ...]]:
    """Halves of the blocks to train on: all, or ``most`` of them drawn without replacement."""
    every = list(combinations(range(blocks), blocks // 2))
    if most is None or len(every) <= most:
        return every
    return [every[i] for i in np.random.default_rng(seed).choice(len(every), most, replace=False)]


def cscv(spark: SparkSession, returns: DataFrame, order: DataFrame, blocks: int = 12, halves: list[tuple[int, ...]] | None = None) -> DataFrame:
    """(split, config_id, oos_rank): the in-sample winner of each split and its share of configurations below it outside.

    ``returns(config_id, date, ret)``; dates on which any configuration lacks a return are left out. Blocks are
    contiguous, the first ones a row longer. Each (block, configuration) enters by its count, sum and sum of squares.
    """
    halves = splits(blocks) if halves is None else halves
    n = returns.agg(F.count_distinct("config_id").alias("n_configs"))
    full = returns.filter("ret IS NOT NULL").groupBy("date").agg(F.count("*").alias("c")).join(F.broadcast(n)).filter("c = n_configs").select("date")
    # Of whole dates: a table of dates, numbered, then cut into blocks.
    numbered = full.withColumn("i", F.row_number().over(Window.orderBy("date")) - 1).withColumn("total", F.count("*").over(Window.partitionBy()))
    size, extra = F.expr(f"total div {blocks}"), F.expr(f"total % {blocks}")
    block = F.when(F.col("i") < extra * (size + 1), F.expr(f"i div (total div {blocks} + 1)")).otherwise(extra + F.floor((F.col("i") - extra * (size + 1)) / size))
    cut = numbered.filter(F.col("total") >= 4 * blocks).select("date", block.cast("int").alias("block"))
    means = returns.groupBy("config_id").agg(F.avg("ret").alias("m"))
    stats = returns.join(F.broadcast(cut), "date").join(F.broadcast(means), "config_id").withColumn("x", F.col("ret") - F.col("m")).groupBy("block", "config_id").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.first("m").alias("m"))
    sides = spark.createDataFrame([(i, b, b in half) for i, half in enumerate(map(set, halves)) for b in range(blocks)], "split int, block int, train boolean")
    sums = stats.join(F.broadcast(sides), "block").groupBy("split", "train", "config_id").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.first("m").alias("m"))
    mean = F.col("s") / F.col("n")
    sd = F.sqrt(F.greatest((F.col("q") - F.col("s") * mean) / (F.col("n") - 1), F.lit(0.0)))
    sharpe = F.round(F.coalesce((mean + F.col("m")) / F.nullif(sd, F.lit(0.0)), F.lit(0.0)) * 252**0.5, 9)
    rated = sums.withColumn("sharpe", sharpe).join(F.broadcast(order), "config_id")
    best = rated.filter("train").withColumn("r", F.row_number().over(Window.partitionBy("split").orderBy(F.desc("sharpe"), "pos"))).filter("r = 1").select("split", F.col("config_id").alias("winner"))
    test = rated.filter("NOT train").select("split", "config_id", "sharpe").join(best, "split")
    return test.groupBy("split", F.col("winner").alias("config_id")).agg(F.max(F.when(F.col("config_id") == F.col("winner"), F.col("sharpe"))).alias("won"), F.collect_list("sharpe").alias("all")).select("split", "config_id", (F.size(F.filter("all", lambda x: x < F.col("won"))) / F.size("all")).alias("oos_rank"))


def pbo(ranked: DataFrame) -> DataFrame:
    """Share of splits whose winner ranks in the lower half outside its sample."""
    return ranked.agg(F.avg((F.least(F.greatest("oos_rank", F.lit(1e-6)), F.lit(1 - 1e-6)) < 0.5).cast("int")).alias("pbo"), F.count("*").alias("n_splits"))


def expected_max(trials: int) -> float:
    """Expected largest of ``trials`` standard normal Sharpe ratios."""
    if trials <= 1:
        return 0.0
    inv = NormalDist().inv_cdf
    return (1 - EULER) * inv(1 - 1 / trials) + EULER * inv(1 - 1 / (trials * math.e))


def minimum_backtest_length(trials: int, target: float = 1.0) -> float:
    """Years below which the best of ``trials`` is expected to reach ``target`` by chance."""
    return (expected_max(trials) / target) ** 2


def probabilistic_sharpe(n: int, sharpe: float, skew: float, kurtosis: float, benchmark: float = 0.0) -> float:
    """Probability that the Sharpe per row exceeds ``benchmark``; ``kurtosis`` is 3 for a normal."""
    scale = 1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe**2
    return NormalDist().cdf((sharpe - benchmark) * math.sqrt(n - 1) / math.sqrt(scale))


def report(spark: SparkSession, returns: DataFrame, order: DataFrame, effective_trials: int | None = None, target: float = 1.0) -> DataFrame:
    """One row: the best configuration, its PSR and deflated Sharpe, the minimum backtest length and PBO."""
    own = returns.filter("ret IS NOT NULL").groupBy("config_id").agg(F.count("*").alias("n"), F.coalesce(F.avg("ret") / F.nullif(F.stddev_samp("ret"), F.lit(0.0)), F.lit(0.0)).alias("sr"), F.skewness("ret").alias("g3"), (F.kurtosis("ret") + 3).alias("g4"))
    best = own.join(F.broadcast(order), "config_id").orderBy(F.desc(F.round("sr", 12)), "pos").first()
    over = own.agg(F.count("*").alias("n"), F.var_samp("sr").alias("v")).first()
    schema = "best string, best_sharpe double, n_obs long, n_trials int, psr double, deflated_sharpe double, min_backtest_years double, pbo double, notes array<string>"
    if best is None:
        return spark.createDataFrame([], schema)
    trials, notes = effective_trials or over.n, []
    found = pbo(cscv(spark, returns, order)).first() if over.n > 1 else None
    if found is None or found.pbo is None:
        notes.append("PBO needs two configurations and four rows for each block")
    known = best.g3 is not None and best.g4 is not None and best.n > 2
    psr = probabilistic_sharpe(best.n, best.sr, best.g3, best.g4) if known else None
    dsr = probabilistic_sharpe(best.n, best.sr, best.g3, best.g4, math.sqrt(over.v or 0.0) * expected_max(trials)) if known else None
    return spark.createDataFrame([(best.config_id, best.sr * 252**0.5, best.n, trials, psr, dsr, minimum_backtest_length(trials, target), found.pbo if found else None, notes)], schema)


def _spa_counts(n: int, reps: range, mean_block: float, seed: int) -> np.ndarray:
    """How often each of n dates is drawn, per repetition, by the stationary bootstrap."""
    out = np.empty((len(reps), n))
    for i, rep in enumerate(reps):
        rng = np.random.default_rng([seed, rep])
        fresh = rng.random(n) < 1 / mean_block
        fresh[0] = True
        at = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        out[i] = np.bincount((rng.integers(0, n, n)[at] + np.arange(n) - at) % n, minlength=n)
    return out


def _spa_block(n: int, reps: int, mean_block: float, seed: int):
    """A block of configurations: each repetition's largest mean above each null's, and as rep -1 the largest means."""

    def run(block):
        import pandas as pd

        d = block.pivot(index="row", columns="config_id", values="d").sort_index().to_numpy(float)
        scale = d.std(axis=0, ddof=1)
        z = d / np.where(scale > 0, scale, 1.0)
        mean = z.mean(axis=0)
        centred = np.maximum(mean, 0), np.where(mean >= -math.sqrt(2 * math.log(math.log(n)) / n), mean, 0), mean
        out = [(-1, *[float(mean.max())] * 3)]
        for lo in range(0, reps, 64):
            some = range(lo, min(lo + 64, reps))
            drawn = _spa_counts(n, some, mean_block, seed) @ z / n
            out += zip(some, *((drawn - c).max(axis=1).tolist() for c in centred), strict=True)
        return pd.DataFrame(out, columns=["rep", "lower", "consistent", "upper"])

    return run


def spa(spark: SparkSession, returns: DataFrame, benchmark: DataFrame, reps: int = 1000, mean_block: float = 10.0, seed: int = 7, cells: int = 1_000_000) -> DataFrame:
    """Hansen's test of superior ability by the stationary bootstrap: p-values of the lower, consistent and upper null.

    ``benchmark(date, ret)``, aligned on common dates; dates on which any configuration lacks a return are left out, and
    of fewer than three dates the p-values are null. A task holds a block of configurations of about ``cells`` cells (one
    configuration at least) and draws the dates that every other one draws, so any number of configurations will do.
    """
    gained = returns.join(benchmark.select("date", F.col("ret").alias("b")), "date").filter("ret IS NOT NULL AND b IS NOT NULL").select("date", "config_id", (F.col("ret") - F.col("b")).alias("d"))
    gained = gained.groupBy("date", "config_id").agg(F.first("d").alias("d"))
    k = gained.agg(F.count_distinct("config_id")).first()[0]
    full = [x.date for x in gained.groupBy("date").agg(F.count("*").alias("c")).filter(F.col("c") == k).select("date").orderBy("date").collect()]
    n = len(full)
    if n < 3:
        return spark.createDataFrame([(None, None, None)], "p_lower double, p_consistent double, p_upper double")
    rows = spark.createDataFrame(list(zip(full, range(n), strict=True)), gained.select("date").schema.add("row", IntegerType()))
    blocks = -(-n * k // cells)
    placed = gained.join(F.broadcast(rows), "date").select(F.pmod(F.xxhash64("config_id"), F.lit(blocks)).alias("block"), "config_id", "row", "d")
    draws = placed.groupBy("block").applyInPandas(_spa_block(n, reps, mean_block, seed), "rep long, lower double, consistent double, upper double")
    best = draws.groupBy("rep").agg(*(F.greatest(F.max(c), F.lit(0.0)).alias(c) for c in ("lower", "consistent", "upper")))
    stat = best.filter("rep = -1").select(F.col("upper").alias("stat"))
    return best.filter("rep >= 0").join(F.broadcast(stat)).agg(*(F.avg((F.col(c) > F.col("stat")).cast("int")).alias(f"p_{c}") for c in ("lower", "consistent", "upper")))
