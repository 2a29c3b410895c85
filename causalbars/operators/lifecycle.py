"""Trade life cycles, all configurations at once.

What becomes of a trade depends on its own symbol alone, but for its quantity: when and at what price it would be
filled, when its exit is signalled and filled, how often the exit is refused, which dividends it collects. This module
works that out for every eligible signal as joins and windows over (symbol, row). Frames that look ahead here only
resolve what follows from a decision already taken; signals never read them.
"""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causalbars.config import Settings
from causalbars.functions.costs import slipped
from causalbars.operators.joins import dividends_over
from causalbars.operators.panel import own_clock, band_blocked, dense, rolling_median, tradeable, trailing


def configurations(spark: SparkSession, settings: dict[str, Settings], universes: dict[str, str] | None = None) -> DataFrame:
    """One row per run; ``universes`` names each run's membership (default ``all``)."""
    rows = []
    for name, s in settings.items():
        e, x, p = s.execution, s.exits, s.portfolio
        rows.append((name, (universes or {}).get(name, "all"), s.short, s.long, float(e.slippage_bps), float(e.min_price), float(e.min_median_turnover), e.tiebreak, e.same_bar_fill, x.on_bear_cross, x.max_holding_days or None, x.stop_loss, p.max_positions, json.dumps(asdict(s))))
    schema = "config_id string, universe string, short int, long int, slippage_bps double, min_price double, min_turnover double, tiebreak string, same_bar boolean, on_bear boolean, max_days int, stop_loss double, max_positions int, settings string"
    return spark.createDataFrame(rows, schema)


def market(bars: DataFrame, calendar: DataFrame, circuit_pct: float = 0.10, tolerance: float = 0.002, lookback: int = 60) -> DataFrame:
    """The dense panel with all that fills and marks need, computed once for all configurations."""
    panel = dense(bars.withColumn("prev_close", F.lag("close").over(own_clock())), calendar)
    panel = panel.withColumns({
        "history": F.count("close").over(own_clock().rowsBetween(Window.unboundedPreceding, 0)),
        "median_turnover": rolling_median(F.col("close") * F.col("volume"), lookback, lookback // 2),
        "mark": F.last("close", ignorenulls=True).over(own_clock().rowsBetween(Window.unboundedPreceding, 0)),
        "trades": tradeable(F.col("open"), F.col("volume")),
        "closes": tradeable(F.col("close"), F.col("volume")),
        "buy_band": band_blocked(F.col("open"), F.col("prev_close"), "BUY", circuit_pct, tolerance),
        "sell_band": band_blocked(F.col("open"), F.col("prev_close"), "SELL", circuit_pct, tolerance),
    })
    sells = F.col("trades") & ~F.col("sell_band")
    blocked = (F.col("trades") & F.col("sell_band")).cast("int")
    after = own_clock().rowsBetween(1, Window.unboundedFollowing)
    return panel.withColumns({
        "next_sell": F.min(F.when(sells, F.struct("row_id", "date", "open"))).over(after),
        "blocked_upto": F.sum(blocked).over(own_clock().rowsBetween(Window.unboundedPreceding, 0)),
        "blocked_all": F.sum(blocked).over(Window.partitionBy("symbol")),
    })


def crosses(bars: DataFrame, calendar: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """(short, long, symbol, row_id, date, bull, sma_short, sma_long, next_cross) of each crossover of each pair.

    All averages share one window specification, so one exchange and sort serve any number of pairs; only crossovers
    leave it as rows. Crossovers of a pair alternate, so the next one is the opposite.
    """
    rows = bars.join(F.broadcast(calendar), "date")
    windows = sorted({n for pair in pairs for n in pair})
    sums = {f"s{n}": F.when(F.count("close").over(trailing(n)) == n, F.sum("close").over(trailing(n))) for n in windows}
    rows = rows.withColumns(sums)
    rows = rows.withColumns({f"a{s}_{l}": F.col(f"s{s}") * l > F.col(f"s{l}") * s for s, l in pairs})
    rows = rows.withColumns({f"c{s}_{l}": F.lag(f"a{s}_{l}").over(own_clock()) != F.col(f"a{s}_{l}") for s, l in pairs})
    each = [F.when(F.col(f"c{s}_{l}"), F.struct(F.lit(s).alias("short"), F.lit(l).alias("long"), F.col(f"a{s}_{l}").alias("bull"), (F.col(f"s{s}") / s).alias("sma_short"), (F.col(f"s{l}") / l).alias("sma_long"))) for s, l in pairs]
    long = rows.select("symbol", "row_id", "date", F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("x")).select("symbol", "row_id", "date", "x.*")
    w = Window.partitionBy("short", "long", "symbol").orderBy("row_id")
    return long.withColumn("next_cross", F.lead("row_id").over(w))


def lifecycles(configs: DataFrame, crossed: DataFrame, panel: DataFrame, membership: DataFrame, dividends: DataFrame, calendar: DataFrame, start: str | None = None) -> DataFrame:
    """Each eligible entry signal of each configuration with its fill, its exit and its rank among the day's signals.

    ``membership(universe, symbol, date)``. Runs begin at row ``long + 1`` or at ``start``, whichever is later; the last
    row decides nothing.
    """
    last = calendar.agg(F.max("row_id").alias("last"), F.min(F.when(F.col("date") >= F.lit(start or "0001-01-01").cast("date"), F.col("row_id"))).alias("from"))
    bulls = crossed.filter("bull").join(F.broadcast(configs), ["short", "long"]).join(F.broadcast(last))
    bulls = bulls.filter("row_id >= greatest(from, long + 1) AND row_id < last")
    at = panel.select("symbol", "row_id", "close", "median_turnover", "closes")
    eligible = bulls.join(membership, ["universe", "symbol", "date"], "left_semi").join(at, ["symbol", "row_id"])
    eligible = eligible.filter("close >= min_price AND median_turnover >= min_turnover")
    by_mode = (
        F.when(F.col("tiebreak") == "turnover", -F.col("median_turnover"))
        .when(F.col("tiebreak") == "spread", -F.coalesce(F.abs(F.try_divide("sma_short", "sma_long") - 1), F.lit(0.0)))
        .otherwise(F.lit(0.0))
    )
    day = Window.partitionBy("config_id", "row_id")
    ranked = eligible.withColumn("key", by_mode).withColumn("up", F.row_number().over(day.orderBy("key", "symbol"))).withColumn("down", F.row_number().over(day.orderBy(F.desc("symbol"))))
    ranked = ranked.withColumn("place", F.when(F.col("tiebreak") == "reverse", F.col("down")).otherwise(F.col("up"))).drop("up", "down", "key")

    fill = panel.select("symbol", F.col("row_id").alias("fill_row"), F.col("date").alias("entry_date"), F.col("open").alias("fill_open"), "trades", "buy_band")
    filled = ranked.withColumn("fill_row", F.col("row_id") + 1).join(fill, ["symbol", "fill_row"], "left")
    usual = F.coalesce("trades", F.lit(False))
    filled = filled.withColumns({
        "buy_blocked": ~F.col("same_bar") & usual & F.col("buy_band"),
        "buy_ok": F.when(F.col("same_bar"), F.col("closes")).otherwise(usual & ~F.coalesce("buy_band", F.lit(False))),
        "entry_price": slipped(F.when(F.col("same_bar"), F.col("close")).otherwise(F.col("fill_open")), "BUY", F.col("slippage_bps")),
    })
    id_ = ["config_id", "symbol", "row_id"]
    # Rules other than the crossover: the first row from the fill on, before the last, at which one holds. Rows beyond a
    # bear crossover that ends the life anyway, or max_days rows on (a row is a day at least), cannot be that row.
    ruled = filled.filter("max_days IS NOT NULL OR stop_loss IS NOT NULL").select(*id_, "fill_row", "entry_date", "entry_price", "max_days", "stop_loss", "last", F.when(F.col("on_bear"), F.col("next_cross")).alias("crossed"), F.col("symbol").alias("s"))
    upto = F.least(F.col("last") - 1, "crossed", F.col("fill_row") + F.col("max_days"))
    ruled = ruled.withColumn("upto", upto).join(panel.select(F.col("symbol").alias("s2"), F.col("row_id").alias("r"), F.col("date").alias("d"), F.col("close").alias("c")), (F.col("s") == F.col("s2")) & (F.col("r") >= F.col("fill_row")) & (F.col("r") <= F.col("upto")))
    too_long = F.coalesce(F.datediff("d", "entry_date") >= F.col("max_days"), F.lit(False))
    stopped = F.coalesce(F.col("c") <= F.col("entry_price") * (1 - F.col("stop_loss")), F.lit(False))
    ruled = ruled.filter(too_long | stopped).groupBy(*id_).agg(F.min(F.struct(F.col("r"), F.when(too_long, "max_holding").otherwise("stop_loss").alias("why"))).alias("rule"))
    known = filled.join(ruled, id_, "left")
    bear = F.when(F.col("on_bear") & (F.col("next_cross") < F.col("last")), F.struct(F.col("next_cross").alias("r"), F.lit("bear_cross").alias("why")))
    # "bear_cross" sorts before the other reasons, which is their order of precedence.
    known = known.withColumn("exit", F.least(bear, F.col("rule"))).withColumns({"exit_signal": F.col("exit.r"), "exit_reason": F.col("exit.why")})
    out = panel.select("symbol", F.col("row_id").alias("exit_signal"), F.col("close").alias("x_close"), F.col("closes").alias("x_closes"), "next_sell", "blocked_upto", "blocked_all")
    known = known.join(out, ["symbol", "exit_signal"], "left").join(F.broadcast(calendar.select((F.col("row_id") - 1).alias("exit_signal"), F.col("date").alias("x_next"))), "exit_signal", "left")
    known = known.withColumns({
        "exit_fill": F.when(F.col("same_bar"), F.when(F.col("x_closes"), F.col("exit_signal") + 1)).otherwise(F.col("next_sell.row_id")),
        "exit_date": F.when(F.col("same_bar"), F.when(F.col("x_closes"), F.col("x_next"))).otherwise(F.col("next_sell.date")),
        "exit_price": slipped(F.when(F.col("same_bar"), F.when(F.col("x_closes"), F.col("x_close"))).otherwise(F.col("next_sell.open")), "SELL", F.col("slippage_bps")),
    })
    past = panel.select("symbol", F.col("row_id").alias("exit_fill"), F.col("blocked_upto").alias("blocked_at_fill"))
    known = known.join(past, ["symbol", "exit_fill"], "left")
    known = known.withColumns({
        "sells_refused": F.when(F.col("exit_signal").isNull(), 0).otherwise(F.coalesce(F.col("exit_fill") - F.col("exit_signal") - 1, F.col("last") - F.col("exit_signal"))),
        "sells_blocked": F.when(F.col("exit_signal").isNull() | F.col("same_bar"), 0).otherwise(F.coalesce("blocked_at_fill", "blocked_all") - F.col("blocked_upto")),
    })
    kept = known.select("config_id", "settings", "symbol", "row_id", "date", "close", "place", "fill_row", "entry_date", "entry_price", "buy_ok", "buy_blocked", "exit_signal", "exit_reason", "exit_fill", "exit_date", "exit_price", "sells_refused", "sells_blocked", "last")
    return dividends_over(kept, dividends)
