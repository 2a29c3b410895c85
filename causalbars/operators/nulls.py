"""What a timing rule has to beat: the same universe without timing, and its own schedule at random entries.

Random picks are integer arithmetic of (draw, trade, purpose), so any engine can repeat them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causalbars.config import Costs
from causalbars.functions.costs import buy_cost, plain_costs, sell_cost

#: A Mersenne prime and the multipliers of three rounds.
PRIME, ROUNDS = 2147483647, (48271, 69621, 16807)


def pick(draw: Column, j: Column, purpose: int) -> Column:
    """A repeatable number from 0 to PRIME - 1."""
    draw, j = draw.cast("long"), j.cast("long")
    x = (draw * 7919 + j * 104729 + purpose * 1299709 + 12345) % PRIME
    x = (x * ROUNDS[0] + draw) % PRIME
    x = (x * ROUNDS[1] + j) % PRIME
    return (x * ROUNDS[2] + purpose) % PRIME


def equal_weight(bars: DataFrame, calendar: DataFrame, membership: DataFrame, dividends: DataFrame, costs: Costs = Costs(), capital: float = 1_000_000.0, slippage_bps: float = 25.0, unit: str = "MM") -> DataFrame:
    """(date, row_id, ret, turnover, net_ret, equity) of the whole universe in equal parts, remarked each period's end.

    Weights stand from one mark to the next and earn from the row after it; dividends count on calendar rows that are
    ex-dates, over the close of the row before. A row without a return of a symbol earns nothing of it.
    """
    rows = bars.join(F.broadcast(calendar), "date")
    own = Window.partitionBy("symbol").orderBy("row_id")
    before = F.lag(F.struct("row_id", "close")).over(own)
    rows = rows.withColumn("b", before).join(dividends.groupBy("symbol", F.col("ex_date").alias("date")).agg(F.sum("dps").alias("dps")), ["symbol", "date"], "left")
    next_to = F.col("b.row_id") == F.col("row_id") - 1
    rows = rows.withColumn("r", F.when(next_to, F.col("close") / F.col("b.close") - 1 + F.coalesce(F.try_divide("dps", "b.close"), F.lit(0.0))))
    marks = calendar.groupBy(F.trunc("date", unit).alias("p")).agg(F.max("row_id").alias("mark")).select("mark")
    marks = marks.withColumn("k", F.row_number().over(Window.orderBy("mark")))
    members = membership.select("symbol", "date").distinct().join(F.broadcast(calendar), "date").join(F.broadcast(marks), F.col("row_id") == F.col("mark")).select("symbol", "mark", "k")
    weights = members.withColumn("w", 1.0 / F.count("*").over(Window.partitionBy("mark")))
    force = calendar.join(marks.select("mark", F.col("mark").alias("row_id")), "row_id", "left").withColumn("in_force", F.last("mark", ignorenulls=True).over(Window.orderBy("row_id").rowsBetween(Window.unboundedPreceding, -1))).select("row_id", "in_force")
    earned = rows.select("symbol", "row_id", "r").join(F.broadcast(force), "row_id").join(weights.select("symbol", F.col("mark").alias("in_force"), "w"), ["symbol", "in_force"]).groupBy("row_id").agg(F.sum(F.col("w") * F.col("r")).alias("ret"))
    # A mark's turnover: what its weights differ from the mark before's.
    signed = weights.select("symbol", "k", "w").unionByName(weights.select("symbol", (F.col("k") + 1).alias("k"), (-F.col("w")).alias("w")))
    turnover = signed.groupBy("k", "symbol").agg(F.abs(F.sum("w")).alias("d")).groupBy("k").agg(F.sum("d").alias("turnover")).join(F.broadcast(marks), "k").filter("mark > 0").select(F.col("mark").alias("row_id"), "turnover")
    buy, sell = plain_costs(costs)
    cost = ((buy(1e5) + sell(1e5)) / 1e5 * 10_000 + 2 * slippage_bps) / 2 / 10_000
    daily = calendar.join(earned, "row_id", "left").join(turnover, "row_id", "left").na.fill(0.0, ["ret", "turnover"])
    daily = daily.withColumn("net_ret", F.col("ret") - F.col("turnover") * cost)
    grown = F.product(1 + F.col("net_ret")).over(Window.orderBy("row_id").rowsBetween(Window.unboundedPreceding, 0))
    return daily.withColumn("equity", grown * capital)


def _net(p0: Column, p1: Column, costs: Costs, slippage_bps: float) -> Column:
    buy, sell = p0 * (1 + slippage_bps / 1e4), p1 * (1 - slippage_bps / 1e4)
    qty = F.lit(1e5) / buy
    net = ((sell - buy) * qty - buy_cost(buy * qty, costs) - sell_cost(sell * qty, costs)) / 1e5
    return F.coalesce(F.when(p0 > 0, net), F.lit(0.0))


def random_timing(trades: DataFrame, bars: DataFrame, calendar: DataFrame, membership: DataFrame, draws: int = 1000, matched: bool = False, costs: Costs = Costs(), slippage_bps: float = 25.0) -> DataFrame:
    """(draw, mean_ret): mean net return of the trades' schedule on random eligible symbols.

    ``trades(entry_row, exit_row)``. Entry rows are drawn from all usable ones or, ``matched``, are the trades' own
    where usable; holding lengths (rows) are permuted within a draw.
    """
    eligible = bars.join(membership.select("symbol", "date").distinct(), ["symbol", "date"], "left_semi").filter("open IS NOT NULL").join(F.broadcast(calendar), "date")
    eligible = eligible.select("symbol", "row_id", "open", (F.row_number().over(Window.partitionBy("row_id").orderBy("symbol")) - 1).alias("pos"), F.count("*").over(Window.partitionBy("row_id")).alias("n_pos"))
    usable = eligible.groupBy("row_id").agg(F.max("n_pos").alias("n_pos"))
    usable = usable.withColumn("at", F.row_number().over(Window.orderBy("row_id")) - 1)
    schedule = trades.select("entry_row", F.greatest(F.lit(1), F.col("exit_row") - F.col("entry_row")).alias("hold")).withColumn("j", F.row_number().over(Window.orderBy("entry_row", "hold")) - 1)
    each = schedule.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    holds = each.select("draw", "hold", (F.row_number().over(Window.partitionBy("draw").orderBy(pick(F.col("draw"), F.col("j"), 1), "j")) - 1).alias("slot"))
    if matched:
        own = schedule.join(F.broadcast(usable), F.col("row_id") == F.col("entry_row")).withColumn("slot", F.row_number().over(Window.orderBy("j")) - 1)
        starts = own.select("slot", "j", "row_id", "n_pos").withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    else:
        n = usable.agg(F.count("*").alias("n_rows"))
        starts = each.join(F.broadcast(n)).withColumn("at", pick(F.col("draw"), F.col("j"), 2) % F.col("n_rows")).join(F.broadcast(usable), "at").select("draw", "j", F.col("j").alias("slot"), "row_id", "n_pos")
    last = calendar.agg(F.max("row_id").alias("last"))
    chosen = starts.join(holds, ["draw", "slot"]).withColumn("pos", (pick(F.col("draw"), F.col("j"), 3) % F.col("n_pos")).cast("int"))
    chosen = chosen.join(eligible.select("row_id", "pos", "symbol", F.col("open").alias("p0")), ["row_id", "pos"]).join(F.broadcast(last)).withColumn("end_row", F.least(F.col("row_id") + F.col("hold"), F.col("last")))
    opens = bars.join(F.broadcast(calendar), "date").select("symbol", F.col("row_id").alias("end_row"), F.col("open").alias("p1"))
    paid = chosen.join(opens, ["symbol", "end_row"], "left").withColumn("r", _net(F.col("p0"), F.col("p1"), costs, slippage_bps))
    return paid.groupBy("draw").agg(F.avg("r").alias("mean_ret"), F.count("*").alias("n"))


def placed(null: DataFrame, actual: float) -> DataFrame:
    """One row: the null's mean and 5th and 95th percentiles, and the share of draws below ``actual``, in percent."""
    return null.agg(
        (F.avg("mean_ret") * 100).alias("null_mean_pct"),
        (F.percentile("mean_ret", 0.05) * 100).alias("p05_pct"),
        (F.percentile("mean_ret", 0.95) * 100).alias("p95_pct"),
        (F.avg((F.col("mean_ret") < actual).cast("int")) * 100).alias("percentile"),
    ).withColumn("beats_null", F.col("percentile") > 95.0)
