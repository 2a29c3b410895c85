"""Charges as Column expressions, and the parsing of a broker's quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causalbars.config import Costs


def _charge(turnover: Column, delivery: Column, costs: Costs, stt: tuple[float, float], stamp: tuple[float, float], flat: Column | float) -> Column:
    brokerage = F.when(delivery, F.lit(costs.brokerage_delivery)).otherwise(F.least(turnover * costs.brokerage_intraday, F.lit(costs.brokerage_intraday_cap)))
    levies = turnover * costs.exchange + turnover * costs.sebi
    taxes = F.when(delivery, turnover * stt[0] + turnover * stamp[0]).otherwise(turnover * stt[1] + turnover * stamp[1])
    return brokerage + levies + taxes + (brokerage + levies) * costs.gst + flat


def buy_cost(turnover: Column, costs: Costs = Costs(), product: Column | str = "CNC") -> Column:
    delivery = (F.lit(product) if isinstance(product, str) else product) == "CNC"
    return _charge(turnover, delivery, costs, (costs.stt_delivery_buy, costs.stt_intraday_buy), (costs.stamp_delivery, costs.stamp_intraday), F.lit(0.0))


def sell_cost(turnover: Column, costs: Costs = Costs(), product: Column | str = "CNC", include_dp: bool = True) -> Column:
    """With the depository's flat charge per symbol and sell day, which a single order's quote does not hold."""
    delivery = (F.lit(product) if isinstance(product, str) else product) == "CNC"
    flat = F.when(delivery, F.lit(costs.dp_per_sell if include_dp else 0.0)).otherwise(0.0)
    return _charge(turnover, delivery, costs, (costs.stt_delivery_sell, costs.stt_intraday_sell), (0.0, 0.0), flat)


def order_cost(turnover: Column, side: Column, costs: Costs = Costs(), product: Column | str = "CNC") -> Column:
    return F.when(side == "BUY", buy_cost(turnover, costs, product)).otherwise(sell_cost(turnover, costs, product, include_dp=False))


def slipped(price: Column, side: Column | str, bps: Column | float) -> Column:
    """Against the trader: up when buying, down when selling."""
    side = F.lit(side) if isinstance(side, str) else side
    k = (F.lit(bps) if isinstance(bps, (int, float)) else bps) / 10_000.0
    return F.when(side == "BUY", price * (1 + k)).otherwise(price * (1 - k))


def plain_costs(costs: Costs):
    """(buy, sell) charges of a delivery as functions of a number, for the admission fold."""
    share = costs.exchange + costs.sebi
    buy = lambda x: costs.brokerage_delivery + x * share + x * costs.stt_delivery_buy + x * costs.stamp_delivery + (costs.brokerage_delivery + x * share) * costs.gst
    sell = lambda x: costs.brokerage_delivery + x * share + x * costs.stt_delivery_sell + (costs.brokerage_delivery + x * share) * costs.gst + costs.dp_per_sell
    return buy, sell


_PART = "transaction_tax:string,exchange_turnover_charge:string,sebi_turnover_charge:string,brokerage:string,stamp_duty:string,total:string,gst:struct<total:string,cgst:string,sgst:string,igst:string>"
QUOTE_SCHEMA = f"struct<total_price:string,turnover:string,charges:struct<{_PART}>>"


def parse_quotes(orders: DataFrame, response: str = "response") -> DataFrame:
    """Broker responses (JSON texts in column ``response``) next to their orders: turnover, each charge, total, bps.

    Missing and non-numeric amounts are 0. Turnover is the first that is not 0 of ``total_price``, ``turnover`` and
    quantity x price; the goods tax is its total, else the sum of its parts.
    """
    number = lambda path: F.coalesce(F.expr(f"try_cast({path} AS double)"), F.lit(0.0))
    q = orders.withColumn("q", F.from_json(F.col(response), QUOTE_SCHEMA))
    given = F.coalesce(F.nullif(number("q.total_price"), F.lit(0.0)), F.nullif(number("q.turnover"), F.lit(0.0)), F.col("quantity") * F.col("average_price"))
    gst = F.coalesce(F.nullif(number("q.charges.gst.total"), F.lit(0.0)), number("q.charges.gst.cgst") + number("q.charges.gst.sgst") + number("q.charges.gst.igst"))
    out = q.withColumns({
        "turnover": given.cast("double"),
        "brokerage": number("q.charges.brokerage"),
        "stt": number("q.charges.transaction_tax"),
        "exchange_charge": number("q.charges.exchange_turnover_charge"),
        "sebi_charge": number("q.charges.sebi_turnover_charge"),
        "stamp": number("q.charges.stamp_duty"),
        "gst": gst,
        "total": number("q.charges.total"),
    }).drop("q")
    return out.withColumn("bps", F.coalesce(F.try_divide(F.col("total") * 10_000, F.col("turnover")), F.lit(0.0)))


def disagreements(quotes: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """Quotes beside the model: model cost and the difference in basis points of turnover."""
    model = order_cost(F.col("turnover"), F.col("transaction_type"), costs, F.col("product"))
    return quotes.withColumn("model", model).withColumn("diff_bps", F.coalesce(F.abs(F.try_divide((F.col("model") - F.col("total")) * 10_000, F.col("turnover"))), F.lit(0.0)))


def gate(compared: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """One row: n, beyond (quotes that differ by more than ``tolerance`` basis points), worst_bps and the exit code: 0 all
    within, 1 some beyond, 3 nothing to compare."""
    beyond = F.count_if(F.col("diff_bps") > tolerance)
    return compared.agg(F.count("*").alias("n"), beyond.alias("beyond"), F.max("diff_bps").alias("worst_bps"), F.when(F.count("*") == 0, 3).when(beyond > 0, 1).otherwise(0).alias("code"))
