"""From a scan to a sized order sheet: conflicts, exits, slots, fresh entries. Nothing is ever sent."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The fields of a broker's order call.
ORDER_FIELDS = ("tradingsymbol", "exchange", "transaction_type", "quantity", "product", "order_type")


def resolve_conflicts(scan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scan rows of each symbol's freshest signal, symbols that had both signals). At equal age BEARISH comes first."""
    first = scan.groupBy("symbol").agg(F.min(F.struct("bars_since", "signal")).alias("f"), F.count_distinct("signal").alias("c"))
    kept = scan.join(first.select("symbol", F.col("f.signal").alias("_signal")), "symbol").filter("signal = _signal").drop("_signal")
    return kept, first.filter("c > 1").select("symbol")


def order_sheet(scan: DataFrame, holdings: DataFrame, capital: float = 1_000_000.0, max_positions: int = 10, max_bars_since: int = 0, exchange: str = "NSE") -> DataFrame:
    """Orders: exits of held symbols with a bearish signal, then fresh entries in scan order while slots are free.

    ``holdings(symbol, qty)``: rows of no quantity take a slot too. A symbol with a bearish signal leaves the book
    whether held or not. An entry that the slot's budget cannot buy one share of still uses its slot.
    """
    scan, _ = resolve_conflicts(scan)
    bear = scan.filter("signal = 'BEARISH'")
    exits = bear.join(holdings.filter("qty > 0"), "symbol").select("symbol", "crossover_date", "bars_since", "close", F.lit("SELL").alias("side"), F.col("qty").cast("long").alias("quantity"))
    after = holdings.select("symbol").distinct().join(bear.select("symbol"), "symbol", "left_anti")
    free = after.agg((F.lit(max_positions) - F.count("*")).alias("free"))
    fresh = scan.filter((F.col("signal") == "BULLISH") & (F.col("bars_since") <= max_bars_since)).join(after, "symbol", "left_anti")
    place = F.row_number().over(Window.orderBy("bars_since", "symbol"))
    entries = fresh.withColumn("_place", place).join(F.broadcast(free)).filter("_place <= free")
    entries = entries.withColumn("quantity", F.floor(F.lit(capital / max_positions) / F.col("close"))).filter("quantity > 0")
    both = exits.unionByName(entries.select("symbol", "crossover_date", "bars_since", "close", F.lit("BUY").alias("side"), F.col("quantity").cast("long").alias("quantity")))
    cross = F.when(F.col("side") == "SELL", "bearish").otherwise("bullish")
    return both.select(
        F.col("symbol").alias("tradingsymbol"),
        F.lit(exchange).alias("exchange"),
        F.col("side").alias("transaction_type"),
        "quantity",
        F.lit("CNC").alias("product"),
        F.lit("MARKET").alias("order_type"),
        F.col("close").alias("est_price"),
        (F.col("close") * F.col("quantity")).alias("est_value"),
        F.concat(cross, F.lit(" cross "), F.col("crossover_date").cast("string"), F.lit(" ("), F.col("bars_since").cast("string"), F.lit(" bars ago)")).alias("rationale"),
    ).orderBy(F.col("transaction_type") == "BUY", "tradingsymbol")


def broker_kwargs(orders: DataFrame) -> DataFrame:
    return orders.select(*ORDER_FIELDS)


def sheet_notes(scan: DataFrame, holdings: DataFrame, max_positions: int = 10, max_bars_since: int = 0, capital: float = 1_000_000.0) -> list[str]:
    """What the sheet leaves out and why, from one-row aggregates."""
    if scan.isEmpty():
        return ["scan produced no signals"]
    notes, (kept, both) = [], resolve_conflicts(scan)
    if n := both.count():
        few = [r.symbol for r in both.orderBy("symbol").limit(5).collect()]
        notes.append(f"{n} symbols had both signals in the window; the more recent one counts ({', '.join(few)})")
    bear = kept.filter("signal = 'BEARISH'")
    sold = bear.join(holdings.filter("qty > 0"), "symbol").count()
    if (n := bear.count() - sold) > 0:
        notes.append(f"{n} bearish signals ignored: not held, and deliveries cannot be sold short")
    left = holdings.select("symbol").distinct().join(bear.select("symbol"), "symbol", "left_anti")
    if (free := max_positions - (held := left.count())) <= 0:
        return [*notes, f"no free slots ({held}/{max_positions} held)"]
    if n := kept.filter((F.col("signal") == "BULLISH") & (F.col("bars_since") > max_bars_since)).count():
        notes.append(f"{n} bullish signals skipped: older than {max_bars_since} bars")
    if max_bars_since > 0:
        notes.append(f"signals of up to {max_bars_since} bars are entered; the simulation enters on the crossover bar alone")
    fresh = kept.filter((F.col("signal") == "BULLISH") & (F.col("bars_since") <= max_bars_since)).join(left, "symbol", "left_anti").orderBy("bars_since", "symbol").limit(free)
    dear = [r.symbol for r in fresh.filter(F.col("close") > capital / max_positions).collect()]
    return notes + [f"{s} skipped: one share costs more than a slot's budget" for s in dear]


def format_sheet(rows: list, notes: list[str]) -> str:
    """Collected orders and notes as text."""
    lines = [f"  {r['transaction_type']:<4} {r['quantity']:>8} {r['tradingsymbol']} @ ~{r['est_price']:,.2f} = {r['est_value']:,.0f}  {r['rationale']}" for r in rows] or ["  (no orders)"]
    return "\n".join(["PROPOSED ORDERS (nothing has been sent)", *lines, *(["notes:"] if notes else []), *(f"  - {n}" for n in notes)])
