"""Named queries over the driver's tables and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causalbars.config import Settings
from causalbars.functions.costs import buy_cost, disagreements, gate, order_cost, parse_quotes, sell_cost, slipped
from causalbars.operators import indicators, joins, lifecycle, metrics, nulls, orders, portfolio, research, selection_bias, sessions, sweep, universe
from causalbars.operators.panel import own_clock, band_blocked, between, dense, tradeable, union_calendar
from causalbars.plans.oracle import sql
from causalbars.sources import tables
from causalbars.sources.stored import stored

#: Parameters of the catalogue. Unit prices of the driver's tables jump, so bands are wide and the turnover floor is 0.
TOP, HISTORY, CIRCUIT, TOLERANCE = 40, 60, 1.0, 0.002
BASE = Settings().having(circuit_pct=CIRCUIT, min_price=2000.0, min_median_turnover=0.0, initial_capital=1e9)
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        _QUERIES[name] = f
        if oracle:
            _ORACLE[name] = oracle
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)


class Inputs:
    """The tables that most queries start from."""

    def __init__(self, spark: SparkSession, sf_dir: str, bars: DataFrame | None = None, calendar: DataFrame | None = None):
        self.spark, self.dir = spark, sf_dir
        self.bars = tables.weekly_bars(spark, sf_dir) if bars is None else bars
        self.calendar = union_calendar(self.bars) if calendar is None else calendar

    @property
    def dividends(self):
        return tables.weekly_dividends(self.spark, self.dir)

    @property
    def listed(self):
        return tables.load(self.spark, self.dir, "supplier").filter("s_suppkey % 3 = 0").select(F.format_string("S%05d", "s_suppkey").alias("symbol"))

    @property
    def sessions(self):
        o = tables.load(self.spark, self.dir, "orders").filter("o_orderkey % 7 <> 0 AND dayofweek(o_orderdate) <> 4 AND weekofyear(o_orderdate) <> 11")
        return o.select(F.trunc(F.col("o_orderdate").cast("date"), "week").alias("date")).distinct()

    @property
    def pit(self):
        return universe.pit_membership(self.bars, self.calendar, TOP, 60, HISTORY)

    @property
    def static(self):
        return universe.static_membership(self.bars, self.listed)


def r(c, n=6):
    """Rounded, and without negative zeros."""
    return F.round(c, n) + 0.0


# --- bars and calendars


@query("weekly_bars", sql("SELECT * FROM bars"))
def _(spark, d):
    return Inputs(spark, d).bars


@query("union_calendar", sql("SELECT * FROM cal"))
def _(spark, d):
    return Inputs(spark, d).calendar


@query("dense_panel_gaps", sql("SELECT symbol, count(*) AS n_rows, count(*) - count(close) AS n_gaps FROM dense GROUP BY symbol"))
def _(spark, d):
    i = Inputs(spark, d)
    return dense(i.bars, i.calendar).groupBy("symbol").agg(F.count("*").alias("n_rows"), F.count_if(F.col("close").isNull()).alias("n_gaps"))


@query("date_slice", sql("SELECT symbol, date, close FROM bars WHERE date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'"))
def _(spark, d):
    return between(Inputs(spark, d).bars, "1997-01-01", "1998-12-31").select("symbol", "date", "close")


@query("hourly_bars", "SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY event_type, date_trunc('hour', ts)")
def _(spark, d):
    return tables.hourly_bars(tables.load(spark, d, "events")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("tradeable_bars", sql("SELECT symbol, count(*) AS n FROM bars WHERE open > 0 AND volume > 0 GROUP BY symbol"))
def _(spark, d):
    return Inputs(spark, d).bars.filter(tradeable(F.col("open"), F.col("volume"))).groupBy("symbol").agg(F.count("*").alias("n"))


# --- signals


@query("sma_pair", sql("SELECT symbol, date, round(sma_short, 6) AS sma_short, round(sma_long, 6) AS sma_long FROM sig"))
def _(spark, d):
    return indicators.sma(Inputs(spark, d).bars, 6, 30).select("symbol", "date", r("sma_short").alias("sma_short"), r("sma_long").alias("sma_long"))


@query("crossover_events", sql("SELECT symbol, date, bull_cross, bear_cross FROM sig WHERE bull_cross OR bear_cross"))
def _(spark, d):
    return indicators.crossovers(Inputs(spark, d).bars, 6, 30).filter("bull_cross OR bear_cross").select("symbol", "date", "bull_cross", "bear_cross")


@query("regime_panel", sql("SELECT symbol, date, CAST(regime AS INT) AS regime FROM pan"))
def _(spark, d):
    i = Inputs(spark, d)
    return indicators.signal_panel(i.bars, i.calendar, 6, 30).select("symbol", "date", F.col("regime").cast("int").alias("regime"))


@query("bars_since_cross", sql("SELECT symbol, date, CAST(bars_since AS INT) AS bars_since FROM pan"))
def _(spark, d):
    i = Inputs(spark, d)
    return indicators.signal_panel(i.bars, i.calendar, 6, 30).select("symbol", "date", F.col("bars_since").cast("int").alias("bars_since"))


def _scan_sql(where: str, lookback: int) -> list[str]:
    return [f"""ev AS (SELECT g.*, c.row_id FROM sig g JOIN cal c ON c.date = g.date WHERE {where}),
lastx AS (SELECT symbol, max(row_id) AS x FROM ev WHERE bull_cross OR bear_cross GROUP BY symbol),
lastbar AS (SELECT symbol, last(close ORDER BY date) AS close, max(date) AS price_date, last(sma_short ORDER BY date) FILTER (sma_short IS NOT NULL) AS ss, last(sma_long ORDER BY date) FILTER (sma_long IS NOT NULL) AS sl FROM ev GROUP BY symbol),
scan AS (SELECT e.symbol, CASE WHEN e.bull_cross THEN 'BULLISH' ELSE 'BEARISH' END AS signal, e.date AS crossover_date, CAST((SELECT max(row_id) FROM cal c WHERE {where.replace("g.", "c.")}) - e.row_id AS INT) AS bars_since,
    round(b.close, 2) AS close, b.price_date, round(b.ss, 2) AS sma_short, round(b.sl, 2) AS sma_long, round((b.ss / b.sl - 1) * 100, 2) AS spread_pct
  FROM ev e JOIN lastx l ON l.symbol = e.symbol AND l.x = e.row_id JOIN lastbar b ON b.symbol = e.symbol
  WHERE (SELECT max(row_id) FROM cal c WHERE {where.replace("g.", "c.")}) - e.row_id <= {lookback})"""]


@query("scan_asof", sql("SELECT * FROM scan", *_scan_sql("g.date <= DATE '1999-06-30'", 30)))
def _(spark, d):
    i = Inputs(spark, d)
    return indicators.scan_asof(i.bars, i.calendar, 6, 30, "1999-06-30", 30)


@query("scan_freshness_counts", sql("SELECT signal, bars_since, count(*) AS n FROM scan GROUP BY signal, bars_since", *_scan_sql("g.date <= DATE '2100-01-01'", 30)))
def _(spark, d):
    i = Inputs(spark, d)
    return indicators.scan_asof(i.bars, i.calendar, 6, 30).groupBy("signal", "bars_since").agg(F.count("*").alias("n"))


# --- liquidity, previous closes, bands


@query("rolling_median_turnover", sql("SELECT symbol, date, round(median_turnover, 4) AS median_turnover FROM tv WHERE close IS NOT NULL"))
def _(spark, d):
    i = Inputs(spark, d)
    return universe.turnover_history(i.bars, i.calendar).filter("close IS NOT NULL").select("symbol", "date", r("median_turnover", 4).alias("median_turnover"))


@query("history_count", sql("SELECT symbol, date, history FROM tv"))
def _(spark, d):
    i = Inputs(spark, d)
    return universe.turnover_history(i.bars, i.calendar).select("symbol", "date", "history")


@query("prev_close_gap", sql("SELECT symbol, date, lag(close) OVER w AS prev_close, round(open / lag(close) OVER w - 1, 6) AS gap FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)"))
def _(spark, d):
    b = Inputs(spark, d).bars.withColumn("prev_close", F.lag("close").over(own_clock()))
    return b.select("symbol", "date", "prev_close", r(F.col("open") / F.col("prev_close") - 1).alias("gap"))


@query("circuit_blocked", sql("SELECT symbol, count(*) FILTER (open / prev_close - 1 >= 0.5 - 0.002) AS buys_blocked, count(*) FILTER (open / prev_close - 1 <= -(0.5 - 0.002)) AS sells_blocked FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS prev_close FROM bars) GROUP BY symbol"))
def _(spark, d):
    b = Inputs(spark, d).bars.withColumn("prev_close", F.lag("close").over(own_clock()))
    blocked = lambda side: F.count_if(band_blocked(F.col("open"), F.col("prev_close"), side, 0.5, 0.002))
    return b.groupBy("symbol").agg(blocked("BUY").alias("buys_blocked"), blocked("SELL").alias("sells_blocked"))


# --- universes


@query("month_end_rebalance", sql("SELECT rebal, row_id, next_rebal FROM reb"))
def _(spark, d):
    return universe.rebalance_dates(Inputs(spark, d).calendar).select("rebal", "row_id", "next_rebal")


@query("pit_ranking", sql("SELECT rebal, symbol, place, round(median_turnover, 4) AS median_turnover FROM chosen"))
def _(spark, d):
    i = Inputs(spark, d)
    return universe.rankings(i.bars, i.calendar, TOP, 60, HISTORY).select("rebal", "symbol", "place", r("median_turnover", 4).alias("median_turnover"))


@query("pit_topn_membership", sql("SELECT symbol, date FROM pit"))
def _(spark, d):
    return Inputs(spark, d).pit


@query("static_membership", sql("SELECT symbol, date FROM static"))
def _(spark, d):
    return Inputs(spark, d).static


@query("universe_overlap", sql("SELECT round((SELECT count(*) FROM static) / n, 6) AS mean_a, round((SELECT count(*) FROM pit) / n, 6) AS mean_b, round((SELECT count(*) FROM static JOIN pit USING (symbol, date)) / n, 6) AS mean_both FROM (SELECT CAST(count(*) AS DOUBLE) AS n FROM cal)"))
def _(spark, d):
    i = Inputs(spark, d)
    return universe.overlap(i.static, i.pit, i.calendar).select(*(r(c).alias(c) for c in ("mean_a", "mean_b", "mean_both")))


@query("effective_membership", sql("SELECT b.symbol, count(*) AS n FROM bars b JOIN (SELECT printf('S%05d', s_suppkey) AS symbol, DATE '1997-01-01' + CAST(s_suppkey % 50 AS INT) * 7 AS f, CASE WHEN s_suppkey % 2 = 0 THEN DATE '1999-01-04' END AS t FROM supplier) s ON b.symbol = s.symbol AND b.date >= s.f AND (s.t IS NULL OR b.date < s.t) GROUP BY b.symbol"))
def _(spark, d):
    s = tables.load(spark, d, "supplier").select(F.format_string("S%05d", "s_suppkey").alias("symbol"), F.expr("date_add(DATE'1997-01-01', cast(s_suppkey % 50 AS int) * 7)").alias("valid_from"), F.expr("CASE WHEN s_suppkey % 2 = 0 THEN DATE'1999-01-04' END").alias("valid_to"))
    return joins.effective_members(Inputs(spark, d).bars, s).groupBy("symbol").agg(F.count("*").alias("n"))


@query("residual_bias", sql("""SELECT count(*) AS requested, count(f) AS with_data, coalesce(string_agg(symbol, ',' ORDER BY symbol) FILTER (f IS NULL), '') AS no_data,
    coalesce(string_agg(symbol, ',' ORDER BY symbol) FILTER (e - l > 30), '') AS stopped, coalesce(string_agg(symbol, ',' ORDER BY symbol) FILTER (f - s > 10), '') AS listed_late
  FROM (SELECT a.symbol, b.f, b.l, (SELECT min(date) FROM bars) AS s, (SELECT max(date) FROM bars) AS e FROM (SELECT printf('S%05d', s_suppkey + 5) AS symbol FROM supplier) a LEFT JOIN (SELECT symbol, min(date) AS f, max(date) AS l FROM bars GROUP BY symbol) b ON a.symbol = b.symbol)"""))
def _(spark, d):
    asked = tables.load(spark, d, "supplier").select(F.format_string("S%05d", F.col("s_suppkey") + 5).alias("symbol"))
    out = universe.residual_bias(Inputs(spark, d).bars, asked)
    return out.select("requested", "with_data", *(F.array_join(c, ",").alias(c) for c in ("no_data", "stopped", "listed_late")))


# --- sessions


@query("calendar_phantom", sql("SELECT date FROM cal WHERE date NOT IN (SELECT date FROM sess)"))
def _(spark, d):
    i = Inputs(spark, d)
    return sessions.phantom(i.calendar, i.sessions)


@query("calendar_missing", sql("SELECT date FROM sess WHERE date BETWEEN (SELECT min(date) FROM cal) AND (SELECT max(date) FROM cal) AND date NOT IN (SELECT date FROM cal WHERE row_id % 9 <> 0)"))
def _(spark, d):
    i = Inputs(spark, d)
    span = i.calendar.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    thin = i.calendar.filter("row_id % 9 <> 0").select("date")
    return i.sessions.join(F.broadcast(span)).filter("date BETWEEN lo AND hi").select("date").join(thin, "date", "left_anti")


@query("session_gaps", sql("SELECT symbol, n_missing FROM (SELECT symbol, count(*) - count(close) AS n_missing FROM dense WHERE date IN (SELECT date FROM sess) GROUP BY symbol) WHERE n_missing >= 10"))
def _(spark, d):
    i = Inputs(spark, d)
    return sessions.gaps(i.bars, i.calendar, i.sessions)


@query("previous_session", sql("SELECT date, (SELECT max(s.date) FROM sess s WHERE s.date < cal.date AND s.date >= cal.date - 20) AS previous_session FROM cal"))
def _(spark, d):
    i = Inputs(spark, d)
    return sessions.previous_session(i.sessions, i.calendar.select("date"))


@query("is_session", sql("SELECT date, date IN (SELECT date FROM sess) AS is_session FROM cal"))
def _(spark, d):
    i = Inputs(spark, d)
    return sessions.is_session(i.sessions, i.calendar.select("date"))


# --- costs, quotes, orders

_SHARE = "t * 0.0000307 + t * 0.000001"


@query("cost_buy_sell", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, round({_SHARE} + t * 0.001 + t * 0.00015 + ({_SHARE}) * 0.18, 4) AS buy, round({_SHARE} + t * 0.001 + ({_SHARE}) * 0.18 + 15.34, 4) AS sell, round(l_extendedprice / l_quantity * 1.0025, 7) AS buy_price FROM (SELECT *, l_extendedprice AS t FROM lineitem)")
def _(spark, d):
    t = F.col("l_extendedprice")
    return tables.load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", r(buy_cost(t), 4).alias("buy"), r(sell_cost(t), 4).alias("sell"), r(slipped(t / F.col("l_quantity"), "BUY", 25.0), 7).alias("buy_price"))


@query("cost_mis", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, round(b + {_SHARE} + t * 0.00003 + (b + {_SHARE}) * 0.18, 4) AS buy, round(b + {_SHARE} + t * 0.00025 + (b + {_SHARE}) * 0.18, 4) AS sell FROM (SELECT *, l_extendedprice AS t, least(l_extendedprice * 0.0003, 20.0) AS b FROM lineitem)")
def _(spark, d):
    t = F.col("l_extendedprice")
    return tables.load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", r(buy_cost(t, product="MIS"), 4).alias("buy"), r(sell_cost(t, product="MIS"), 4).alias("sell"))


@query("quote_vs_model", f"""SELECT order_id, round(turnover, 4) AS turnover, round(gst, 6) AS gst, round(total, 6) AS total, round(total / turnover * 10000, 6) AS bps, round(abs(model - total) / turnover * 10000, 4) AS diff_bps FROM
  (SELECT o_orderkey AS order_id, o_totalprice AS turnover, round(o_totalprice * 0.000006, 4) + round(o_totalprice * 0.000002, 4) AS gst, round(o_totalprice * 0.0012, 4) AS total,
    CASE WHEN o_orderkey % 2 = 0 THEN {_SHARE} + t * 0.001 + t * 0.00015 + ({_SHARE}) * 0.18 ELSE {_SHARE} + t * 0.001 + ({_SHARE}) * 0.18 END AS model FROM (SELECT *, o_totalprice AS t FROM orders))""")
def _(spark, d):
    o = tables.load(spark, d, "orders")
    body = F.to_json(F.struct(F.lit("oops").alias("total_price"), F.col("o_totalprice").cast("string").alias("turnover"), F.struct(F.round(F.col("o_totalprice") * 0.0012, 4).alias("total"), F.struct(F.round(F.col("o_totalprice") * 0.000006, 4).alias("cgst"), F.round(F.col("o_totalprice") * 0.000002, 4).alias("sgst")).alias("gst")).alias("charges")))
    asked = o.select(F.col("o_orderkey").alias("order_id"), F.when(F.col("o_orderkey") % 2 == 0, "BUY").otherwise("SELL").alias("transaction_type"), F.lit("CNC").alias("product"), F.lit(1).alias("quantity"), F.col("o_totalprice").alias("average_price"), body.alias("response"))
    out = disagreements(parse_quotes(asked))
    return out.select("order_id", r("turnover", 4).alias("turnover"), r("gst").alias("gst"), r("total").alias("total"), r("bps").alias("bps"), r("diff_bps", 4).alias("diff_bps"))


@query("charge_grid", f"""SELECT symbol, side, quantity, round(CASE WHEN side = 'BUY' THEN {_SHARE} + t * 0.001 + t * 0.00015 + ({_SHARE}) * 0.18 ELSE {_SHARE} + t * 0.001 + ({_SHARE}) * 0.18 END, 6) AS model
  FROM (SELECT printf('P%06d', p_partkey) AS symbol, side, (p_size + 1) AS quantity, p_retailprice * (p_size + 1) AS t FROM part CROSS JOIN (VALUES ('BUY'), ('SELL')) v(side))""")
def _(spark, d):
    p = tables.load(spark, d, "part").select(F.format_string("P%06d", "p_partkey").alias("symbol"), (F.col("p_size") + 1).alias("quantity"), "p_retailprice")
    both = p.withColumn("side", F.explode(F.array(F.lit("BUY"), F.lit("SELL"))))
    return both.select("symbol", "side", "quantity", r(order_cost(F.col("p_retailprice") * F.col("quantity"), F.col("side"))).alias("model"))


_BOTH = """twosided AS (SELECT symbol, signal, crossover_date, bars_since, close FROM scan
  UNION ALL SELECT symbol, CASE WHEN signal = 'BULLISH' THEN 'BEARISH' ELSE 'BULLISH' END, crossover_date, bars_since + 1, close FROM scan WHERE CAST(substr(symbol, 2) AS INT) % 4 = 0),
fresh AS (SELECT t.* FROM twosided t JOIN (SELECT symbol, min(bars_since) AS b FROM twosided GROUP BY symbol) m ON t.symbol = m.symbol AND t.bars_since = m.b)"""


def _twosided(spark, d):
    i = Inputs(spark, d)
    scan = indicators.scan_asof(i.bars, i.calendar, 6, 30).select("symbol", "signal", "crossover_date", "bars_since", "close")
    more = scan.filter("cast(substr(symbol, 2) AS int) % 4 = 0").selectExpr("symbol", "CASE WHEN signal = 'BULLISH' THEN 'BEARISH' ELSE 'BULLISH' END AS signal", "crossover_date", "bars_since + 1 AS bars_since", "close")
    held = tables.load(spark, d, "supplier").filter("s_suppkey % 5 = 0").select(F.format_string("S%05d", "s_suppkey").alias("symbol"), (F.col("s_suppkey") % 3 * 10).alias("qty"))
    return scan.unionByName(more), held


@query("signal_conflicts", sql("SELECT symbol FROM twosided GROUP BY symbol HAVING count(DISTINCT signal) > 1", *_scan_sql("g.date <= DATE '2100-01-01'", 30), _BOTH))
def _(spark, d):
    return orders.resolve_conflicts(_twosided(spark, d)[0])[1]


@query("order_sheet", sql("""SELECT symbol AS tradingsymbol, 'SELL' AS transaction_type, CAST(qty AS BIGINT) AS quantity, close AS est_price, close * qty AS est_value FROM fresh JOIN hold USING (symbol) WHERE signal = 'BEARISH' AND qty > 0
  UNION ALL SELECT symbol, 'BUY', CAST(floor(1e7 / 60 / close) AS BIGINT), close, close * floor(1e7 / 60 / close) FROM (SELECT *, row_number() OVER (ORDER BY bars_since, symbol) AS place FROM fresh WHERE signal = 'BULLISH' AND bars_since <= 8 AND symbol NOT IN (SELECT symbol FROM kept))
    WHERE place <= 60 - (SELECT count(*) FROM kept) AND floor(1e7 / 60 / close) > 0""", *_scan_sql("g.date <= DATE '2100-01-01'", 30), _BOTH, "hold AS (SELECT printf('S%05d', s_suppkey) AS symbol, s_suppkey % 3 * 10 AS qty FROM supplier WHERE s_suppkey % 5 = 0), kept AS (SELECT symbol FROM hold WHERE symbol NOT IN (SELECT symbol FROM fresh WHERE signal = 'BEARISH'))"))
def _(spark, d):
    scan, held = _twosided(spark, d)
    return orders.order_sheet(scan, held, 1e7, 60, 8).select("tradingsymbol", "transaction_type", "quantity", "est_price", "est_value")


@query("merge_cache_upsert", sql("SELECT symbol, date, close FROM bars WHERE date < DATE '1998-01-05' AND NOT (date >= DATE '1997-06-02' AND CAST(substr(symbol, 2) AS INT) % 2 = 0) UNION ALL SELECT symbol, date, close + 1 FROM bars WHERE date >= DATE '1997-06-02' AND CAST(substr(symbol, 2) AS INT) % 2 = 0"))
def _(spark, d):
    b = Inputs(spark, d).bars.select("symbol", "date", "close")
    fresh = b.filter("date >= DATE'1997-06-02' AND cast(substr(symbol, 2) AS int) % 2 = 0").withColumn("close", F.col("close") + 1)
    return tables.merge_cache(b.filter("date < DATE'1998-01-05'"), fresh)


@query("cache_hits", sql("SELECT symbol, min(date) <= DATE '1996-01-20' + 10 AND max(date) >= DATE '2002-10-20' - 7 AS hit FROM bars GROUP BY symbol"))
def _(spark, d):
    return tables.cache_hits(Inputs(spark, d).bars, "1996-01-20", "2002-10-20").select("symbol", "hit")


# --- life cycles and the portfolio

LIFE = """mkt AS (SELECT d.*, t.median_turnover, p.prev_close, coalesce(d.open > 0 AND d.volume > 0, false) AS trades,
    coalesce(d.open / p.prev_close - 1 >= 0.998, false) AS buy_band, coalesce(d.open / p.prev_close - 1 <= -0.998, false) AS sell_band
  FROM dense d JOIN tv t ON t.symbol = d.symbol AND t.row_id = d.row_id LEFT JOIN (SELECT symbol, date, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS prev_close FROM bars) p ON p.symbol = d.symbol AND p.date = d.date),
xs AS (SELECT symbol, row_id, date, bull_cross, lead(row_id) OVER (PARTITION BY symbol ORDER BY row_id) AS next_cross FROM (SELECT g.symbol, c.row_id, g.date, g.bull_cross FROM sig g JOIN cal c ON c.date = g.date WHERE g.bull_cross OR g.bear_cross)),
ends AS (SELECT max(row_id) AS last_row FROM cal),
lf0 AS (SELECT x.symbol, x.row_id, x.date, m.close, m.median_turnover, f.row_id AS fill_row, f.date AS entry_date, f.trades AND NOT f.buy_band AS buy_ok, f.open * 1.0025 AS entry_price, CASE WHEN x.next_cross < ends.last_row THEN x.next_cross END AS exit_signal
  FROM xs x CROSS JOIN ends JOIN mkt m ON m.symbol = x.symbol AND m.row_id = x.row_id JOIN mkt f ON f.symbol = x.symbol AND f.row_id = x.row_id + 1
  WHERE x.bull_cross AND x.row_id >= 31 AND x.row_id < ends.last_row AND m.close >= 2000 AND m.median_turnover >= 0 AND (x.symbol, x.date) IN (SELECT (symbol, date) FROM pit)),
ok AS (SELECT symbol, row_id, date, open FROM mkt WHERE trades AND NOT sell_band),
lf1 AS (SELECT l.*, (SELECT min(o.row_id) FROM ok o WHERE o.symbol = l.symbol AND o.row_id > l.exit_signal) AS exit_fill FROM lf0 l),
life AS (SELECT l.*, o.date AS exit_date, o.open * 0.9975 AS exit_price, coalesce((SELECT sum(dps) FROM divs v WHERE v.symbol = l.symbol AND v.ex_date > l.entry_date AND v.ex_date <= o.date), 0) AS dps_held,
    CASE WHEN l.exit_signal IS NULL THEN 0 ELSE coalesce(l.exit_fill - l.exit_signal - 1, (SELECT last_row FROM ends) - l.exit_signal) END AS sells_refused
  FROM lf1 l LEFT JOIN ok o ON o.symbol = l.symbol AND o.row_id = l.exit_fill),
trd AS (SELECT *, (exit_price - entry_price) / entry_price AS gross_ret, date_diff('day', entry_date, exit_date) AS holding_days FROM life WHERE buy_ok AND exit_fill IS NOT NULL)"""


def _world(spark, d, runs: dict[str, Settings], universes: dict[str, str] | None = None):
    """(configs, panel, life cycles, calendar) of the runs; every universe that they name."""
    i = Inputs(spark, d)
    configs = lifecycle.configurations(spark, runs, universes or dict.fromkeys(runs, "pit"))
    panel = lifecycle.market(i.bars, i.calendar, CIRCUIT, TOLERANCE)
    members = i.pit.withColumn("universe", F.lit("pit")).unionByName(i.static.withColumn("universe", F.lit("static")))
    crossed = lifecycle.crosses(i.bars, i.calendar, sorted({(s.short, s.long) for s in runs.values()}))
    return configs, panel, lifecycle.lifecycles(configs, crossed, panel, members, i.dividends, i.calendar), i.calendar


@query("trade_lifecycle", sql("SELECT symbol, row_id, fill_row, buy_ok, round(entry_price, 4) AS entry_price, exit_signal, exit_fill, exit_date, round(exit_price, 4) AS exit_price, dps_held, CAST(sells_refused AS INT) AS sells_refused FROM life", LIFE))
def _(spark, d):
    lives = _world(spark, d, {"base": BASE})[2]
    return lives.select("symbol", "row_id", "fill_row", "buy_ok", r("entry_price", 4).alias("entry_price"), "exit_signal", "exit_fill", "exit_date", r("exit_price", 4).alias("exit_price"), "dps_held", F.col("sells_refused").cast("int").alias("sells_refused"))


@query("dividends_over_holding", sql("SELECT symbol, entry_date, exit_date, dps_held FROM trd", LIFE))
def _(spark, d):
    return _world(spark, d, {"base": BASE})[2].filter("buy_ok AND exit_fill IS NOT NULL").select("symbol", "entry_date", "exit_date", "dps_held")


@query("exit_reason_mix", sql("""SELECT reason AS exit_reason, count(*) AS n FROM (SELECT CASE WHEN x IS NULL AND y IS NULL THEN NULL WHEN y IS NULL OR x <= y THEN 'bear_cross' ELSE 'max_holding' END AS reason FROM
    (SELECT exit_signal AS x, (SELECT min(c.row_id) FROM cal c WHERE c.row_id >= l.fill_row AND c.row_id < (SELECT last_row FROM ends) AND date_diff('day', l.entry_date, c.date) >= 60) AS y FROM life l)) GROUP BY reason""", LIFE))
def _(spark, d):
    return _world(spark, d, {"held": BASE.having(max_holding_days=60)})[2].groupBy("exit_reason").agg(F.count("*").alias("n"))


def _unconstrained(spark, d):
    t = _world(spark, d, {"base": BASE})[2].filter("buy_ok AND exit_fill IS NOT NULL")
    return t.select("config_id", "symbol", F.col("fill_row").alias("entry_row"), F.col("exit_fill").alias("exit_row"), "entry_price", "exit_price", F.datediff("exit_date", "entry_date").alias("holding_days"), ((F.col("exit_price") / F.col("entry_price") - 1) * 100).alias("net_return_pct"), (F.col("exit_price") - F.col("entry_price")).alias("net_pnl"), F.lit(0.0).alias("charges"), F.col("dps_held").alias("dividends"))


@query("unconstrained_trade_stats", sql("""SELECT count(*) AS n_trades, round(avg(CASE WHEN p > 0 THEN 1.0 ELSE 0 END), 6) AS win_rate, round(avg(q), 4) AS mean_trade_pct, round(median(q), 4) AS median_trade_pct, round(coalesce(avg(q) FILTER (p > 0), 0), 4) AS avg_win_pct, round(coalesce(avg(q) FILTER (p <= 0), 0), 4) AS avg_loss_pct,
    round(sum(p) FILTER (p > 0) / -sum(p) FILTER (p <= 0), 6) AS profit_factor, round(avg(holding_days), 4) AS mean_holding_days, CAST(median(holding_days) AS DOUBLE) AS median_holding_days, sum(dps_held) AS dividends FROM (SELECT *, exit_price - entry_price AS p, (exit_price / entry_price - 1) * 100 AS q FROM trd)""", LIFE))
def _(spark, d):
    s = metrics.trade_stats(_unconstrained(spark, d))
    return s.select("n_trades", r("win_rate").alias("win_rate"), *(r(c, 4).alias(c) for c in ("mean_trade_pct", "median_trade_pct", "avg_win_pct", "avg_loss_pct")), r("profit_factor").alias("profit_factor"), r("mean_holding_days", 4).alias("mean_holding_days"), F.col("median_holding_days").cast("double").alias("median_holding_days"), "dividends")


def _simulated(spark, d, runs, universes=None):
    configs, panel, lives, calendar = _world(spark, d, runs, universes)
    placed = portfolio.simulate(lives, panel)
    return configs, panel, placed, calendar


def _simulated_once(spark, d, runs, universes=None):
    """As ``_simulated``, but bars, panel, life cycles and orders are written once, each by a job of its own whose shuffle
    files go with it: else every use of the panel computes it again, and all their shuffles stay until the end."""
    bars = stored(tables.weekly_bars(spark, d, by_symbol=True), "bars")
    calendar = stored(union_calendar(bars), "calendar")
    panel = stored(lifecycle.market(bars, calendar, CIRCUIT, TOLERANCE), "panel")
    configs = lifecycle.configurations(spark, runs, universes or dict.fromkeys(runs, "pit"))
    i = Inputs(spark, d, bars, calendar)
    pit = universe.pit_membership(bars, calendar, TOP, 60, HISTORY, history=panel.select("symbol", "date", "median_turnover", "history"))
    members = stored(pit.withColumn("universe", F.lit("pit")).unionByName(i.static.withColumn("universe", F.lit("static"))), "members")
    crossed = stored(lifecycle.crosses(bars, calendar, sorted({(s.short, s.long) for s in runs.values()})), "crosses")
    lives = stored(lifecycle.lifecycles(configs, crossed, panel, members, i.dividends, calendar), "lives")
    return configs, panel, stored(portfolio.simulate(lives, panel), "orders"), calendar


@query("portfolio_trades")
def _(spark, d):
    return portfolio.closed_trades(_simulated(spark, d, {"base": BASE})[2])


@query("portfolio_equity")
def _(spark, d):
    configs, panel, placed, calendar = _simulated(spark, d, {"base": BASE})
    return portfolio.equity_curve(placed, panel, configs, calendar)


def _summary(spark, d, runs, universes=None):
    configs, panel, placed, calendar = _simulated_once(spark, d, runs, universes)
    curves = stored(portfolio.equity_curve(placed, panel, configs, calendar), "curves")
    perf = metrics.performance(curves, slots=BASE.portfolio.max_positions)
    return perf.join(metrics.trade_stats(portfolio.closed_trades(placed)), "config_id", "left").join(portfolio.refusals(placed), "config_id", "left")


@query("ladder_summary")
def _(spark, d):
    return _summary(spark, d, *sweep.ladder(BASE))


@query("tiebreak_band")
def _(spark, d):
    return _summary(spark, d, sweep.tiebreaks(BASE)).agg(F.min("cagr").alias("low"), F.max("cagr").alias("high"))


@query("slippage_band")
def _(spark, d):
    return _summary(spark, d, sweep.slippages(BASE)).select("config_id", "cagr", "sharpe_rf", "max_drawdown")


@query("param_grid")
def _(spark, d):
    return _summary(spark, d, sweep.grid(BASE)).select("config_id", "cagr", "sharpe_rf", "sharpe_raw", "max_drawdown", "n_trades")


# --- nulls and their statistics

_COST = "((1e5 * 0.0000307 + 1e5 * 0.000001 + 1e5 * 0.001 + 1e5 * 0.00015 + (1e5 * 0.0000307 + 1e5 * 0.000001) * 0.18 + 1e5 * 0.0000307 + 1e5 * 0.000001 + 1e5 * 0.001 + (1e5 * 0.0000307 + 1e5 * 0.000001) * 0.18 + 15.34) / 1e5 * 10000 + 50) / 2 / 10000"
EW = f"""wd AS (SELECT symbol, CAST(date_trunc('week', ex_date) AS DATE) AS date, sum(dps) AS dps FROM divs GROUP BY 1, 2),
rr AS (SELECT d.symbol, d.row_id, d.close / lag(d.close) OVER w - 1 + coalesce(wd.dps / lag(d.close) OVER w, 0) AS r FROM dense d LEFT JOIN wd ON wd.symbol = d.symbol AND wd.date = d.date WINDOW w AS (PARTITION BY d.symbol ORDER BY d.row_id)),
mk AS (SELECT row_id AS mark, row_number() OVER (ORDER BY row_id) AS k FROM reb),
wt AS (SELECT p.symbol, mk.mark, mk.k, 1.0 / count(*) OVER (PARTITION BY mk.mark) AS w FROM (SELECT DISTINCT symbol, date FROM pit) p JOIN cal c ON c.date = p.date JOIN mk ON mk.mark = c.row_id),
fc AS (SELECT c.row_id, (SELECT max(mark) FROM mk WHERE mark < c.row_id) AS m FROM cal c),
er AS (SELECT rr.row_id, sum(wt.w * rr.r) AS ret FROM rr JOIN fc ON fc.row_id = rr.row_id JOIN wt ON wt.symbol = rr.symbol AND wt.mark = fc.m GROUP BY rr.row_id),
td AS (SELECT k, sum(abs(d)) AS turnover FROM (SELECT k, symbol, sum(w) AS d FROM (SELECT k, symbol, w FROM wt UNION ALL SELECT k + 1, symbol, -w FROM wt) GROUP BY k, symbol) GROUP BY k),
tu AS (SELECT mk.mark AS row_id, td.turnover FROM td JOIN mk ON mk.k = td.k WHERE mk.mark > 0),
ew AS (SELECT c.date, c.row_id, coalesce(er.ret, 0) AS ret, coalesce(tu.turnover, 0) AS turnover, coalesce(er.ret, 0) - coalesce(tu.turnover, 0) * ({_COST}) AS net_ret FROM cal c LEFT JOIN er ON er.row_id = c.row_id LEFT JOIN tu ON tu.row_id = c.row_id),
eq AS (SELECT *, product(1 + net_ret) OVER (ORDER BY row_id ROWS UNBOUNDED PRECEDING) * 1e6 AS equity FROM ew),
dd AS (SELECT *, equity / lag(equity) OVER (ORDER BY row_id) - 1 AS rt, equity / max(equity) OVER (ORDER BY row_id ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM eq)"""


def _equal_weight(spark, d):
    i = Inputs(spark, d)
    weekly = i.dividends.withColumn("ex_date", F.trunc("ex_date", "week"))
    return nulls.equal_weight(i.bars, i.calendar, i.pit, weekly).withColumn("config_id", F.lit("equal weight")), i


@query("equal_weight_null", sql("SELECT date, round(ret, 8) AS ret, round(turnover, 8) AS turnover, round(ln(equity / 1e6), 6) AS log_growth FROM eq", EW))
def _(spark, d):
    return _equal_weight(spark, d)[0].select("date", r("ret", 8).alias("ret"), r("turnover", 8).alias("turnover"), r(F.log(F.col("equity") / 1e6)).alias("log_growth"))


@query("returns", sql("SELECT date, round(rt, 8) AS ret FROM dd", EW))
def _(spark, d):
    return indicators.returns(_equal_weight(spark, d)[0].drop("ret"), "config_id", "date", "equity").select("date", r("ret", 8).alias("ret"))


@query("drawdown", sql("SELECT date, round(drawdown, 8) AS drawdown FROM dd", EW))
def _(spark, d):
    return metrics.drawdowns(_equal_weight(spark, d)[0].drop("ret")).select("date", r("drawdown", 8).alias("drawdown"))


@query("longest_drawdown", sql("SELECT coalesce(max(n), 0) AS longest_drawdown FROM (SELECT count(*) FILTER (drawdown < -1e-9) AS n FROM (SELECT *, sum(CASE WHEN drawdown < -1e-9 THEN 0 ELSE 1 END) OVER (ORDER BY row_id) AS g FROM dd) GROUP BY g)", EW))
def _(spark, d):
    return metrics.longest_drawdown(_equal_weight(spark, d)[0].drop("ret")).select("longest_drawdown")


@query("perf_summary", sql("""SELECT count(*) AS n_rows, round(ln(last(equity ORDER BY date) / first(equity ORDER BY date)) / (date_diff('day', min(date), max(date)) / 365.25), 6) AS log_cagr, round(stddev_samp(rt) * sqrt(252), 6) AS volatility,
    round(avg(rt - 0.065 / 252) / stddev_samp(rt) * sqrt(252), 6) AS sharpe_rf, round(avg(rt) / stddev_samp(rt) * sqrt(252), 6) AS sharpe_raw, round(avg(rt - 0.065 / 252) / stddev_samp(CASE WHEN rt < 0 THEN rt END) * sqrt(252), 6) AS sortino, round(min(drawdown), 6) AS max_drawdown FROM dd""", EW))
def _(spark, d):
    p = metrics.performance(_equal_weight(spark, d)[0].drop("ret"))
    return p.select("n_rows", r(F.log1p("cagr")).alias("log_cagr"), *(r(c).alias(c) for c in ("volatility", "sharpe_rf", "sharpe_raw", "sortino", "max_drawdown")))


@query("benchmark_asof", sql("SELECT cal.date, round(b.net, 4) AS level FROM cal ASOF LEFT JOIN (SELECT date, level * pow(0.9975, (row_number() OVER (ORDER BY date) - 1) / 252) AS net FROM bench WHERE level % 3 <> 0) b ON cal.date >= b.date"))
def _(spark, d):
    i = Inputs(spark, d)
    # The fee accrues over the rows that are there: every third level or so is missing.
    levels = metrics.benchmark_levels(tables.order_benchmark(spark, d).filter("level % 3 <> 0")).select("date", F.col("net_level"))
    found = joins.asof(i.calendar.select("date"), levels, "date", ["net_level"])
    return found.select("date", r("net_level", 4).alias("level"))


@query("benchmark_rebased", sql("SELECT date, round(level / first_value(level) OVER (ORDER BY date) * 1e6, 4) AS rebased FROM bench"))
def _(spark, d):
    return metrics.rebased(tables.order_benchmark(spark, d).withColumn("one", F.lit(1)), "level", 1e6, "one").select("date", r("rebased", 4).alias("rebased"))


@query("benchmark_alpha", sql("SELECT round(ln(1 + x), 6) AS log_cagr, round(y, 6) AS benchmark_cagr, x > y AS ahead FROM (SELECT pow(last(e ORDER BY date) / first(e ORDER BY date), 1 / t) - 1 AS x, pow(last(b ORDER BY date) / first(b ORDER BY date), 1 / t) - 1 AS y FROM (SELECT j.*, date_diff('day', min(date) OVER (), max(date) OVER ()) / 365.25 AS t FROM (SELECT eq.date, eq.equity AS e, b.net AS b FROM eq ASOF JOIN (SELECT date, level * pow(0.9975, (row_number() OVER (ORDER BY date) - 1) / 252) AS net FROM bench) b ON eq.date >= b.date) j) GROUP BY t)", EW))
def _(spark, d):
    out = metrics.against_benchmark(_equal_weight(spark, d)[0], metrics.benchmark_levels(tables.order_benchmark(spark, d)))
    return out.select(r(F.log1p("cagr")).alias("log_cagr"), r("benchmark_cagr").alias("benchmark_cagr"), (F.col("alpha_points") > 0).alias("ahead"))


@query("horizon_cagr", sql("SELECT years, round(pow((SELECT last(level ORDER BY date) FROM bench) / last(level ORDER BY date), 1.0 / years) - 1, 6) AS cagr FROM bench, (VALUES (2), (4)) v(years) WHERE date <= (SELECT max(date) FROM bench) - to_years(years) GROUP BY years"))
def _(spark, d):
    return metrics.horizon_cagr(tables.order_benchmark(spark, d), (2, 4)).select("years", r("cagr").alias("cagr"))


def _pick_sql(draw: str, j: str, purpose: int) -> str:
    x = f"(({draw} * 7919 + {j} * 104729 + {purpose} * 1299709 + 12345) % 2147483647)"
    x = f"(({x} * 48271 + {draw}) % 2147483647)"
    x = f"(({x} * 69621 + {j}) % 2147483647)"
    return f"(({x} * 16807 + {purpose}) % 2147483647)"


DRAWS = 1000
_PAID = """pd AS (SELECT g.draw, g.p0 * 1.0025 AS buy, b.open * 0.9975 AS sell FROM ch g LEFT JOIN (SELECT b.symbol, b.open, c.row_id FROM bars b JOIN cal c ON c.date = b.date) b ON b.symbol = g.symbol AND b.row_id = g.end_row),
nt AS (SELECT draw, coalesce(((sell - buy) * q - (t * 0.0000317 + t * 0.00115 + t * 0.0000317 * 0.18) - (u * 0.0000317 + u * 0.001 + u * 0.0000317 * 0.18 + 15.34)) / 1e5, 0) AS x FROM (SELECT *, 1e5 / buy AS q, 1e5 / buy * buy AS t, 1e5 / buy * sell AS u FROM pd))"""
_POOL = f"""el AS (SELECT b.symbol, c.row_id, b.open, row_number() OVER (PARTITION BY c.row_id ORDER BY b.symbol) - 1 AS pos, count(*) OVER (PARTITION BY c.row_id) AS n_pos FROM bars b JOIN cal c ON c.date = b.date WHERE (b.symbol, b.date) IN (SELECT (symbol, date) FROM pit) AND b.open IS NOT NULL),
us AS (SELECT row_id, n_pos, row_number() OVER (ORDER BY row_id) - 1 AS at FROM (SELECT DISTINCT row_id, n_pos FROM el)),
sc AS (SELECT fill_row, greatest(1, exit_fill - fill_row) AS hold, row_number() OVER (ORDER BY fill_row, greatest(1, exit_fill - fill_row)) - 1 AS j FROM trd),
ec AS (SELECT sc.*, CAST(g.draw AS BIGINT) AS draw FROM sc, range(1, {DRAWS + 1}) g(draw)),
hd AS (SELECT draw, hold, row_number() OVER (PARTITION BY draw ORDER BY {_pick_sql('draw', 'j', 1)}, j) - 1 AS slot FROM ec)"""
_CHOSEN = f"ch AS (SELECT s.draw, e.symbol, e.open AS p0, least(s.row_id + hd.hold, (SELECT last_row FROM ends)) AS end_row FROM st s JOIN hd ON hd.draw = s.draw AND hd.slot = s.slot JOIN el e ON e.row_id = s.row_id AND e.pos = {_pick_sql('s.draw', 's.j', 3)} % s.n_pos)"


@query("random_timing_null", sql("SELECT CAST(draw AS INT) AS draw, round(avg(x), 8) AS mean_ret, count(*) AS n FROM nt GROUP BY draw", LIFE, _POOL, f"st AS (SELECT ec.draw, ec.j, ec.j AS slot, us.row_id, us.n_pos FROM ec JOIN us ON us.at = {_pick_sql('ec.draw', 'ec.j', 2)} % (SELECT count(*) FROM us))", _CHOSEN, _PAID))
def _(spark, d):
    i = Inputs(spark, d)
    out = nulls.random_timing(_unconstrained(spark, d), i.bars, i.calendar, i.pit, DRAWS)
    return out.select("draw", r("mean_ret", 8).alias("mean_ret"), "n")


@query("date_matched_null", sql("SELECT CAST(draw AS INT) AS draw, round(avg(x), 8) AS mean_ret, count(*) AS n FROM nt GROUP BY draw", LIFE, _POOL, f"ow AS (SELECT sc.j, us.row_id, us.n_pos, row_number() OVER (ORDER BY sc.j) - 1 AS slot FROM sc JOIN us ON us.row_id = sc.fill_row), st AS (SELECT ow.*, CAST(g.draw AS BIGINT) AS draw FROM ow, range(1, {DRAWS + 1}) g(draw))", _CHOSEN, _PAID))
def _(spark, d):
    i = Inputs(spark, d)
    out = nulls.random_timing(_unconstrained(spark, d), i.bars, i.calendar, i.pit, DRAWS, matched=True)
    return out.select("draw", r("mean_ret", 8).alias("mean_ret"), "n")


@query("null_percentile", sql("SELECT round(avg(m) * 100, 6) AS null_mean_pct, round(quantile_cont(m, 0.05) * 100, 6) AS p05_pct, round(quantile_cont(m, 0.95) * 100, 6) AS p95_pct, round(avg(CASE WHEN m < 0.05 THEN 1.0 ELSE 0 END) * 100, 4) AS percentile FROM (SELECT avg(x) AS m FROM nt GROUP BY draw)", LIFE, _POOL, f"st AS (SELECT ec.draw, ec.j, ec.j AS slot, us.row_id, us.n_pos FROM ec JOIN us ON us.at = {_pick_sql('ec.draw', 'ec.j', 2)} % (SELECT count(*) FROM us))", _CHOSEN, _PAID))
def _(spark, d):
    i = Inputs(spark, d)
    out = nulls.placed(nulls.random_timing(_unconstrained(spark, d), i.bars, i.calendar, i.pit, DRAWS), 0.05)
    return out.select(r("null_mean_pct").alias("null_mean_pct"), r("p05_pct").alias("p05_pct"), r("p95_pct").alias("p95_pct"), r("percentile", 4).alias("percentile"))


# --- walk-forward and selection bias, on long-or-flat returns of single symbols as configurations

FLAT = """fl AS (SELECT symbol AS config_id, date, CASE WHEN lag(regime) OVER w = 1 THEN coalesce(close / lag(close) OVER w - 1, 0) ELSE 0 END AS ret FROM pan WINDOW w AS (PARTITION BY symbol ORDER BY date)),
po AS (SELECT config_id, row_number() OVER (ORDER BY config_id) - 1 AS pos FROM (SELECT DISTINCT config_id FROM fl)),
yr AS (SELECT config_id, CAST(year(date) AS INT) AS y, count(*) AS n, sum(ret) AS s, sum(ret * ret) AS q, product(1 + ret) - 1 AS grown FROM fl GROUP BY 1, 2),
tn AS (SELECT t.test_year, yr.config_id, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM yr JOIN (SELECT DISTINCT y AS test_year FROM yr WHERE y >= (SELECT min(y) FROM yr) + 3) t ON yr.y BETWEEN t.test_year - 3 AND t.test_year - 1 GROUP BY 1, 2 HAVING sum(n) >= 100),
bs AS (SELECT * FROM (SELECT tn.*, sh, row_number() OVER (PARTITION BY test_year ORDER BY round(sh, 9) DESC, pos) AS rk FROM (SELECT *, coalesce(s / n / nullif(sqrt(greatest((q - s * s / n) / (n - 1), 0)), 0), 0) * sqrt(252) AS sh FROM tn) tn JOIN po USING (config_id)) WHERE rk = 1),
pk AS (SELECT bs.test_year, bs.config_id, bs.sh AS train_sharpe, yr.grown AS test_return FROM bs JOIN yr ON yr.config_id = bs.config_id AND yr.y = bs.test_year)"""


def _flat(spark, d):
    i = Inputs(spark, d)
    p = indicators.signal_panel(i.bars, i.calendar, 6, 30)
    ret = F.when(F.lag("regime").over(own_clock()) == 1, F.coalesce(F.col("close") / F.lag("close").over(own_clock()) - 1, F.lit(0.0))).otherwise(0.0)
    flat = p.select(F.col("symbol").alias("config_id"), "date", ret.alias("ret"))
    order = flat.select("config_id").distinct().withColumn("pos", F.row_number().over(Window.orderBy("config_id")) - 1)
    return flat, order


def on_flat(name: str, select: str, *more: str):
    """Registers ``name`` on the flat returns of every symbol."""

    def add(f):
        query(name, sql(select, FLAT, *more))(lambda spark, d: f(spark, d, *_flat(spark, d)))
        return f

    return add


@on_flat("walk_forward_picks", "SELECT test_year, config_id, round(train_sharpe, 6) AS train_sharpe, round(test_return, 6) AS test_return FROM pk")
def _(spark, d, flat, order):
    return sweep.walk_forward(flat, order, least_rows=100).select("test_year", "config_id", r("train_sharpe").alias("train_sharpe"), r("test_return").alias("test_return"))


@on_flat("oos_curve", "SELECT fl.date, fl.config_id, round(product(1 + ret) OVER (ORDER BY fl.date ROWS UNBOUNDED PRECEDING), 6) AS growth FROM fl JOIN pk ON pk.config_id = fl.config_id AND pk.test_year = year(fl.date)")
def _(spark, d, flat, order):
    return sweep.out_of_sample(flat, sweep.walk_forward(flat, order, least_rows=100)).select("date", "config_id", r(F.col("equity") / 1e6).alias("growth"))


_RANKED = "rg AS (SELECT config_id, coalesce(avg(ret - 0.065 / 252) / nullif(stddev_samp(ret), 0), 0) * sqrt(252) AS sharpe_rf, coalesce(avg(ret) / nullif(stddev_samp(ret), 0), 0) * sqrt(252) AS sharpe_raw, product(1 + ret) - 1 AS grown FROM fl GROUP BY config_id)"


@on_flat("grid_sharpe_rank", "SELECT config_id, round(sharpe_rf, 6) AS sharpe_rf, round(sharpe_raw, 6) AS sharpe_raw, row_number() OVER (ORDER BY round(sharpe_rf, 9) DESC, config_id) AS rank_rf, row_number() OVER (ORDER BY round(sharpe_raw, 9) DESC, config_id) AS rank_raw FROM rg", _RANKED)
def _(spark, d, flat, order):
    return sweep.ranked_grid(flat, order).select("config_id", r("sharpe_rf").alias("sharpe_rf"), r("sharpe_raw").alias("sharpe_raw"), "rank_rf", "rank_raw")


@on_flat("hindsight_gap", "SELECT round((SELECT grown FROM rg JOIN po USING (config_id) ORDER BY round(sharpe_raw, 9) DESC, pos LIMIT 1), 6) AS hindsight, round((SELECT product(1 + ret) - 1 FROM fl JOIN pk ON pk.config_id = fl.config_id AND pk.test_year = year(fl.date)), 6) AS walk_forward", _RANKED)
def _(spark, d, flat, order):
    best = sweep.ranked_grid(flat, order).filter("rank_raw = 1").select(r("grown").alias("hindsight"))
    oos = sweep.out_of_sample(flat, sweep.walk_forward(flat, order, least_rows=100)).agg(r(F.product(1 + F.col("ret")) - 1).alias("walk_forward"))
    return best.join(oos)


#: All halves of twelve blocks over every symbol; a block's sums are added up, as its rows would be read 924 times.
_SPLIT_SQL = """bk AS (SELECT date, CASE WHEN i < (n % 12) * (n // 12 + 1) THEN i // (n // 12 + 1) ELSE n % 12 + (i - (n % 12) * (n // 12 + 1)) // (n // 12) END AS block FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM fl))),
ct AS (SELECT *, ret - avg(ret) OVER (PARTITION BY config_id) AS x, avg(ret) OVER (PARTITION BY config_id) AS m FROM fl),
bsum AS (SELECT block, config_id, any_value(m) AS m, count(*) AS n, sum(x) AS s, sum(x * x) AS q FROM ct JOIN bk USING (date) GROUP BY 1, 2),
hv AS (SELECT m AS split FROM range(4096) t(m) WHERE bit_count(m::INT) = 6),
sd AS (SELECT split, b AS block, (split >> b) & 1 = 1 AS train FROM hv, range(12) t(b)),
sm AS (SELECT split, train, config_id, round(coalesce((s / n + m) / nullif(sqrt(greatest((q - s * s / n) / (n - 1), 0)), 0), 0) * sqrt(252), 9) AS sharpe FROM (SELECT split, train, config_id, any_value(m) AS m, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM bsum JOIN sd USING (block) GROUP BY 1, 2, 3)),
wn AS (SELECT split, config_id AS winner FROM (SELECT sm.*, row_number() OVER (PARTITION BY split ORDER BY sharpe DESC, config_id) AS k FROM sm WHERE train) WHERE k = 1),
rk AS (SELECT s.split, avg(CASE WHEN s.sharpe < t.sharpe THEN 1.0 ELSE 0 END) AS oos_rank FROM sm s JOIN wn ON wn.split = s.split JOIN sm t ON t.split = s.split AND t.config_id = wn.winner AND NOT t.train WHERE NOT s.train GROUP BY s.split)"""


@query("pbo_cscv", sql("SELECT round(avg(CASE WHEN oos_rank < 0.5 THEN 1.0 ELSE 0 END), 6) AS pbo, count(*) AS n_splits FROM rk", FLAT, _SPLIT_SQL))
def _(spark, d):
    found = selection_bias.cscv(spark, *_flat(spark, d), blocks=12, halves=selection_bias.splits(12, None))
    return selection_bias.pbo(found).select(r("pbo").alias("pbo"), "n_splits")


@query("selection_bias_report")
def _(spark, d):
    return selection_bias.report(spark, *_flat(spark, d))


@query("spa_test")
def _(spark, d):
    flat, _ = _flat(spark, d)
    levels = tables.order_benchmark(spark, d).withColumn("one", F.lit(1))
    return selection_bias.spa(spark, flat, indicators.returns(levels, "one", "date", "level"), reps=1000)


@query("cagr_trades_corr", sql("SELECT round(corr(g, ln(n)), 6) AS corr FROM (SELECT symbol, count(*) AS n, avg(gross_ret) AS g FROM trd GROUP BY symbol)", LIFE))
def _(spark, d):
    per = _unconstrained(spark, d).groupBy("symbol").agg(F.count("*").alias("n"), F.avg("net_return_pct").alias("g"))
    return per.agg(r(F.corr("g", F.log("n"))).alias("corr"))


_MONTHS = tuple(range(1, 13))


@query("heat_map", sql("SELECT config_id, CAST(year(date) AS INT) AS y, " + ", ".join(f"round(product(1 + ret) FILTER (month(date) = {m}) - 1, 6) AS m{m}" for m in _MONTHS) + " FROM fl GROUP BY 1, 2", FLAT))
def _(spark, d):
    own = _flat(spark, d)[0].select("config_id", F.year("date").alias("y"), F.concat(F.lit("m"), F.month("date").cast("string")).alias("m"), "ret")
    return own.groupBy("config_id", "y").pivot("m", [f"m{m}" for m in _MONTHS]).agg(r(F.product(1 + F.col("ret")) - 1))


@query("grid_heat_map")
def _(spark, d):
    return sweep.heat_map(_summary(spark, d, sweep.grid(BASE)))


@query("downsampled_curve", sql("SELECT date, level FROM (SELECT *, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM bench) WHERE i IN (SELECT CAST(floor(k * ((SELECT count(*) FROM bench) - 1) / 49) AS BIGINT) FROM range(50) t(k))"))
def _(spark, d):
    rows = tables.order_benchmark(spark, d).withColumn("i", F.row_number().over(Window.orderBy("date")) - 1)
    n = rows.agg(F.count("*").alias("n"))
    at = spark.range(50).join(F.broadcast(n)).select(F.expr("cast(floor(id * (n - 1) / 49) AS int)").alias("i")).distinct()
    return rows.join(F.broadcast(at), "i", "left_semi").select("date", "level")


# --- second-tier research statistics


@query("suspicious_mask", sql("SELECT symbol, date, max(far) OVER (PARTITION BY symbol ORDER BY date ROWS 30 PRECEDING) AS masked FROM (SELECT *, coalesce(abs(close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1) > 0.3, false) AS far FROM bars)"))
def _(spark, d):
    return research.suspicious(Inputs(spark, d).bars).select("symbol", "date", "masked")


#: Flat positions: a symbol is held on the rows after a bullish regime.
_HELD = "hd AS (SELECT symbol AS config_id, date, CASE WHEN lag(regime) OVER w = 1 THEN 1.0 ELSE 0.0 END AS weight, CASE WHEN lag(regime) OVER w = 1 THEN coalesce(close / lag(close) OVER w - 1, 0) ELSE 0 END AS ret FROM pan WINDOW w AS (PARTITION BY symbol ORDER BY date))"


@query("annual_turnover", sql("SELECT config_id, CAST(year(date) AS INT) AS y, sum(change) AS turnover, round(product(1 + ret) - 1, 6) AS gross, round(product(1 + ret - change * 0.0025) - 1, 6) AS net FROM (SELECT *, abs(weight - coalesce(lag(weight) OVER (PARTITION BY config_id ORDER BY date), 0)) AS change FROM hd) GROUP BY 1, 2", _HELD))
def _(spark, d):
    i = Inputs(spark, d)
    p = indicators.signal_panel(i.bars, i.calendar, 6, 30)
    held = F.coalesce(F.lag("regime").over(own_clock()) == 1, F.lit(False))
    ret = F.when(held, F.coalesce(F.col("close") / F.lag("close").over(own_clock()) - 1, F.lit(0.0))).otherwise(0.0)
    weights = p.select(F.col("symbol").alias("config_id"), "date", held.cast("double").alias("weight"), ret.alias("ret"))
    return research.turnover(weights).select("config_id", "y", "turnover", r("gross").alias("gross"), r("net").alias("net"))


_TESTED = """ts AS (SELECT config_id, round(coalesce(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(count(*)), 0), 9) AS t FROM fl GROUP BY config_id),
pv AS (SELECT config_id, t, abs(t) / sqrt(2.0::DOUBLE) AS x, 1 / (1 + 0.3275911::DOUBLE * abs(t) / sqrt(2.0::DOUBLE)) AS k FROM ts),
pp AS (SELECT config_id, t, round((((((1.061405429::DOUBLE * k - 1.453152027::DOUBLE) * k) + 1.421413741::DOUBLE) * k - 0.284496736::DOUBLE) * k + 0.254829592::DOUBLE) * k * exp(-x * x), 9) AS p FROM pv),
pl AS (SELECT *, row_number() OVER (ORDER BY p, config_id) AS place, count(*) OVER () AS n FROM pp)"""


@query("false_discoveries", sql("SELECT config_id, round(t, 6) AS t, round(p, 6) AS p, CAST(place AS INT) AS place, round(least(1.0::DOUBLE, min(p * n / place) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q FROM pl", FLAT, _TESTED))
def _(spark, d):
    flat, _ = _flat(spark, d)
    t = F.round(F.coalesce(F.avg("ret") / F.nullif(F.stddev_samp("ret"), F.lit(0.0)) * F.sqrt(F.count("*")), F.lit(0.0)), 9)
    tests = flat.groupBy("config_id").agg(t.alias("t")).withColumn("p", F.round(research.two_sided(F.col("t")), 9))
    return research.discoveries(tests).select("config_id", r("t").alias("t"), r("p").alias("p"), "place", r("q").alias("q"))


_REGRESSED = """br AS (SELECT date, level / lag(level) OVER (ORDER BY date) - 1 AS bench FROM bench),
kn AS (SELECT config_id, fl.date, ret, bench FROM fl JOIN br USING (date) WHERE bench IS NOT NULL),
ft AS (SELECT config_id, count(*) AS n, regr_slope(ret, bench) AS beta, regr_intercept(ret, bench) AS alpha, avg(bench) AS m, regr_sxx(ret, bench) AS sxx FROM kn GROUP BY 1),
gg AS (SELECT config_id, date, n, alpha, beta, (1.0::DOUBLE / n - m * (bench - m) / sxx) * (ret - alpha - beta * bench) AS g FROM kn JOIN ft USING (config_id)),
vv AS (SELECT config_id, n, alpha, beta, g * (g + """ + " + ".join(f"{2 * (1 - k / 6)!r}::DOUBLE * coalesce(lag(g, {k}) OVER w, 0)" for k in range(1, 6)) + """) AS v FROM gg WINDOW w AS (PARTITION BY config_id ORDER BY date))"""


@query("alpha_beta", sql("SELECT config_id, n, round(alpha, 8) AS alpha, round(beta, 6) AS beta, round(alpha / nullif(sqrt(nullif(greatest(sum(v), 0), 0)), 0), 4) AS t_alpha FROM vv GROUP BY config_id, n, alpha, beta", FLAT, _REGRESSED))
def _(spark, d):
    flat, _ = _flat(spark, d)
    levels = indicators.returns(tables.order_benchmark(spark, d).withColumn("one", F.lit(1)), "one", "date", "level").select("date", F.col("ret").alias("bench"))
    found = research.alpha_beta(flat.join(F.broadcast(levels), "date"))
    return found.select("config_id", "n", r("alpha", 8).alias("alpha"), r("beta").alias("beta"), r("t_alpha", 4).alias("t_alpha"))


@query("rolling_growth", sql("SELECT count(*) AS n, round(avg(CASE WHEN g < 0 THEN 1.0 ELSE 0 END), 6) AS lost, " + ", ".join(f"round(quantile_cont(g, {p}), 6) AS p{round(100 * p):02d}" for p in (0.05, 0.25, 0.5, 0.75, 0.95)) + " FROM (SELECT level / lag(level, 52) OVER (ORDER BY date) - 1 AS g FROM bench) WHERE g IS NOT NULL"))
def _(spark, d):
    out = research.rolling_growth(tables.order_benchmark(spark, d), 52)
    return out.select("n", *(r(c).alias(c) for c in out.columns[1:]))


@query("charge_gate", """SELECT count(*) AS n, count(*) FILTER (diff > 0.5) AS beyond, round(max(diff), 4) AS worst_bps, CAST(CASE WHEN count(*) = 0 THEN 3 WHEN count(*) FILTER (diff > 0.5) > 0 THEN 1 ELSE 0 END AS INT) AS code FROM
  (SELECT abs(model - total) / turnover * 10000 AS diff FROM (SELECT o_totalprice AS turnover, round(o_totalprice * 0.0012, 4) AS total,
    CASE WHEN o_orderkey % 2 = 0 THEN {share} + t * 0.001 + t * 0.00015 + ({share}) * 0.18 ELSE {share} + t * 0.001 + ({share}) * 0.18 END AS model FROM (SELECT *, o_totalprice AS t FROM orders)))""".replace("{share}", _SHARE))
def _(spark, d):
    o = tables.load(spark, d, "orders")
    body = F.to_json(F.struct(F.col("o_totalprice").cast("string").alias("turnover"), F.struct(F.round(F.col("o_totalprice") * 0.0012, 4).alias("total")).alias("charges")))
    asked = o.select(F.when(F.col("o_orderkey") % 2 == 0, "BUY").otherwise("SELL").alias("transaction_type"), F.lit("CNC").alias("product"), F.lit(1).alias("quantity"), F.col("o_totalprice").alias("average_price"), body.alias("response"))
    return gate(disagreements(parse_quotes(asked))).select("n", "beyond", r("worst_bps", 4).alias("worst_bps"), "code")
