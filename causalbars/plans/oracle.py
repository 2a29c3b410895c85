"""Shared pieces of the SQL that must give the same rows as the queries (DuckDB's dialect)."""

from __future__ import annotations

BARS = """bars AS (SELECT symbol, date, first(px ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS open, max(px) AS high, min(px) AS low,
    last(px ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS close, sum(l_quantity) AS volume
  FROM (SELECT *, printf('S%05d', l_suppkey) AS symbol, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, round(l_extendedprice * 100 / l_quantity) AS px FROM lineitem) GROUP BY symbol, date)"""
CAL = "cal AS (SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS INT) AS row_id FROM (SELECT DISTINCT date FROM bars))"
SIG = """sums AS (SELECT *, CASE WHEN count(close) OVER w6 = 6 THEN sum(close) OVER w6 END AS s6, CASE WHEN count(close) OVER w30 = 30 THEN sum(close) OVER w30 END AS s30
  FROM bars WINDOW w6 AS (PARTITION BY symbol ORDER BY date ROWS 5 PRECEDING), w30 AS (PARTITION BY symbol ORDER BY date ROWS 29 PRECEDING)),
abv AS (SELECT *, s6 / 6 AS sma_short, s30 / 30 AS sma_long, s6 * 30 > s30 * 6 AS above FROM sums),
sig AS (SELECT *, coalesce(above AND NOT lag(above) OVER w, false) AS bull_cross, coalesce(NOT above AND lag(above) OVER w, false) AS bear_cross,
    CASE WHEN above THEN 1 WHEN NOT above THEN -1 END AS regime FROM abv WINDOW w AS (PARTITION BY symbol ORDER BY date))"""
DENSE = "dense AS (SELECT s.symbol, c.date, c.row_id, b.open, b.high, b.low, b.close, b.volume FROM (SELECT DISTINCT symbol FROM bars) s CROSS JOIN cal c LEFT JOIN bars b ON b.symbol = s.symbol AND b.date = c.date)"
PANEL = """pan AS (SELECT d.*, g.sma_short, g.sma_long, coalesce(g.bull_cross, false) AS bull_cross, coalesce(g.bear_cross, false) AS bear_cross, coalesce(last_value(g.regime IGNORE NULLS) OVER w, 0) AS regime,
    d.row_id - max(CASE WHEN g.bull_cross OR g.bear_cross THEN d.row_id END) OVER w AS bars_since
  FROM dense d LEFT JOIN sig g ON g.symbol = d.symbol AND g.date = d.date WINDOW w AS (PARTITION BY d.symbol ORDER BY d.date ROWS UNBOUNDED PRECEDING))"""
TURN = """tv AS (SELECT *, CASE WHEN count(close * volume) OVER w >= 30 THEN median(close * volume) OVER w END AS median_turnover, count(close) OVER h AS history
  FROM dense WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 59 PRECEDING), h AS (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING))"""
REBAL = """reb AS (SELECT rebal, row_id, lead(rebal) OVER (ORDER BY rebal) AS next_rebal FROM (SELECT max(date) AS rebal, max(row_id) AS row_id FROM cal GROUP BY date_trunc('month', date)))"""
PIT = """rnk AS (SELECT r.rebal, r.next_rebal, t.symbol, t.median_turnover, row_number() OVER (PARTITION BY r.rebal ORDER BY t.median_turnover DESC, t.symbol) AS place
  FROM tv t JOIN reb r ON t.date = r.rebal WHERE t.median_turnover IS NOT NULL AND t.history >= 60),
chosen AS (SELECT * FROM rnk WHERE place <= 40),
pit AS (SELECT b.symbol, b.date FROM bars b JOIN chosen c ON b.symbol = c.symbol AND b.date > c.rebal AND (c.next_rebal IS NULL OR b.date <= c.next_rebal))"""
LISTED = "listed AS (SELECT printf('S%05d', s_suppkey) AS symbol FROM supplier WHERE s_suppkey % 3 = 0), static AS (SELECT symbol, date FROM bars WHERE symbol IN (SELECT symbol FROM listed))"
SESS = "sess AS (SELECT DISTINCT CAST(date_trunc('week', o_orderdate) AS DATE) AS date FROM orders WHERE o_orderkey % 7 <> 0 AND dayofweek(o_orderdate) <> 3 AND week(o_orderdate) <> 11)"
DIVS = "divs AS (SELECT printf('S%05d', l_suppkey) AS symbol, CAST(l_shipdate AS DATE) AS ex_date, sum(round(l_tax * 100)) AS dps FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2 HAVING sum(round(l_tax * 100)) > 0)"
BENCH = "bench AS (SELECT date, round(sum(c) / count(*)) AS level FROM (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS date, round(o_totalprice * 100) AS c FROM orders) GROUP BY date)"
EVERY = [BARS, CAL, SIG, DENSE, PANEL, TURN, REBAL, PIT, LISTED, SESS, DIVS, BENCH]


def sql(select: str, *more: str) -> str:
    """A statement over the shared tables, of which unused ones cost nothing, and ``more`` of its own."""
    return "WITH " + ",\n".join([*EVERY, *more]) + "\n" + select
