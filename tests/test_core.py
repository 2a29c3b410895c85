import datetime as dt
import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F
from world import panel, plain_simulation

from causalbars.config import Costs, Settings
from causalbars.functions.costs import buy_cost, order_cost, parse_quotes, plain_costs, sell_cost
from causalbars.operators import indicators, joins, lifecycle, metrics, nulls, orders, portfolio, selection_bias, sessions, sweep, universe
from causalbars.operators.panel import union_calendar
from causalbars.plans import lint
from causalbars.sources.tables import BARS, merge_cache, parse_benchmark


def frame(spark, rows):
    return spark.createDataFrame(rows, BARS).repartition(3).cache()


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@pytest.fixture(scope="module")
def smooth(spark):
    return frame(spark, panel())


@pytest.fixture(scope="module")
def hostile(spark):
    return frame(spark, panel(12, 420, 11, True))


# --- causality


@pytest.mark.parametrize("rows", [200, 350])
def test_signals_do_not_change_when_the_future_is_cut(hostile, rows):
    cal = union_calendar(hostile)
    day = cal.filter(f"row_id = {rows}").first().date
    full = indicators.signal_panel(hostile, cal, 6, 30).filter(F.col("date") <= F.lit(day))
    cut = hostile.filter(F.col("date") <= F.lit(day))
    assert same(full, indicators.signal_panel(cut, union_calendar(cut), 6, 30))
    assert same(indicators.scan_asof(hostile, cal, 6, 30, str(day)), indicators.scan_asof(cut, union_calendar(cut), 6, 30))


def test_universe_does_not_change_when_the_future_is_cut_or_scrambled(hostile):
    cal = union_calendar(hostile)
    day = cal.filter("row_id = 300").first().date
    past = F.col("date") <= F.lit(day)
    full = universe.pit_membership(hostile, cal, 6, 40, 60).filter(past)
    cut = hostile.filter(past)
    noise = hostile.withColumns({c: F.when(past, F.col(c)).otherwise(F.col(c) * (F.pmod(F.xxhash64("symbol", "date", F.lit(c)), F.lit(211)) / 100.0 + 0.4)) for c in ("open", "close", "volume")})
    assert same(full, universe.pit_membership(cut, union_calendar(cut), 6, 40, 60)) and full.count() > 500
    assert same(full, universe.pit_membership(noise, cal, 6, 40, 60).filter(past))


def test_plans_of_signals_do_not_look_ahead(smooth):
    cal = union_calendar(smooth)
    for df in (indicators.signals(smooth, cal, 6, 30), indicators.signal_panel(smooth, cal, 6, 30), universe.turnover_history(smooth, cal), metrics.drawdowns(smooth.withColumnRenamed("close", "equity"), "symbol")):
        assert lint.looks_ahead(df) == []
    ahead = smooth.withColumn("x", F.lead("close").over(indicators.own_clock())).withColumn("y", F.max("close").over(indicators.own_clock().rowsBetween(0, 3)))
    assert len(lint.looks_ahead(ahead)) == 2


def test_bars_since(spark):
    days = [dt.date(2021, 1, 1) + dt.timedelta(i) for i in range(10)]
    flags = spark.createDataFrame([(d, i in (2, 6)) for i, d in enumerate(days)], "date date, a boolean")
    got = [r.bars_since for r in indicators.bars_since(flags, "date", "a").orderBy("date").collect()]
    assert got == [None, None, 0, 1, 2, 3, 0, 1, 2, 3]


# --- the portfolio against a plain walk over the days

BASE = Settings().having(max_positions=4, min_median_turnover=1e6)
CASES = {
    "base": BASE,
    "same bar": BASE.having(same_bar_fill=True),
    "zero cost": BASE.having(costs=Costs.zero(), slippage_bps=0.0),
    "turnover": BASE.having(tiebreak="turnover", max_positions=2),
    "reverse": BASE.having(tiebreak="reverse", max_positions=2),
    "spread": BASE.having(tiebreak="spread", max_positions=1),
    "short": BASE.having(short=3, long=20, max_positions=2, initial_capital=30_000.0),
    "rules": BASE.having(max_holding_days=20, stop_loss=0.05),
    "rules alone": BASE.having(max_holding_days=15, on_bear_cross=False),
}


@pytest.fixture(scope="module")
def simulated(spark, hostile):
    days = sorted({r.date for r in hostile.select("date").distinct().collect()})
    paid = {(f"SYM{k}", days[i]): 4.0 for k in range(4) for i in (80, 200, 320)}
    dividends = spark.createDataFrame([(y, d, v) for (y, d), v in paid.items()], "symbol string, ex_date date, dps double")
    cal = union_calendar(hostile).cache()
    members = universe.pit_membership(hostile, cal, 8, 40, 60).withColumn("universe", F.lit("all")).cache()
    configs = lifecycle.configurations(spark, CASES)
    market = lifecycle.market(hostile, cal).cache()
    crossed = lifecycle.crosses(hostile, cal, sorted({(s.short, s.long) for s in CASES.values()}))
    placed = portfolio.simulate(lifecycle.lifecycles(configs, crossed, market, members, dividends, cal), market).cache()
    member = {(r.symbol, r.date) for r in members.collect()}
    rows = [tuple(r) for r in hostile.collect()]
    return {"orders": placed, "trades": portfolio.closed_trades(placed).collect(), "equity": portfolio.equity_curve(placed, market, configs, cal).collect(), "refused": {r.config_id: r for r in portfolio.refusals(placed).collect()}, "plain": {k: plain_simulation(rows, paid, member, s) for k, s in CASES.items()}}


@pytest.mark.parametrize("name", CASES)
def test_simulation_matches_the_plain_walk(simulated, name):
    trades, equity, refused, blocked = simulated["plain"][name]
    got = sorted((t.symbol, t.qty, t.entry_date, t.exit_date, t.exit_reason, t.net_pnl) for t in simulated["trades"] if t.config_id == name)
    want = sorted((y, n, a, b, why, net) for y, n, a, b, net, why in trades)
    assert [g[:5] for g in got] == [w[:5] for w in want] and len(want) > 5
    assert all(math.isclose(g[5], w[5], rel_tol=1e-9, abs_tol=1e-6) for g, w in zip(got, want, strict=True))
    curve = sorted((r.date, r.equity, r.n_positions) for r in simulated["equity"] if r.config_id == name)
    assert [(c[0], c[2]) for c in curve] == [(e[0], e[2]) for e in equity]
    assert all(math.isclose(c[1], e[1], rel_tol=1e-9) for c, e in zip(curve, equity, strict=True))
    own = simulated["refused"].get(name)
    assert (own.rejected, own.band_blocked) == (refused, blocked)


def test_no_configuration_overdraws(simulated):
    for name, s in CASES.items():
        own = [r for r in simulated["equity"] if r.config_id == name]
        assert all(r.equity > 0 and r.n_positions <= s.portfolio.max_positions + 1 for r in own)


# --- costs


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_charges(spark):
    lakh = F.lit(1e5)
    assert value(spark, buy_cost(lakh)) / 10 == pytest.approx(11.87406)
    assert value(spark, sell_cost(lakh, include_dp=False)) / 10 == pytest.approx(10.37406)
    assert value(spark, buy_cost(lakh) + sell_cost(lakh)) == pytest.approx(237.82, abs=0.005)
    assert value(spark, buy_cost(lakh, Costs.zero()) + sell_cost(lakh, Costs.zero())) == 0
    assert value(spark, sell_cost(lakh) - sell_cost(lakh, include_dp=False)) == pytest.approx(15.34)
    assert value(spark, sell_cost(lakh, product="MIS") - sell_cost(lakh, product="MIS", include_dp=False)) == 0
    big = value(spark, buy_cost(F.lit(1e7), replace(Costs(), exchange=0.0, sebi=0.0, stamp_intraday=0.0), "MIS"))
    assert big == pytest.approx(20 * 1.18)  # the cap, and tax on it
    buy, sell = plain_costs(Costs())
    assert buy(1e5) == pytest.approx(value(spark, buy_cost(lakh))) and sell(1e5) == pytest.approx(value(spark, sell_cost(lakh)))
    assert value(spark, order_cost(lakh, F.lit("SELL"))) == pytest.approx(103.7406)


def test_quotes(spark):
    rows = [(1, 10, 50.0, '{"total_price": 1000, "charges": {"total": 2, "gst": {"total": 0.3, "cgst": 9}}}'), (2, 10, 50.0, '{"turnover": "800", "charges": {"total": "x", "gst": {"cgst": 0.1, "igst": 0.2}}}'), (3, 10, 50.0, "{}"), (4, 0, 50.0, "not json")]
    got = {r.id: (r.turnover, r.total, round(r.gst, 6), r.bps) for r in parse_quotes(spark.createDataFrame(rows, "id int, quantity int, average_price double, response string")).collect()}
    assert got == {1: (1000.0, 2.0, 0.3, 20.0), 2: (800.0, 0.0, 0.3, 0.0), 3: (500.0, 0.0, 0.0, 0.0), 4: (0.0, 0.0, 0.0, 0.0)}


# --- sessions, orders, sources


def test_calendar_audit(spark):
    days = [dt.date(2025, 3, 3) + dt.timedelta(i) for i in range(60) if (dt.date(2025, 3, 3) + dt.timedelta(i)).weekday() < 5]
    sess = spark.createDataFrame([(d,) for d in days], "date date")
    bar = lambda y, d: (y, d, 100.0, 100.0, 100.0, 100.0, 1.0)
    clean = frame(spark, [bar(y, d) for y in "AB" for d in days])
    assert sessions.audit(clean, union_calendar(clean), sess).first().clean
    odd = frame(spark, [bar("A", d) for i, d in enumerate(days) if i != 7] + [bar("A", dt.date(2025, 3, 30))] + [bar("P", d) for i, d in enumerate(days) if i != 7 and not 10 <= i < 25])
    got = sessions.audit(odd, union_calendar(odd), sess).first()
    assert got.phantom == [dt.date(2025, 3, 30)] and got.missing == [days[7]] and [tuple(g) for g in got.worst_gaps] == [(15, "P")] and not got.clean
    assert "P: 15 bars missing" in sessions.report(got)
    asked = spark.createDataFrame([(days[5],), (days[0],), (dt.date(2025, 3, 9),)], "date date")
    prev = {r.date: r.previous_session for r in sessions.previous_session(sess, asked).collect()}
    assert prev == {days[5]: days[4], days[0]: None, dt.date(2025, 3, 9): dt.date(2025, 3, 7)}


def sheet(spark, scan, held, **k):
    scan = spark.createDataFrame(scan, "symbol string, signal string, bars_since int, close double, crossover_date date")
    held = spark.createDataFrame(held, "symbol string, qty long")
    return [(r.tradingsymbol, r.transaction_type, r.quantity) for r in orders.order_sheet(scan, held, **k).collect()], orders.sheet_notes(scan, held, **k)


def test_order_sheet(spark):
    day = dt.date(2025, 1, 1)
    row = lambda y, s, b, c: (y, s, b, c, day)
    scan = [row("AAA", "BULLISH", 0, 100.0), row("BBB", "BULLISH", 0, 200.0), row("CCC", "BULLISH", 2, 50.0), row("DDD", "BEARISH", 0, 10.0), row("EEE", "BEARISH", 0, 10.0), row("FFF", "BULLISH", 0, 2e5), row("GGG", "BULLISH", 0, 10.0), row("GGG", "BEARISH", 5, 10.0)]
    got, notes = sheet(spark, scan, [("DDD", 7), ("AAA", 3)])
    assert got == [("DDD", "SELL", 7), ("BBB", "BUY", 500), ("GGG", "BUY", 10_000)]
    assert any("both signals" in n for n in notes) and any("not held" in n for n in notes) and any("older than" in n for n in notes) and any("FFF" in n for n in notes)
    assert sheet(spark, scan, [("X", 1), ("Y", 0)], max_positions=2)[0] == []
    assert sheet(spark, [], [])[1] == ["scan produced no signals"]
    assert [c for c in orders.broker_kwargs(orders.order_sheet(spark.createDataFrame([scan[0]], "symbol string, signal string, bars_since int, close double, crossover_date date"), spark.createDataFrame([], "symbol string, qty long"))).columns] == list(orders.ORDER_FIELDS)


def test_merge_and_benchmark_sources(spark):
    a = spark.createDataFrame([("A", dt.date(2024, 1, 1), 1.0), ("A", dt.date(2024, 1, 2), 2.0)], "symbol string, date date, close double")
    b = spark.createDataFrame([("A", dt.date(2024, 1, 2), 9.0), ("B", dt.date(2024, 1, 2), 3.0)], a.schema)
    assert sorted(r.close for r in merge_cache(a, b).collect()) == [1.0, 3.0, 9.0]
    inner = '[{"Index Name": "N", "Date": "02 Jan 2024", "TRI": "12,345.5"}, {"Index Name": "N", "Date": "x", "TRI": "1"}]'.replace('"', '\\"')
    got = parse_benchmark(spark.createDataFrame([(f'{{"d": "{inner}"}}',)], "body string")).collect()
    assert [(r.date, r.level) for r in got] == [(dt.date(2024, 1, 2), 12345.5)]


# --- statistics


def test_performance_by_hand(spark):
    values = [100.0, 110.0, 99.0, 99.0, 120.0]
    rows = [("c", dt.date(2024, 1, 1) + dt.timedelta(91 * i), v, 1) for i, v in enumerate(values)]
    got = metrics.performance(spark.createDataFrame(rows, "config_id string, date date, equity double, n_positions int"), slots=2).first()
    rets = [b / a - 1 for a, b in zip(values, values[1:], strict=False)]
    mean = sum(rets) / 4
    sd = (sum((x - mean) ** 2 for x in rets) / 3) ** 0.5
    assert got.cagr == pytest.approx(1.2 ** (365.25 / 364) - 1) and got.volatility == pytest.approx(sd * 252**0.5)
    assert got.sharpe_rf == pytest.approx((mean - 0.065 / 252) / sd * 252**0.5) and got.max_drawdown == pytest.approx(-0.1)
    assert got.longest_drawdown == 2 and got.exposure == 0.5 and got.sortino is None


def test_trade_stats_without_losses(spark):
    rows = [("c", 10.0, 1.0, 5, 0.1, 0.0)]
    got = metrics.trade_stats(spark.createDataFrame(rows, "config_id string, net_pnl double, net_return_pct double, holding_days int, charges double, dividends double")).first()
    assert got.profit_factor == math.inf and got.avg_loss_pct == 0 and got.win_rate == 1


def test_dividends_over_a_holding(spark):
    t = spark.createDataFrame([("A", dt.date(2024, 1, 1), dt.date(2024, 1, 5)), ("A", dt.date(2024, 1, 5), None), ("B", dt.date(2024, 1, 1), dt.date(2024, 1, 2))], "symbol string, entry_date date, exit_date date")
    d = spark.createDataFrame([("A", dt.date(2024, 1, 1), 1.0), ("A", dt.date(2024, 1, 5), 2.0), ("A", dt.date(2024, 1, 6), 4.0)], "symbol string, ex_date date, dps double")
    assert sorted(r.dps_held for r in joins.dividends_over(t, d).collect()) == [0.0, 0.0, 2.0]


def test_selection_bias(spark):
    assert selection_bias.minimum_backtest_length(38) == pytest.approx(4.70515775762)
    rows = [(f"c{k}", dt.date(2020, 1, 1) + dt.timedelta(i), ((i * 37 + k * 91) % 101 - 50) / 5000 + k * 1e-3) for k in range(5) for i in range(120)]
    returns = spark.createDataFrame(rows, "config_id string, date date, ret double")
    order = spark.createDataFrame([(f"c{k}", k) for k in range(5)], "config_id string, pos int")
    got = selection_bias.report(spark, returns, order).first()
    assert got.best == "c4" and got.pbo == 0.0 and 0 <= got.deflated_sharpe <= got.psr <= 1
    flat = spark.createDataFrame([(dt.date(2020, 1, 1) + dt.timedelta(i), 0.0) for i in range(120)], "date date, ret double")
    p = selection_bias.spa(spark, returns, flat, reps=100).first()
    assert p.p_lower <= p.p_consistent <= p.p_upper and p.p_upper < 0.5


def test_spa_in_blocks_equals_one_array(spark):
    rng, n, k, reps = np.random.default_rng(4), 60, 7, 50
    d = rng.normal(0.0005, 0.01, (n, k))
    days = [dt.date(2020, 1, 1) + dt.timedelta(i) for i in range(n)]
    rows = [(f"c{j}", days[i], float(d[i, j])) for i in range(n) for j in range(k) if (i, j) != (5, 2)]  # date 5 is left out
    returns = spark.createDataFrame(rows, "config_id string, date date, ret double")
    flat = spark.createDataFrame([(x, 0.0) for x in days], "date date, ret double")
    z = np.delete(d, 5, axis=0)
    z, n = z / z.std(axis=0, ddof=1), n - 1
    mean, above = z.mean(axis=0), [0, 0, 0]
    for rep in range(reps):
        own = np.random.default_rng([7, rep])
        fresh = own.random(n) < 0.1
        fresh[0] = True
        at = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        drawn = z[(own.integers(0, n, n)[at] + np.arange(n) - at) % n].mean(axis=0)
        for i, c in enumerate((np.maximum(mean, 0), np.where(mean >= -math.sqrt(2 * math.log(math.log(n)) / n), mean, 0), mean)):
            above[i] += max(0.0, (drawn - c).max()) > max(0.0, mean.max())
    for cells in (100, 1_000_000):
        assert list(selection_bias.spa(spark, returns, flat, reps=reps, cells=cells).first()) == pytest.approx([x / reps for x in above])
    assert list(selection_bias.spa(spark, returns, flat.limit(2), reps=reps).first()) == [None] * 3  # was an error


def test_sweep_sets():
    assert len(sweep.grid(Settings())) == 41
    assert sweep.ladder(Settings())[0]["S0"].execution.same_bar_fill
    with pytest.raises(ValueError):
        Settings().having(tiebreak="luck")


def test_null_picks_are_in_range(spark):
    r = spark.range(1000).select(nulls.pick(F.col("id"), F.col("id") * 3, 2).alias("x")).agg(F.min("x").alias("a"), F.max("x").alias("b"), F.count_distinct("x").alias("n")).first()
    assert 0 <= r.a and r.b < nulls.PRIME and r.n > 990


def test_ladder_computes_its_panel_once(spark):
    """Bars, panel and life cycles are written once: the summary reads them, and computes none of them again."""
    from causalbars.plans import catalogue
    from causalbars.sources import tables

    d = "/root/testdata/sf0.001"
    got = catalogue.queries()["ladder_summary"](spark, d)
    assert not [x for x in got.inputFiles() if "lineitem" in x]
    bars = [sorted(map(tuple, tables.weekly_bars(spark, d, by_symbol).collect())) for by_symbol in (False, True)]
    assert bars[0] == bars[1]
