"""Seeded panels, and a plain day-by-day simulation to hold the relational one against."""

import datetime as dt
import math
import random

from causalbars.functions.costs import plain_costs


def panel(n=8, days=420, seed=7, hostile=False):
    """Bars of ``n`` symbols: random walks; hostile ones have gaps, jumps and a thin symbol."""
    rng, out, day = random.Random(seed), [], dt.date(2020, 1, 1)
    dates = []
    while len(dates) < days:
        if day.weekday() < 5:
            dates.append(day)
        day += dt.timedelta(1)
    for k in range(n):
        close = 500.0
        holes = set(rng.sample(range(days), 25)) if hostile and 1 <= k <= 3 else set()
        jumps = set(rng.sample(range(60, days), 6)) if hostile and k < 5 else set()
        for i, d in enumerate(dates):
            before, close = close, close * math.exp(rng.gauss(0.0004, 0.016)) * (rng.choice([0.84, 1.16]) if i in jumps else 1)
            open_ = before * (1 + rng.gauss(0, 0.004)) * (close / before if i in jumps else 1)
            volume = 500.0 if hostile and k == n - 1 else float(rng.randrange(4_000_000, 9_000_000))
            if i not in holes:
                out.append((f"SYM{k}", d, round(open_ * 100) / 100, round(max(open_, close) * 100) / 100, round(min(open_, close) * 100) / 100, round(close * 100) / 100, volume))
    return out


def plain_simulation(bars, dividends, member, s, start=None):
    """Trades, equity and refusals of one configuration, by walking the days: fill, mark, decide."""
    buy_cost, sell_cost = plain_costs(s.costs)
    ex, pf = s.execution, s.portfolio
    by = {(r[0], r[1]): r for r in bars}
    dates, symbols = sorted({r[1] for r in bars}), sorted({r[0] for r in bars})
    own = {y: [d for d in dates if (y, d) in by] for y in symbols}
    bull, bear, prev, spread = set(), set(), {}, {}
    for y in symbols:
        closes, above = [], None
        for i, d in enumerate(own[y]):
            if i:
                prev[y, d] = by[y, own[y][i - 1]][5]
            closes.append(by[y, d][5])
            if len(closes) >= s.long:
                a, b = math.fsum(closes[-s.short :]) / s.short, math.fsum(closes[-s.long :]) / s.long
                now = a > b
                if above is not None and now != above:
                    (bull if now else bear).add((y, d))
                    spread[y, d] = abs(a / b - 1)
                above = now

    def median(y, i):
        v = sorted(by[y, d][5] * by[y, d][6] for d in dates[max(0, i - 59) : i + 1] if (y, d) in by)
        return None if len(v) < 30 else (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2

    cash, held, pending, trades, equity, refused, blocked = pf.initial_capital, {}, [], [], [], 0, 0
    first = max(next(i for i, d in enumerate(dates) if start is None or d >= start), s.long + 1)
    for i in range(first, len(dates)):
        d, again = dates[i], []
        for side, y, qty, why, queued in pending:
            row = by.get((y, queued if ex.same_bar_fill else d))
            price = row and (row[5] if ex.same_bar_fill else row[2])
            ok = bool(row) and price > 0 and row[6] > 0
            if ok and not ex.same_bar_fill and prev.get((y, d), 0) > 0:
                gap, edge = price / prev[y, d] - 1, ex.circuit_pct - ex.band_tolerance
                if (gap >= edge) if side == "BUY" else (gap <= -edge):
                    ok, blocked = False, blocked + 1
            if not ok:
                refused += 1
                if side == "SELL":
                    again.append((side, y, qty, why, queued))
            elif side == "BUY":
                price *= 1 + ex.slippage_bps / 1e4
                if price * qty + buy_cost(price * qty) > cash:
                    qty = int(cash * 0.995 // price)
                if qty <= 0:
                    refused += 1
                    continue
                cash -= price * qty + buy_cost(price * qty)
                held[y] = (qty, price, d, buy_cost(price * qty))
            else:
                price *= 1 - ex.slippage_bps / 1e4
                n, paid, since, charge = held.pop(y)
                got = sum(v for (z, e), v in dividends.items() if z == y and since < e <= d) * n
                cash += price * n - sell_cost(price * n) + got
                trades.append((y, n, since, d, (price - paid) * n - charge - sell_cost(price * n) + got, why))
        pending = again
        worth = cash
        for y, (n, paid, _, _) in held.items():
            last = [e for e in own[y] if e <= d]
            worth += n * (by[y, last[-1]][5] if last else paid)
        equity.append((d, worth, len(held)))
        if i == len(dates) - 1:
            break
        for y, (n, paid, since, _) in held.items():
            why = None
            if s.exits.on_bear_cross and (y, d) in bear:
                why = "bear_cross"
            elif s.exits.max_holding_days and (d - since).days >= s.exits.max_holding_days:
                why = "max_holding"
            elif s.exits.stop_loss is not None and (y, d) in by and by[y, d][5] <= paid * (1 - s.exits.stop_loss):
                why = "stop_loss"
            if why and not any(o[1] == y for o in pending):
                pending.append(("SELL", y, n, why, d))
        free = pf.max_positions - (len(held) - len(pending))
        able = [y for y in symbols if (y, d) in bull and y not in held and (y, d) in member and by[y, d][5] >= ex.min_price and (median(y, i) or -1) >= ex.min_median_turnover]
        key = {"turnover": lambda y: (-median(y, i), y), "spread": lambda y: (-spread[y, d], y)}.get(ex.tiebreak, lambda y: y)
        able.sort(key=key, reverse=ex.tiebreak == "reverse")
        left = cash
        for y in able[: max(free, 0)]:
            dear = by[y, d][5] * 1.02
            n = int(worth / pf.max_positions // dear)
            if n > 0 and dear * n > left:
                n = int(left * 0.98 // dear)
            if n > 0:
                left -= dear * n
                pending.append(("BUY", y, n, "bull_cross", d))
    return trades, equity, refused, blocked
