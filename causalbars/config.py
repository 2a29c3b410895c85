"""Cost, execution and portfolio parameters. A run is one ``Settings``; sweeps hold many as rows."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace


@dataclass(frozen=True)
class Costs:
    """Statutory and broker rates, fractions of turnover unless named otherwise."""

    brokerage_delivery: float = 0.0
    brokerage_intraday: float = 0.0003
    brokerage_intraday_cap: float = 20.0
    stt_delivery_buy: float = 0.001
    stt_delivery_sell: float = 0.001
    stt_intraday_buy: float = 0.0
    stt_intraday_sell: float = 0.00025
    exchange: float = 0.0000307
    sebi: float = 0.000001
    stamp_delivery: float = 0.00015
    stamp_intraday: float = 0.00003
    gst: float = 0.18
    dp_per_sell: float = 15.34

    @classmethod
    def zero(cls) -> Costs:
        return cls(**dict.fromkeys(asdict(cls()), 0.0))


@dataclass(frozen=True)
class Execution:
    slippage_bps: float = 25.0
    circuit_pct: float = 0.10
    band_tolerance: float = 0.002
    min_price: float = 20.0
    min_median_turnover: float = 5e7
    tiebreak: str = "alpha"
    same_bar_fill: bool = False


@dataclass(frozen=True)
class Portfolio:
    initial_capital: float = 1_000_000.0
    max_positions: int = 10


@dataclass(frozen=True)
class Exits:
    on_bear_cross: bool = True
    max_holding_days: int | None = None
    stop_loss: float | None = None


@dataclass(frozen=True)
class Settings:
    costs: Costs = field(default_factory=Costs)
    execution: Execution = field(default_factory=Execution)
    portfolio: Portfolio = field(default_factory=Portfolio)
    exits: Exits = field(default_factory=Exits)
    short: int = 6
    long: int = 30

    def having(self, **changes) -> Settings:
        """A copy with fields changed; fields of the parts are given by their own names."""
        own = {k: v for k, v in changes.items() if k in ("costs", "execution", "portfolio", "exits", "short", "long")}
        for part in ("execution", "portfolio", "exits"):
            mine = {k: v for k, v in changes.items() if k in asdict(getattr(self, part))}
            if mine:
                own[part] = replace(own.get(part, getattr(self, part)), **mine)
        if unknown := set(changes) - set(own) - {k for part in ("execution", "portfolio", "exits") for k in asdict(getattr(self, part))}:
            raise ValueError(f"no such setting: {sorted(unknown)}")
        if (mode := changes.get("tiebreak", "alpha")) not in ("alpha", "turnover", "spread", "reverse"):
            raise ValueError(f"no such tiebreak: {mode}")
        return replace(self, **own)
