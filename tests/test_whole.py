"""Registered queries take all of their input."""

import os
from collections import defaultdict

import pytest

from causalbars.operators import sweep
from causalbars.plans import catalogue

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.exists(DATA), reason="no test data")


@needs_data
def test_sweeps_take_every_symbol(spark):
    q = catalogue.queries()
    flat = catalogue._flat(spark, DATA)[0].collect()
    by = defaultdict(list)
    for x in flat:
        by[x.config_id].append(x.ret)
    assert len(by) == catalogue.Inputs(spark, DATA).bars.select("symbol").distinct().count() > 12
    got = {x.config_id: x for x in q["grid_sharpe_rank"](spark, DATA).collect()}

    def sharpe(v):
        m = sum(v) / len(v)
        sd = (sum((x - m) ** 2 for x in v) / (len(v) - 1)) ** 0.5
        return m / sd * 252**0.5 if sd else 0.0

    assert {c: x.sharpe_raw for c, x in got.items()} == pytest.approx({c: sharpe(v) for c, v in by.items()}, abs=2e-6)
    report = q["selection_bias_report"](spark, DATA).first()
    assert report.n_trials == len(by) and got[report.best].rank_raw == 1


def test_heat_map_has_all_pairs_of_the_grid(spark):
    from causalbars.config import Settings

    names = list(sweep.grid(Settings()))
    summary = spark.createDataFrame([(x, float(i), 0) for i, x in enumerate(names)], "config_id string, cagr double, other int")
    got = {(x.short, int(c[5:])): x[c] for x in sweep.heat_map(summary).collect() for c in x.asDict() if c != "short"}
    assert len(got) == 42 and got.pop((20, 20)) is None
    assert {f"{s}_{l}": v for (s, l), v in got.items()} == {x: float(i) for i, x in enumerate(names)}


@needs_data
def test_monthly_map_has_all_months_of_every_symbol(spark):
    grown = defaultdict(lambda: 1.0)
    for x in catalogue._flat(spark, DATA)[0].collect():
        grown[x.config_id, x.date.year, x.date.month] *= 1 + x.ret
    rows = catalogue.queries()["heat_map"](spark, DATA).collect()
    got = {(x.config_id, x.y, m): x[f"m{m}"] for x in rows for m in range(1, 13) if x[f"m{m}"] is not None}
    assert got == pytest.approx({k: v - 1 for k, v in grown.items()}, abs=2e-6)


@needs_data
def test_registered_spa_has_the_reference_repetitions(spark, monkeypatch):
    monkeypatch.setattr(catalogue.selection_bias, "spa", lambda *a, reps=1000, **k: reps)
    assert catalogue.queries()["spa_test"](spark, DATA) == 1000
