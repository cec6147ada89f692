import datetime as dt
import math
import os
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

from crosspanel.plans import queries

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


@pytest.fixture(scope="module")
def tables():
    duckdb = pytest.importorskip("duckdb")
    if not DATA.exists():
        pytest.skip("no test tables here")
    found = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        found.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return found


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    return f"{value + 0.0:.10g}" if isinstance(value, float) else str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, tables, name):
    df = queries.QUERIES[name](spark, str(DATA))
    relation = tables.sql(queries.ORACLES[name])
    assert sorted(df.columns) == sorted(relation.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(relation.columns, relation.fetchall())


def test_entry():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def events_by_hand(px, c):
    """Both signals at all horizons, by loops over one hour and one symbol at a time."""
    close, opens, volume = (px.pivot(index="timestamp", columns="symbol", values=v).sort_index() for v in ("close", "open", "quote_volume"))
    ret = np.log(close).diff()
    alts = [s for s in ret if s not in c.anchors]
    median = ret[alts].median(axis=1).where(ret[alts].notna().sum(axis=1) >= c.least_alts)
    x = np.column_stack([np.ones(len(ret)), ret[c.anchors[0]], ret[c.anchors[1]], median])
    known, n, out = ~np.isnan(x).any(1), c.lookback, []
    for s in alts:
        y, p, o, v = (f[s].to_numpy() for f in (ret, close, opens, volume))
        residual = np.full(len(y), np.nan)
        for t in range(len(y)):
            rows = np.arange(max(0, t - c.factor_window), t)
            rows = rows[known[rows]]
            if len(rows) >= c.least_factor_rows and not np.isnan(y[rows]).any() and known[t]:
                m = x[rows].T @ x[rows] + np.diag([0, *[c.ridge] * 3])
                residual[t] = y[t] - x[t] @ np.linalg.solve(m, x[rows].T @ y[rows])
        moves = {"raw_pump": (lambda t: p[t] / p[t - n] - 1, c.raw_threshold), "residual_pump": (lambda t: np.expm1(residual[t - n + 1 : t + 1].sum()), c.residual_threshold)}
        for signal, (move, threshold) in moves.items():
            last = None
            for t in range(n - 1 if signal == "residual_pump" else n, len(y)):
                if volume[s].iloc[t - n + 1 : t + 1].sum() >= c.least_quote_volume and move(t) >= threshold and (last is None or t - last >= c.cooldown_hours):
                    last = t
                    if t + 1 < len(y):
                        forward = [p[t + h] / o[t + 1] - 1 if t + h < len(y) else None for h in (1, 4, 12, 24, 72)]
                        out.append((signal, s, close.index[t].to_pydatetime(), o[t + 1], *(z for f in forward for z in ((None, None) if f is None else (f, -f - c.cost_bps / 10_000)))))
    return out


def test_pump_events_have_both_signals_and_all_horizons(spark, tmp_path):
    rng, start = np.random.default_rng(5), dt.datetime(2024, 1, 1)
    rows = []
    for s in ("click", "purchase", "view", "error", "signup"):
        level = 100 * np.exp(np.cumsum(rng.normal(size=260) * 0.03))
        if s in ("view", "error"):
            level[120 if s == "view" else 170 :] *= 1.9
        level[90:] *= 1.0 if s == "signup" else 1.6  # all but one rise: raw moves without residual ones
        rows += [(s, start + dt.timedelta(hours=i), float(v)) for i, v in enumerate(level)]
    table = pd.DataFrame(rows, columns=["event_type", "ts", "value"]).assign(event_id=range(len(rows)))
    spark.createDataFrame(table).write.parquet(str(tmp_path / "events.parquet"))
    px = table.rename(columns={"ts": "timestamp"}).assign(symbol=table["event_type"].str.upper(), open=table["value"], close=table["value"], quote_volume=table["value"])
    wanted = events_by_hand(px, queries.HOURLY)
    assert {r[0] for r in wanted} == {"raw_pump", "residual_pump"} and len({r[2] for r in wanted if r[0] == "raw_pump"} ^ {r[2] for r in wanted if r[0] != "raw_pump"}) > 0
    got = queries.QUERIES["pump_events"](spark, str(tmp_path))
    assert got.columns[4:] == [f"{name}_{h}h" for h in (1, 4, 12, 24, 72) for name in ("asset_fwd", "short_net")]
    near = lambda r: r[:3] + tuple(None if v is None else pytest.approx(v, abs=2e-6) for v in r[3:])
    assert sorted(map(tuple, got.collect()), key=lambda r: r[:3]) == [near(r) for r in sorted(wanted, key=lambda r: r[:3])]
    summary = {(r.signal, r.horizon): r for r in queries.QUERIES["pump_summary"](spark, str(tmp_path)).collect()}
    assert len(summary) == 10
    for (signal, h), r in summary.items():
        net = [e[5 + 2 * (1, 4, 12, 24, 72).index(h)] for e in wanted if e[0] == signal]
        net = [v for v in net if v is not None]
        assert r.n == len(net) and r["mean"] == pytest.approx(np.mean(net), abs=2e-6) and r["median"] == pytest.approx(np.median(net), abs=2e-6) and r.hit_rate == pytest.approx(np.mean([v > 0 for v in net]), abs=2e-6)


@pytest.mark.parametrize("name", ["overlay_streams", "overlay_comparison"])
def test_overlays_run_the_published_grid(spark, name):
    from crosspanel.operators import overlay

    found = {r.strategy for r in queries.QUERIES[name](spark, str(DATA)).select("strategy").distinct().collect()}
    assert len(overlay.SCENARIOS) == 11 and {s[0] for s in overlay.SCENARIOS} <= found


def test_gate_interval_draws_as_many_samples_as_the_gate(spark, monkeypatch):
    from crosspanel.plans import gate

    drawn = []
    monkeypatch.setattr(gate, "bootstrap_interval", lambda paired, samples, *_: drawn.append(samples) or paired)
    queries.QUERIES["gate_interval"](spark, str(DATA))
    assert drawn == [2000]


def test_residual_momentum_is_that_of_36_months(spark, monkeypatch):
    import inspect

    from crosspanel.operators import regress

    called, plain = [], inspect.signature(regress.residual_momentum)
    monkeypatch.setattr(regress, "residual_momentum", lambda *a, **b: called.append(plain.bind(*a, **b)) or a[0])
    queries.QUERIES["residual_momentum_36m"](spark, str(DATA))
    called[0].apply_defaults()
    assert {k: called[0].arguments[k] for k in ("window", "least", "formation", "skip")} == {"window": 36, "least": 24, "formation": 11, "skip": 1}
