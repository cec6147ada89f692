import datetime as dt
import math
import random

import pytest

from crosspanel.plans import cli


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    at, rng = tmp_path_factory.mktemp("files"), random.Random(1)
    names = [f"T{i}" for i in range(12)]
    (at / "u.csv").write_text("Symbol,Security,GICS Sector,GICS Sub-Industry\n" + "".join(f"{n},x,S{i % 2},I{i % 4}\n" for i, n in enumerate(names)))
    price, rows, panel = {n: 50.0 for n in [*names, "SPY"]}, [], []
    for d in range(120):
        date = dt.date(2020, 1, 1) + dt.timedelta(d)
        for n in price:
            price[n] *= math.exp(rng.gauss(0, 0.01))
            rows.append((date, n, price[n]))
            panel.append((n, date, price[n], 1, 1e6 * (1 + len(panel) % 7), 1.5))
    spark.createDataFrame(rows, "date date, ticker string, close double").write.parquet(str(at / "p.parquet"))
    spark.createDataFrame(panel, "ticker string, date date, close double, is_universe int, market_cap double, price_to_book double").write.parquet(str(at / "f.parquet"))
    hours = [(dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), s, 1.0 + h / 100, 1.0 + h / 90, 5.0) for h in range(30) for s in ("BTCUSDT", "ETHUSDT", "X")]
    spark.createDataFrame(hours, "timestamp timestamp, symbol string, open double, close double, quote_volume double").write.parquet(str(at / "h.parquet"))
    lines = ["ticker,date,close,shares,exposure,sharetrades,tradevalue,commission,interest,short_borrow_cost,margin_call"]
    cash, last = 1000.0, None
    for d in range(50):
        vti = 100 + d % 7
        cash -= 0 if last else 5 * vti
        last = vti
        lines += [f"VTI,{dt.date(2020, 1, 1) + dt.timedelta(d)},{vti},5,{5 * vti},0,0,0,0,0,0", f"Cash,{dt.date(2020, 1, 1) + dt.timedelta(d)},1,{cash},{cash},0,0,0,0,0,0"]
    (at / "t.csv").write_text("\n".join(lines) + "\n")
    return at


@pytest.mark.parametrize(
    ("arguments", "made"),
    [
        (["research", "--prices", "p.parquet", "--universe", "u.csv", "--lookback", "5"], "raw_momentum_performance"), (["build", "--ohlc", "f.parquet", "--fundamentals", "f.parquet"], "manifest.json"),
        (["audit", "--table", "f.parquet"], "audit.json"), (["audit", "--table", "f.parquet"], "sizes_by_month"), (["research", "--prices", "p.parquet", "--universe", "u.csv", "--lookback", "5", "--weights", "sector", "--cost-bps", "5"], "raw_momentum_weights"),
        (["build", "--ohlc", "f.parquet", "--fundamentals", "f.parquet", "--stop-after", "panel"], "coverage"), (["attribution", "--trades", "t.csv", "--beta-window", "30"], "rolling_beta"), (["overlay", "--trades", "t.csv"], "beta"), (["events", "--panel", "h.parquet", "--days", "1"], "summary"), (["events", "--panel", "h.parquet"], "REPORT.md"), (["attribution", "--trades", "t.csv"], "REPORT.md"), (["overlay", "--trades", "t.csv"], "comparison"),
    ],
)
def test_studies_write_their_tables(spark, files, tmp_path, arguments, made):
    full = [str(files / a) if a.endswith((".parquet", ".csv")) else a for a in arguments]
    cli.run(spark, cli.parser().parse_args([*full, "--out", str(tmp_path / "o")]))
    assert (tmp_path / "o" / made).exists()
