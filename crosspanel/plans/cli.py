"""Studies from the command line: ``python -m crosspanel.plans.cli STUDY ...``."""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from dataclasses import fields, replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from crosspanel.operators import attribution, betas, events, metrics, overlay, pit, portfolio, risk_model, signals, styles
from crosspanel.plans import gate
from crosspanel.sources import readers, store


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="crosspanel")
    studies = out.add_subparsers(dest="study", required=True)

    def study(name: str, **options) -> None:
        sub = studies.add_parser(name)
        sub.add_argument("--out", required=True)
        for option, default in options.items():
            sub.add_argument(f"--{option.replace('_', '-')}", required=default is str, default=None if default is str else default, type=str if default is str or default is None else type(default))

    study("research", prices=str, universe=str, start=None, end=None, lookback=20, quantile=0.20, cost_bps=0.0, weights="global")
    study("gate", prices=str, universe=str, market=str, quantile=0.2, cost_bps=5.0, beta_window=252, least_beta=126, shrinkage=0.5, samples=2000, block=6, clean_years=None)
    study("build", ohlc=str, fundamentals=str, coverage_floor=0.90, prefix="R1000::", stop_after="signals")
    study("audit", table=str)
    study("events", panel=str, symbols=None, days=None, raw_threshold=0.50, residual_threshold=0.30, factor_window=336, cooldown_hours=24, cost_bps=20.0)
    study("attribution", trades=str, start=None, risk_window=60, beta_window=60)
    study("overlay", trades=str, start="2012-01-05", end=None, beta_window=60, cost_bps=0.0)
    return out


def _within(df, start: str | None, end: str | None):
    df = df.where(F.col("date") >= F.lit(start).cast("date")) if start else df
    return df.where(F.col("date") <= F.lit(end).cast("date")) if end else df


def rolling(daily, window: int):
    """The strategy's rolling beta against the market sleeve."""
    return betas.rolling_beta(daily.select("date", F.lit("STRATEGY").alias("asset"), F.col("ret").alias("y"), F.col("r_VTI").alias("x")), window)


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    write = lambda df, name, kind="csv": store.write_table(df, f"{args.out}/{name}", kind)
    if args.study == "research":
        universe = readers.read_universe(spark, args.universe)
        returns = _within(readers.returns_of(readers.read_frame(spark, args.prices), universe), args.start, args.end)
        panel = returns.join(universe.select(F.col("ticker").alias("asset"), "sector", "industry"), "asset")
        residuals = risk_model.decompose(panel)
        write(returns, "returns")
        write(residuals, "residuals")  # fitted returns among them
        write(risk_model.factor_returns(panel), "factors")
        write(risk_model.diagnostics(panel), "diagnostics")
        chosen = {"residual_momentum": signals.momentum(residuals, "residual", args.lookback), "residual_reversal": signals.reversal(residuals, "residual", args.lookback), "raw_momentum": signals.momentum(returns, "ret", args.lookback)}
        for name, signal in chosen.items():
            earned = returns if name == "raw_momentum" else residuals.select("date", "asset", F.col("residual").alias("ret"))
            if args.weights == "sector":
                weights = portfolio.sector_neutral_weights(signal.join(universe.select(F.col("ticker").alias("asset"), "sector"), "asset"), args.quantile)
            elif args.weights == "global":
                weights = portfolio.global_weights(signal, args.quantile)
            else:
                raise ValueError(f"unknown weights: {args.weights}")
            path = portfolio.path(weights, earned, args.cost_bps)
            coefficients = metrics.information_coefficient(signal, earned)
            for df, what in ((signal, "signal"), (weights.where("weight <> 0"), "weights"), (path, "backtest"), (metrics.performance(path), "performance"), (coefficients, "ic"), (metrics.coefficient_summary(coefficients), "ic_summary")):
                write(df, f"{name}_{what}")
    elif args.study == "gate":
        universe = readers.read_universe(spark, args.universe)
        prices = readers.read_frame(spark, args.prices)
        market = readers.returns_of(prices.where(F.col("ticker") == args.market)).select("date", F.col("ret").alias("market"))
        names = {f.name for f in fields(gate.GateConfig)}
        given = {k: v for k, v in vars(args).items() if k in names and v is not None}
        if "clean_years" in given:
            given["clean_years"] = float(given["clean_years"])
        store.write_json(spark, f"{args.out}/gate_summary.json", gate.run_gate(readers.returns_of(prices, universe), market, replace(gate.GateConfig(), **given)))
    elif args.study == "build":
        panel, coverage = pit.build_panel(readers.read_frame(spark, args.ohlc), readers.read_frame(spark, args.fundamentals), args.coverage_floor, args.prefix)
        write(panel, "panel", "parquet")
        write(coverage, "coverage", "parquet")
        if args.stop_after == "panel":
            return
        panel = spark.read.parquet(f"{args.out}/panel")
        inputs = styles.style_inputs(panel)
        rows = styles.style_residuals(inputs).join(inputs.select("date", "ticker", "ret"), ["date", "ticker"]).withColumnRenamed("ticker", "symbol")
        made = {"signals_12_1": signals.monthly_signals(rows, 11, 1), "signals_6_1": signals.monthly_signals(rows, 5, 1)}
        for name, df in made.items():
            write(df, name, "parquet")
        store.write_json(spark, f"{args.out}/manifest.json", store.build_manifest(panel, {n: spark.read.parquet(f"{args.out}/{n}") for n in made}))
    elif args.study == "audit":
        table = readers.read_frame(spark, args.table)
        key = "ticker" if "ticker" in table.columns else "asset_id"
        write(store.audit(table, key), "audit")
        write(store.ever_missing(table.drop("date"), key), "ever_missing")
        found = {"history": store.years_of_history(table).first().asDict()}
        if "is_universe" in table.columns:
            write(store.universe_sizes(table), "sizes_by_year")
            write(store.universe_sizes(table, "month"), "sizes_by_month")
            found["flags"] = {str(r["is_universe"]): r["count"] for r in table.groupBy("is_universe").count().collect()}  # a flag has few values
        store.write_json(spark, f"{args.out}/audit.json", found)
    elif args.study == "events":
        names = {f.name for f in fields(events.StudyConfig)}
        config = replace(events.StudyConfig(), **{k: v for k, v in vars(args).items() if k in names})
        panel = events.valid_panel(readers.read_frame(spark, args.panel))
        if args.symbols:
            panel = panel.where(F.col("symbol").isin(readers.symbols_in("\n".join(r[0] for r in spark.read.text(args.symbols).collect()))))  # a list that a person wrote
        if args.days:
            last = panel.agg(F.max("timestamp").alias("_last"))
            panel = panel.join(F.broadcast(last), F.col("timestamp") > F.col("_last") - F.make_interval(days=F.lit(int(args.days)))).drop("_last")  # one row
        found = events.events(events.features(panel, config), config)
        store.write_report(spark, args.out, "Event study", vars(args), {"events": found, "summary": events.event_summary(found, config)})
    else:
        trades = readers.read_trades(spark, args.trades)
        daily = attribution.check_accounts(trades, attribution.accounts(trades))
        if args.study == "overlay":
            found = overlay.streams(daily, beta_window=args.beta_window, cost_bps=args.cost_bps)
            write(found, "streams")
            write(rolling(daily, args.beta_window), "beta")
            write(overlay.compared(found, args.start, args.end), "comparison")
        else:
            daily = _within(daily, args.start, None)
            tables = {f.__name__: f(daily) for f in (attribution.contributions, attribution.dollar_attribution, attribution.conditional_betas, attribution.unique_risk, attribution.strategy_stress, attribution.state_stats, attribution.state_stress, attribution.correlations, attribution.worst_days)}
            tables |= {"performance": metrics.performance(daily, value="ret"), "risk": attribution.rolling_risk(daily, args.risk_window), "latest_risk": attribution.latest_risk(daily, args.risk_window), "rolling_beta": rolling(daily, args.beta_window)}
            store.write_report(spark, args.out, "Attribution", vars(args), tables)


def main(arguments: Sequence[str] | None = None) -> None:
    args = parser().parse_args(arguments)
    run(SparkSession.builder.appName("crosspanel").config("spark.sql.session.timeZone", "UTC").getOrCreate(), args)


if __name__ == "__main__":
    main()
