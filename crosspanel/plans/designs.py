"""Frozen choices of the universe and the research design, checked before use."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import asdict, dataclass
from typing import Any

from pyspark.sql import DataFrame

from crosspanel.operators import pit


def _check(of: object, rules: Mapping[str, bool]) -> None:
    """ValueError naming all fields whose rule does not hold."""
    if broken := [f"{name} = {getattr(of, name)!r}" for name, holds in rules.items() if not holds]:
        raise ValueError(f"{type(of).__name__} out of range: {', '.join(broken)}")


@dataclass(frozen=True)
class UniverseConfig:
    """Rules of the mechanical universe; each looks at rows before the date. Membership of an index is not among them."""

    # Fixed values.
    price_floor: float = 5.0
    adv_window_days: int = 63
    adv_min_periods: int = 42
    min_dollar_volume: float = 5_000_000.0
    top_n_by_dollar_volume: int | None = 3000
    min_history_days: int = 252
    information_lag_days: int = 1
    require_common_stock: bool = True
    require_major_exchange: bool = True

    def validate(self) -> UniverseConfig:
        top = self.top_n_by_dollar_volume
        _check(self, {
            "price_floor": self.price_floor > 0, "adv_window_days": self.adv_window_days > 1, "adv_min_periods": self.adv_min_periods in range(1, self.adv_window_days + 1),
            "min_dollar_volume": self.min_dollar_volume >= 0, "top_n_by_dollar_volume": top is None or top > 1, "min_history_days": self.min_history_days > 0, "information_lag_days": self.information_lag_days > 0,
        })
        return self

    def universe(self, bars: DataFrame, history: DataFrame) -> DataFrame:
        """The mechanical universe by these rules; ValueError for a rule that the operator always or never applies."""
        self.validate()
        if self.information_lag_days != 1 or not (self.require_common_stock and self.require_major_exchange):
            raise ValueError("the universe looks one row back and asks for common stock on a major exchange")
        return pit.mechanical_universe(bars, history, self.price_floor, self.adv_window_days, self.adv_min_periods, self.min_history_days, self.min_dollar_volume, self.top_n_by_dollar_volume)


@dataclass(frozen=True)
class ResearchDesign:
    """What a study was registered with; the texts only describe, the source's and the model's names are the caller's."""

    # Fixed values.
    primary_signal: str = "12-1 residual momentum"
    secondary_signal: str = "6-1 residual momentum"
    registered_trials: int = 2
    target_vol: float = 0.10
    incremental_alpha_hurdle: float = 0.03
    desired_power: float = 0.80
    family_significance: float = 0.05
    primary_statistic: str = "net spanning-regression alpha: residual | raw"
    mechanism_statistic: str = "paired cross-sectional IC difference"
    secondary_statistic: str = "delta Sharpe"
    case_c_incremental_risk_budget: float = 0.25
    transaction_cost_bps: float = 5.0
    primary_universe: str = "point-in-time membership of 1,000 large stocks"
    primary_factor_model: str = "market + size + value (no momentum; no undated sectors)"
    characteristic_coverage_floor: float = 0.90

    def validate(self) -> ResearchDesign:
        shares = ("desired_power", "family_significance", "case_c_incremental_risk_budget")
        _check(self, {
            "registered_trials": self.registered_trials == 2, "target_vol": self.target_vol > 0, "incremental_alpha_hurdle": self.incremental_alpha_hurdle > 0, "transaction_cost_bps": self.transaction_cost_bps >= 0,
            **{name: 0 < getattr(self, name) < 1 for name in shares}, "characteristic_coverage_floor": 0 < self.characteristic_coverage_floor <= 1,
        })
        return self

    def to_dict(self) -> dict[str, Any]:
        return asdict(self.validate())
