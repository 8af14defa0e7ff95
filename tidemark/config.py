"""Settings: defaults, then a YAML file, then FC_ environment variables (FC_DECISION__MIN_ROAS_TARGET=2.5)."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from copy import deepcopy
from typing import Any

#: The default settings.
DEFAULTS: dict[str, Any] = {
    "project": {"random_seed": 42},
    "forecast": {"horizons": [30, 60, 90], "quantiles": [0.1, 0.5, 0.9], "min_history_days": 30, "lookback_window": 90},
    "features": {"rolling_windows": [7, 14, 30], "lag_windows": [1, 7, 14, 30], "max_na_ratio": 0.3},
    "validation": {
        "max_missing_ratio": 0.3,
        "max_future_days": 7,
        "max_duplicate_ratio": 0.05,
        "valid_campaign_types": {
            "google": ["SEARCH", "PERFORMANCE_MAX", "DISPLAY", "VIDEO", "DEMAND_GEN", "SHOPPING"],
            "meta": ["Generic", "Prospecting", "Remarketing"],
            "bing": ["Search", "PerformanceMax", "Audience", "Shopping"],
        },
    },
    "uncertainty": {"relative_width_threshold": 2.0, "target_coverage": 0.8, "calibration_holdout_days": 14},
    "decision": {"min_roas_target": 3.0, "volatility_threshold": 0.5, "cost_inflation_threshold": 0.2, "concentration_threshold": 0.6, "zero_revenue_threshold_days": 45, "max_change_ratio": 0.5},
    "report": {"include_raw_forecasts": False, "decimal_places": 2},
}


def merged(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


class Config:
    def __init__(self, path: str | None = None, values: Mapping[str, Any] | None = None, environ: Mapping[str, str] | None = None):
        self.values = deepcopy(DEFAULTS)
        if path:
            import yaml

            with open(path) as f:
                self.values = merged(self.values, yaml.safe_load(f) or {})
        self.values = merged(self.values, values or {})
        for name, text in (os.environ if environ is None else environ).items():
            if name.startswith("FC_"):
                self._set(name[3:].lower().split("__"), text)

    def _set(self, keys: list[str], text: str) -> None:
        try:
            value = json.loads(text)
        except ValueError:
            value = text
        at = self.values
        for k in keys[:-1]:
            at = at.setdefault(k, {})
        at[keys[-1]] = value

    def get(self, dotted: str, default: Any = None) -> Any:
        """The value at a dotted name; default if there is none, or if it is None."""
        at: Any = self.values
        for k in dotted.split("."):
            if not isinstance(at, Mapping) or k not in at:
                return default
            at = at[k]
        return default if at is None else at
