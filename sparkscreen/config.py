"""Configuration of a run; nothing is read or created at import."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime

MODEL_VERSION = "2.0"
RANKED, PARTIAL, INSUFFICIENT = "RANKED", "PARTIAL_DATA", "INSUFFICIENT_DATA"


@dataclass(frozen=True)
class ScreenConfig:
    """run_ts, a UTC time, is a literal in all plans, so that a run can be repeated; by default it is when the object is made."""

    run_ts: str = field(default_factory=lambda: datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%S"))
    ticker: str = "VRTX"
    top_n: int = 100
    export: bool = False
    low_coverage_ratings: int = 10
    high_dispersion_pct: float = 50.0
    earnings_warning_days: int = 7
    high_volatility_pct: float = 60.0
    low_dollar_volume: float = 10_000_000.0
    very_low_dollar_volume: float = 5_000_000.0
    min_long_coverage_pct: float = 70.0
    min_short_coverage_pct: float = 75.0

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None, **changes) -> ScreenConfig:
        env = dict(os.environ) if env is None else env
        found = {}
        if "EXPORT_RESULTS" in env:
            found["export"] = env["EXPORT_RESULTS"].strip().lower() in {"1", "true", "yes", "y"}
        for key, name in (("LOW_AVERAGE_DOLLAR_VOLUME", "low_dollar_volume"), ("VERY_LOW_AVERAGE_DOLLAR_VOLUME", "very_low_dollar_volume")):
            if key in env:
                found[name] = float(env[key])
        return replace(cls(), **(found | changes))


def read_dotenv(text: str, env: dict[str, str]) -> dict[str, str]:
    """KEY=value lines of a .env file added to env where a key is not there yet; comments and blank lines are skipped."""
    out = dict(env)
    for line in text.splitlines():
        line = line.strip()
        if line and not line.startswith("#") and "=" in line:
            key, _, value = line.partition("=")
            out.setdefault(key.strip(), value.strip().strip("\"'"))
    return out
