"""Run profiles."""

from __future__ import annotations

from dataclasses import dataclass, fields

import yaml

#: Simulations, batch, block length and method of each profile.
PROFILES = {"quick_test": (50, 25, 5, "iid"), "development": (100, 50, 10, "iid"), "production": (1000, 100, 10, "block"), "research": (2000, 200, 20, "stationary")}


@dataclass(frozen=True)
class BootstrapProfile:
    n_sims: int
    batch_size: int
    block_length: int
    method: str
    confidence_level: float = 0.95
    description: str = ""


def profile(name: str) -> BootstrapProfile:
    return BootstrapProfile(*PROFILES[name])


def load_profiles(text: str) -> dict[str, BootstrapProfile]:
    """Profiles from YAML: name -> fields. Names that a profile has no field for are an error."""
    known = {f.name for f in fields(BootstrapProfile)}
    out = {}
    for name, values in (yaml.safe_load(text) or {}).items():
        if odd := set(values) - known:
            raise ValueError(f"{name}: unknown {', '.join(sorted(odd))}")
        out[name] = BootstrapProfile(**{**values, "method": str(values["method"]).lower()})
    return out


def validation_profile(base: BootstrapProfile) -> BootstrapProfile:
    """A fifth of the simulations, 50 at least."""
    return BootstrapProfile(max(50, base.n_sims // 5), base.batch_size, base.block_length, base.method, base.confidence_level, base.description)


def load_batch(text: str) -> dict:
    """A batch run: strategies, symbols, period and strategy_params."""
    found = yaml.safe_load(text) or {}
    if missing := [k for k in ("strategies", "symbols") if not found.get(k)]:
        raise ValueError(f"missing {', '.join(missing)}")
    return {"period": "1y", "strategy_params": {}} | found
