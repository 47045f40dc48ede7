"""Layered settings: defaults below a domain's below an environment's. Maps merge, anything else is replaced."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping

_FLOAT = re.compile(r"[+-]?\d+(?:\.\d*)?[eE][+-]?\d+$")


def _numbers(x):
    """Plain exponents such as 1e-10, which YAML reads as text, are numbers."""
    if isinstance(x, Mapping):
        return {k: _numbers(v) for k, v in x.items()}
    if isinstance(x, list):
        return [_numbers(v) for v in x]
    return float(x) if isinstance(x, str) and _FLOAT.match(x) else x


def merged(below: Mapping, above: Mapping) -> dict:
    out = dict(below)
    for k, v in above.items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


#: What the operators assume where settings say nothing.
DEFAULTS = {
    "dynamics": {"smooth": False},
    "collapse": {"threshold": -0.05, "least": 3},
    "phase_space": {"dim": 3, "tau": 1},
    "geometry": {"groups": {"shape": ["kurtosis", "skewness", "crest_factor"]}, "exclude": ["cv", "range_ratio", "window_size"], "norm": "zscore"},
    "pairwise": {"gate": 0.1, "fleet_gate": 0.3, "least_samples": 100, "most_samples": 2000},
    "alignment": {"window": 64, "stride": 32},
}


class Settings:
    def __init__(self, *layers: Mapping):
        self.values: dict = {}
        for layer in layers:
            self.values = merged(self.values, _numbers(layer or {}))

    @classmethod
    def load(cls, *paths: str) -> Settings:
        import yaml

        layers = []
        for p in paths:
            if os.path.exists(p):
                with open(p, encoding="utf-8") as f:
                    layers.append(yaml.safe_load(f))
        return cls(*layers)

    def get(self, path: str, default=None):
        """A value by dotted path."""
        at = self.values
        for part in path.split("."):
            if not isinstance(at, Mapping) or part not in at:
                return default
            at = at[part]
        return at

    def section(self, name: str) -> dict:
        """A section of the settings over its defaults."""
        return merged(DEFAULTS.get(name, {}), self.get(name, {}) or {})
