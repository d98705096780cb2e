"""Engine settings: thresholds that the rules use as literals, and their version."""

from __future__ import annotations

import hashlib
import json
import os
import tomllib
from dataclasses import asdict, dataclass, field, fields

# The eleven completeness fields, nine of which a report declares itself.
FIELDS = (
    "randomized_n", "arm_sizes", "analysis_population", "primary_outcome", "effect_estimate", "precision", "harms",
    "protocol_registration", "data_sharing", "conflicts_of_interest", "patient_public_involvement",
)
REPORTING = FIELDS[2:]
# The settings that change results, and below their defaults.
SEMANTIC = ("rules_version", "model_revision", "alpha", "interaction_sample_multiplier", "min_events_per_parameter", "min_expected_cell_count", "baseline_extreme_p", "completeness_weights")


@dataclass(frozen=True)
class Config:
    rules_version: str = "1.2.0"
    alpha: float = 0.05
    interaction_sample_multiplier: float = 4.0
    min_events_per_parameter: int = 10
    min_expected_cell_count: float = 5.0
    baseline_extreme_p: float = 0.001
    cache_ttl_seconds: int = 86400
    cache_max_entries: int = 4096
    model_revision: str = "regex-biomed-v1"
    completeness_weights: dict[str, float] = field(default_factory=lambda: dict.fromkeys(FIELDS, 1.0))

    def __post_init__(self) -> None:
        if not 0 < self.alpha < 1 or not 0 < self.baseline_extreme_p < 1:
            raise ValueError("alpha and baseline_extreme_p lie between 0 and 1")
        if self.interaction_sample_multiplier <= 0 or self.min_events_per_parameter < 1 or self.min_expected_cell_count <= 0:
            raise ValueError("multiplier, event floor and cell floor must be positive")
        if self.cache_ttl_seconds < 1 or self.cache_max_entries < 1:
            raise ValueError("cache bounds must be positive")
        if set(self.completeness_weights) != set(FIELDS) or min(self.completeness_weights.values()) <= 0:
            raise ValueError("completeness weights need exactly the eleven fields, each over 0")

    @property
    def version(self) -> str:
        """The first 16 hex digits of the SHA-256 of what changes results."""
        own = {k: v for k, v in asdict(self).items() if k in SEMANTIC}
        return hashlib.sha256(json.dumps(own, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]


def load(path: str | None = None) -> Config:
    """Settings of a TOML file: of path, else of PLUMBLINE_CONFIG, else the defaults.

    Settings stand at the top or in the section engine, weights in completeness.weights; weights left out are 1.
    """
    path = path or os.environ.get("PLUMBLINE_CONFIG")
    if not path:
        return Config()
    with open(path, "rb") as f:
        given = tomllib.load(f)
    weights = given.pop("completeness", {})
    if extra := set(weights) - {"weights"}:
        raise ValueError(f"unknown completeness settings: {sorted(extra)}")
    given |= given.pop("engine", {})
    if "memory_cache_entries" in given:  # the setting's older name
        given["cache_max_entries"] = given.pop("memory_cache_entries")
    if weights:
        given["completeness_weights"] = dict.fromkeys(FIELDS, 1.0) | weights["weights"]
    known = {f.name for f in fields(Config)}
    if extra := set(given) - known:
        raise ValueError(f"unknown settings: {sorted(extra)}")
    return Config(**given)
