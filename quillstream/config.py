"""Thresholds and weights. Results depend on them."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Config:
    tfidf_threshold: float = 0.42
    most_terms: int = 20_000
    ngram_threshold: float = 0.16
    containment_threshold: float = 0.5
    containment_shared: int = 3
    simhash_distance: int = 4
    continuity_threshold: float = 0.35
    continuity_days: int = 4
    exact_term_length: int = 4
    min_signal: int = 1
    cross_category_min: int = 2
    candidates_per_category: int = 12
    lookback_hours: int = 30
    per_source: int = 40
    body_chars: int = 8000
    message_chars: int = 4000
    picks_per_category: int = 3
    deep_dive_floor: float = 0.35
    probability_tolerance: float = 0.15
    interest_days: int = 60
    selection: dict = field(default_factory=lambda: {"democracy": 0.30, "impact": 0.25, "novelty": 0.20, "credibility": 0.15, "personal": 0.10})
    penalties: dict = field(default_factory=lambda: {"single_source": 0.08, "one_lean": 0.06, "flag": 0.05, "repeat": 0.10, "crowding": 0.07})
    reliability: dict = field(default_factory=lambda: {"high": 1.0, "medium": 0.75, "low": 0.45, "propaganda": 0.15})
    reliability_default: float = 0.5
    dimensions: dict = field(
        default_factory=lambda: {
            "rule_of_law": 1.0, "checks_and_balances": 1.0, "electoral_integrity": 1.0, "media_freedom": 0.9, "anticorruption": 0.85,
            "civil_liberties": 0.85, "civic_space": 0.75, "information_integrity": 0.75, "minority_rights": 0.7, "state_capacity": 0.55,
        }
    )
    dimension_default: float = 0.6
    interest_deltas: dict = field(default_factory=lambda: {"more": 0.15, "deep_dive": 0.2, "less": -0.15, "irrelevant": -0.3})


DEFAULT = Config()
