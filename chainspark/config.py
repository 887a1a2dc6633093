"""Tunables of correlation, scoring and detection."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    weights: dict[str, int] = field(
        default_factory=lambda: {
            "temporal": 20, "same_host": 20, "same_user": 11, "same_source_ip": 4, "same_destination_ip": 4, "shared_domain": 2,
            "process_relationship": 20, "shared_file": 4, "attack_progression": 10, "event_dependency": 5,
        }
    )
    strict_seconds: int = 30
    normal_seconds: int = 120
    broad_seconds: int = 600
    min_edge_score: int = 35
    absorb_score: int = 50
    max_candidates_per_event: int = 40
    attack_confidence: float = 45.0
    attack_risk: float = 40.0
    brute_force_failures: int = 5
    brute_force_window: int = 300
    suspicious_dns_length: int = 60
    scan_destinations: int = 8
    max_events_per_ingest: int = 50_000


DEFAULT = Settings()
