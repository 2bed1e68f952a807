"""Settings of the studies, as one immutable value; functions take them as arguments."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Study:
    # Fixed values of the published protocol.
    least_age: int = 18
    hours_before: int = 24
    hours_after: int = 24
    sentinel: float = -999.0
    core_completeness: float = 0.95
    floor_completeness: float = 0.02
    ranged_share: float = 0.90
    panel: tuple[str, ...] = ("BUN", "Hct", "Hgb", "RBC", "WBC", "bicarbonate", "chloride", "creatinine", "glucose", "platelets", "potassium", "sodium")
    outcomes: tuple[str, ...] = ("hospital_expire_flag", "gender_female", "age_ge65", "race_binary")
    k: int = 13
    ks: tuple[int, ...] = (4, 5, 6, 7, 8, 10, 13, 16, 20)
    starts: int = 10
    k_within_sites: int = 5
    seeds: tuple[int, ...] = (0, 1, 2, 3, 4)
    measures: tuple[str, ...] = ("broja", "ccs")
    permutations: int = 1000
    calibration_permutations: int = 200
    bootstrap_draws: int = 1000
    gaussian_bootstrap_draws: int = 400
    least_site: int = 1000
    least_site_target: int = 500
    pooled_rows: int = 3000
    pooled_sites: tuple[int, ...] = (1, 2, 4, 8, 16, 32, 64, 128)
    pooled_draws: int = 20
    least_gap: float = 2.0
    level: float = 0.05
