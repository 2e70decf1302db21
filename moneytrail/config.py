"""Thresholds of the detectors; two presets with the reference's literals."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class AmlConfig:
    # Fixed values of the Mongolian preset.
    reporting: int = 20_000_000
    near_low: int = 17_000_000
    near_high: int = 20_000_000
    round_min: int = 50_000
    round_modulus: int = 10_000
    night_start: int = 0
    night_end: int = 6
    high_value: int = 1_000_000
    mule_inflow: int = 10_000_000
    mule_ratio: float = 0.9
    smurf_unit: int = 3_000_000
    smurf_total: int = 9_000_000
    symbol: str = "₮"
    decimals: int = 0
    # literals of single detectors
    velocity_minutes: float = 10.0
    surge_recipients: int = 10
    rapid_minutes: float = 5.0
    burst_minutes: float = 30.0


MNT = AmlConfig()
# Fixed values of the US preset.
USD = AmlConfig(10_000, 8_500, 10_000, 500, 100, 0, 6, 1_000, 10_000, 0.9, 3_000, 9_000, "$", 2)
