"""Thresholds of the activity analytics, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    """``bin_length_min``: minutes a row of the series stands for; runs count rows, as the series is sparse."""

    bin_length_min: int = 1
    sleep_threshold_min: int = 5
    excluded_days: tuple[int, ...] = (1, 7)
    ref_day: int = 4
    transition_window_min: int = 10
    max_missing: float = 0.10
    decline_threshold: float = 0.5
    death_threshold: float = 0.2
    window_hours: int = 6
    min_data_hours: int = 3


DEFAULT = Params()
