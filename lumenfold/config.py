"""Constants that define results, by group. They must stay as they are for results to agree."""

from __future__ import annotations

from dataclasses import dataclass

LUMA = (0.2126, 0.7152, 0.0722)
FLAG_SATURATED, FLAG_NOISE_LIMITED = 1, 2
MIDDLE_GREY = 0.18


@dataclass(frozen=True)
class Merge:
    sat_low: float = 0.90
    sat_high: float = 0.99
    min_snr: float = 1.0
    shot: float = 1e-4
    read: float = 4e-6


@dataclass(frozen=True)
class Meter:
    saturation: float = 0.98
    noise_floor: float = 2e-4
    low_percentile: float = 0.01
    high_percentile: float = 0.999
    clip_tolerance: float = 1e-4
    black_tolerance: float = 0.02
    target: float = 0.60
    target_low: float = 0.30
    target_high: float = 0.90
    max_step: float = 64.0


@dataclass(frozen=True)
class Bracket:
    ev_step: float = 3.0
    saturation_target: float = 0.70
    shadow_target: float = 0.05
    min_per_target: int = 3
    max_per_target: int = 9
    max_rungs: int = 14


@dataclass(frozen=True)
class Limits:
    min_time: float = 1e-4
    max_time: float = 0.5
    min_iso: int = 50
    max_iso: int = 3200
    base_iso: int = 100
    aperture: float = 1.8
    handheld: float = 1 / 15


@dataclass(frozen=True)
class Photometry:
    saturation: float = 78.0
    lens: float = 0.65
    meter: float = 12.5


@dataclass(frozen=True)
class Matching:
    ratio: float = 0.80
    max_distance: int = 96


@dataclass(frozen=True)
class Work:
    feature_pixels: int = 640 * 480
    match_pixels: int = 640 * 480 * 3
    write_bytes: float = 40.0 * 1024 * 1024
    read_bytes: float = 200.0 * 1024 * 1024
    weight: float = 0.4
    max_step: float = 3.0
    least_factor: float = 0.01
    most_factor: float = 100.0
    least_seconds: float = 1.0


@dataclass(frozen=True)
class Seam:
    smoothness: float = 8.0
    sweeps: int = 4
    min_cost: float = 0.02
    unavailable: float = 1e6
    max_candidates: int = 8


@dataclass(frozen=True)
class Lens:
    """A pinhole camera with radial terms; x right, y down, z forward."""

    width: int = 800
    height: int = 600
    fx: float = 600.0
    fy: float = 600.0
    cx: float = 399.5
    cy: float = 299.5
    k1: float = 0.0
    k2: float = 0.0
    k3: float = 0.0


@dataclass(frozen=True)
class Distortion:
    """When a radial coefficient is fitted, and when it is believed."""

    limit: float = 0.4
    warm_deg: float = 12.0
    huber_deg: float = 0.5
    least_gain: float = 0.01
    least_signal_deg: float = 0.05
    rounds: int = 60
    attempts: int = 12
    least_step: float = 1e-10
