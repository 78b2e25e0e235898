"""Thresholds of the operators, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class BurstOptions:
    burst_hamming: int = 10
    burst_ms: int = 3_000
    dup_hamming: int = 5
    min_luma_variance: float = 0.0008
    min_burst_size: int = 3


@dataclass(frozen=True)
class PlacesOptions:
    eps_meters: float = 500.0
    min_points: int = 3


@dataclass(frozen=True)
class TimelineOptions:
    session_gap_ms: int = 4 * 3_600_000
    day_bridge_ms: int = 18 * 3_600_000
    trip_min_days: int = 2
    trip_min_photos: int = 20
    far_meters: float = 30_000.0


@dataclass(frozen=True)
class AlbumOptions:
    min_event_photos: int = 5
    min_place_photos: int = 5
    min_device_photos: int = 30
    min_scene_photos: int = 6
    sure_event_photos: int = 8
    scene_floor: float = 0.55
    max_jaccard: float = 0.8
    home_meters: float = 1_000.0
    place_meters: float = 1_500.0
    city_meters: float = 8_000.0
    bursts: BurstOptions = field(default_factory=BurstOptions)
    places: PlacesOptions = field(default_factory=PlacesOptions)
    timeline: TimelineOptions = field(default_factory=TimelineOptions)
