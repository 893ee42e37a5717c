"""Detector and decision parameters with their bounds, and the profile loader."""

from __future__ import annotations

import copy
import math
from dataclasses import dataclass, field, fields, replace

import yaml

MAX_POINT_LIMIT = 10_000_000
MAX_CLOUD_BYTE_LIMIT = 1 << 30


class ConfigError(ValueError):
    """A parameter is missing, of the wrong type or out of its range."""


def _check(ok: bool, what: str) -> None:
    if not ok:
        raise ConfigError(what)


def _finite(*values) -> bool:
    return all(isinstance(v, (int, float)) and math.isfinite(v) for v in values)


@dataclass(frozen=True)
class Box:
    low: tuple
    high: tuple

    def __post_init__(self):
        _check(len(self.low) == 3 and len(self.high) == 3, "ROI needs three axes")
        _check(_finite(*self.low, *self.high), "ROI must be finite")
        _check(all(a < b for a, b in zip(self.low, self.high)), "ROI min must be below max")


@dataclass(frozen=True)
class DetectorConfig:
    max_points: int | None = None
    record_rejected: bool = False
    record_motion: bool = False
    blind_radius_m: float = 0.5
    geometry_roi: Box = field(default_factory=lambda: Box((-10, -20, -10), (150, 20, 15)))
    detection_roi: Box = field(default_factory=lambda: Box((0, -5, -3), (120, 5, 5)))
    corridor_half_width_m: float = 2.0
    corridor_height_m: float = 3.5
    ground_max_slope: float = 0.15
    ground_inlier_tolerance_m: float = 0.15
    ground_max_gap_m: float = 10.0
    ground_hold_frames: int = 0
    ground_min_bin_points: int = 30
    ground_far_min_bin_points: int = 0
    ground_far_from_m: float = 60.0
    ground_max_x_m: float = 90.0
    obstacle_min_height_m: float = 0.25
    candidate_margin_m: float = 0.5
    angular_cell_deg: float = 0.25
    min_ground_inliers: int = 30
    min_candidate_cells: int = 3
    min_candidate_points: int = 5
    background_history_frames: int = 10
    background_lag_frames: int = 5
    background_margin_m: float = 0.5
    background_relative_margin: float = 0.02
    route_estimation: bool = True
    route_min_radius_m: float = 150.0
    route_smoothing: float = 0.0
    rail_route_weight: float = 0.0
    route_margin_per_m: float = 0.0
    route_margin_max_m: float = 0.5
    route_support_margin_m: float = 0.0
    static_channel: bool = True
    gauge_certifies_clear: bool = False
    static_half_width_m: float = 0.9
    static_inner_half_width_m: float = 0.9
    static_outer_max_length_m: float = 1.0
    static_outer_min_width_m: float = 0.15
    static_outer_min_points: int = 10
    static_min_height_m: float = 0.3
    sensor_height_above_rail_m: float = 0.0
    rail_head_margin_m: float = 0.1
    static_max_height_m: float = 2.5
    static_max_length_m: float = 3.0
    side_structure_max_length_m: float = 0.0
    far_gauge_max_x_m: float = 0.0
    far_gauge_half_width_m: float = 0.7
    far_gauge_min_height_m: float = 0.6
    far_min_extent_m: float = 0.4
    far_gauge_max_curvature: float = 0.0
    low_object_height_m: float = 1.0
    low_object_half_width_m: float = 0.5
    low_bump_max_length_m: float = 0.6
    low_bump_min_width_m: float = 0.15
    low_bump_min_prominence_m: float = 0.15
    low_bump_min_context_points: int = 10
    hanging_channel: bool = False
    pole_rejection: bool = False
    hanging_tip_max_height_m: float = 3.15
    hanging_min_vertical_span_m: float = 0.5
    hanging_max_footprint_m: float = 0.25
    hanging_min_points: int = 8
    envelope_half_width_m: float = 1.5
    envelope_min_speed_mps: float = 1.0
    ego_motion_compensation: bool = True
    ego_max_speed_mps: float = 25.0
    ego_min_contrast: float = 0.005

    def __post_init__(self):
        for f in fields(self):
            value = getattr(self, f.name)
            if isinstance(f.default, float):
                _check(_finite(value), f"{f.name} must be finite")
        # Fixed bounds: (name, lowest, highest, lowest allowed, highest allowed).
        for name, low, high, low_ok, high_ok in (
            ("max_points", 1, MAX_POINT_LIMIT, True, True),
            ("blind_radius_m", 0, math.inf, True, True),
            ("corridor_half_width_m", 0, 5, False, True),
            ("corridor_height_m", 0, 8, False, True),
            ("ground_max_slope", 0, 0.5, False, True),
            ("ground_inlier_tolerance_m", 0, 0.5, False, True),
            ("ground_max_gap_m", 5, 50, True, True),
            ("ground_min_bin_points", 1, math.inf, True, True),
            ("ground_hold_frames", 0, 10, True, True),
            ("ground_far_min_bin_points", 0, self.ground_min_bin_points, True, True),
            ("ground_far_from_m", 0, math.inf, True, True),
            ("ground_max_x_m", 30, 200, True, True),
            ("obstacle_min_height_m", 0, self.corridor_height_m, False, True),
            ("candidate_margin_m", 0, 2, True, True),
            ("angular_cell_deg", 0.05, 1.0, True, True),
            ("min_ground_inliers", 3, math.inf, True, True),
            ("min_candidate_cells", 1, math.inf, True, True),
            ("min_candidate_points", 1, math.inf, True, True),
            ("background_history_frames", 0, 60, True, True),
            ("background_margin_m", 0, math.inf, True, True),
            ("background_relative_margin", 0, 0.5, True, True),
            ("route_min_radius_m", 20, math.inf, True, True),
            ("route_smoothing", 0, 1, True, False),
            ("rail_route_weight", 0, math.inf, True, True),
            ("route_margin_per_m", 0, math.inf, True, True),
            ("route_margin_max_m", 0, math.inf, True, True),
            ("route_support_margin_m", 0, math.inf, True, True),
            ("static_half_width_m", 0, math.inf, False, True),
            ("static_inner_half_width_m", 0, self.static_half_width_m, False, True),
            ("static_outer_max_length_m", 0, self.static_max_length_m, False, True),
            ("static_outer_min_width_m", 0, self.static_half_width_m, False, True),
            ("static_outer_min_points", 1, math.inf, True, True),
            ("static_min_height_m", 0, self.static_max_height_m, False, False),
            ("sensor_height_above_rail_m", 0, 5, True, True),
            ("rail_head_margin_m", 0, math.inf, True, True),
            ("static_max_length_m", 0, math.inf, False, True),
            ("side_structure_max_length_m", 0, math.inf, True, True),
            ("far_gauge_max_x_m", 0, 300, True, True),
            ("far_gauge_half_width_m", 0, math.inf, False, True),
            ("far_gauge_min_height_m", 0, math.inf, True, True),
            ("far_min_extent_m", 0, math.inf, True, True),
            ("far_gauge_max_curvature", 0, math.inf, True, True),
            ("low_object_height_m", 0, math.inf, True, True),
            ("low_object_half_width_m", 0, math.inf, True, True),
            ("low_bump_max_length_m", 0, self.static_max_length_m, False, True),
            ("low_bump_min_width_m", 0, self.corridor_half_width_m, False, True),
            ("low_bump_min_prominence_m", 0, self.low_object_height_m, False, True),
            ("low_bump_min_context_points", 1, math.inf, True, True),
            ("hanging_tip_max_height_m", 0, self.corridor_height_m, False, True),
            ("hanging_min_vertical_span_m", 0, self.corridor_height_m, False, True),
            ("hanging_max_footprint_m", 0, self.corridor_half_width_m, False, True),
            ("hanging_min_points", 1, math.inf, True, True),
            ("envelope_half_width_m", 0, math.inf, True, True),
            ("envelope_min_speed_mps", 0, math.inf, True, True),
            ("ego_max_speed_mps", 0, 60, False, True),
            ("ego_min_contrast", 0, 0.3, False, True),
        ):
            value = getattr(self, name)
            if value is None:
                continue
            above = value >= low if low_ok else value > low
            below = value <= high if high_ok else value < high
            _check(above and below, f"{name} out of range: {value}")
        if self.background_history_frames:
            _check(
                0 < self.background_lag_frames < self.background_history_frames,
                "background_lag_frames must be inside the history",
            )
        inside = all(
            g_lo <= d_lo and d_hi <= g_hi
            for g_lo, d_lo, d_hi, g_hi in zip(
                self.geometry_roi.low, self.detection_roi.low,
                self.detection_roi.high, self.geometry_roi.high,
            )
        )
        _check(inside, "Detection ROI must be inside geometry ROI")

    @property
    def band_half_width_m(self) -> float:
        return self.corridor_half_width_m + self.candidate_margin_m

    @property
    def gauge_half_width_m(self) -> float:
        return min(self.static_half_width_m, self.corridor_half_width_m)

    @property
    def gauge_max_height_m(self) -> float:
        return min(self.static_max_height_m, self.corridor_height_m)


@dataclass(frozen=True)
class TemporalConfig:
    confirm_hits: int = 1
    confirm_window: int = 1
    gauge_confirm_hits: int = 1
    gauge_confirm_window: int = 1
    far_confirm_hits: int = 1
    far_confirm_window: int = 1
    far_confirm_from_m: float = 0.0
    motion_gauge_speed_mps: float = 0.0
    outer_offset_m: float = 0.0
    edge_retracts: bool = False
    outer_confirm_hits: int = 1
    outer_confirm_window: int = 1
    release_misses: int = 1
    gate_base_m: float = 1.0
    gate_range_fraction: float = 0.03
    object_max_speed_mps: float = 4.0
    unknown_ego_speed_mps: float = 20.0
    still_speed_mps: float = 0.0
    still_min_points: int = 50
    max_gap_s: float = 0.5
    max_tracks: int | None = None
    assumed_clear: bool = False
    assumed_clear_min_range_m: float = 50.0

    def __post_init__(self):
        for rule in ("", "gauge_", "far_", "outer_"):
            hits = getattr(self, f"{rule}confirm_hits")
            window = getattr(self, f"{rule}confirm_window")
            _check(1 <= hits <= window <= 32, f"{rule}confirm rule out of range")
        for name in (
            "far_confirm_from_m", "motion_gauge_speed_mps", "outer_offset_m",
            "gate_range_fraction", "object_max_speed_mps", "unknown_ego_speed_mps",
            "still_speed_mps",
        ):
            value = getattr(self, name)
            _check(_finite(value) and value >= 0, f"{name} out of range")
        for name in ("gate_base_m", "max_gap_s", "assumed_clear_min_range_m"):
            value = getattr(self, name)
            _check(_finite(value) and value > 0, f"{name} out of range")
        _check(1 <= self.release_misses <= 32, "release_misses out of range")
        _check(self.max_tracks is None or 1 <= self.max_tracks <= 1024, "max_tracks out of range")

    @property
    def longest_window(self) -> int:
        return max(
            self.confirm_window, self.gauge_confirm_window,
            self.far_confirm_window, self.outer_confirm_window,
        )


@dataclass(frozen=True)
class CloudLimits:
    """Limits of a cloud message; none unless a profile sets them."""

    max_points: int | None = None
    max_cloud_bytes: int | None = None

    def __post_init__(self):
        _check(
            self.max_points is None or 1 <= self.max_points <= MAX_POINT_LIMIT,
            "max_points must be in [1, 10000000]",
        )
        _check(
            self.max_cloud_bytes is None or 1 <= self.max_cloud_bytes <= MAX_CLOUD_BYTE_LIMIT,
            "max_cloud_bytes must be in [1, 1073741824]",
        )


@dataclass(frozen=True)
class Profile:
    """One sensor profile: mounting, calibration flags, detector and decision parameters."""

    source_frame_mode: str = "exact"
    source_frame: str | None = None
    target_frame: str = "target"
    calibration_verified: bool = False
    allow_unverified_calibration: bool = False
    translation: tuple = (0.0, 0.0, 0.0)
    rotation: tuple = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)
    has_transform: bool = False
    detector: DetectorConfig = field(default_factory=DetectorConfig)
    temporal: TemporalConfig = field(default_factory=TemporalConfig)

    @property
    def working_range_m(self) -> float | None:
        """Far end of the detection zone; none when the profile stops unverified frames."""
        if not self.calibration_verified and not self.allow_unverified_calibration:
            return None
        return float(self.detector.detection_roi.high[0])


def rotation_from_rpy(roll: float, pitch: float, yaw: float) -> tuple:
    """Row-major rotation matrix Rz(yaw) Ry(pitch) Rx(roll)."""
    cr, sr, cp, sp = math.cos(roll), math.sin(roll), math.cos(pitch), math.sin(pitch)
    cy, sy = math.cos(yaw), math.sin(yaw)
    return (
        cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr,
        sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr,
        -sp, cp * sr, cp * cr,
    )


def _typed(cls, section: dict, where: str):
    """Dataclass from a YAML mapping with strict names and types."""
    known = {f.name: f for f in fields(cls)}
    values = {}
    for name, value in (section or {}).items():
        _check(name in known, f"Unknown key {where}.{name}")
        kind = type(known[name].default)
        if kind is bool:
            _check(isinstance(value, bool), f"{where}.{name} must be true or false")
        elif kind is int:
            _check(isinstance(value, int) and not isinstance(value, bool),
                   f"{where}.{name} must be an integer")
            _check(value >= 0, f"{where}.{name} must not be negative")
        else:
            _check(isinstance(value, (int, float)) and not isinstance(value, bool),
                   f"{where}.{name} must be a number")
            value = float(value)
        values[name] = value
    return cls(**values)


def profile_from_mapping(data: dict) -> Profile:
    _check(isinstance(data, dict), "Profile must be a mapping")
    detector = _typed(DetectorConfig, data.get("detector"), "detector")
    changes = {}
    if "blind_radius_m" in data:
        changes["blind_radius_m"] = float(data["blind_radius_m"])
    for name in ("geometry_roi", "detection_roi"):
        if name in data:
            roi = data[name]
            changes[name] = Box(tuple(map(float, roi["min"])), tuple(map(float, roi["max"])))
    mode = data.get("source_frame_mode", "exact")
    _check(mode in ("exact", "bind_first"), "source_frame_mode must be exact or bind_first")
    translation, rpy = data.get("translation_m"), data.get("rotation_rpy_rad")
    _check((translation is None) == (rpy is None), "Transform needs translation and rotation")
    for flag in ("calibration_verified", "allow_unverified_calibration"):
        _check(isinstance(data.get(flag, False), bool), f"{flag} must be true or false")
    return Profile(
        source_frame_mode=mode,
        source_frame=data.get("source_frame"),
        target_frame=data.get("target_frame", "target"),
        calibration_verified=data.get("calibration_verified", False),
        allow_unverified_calibration=data.get("allow_unverified_calibration", False),
        translation=tuple(map(float, translation)) if translation else (0.0, 0.0, 0.0),
        rotation=rotation_from_rpy(*map(float, rpy)) if rpy else Profile.rotation,
        has_transform=translation is not None,
        detector=replace(detector, **changes),
        temporal=_typed(TemporalConfig, data.get("temporal"), "temporal"),
    )


def load_profile(path: str) -> Profile:
    with open(path) as stream:
        return profile_from_mapping(yaml.safe_load(stream) or {})


def override_profile(data: dict, overrides: list[str]) -> dict:
    """Copy of a profile mapping with ``section.key=value`` patches (detector by default)."""
    patched = copy.deepcopy(data)
    for item in overrides:
        key, found, value = item.partition("=")
        _check(bool(found and key), f"Override is not KEY=VALUE: {item}")
        section, _, name = key.rpartition(".")
        patched.setdefault(section or "detector", {})[name] = yaml.safe_load(value)
    return patched
