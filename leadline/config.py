"""Settings of the engine, as parameters of plans."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields

MODEL_VERSION = 5


@dataclass(frozen=True)
class Config:
    """Defaults and clamps of every setting that a computation reads. Times are in the unit of their name."""

    position_sigma_m: float = 3.0
    velocity_sigma_mps: float = 0.3
    motion_max_age_s: float = 2.0
    attitude_max_age_s: float = 0.5
    attitude_sigma_deg: float = 2.0
    beam_width_deg: float = 20.0
    depth_sigma_m: float = 0.2
    offset_sigma_m: float = 0.1
    tide_sigma_m: float = 0.25
    tide_max_age_s: float = 900.0
    max_interval_s: float = 1.0
    distance_m: float = 2.0
    minimum_speed_mps: float = 0.25
    stationary_radius_m: float = 3.0
    stationary_window_s: float = 60.0
    stationary_min_samples: int = 10
    max_live_skew_s: float = 2.0
    segment_gap_s: float = 300.0
    instrument_min_m: float = 0.4
    instrument_max_m: float = 120.0
    base_cell_m: float = 5.0
    surface_to_keel_m: float = 1.5
    surface_to_transducer_m: float = 0.5
    danger_under_keel_m: float = 0.75
    recency_half_life_days: float = 365.0
    mad_multiplier: float = 4.5
    outlier_floor_m: float = 0.5
    change_min_passes: int = 3
    change_min_days: float = 2.0
    target_datum: str = "MLLW"
    tide_station_id: str = ""
    tide_station_name: str = ""
    min_zoom: int = 8
    max_zoom: int = 24
    batch_size: int = 20
    flush_interval_ms: int = 1000
    history_resolution_s: int = 1
    auto_backfill_days: float = 30.0
    auto_backfill_delay_s: float = 15.0
    display_depth: str = "predicted"
    show_depth_labels: bool = True
    depth_label_relative_size: float = 1.0
    overlay_opacity: float = 0.7
    mount_roll_deg: float = 0.0
    mount_pitch_deg: float = 0.0
    attitude_correction: bool = False

    def __post_init__(self) -> None:
        defaults = {f.name: f.default for f in fields(self)}

        def put(name: str, value) -> None:
            object.__setattr__(self, name, value)

        def number(name: str, ok) -> float:
            v = getattr(self, name)
            return v if isinstance(v, int | float) and math.isfinite(v) and ok(v) else defaults[name]

        for name in ("position_sigma_m", "velocity_sigma_mps", "motion_max_age_s", "attitude_max_age_s", "attitude_sigma_deg", "beam_width_deg", "max_live_skew_s", "base_cell_m", "max_interval_s", "distance_m", "stationary_window_s"):
            put(name, number(name, lambda v: v > 0))
        for name in ("surface_to_keel_m", "surface_to_transducer_m", "danger_under_keel_m"):
            put(name, number(name, lambda v: v >= 0))
        put("beam_width_deg", min(90.0, self.beam_width_deg))
        put("history_resolution_s", max(1, min(60, _round(number("history_resolution_s", lambda v: v > 0)))))
        put("flush_interval_ms", _round(number("flush_interval_ms", lambda v: v > 0)))
        put("batch_size", _round(number("batch_size", lambda v: v > 0)))
        put("stationary_min_samples", max(3, _round(self.stationary_min_samples)))
        put("change_min_passes", max(1, _round(self.change_min_passes)))
        put("change_min_days", max(0.0, self.change_min_days))
        put("overlay_opacity", min(1.0, max(0.0, self.overlay_opacity)))
        put("depth_label_relative_size", min(2.0, max(0.5, self.depth_label_relative_size)))
        put("auto_backfill_days", min(31, max(1, self.auto_backfill_days)))
        put("auto_backfill_delay_s", min(600, max(0, self.auto_backfill_delay_s)))
        put("min_zoom", _round(min(22, max(0, self.min_zoom))))
        put("max_zoom", _round(min(24, max(self.min_zoom, self.max_zoom))))
        put("target_datum", (self.target_datum or "").strip().upper() or defaults["target_datum"])
        if self.display_depth not in ("conservative", "predicted"):
            put("display_depth", defaults["display_depth"])
        if self.instrument_max_m <= self.instrument_min_m:
            put("instrument_max_m", defaults["instrument_max_m"])


#: Settings that clients may see: what is shown and how, and what it was computed with.
PUBLIC = ("target_datum", "base_cell_m", "min_zoom", "max_zoom", "display_depth", "show_depth_labels", "depth_label_relative_size", "overlay_opacity", "surface_to_keel_m", "surface_to_transducer_m", "danger_under_keel_m", "recency_half_life_days", "attitude_correction", "beam_width_deg")


def public_settings(config: Config) -> dict:
    """The settings that clients may see, with the model's version."""
    return {name: getattr(config, name) for name in PUBLIC} | {"model_version": MODEL_VERSION}


def _round(x: float) -> int:
    """Half up, as everywhere in the engine."""
    return math.floor(x + 0.5)


def depth_reference(path: str) -> str:
    """What a depth path measures from, by its last part; other paths are an error."""
    last = path.rsplit(".", 1)[-1]
    if last not in ("belowSurface", "belowTransducer", "belowKeel") or "." not in path:
        raise ValueError(f"not a depth path: {path}")
    return last
