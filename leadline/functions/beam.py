"""Attitude and beam geometry of a sounding, as Column expressions.

Vectors are (forward, starboard, down). Angles are radians.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadline.config import Config
from leadline.functions.geo import destination
from leadline.functions.numbers import ColumnOrName, Plain, c, hypot3, of

Vector = tuple[Column, Column, Column]

#: Roll or pitch beyond this is no attitude of a vessel under way.
MOST_TILT = math.radians(60)


def rotate(v: tuple[ColumnOrName | float, ColumnOrName | float, ColumnOrName | float], roll: ColumnOrName | float, pitch: ColumnOrName | float, m=F) -> Vector:
    """A vector of the hull in level axes: roll about the keel first, then pitch. ``m``: F, or Plain for numbers."""
    forward, starboard, down = (of(m, x) for x in v)
    r, p = of(m, roll), of(m, pitch)
    side = m.cos(r) * starboard - m.sin(r) * down
    lowered = m.sin(r) * starboard + m.cos(r) * down
    return m.cos(p) * forward + m.sin(p) * lowered, side, m.cos(p) * lowered - m.sin(p) * forward


@dataclass(frozen=True)
class Installation:
    """Where the transducer is: its mount's angles and the levers from antenna and from the motion's origin, in metres."""

    mount_roll: float = 0.0
    mount_pitch: float = 0.0
    antenna: tuple[float | None, float | None, float | None] = (None, None, None)
    origin: tuple[float | None, float | None, float | None] = (None, None, None)
    verified: bool = False

    @property
    def levers(self) -> tuple[tuple[float, ...], tuple[float, ...]]:
        """Both levers; none unless verified and all six parts are finite."""
        parts = (*self.antenna, *self.origin)
        if not self.verified or not all(x is not None and math.isfinite(x) for x in parts):
            return (0.0, 0.0, 0.0), (0.0, 0.0, 0.0)
        return self.antenna, self.origin


def _parts(m, rng, roll, pitch, h, lat, lon, position_sigma_m, config: Config, at: Installation) -> dict:
    """What a slant range says under an attitude, and ``edge``, the angle of its cone's outer edge from straight down."""
    angle, half = math.radians(config.attitude_sigma_deg), math.radians(config.beam_width_deg) / 2
    beam_f, beam_s, beam_d = rotate(rotate((0.0, 0.0, 1.0), at.mount_roll, at.mount_pitch, m), roll, pitch, m)
    tilt = m.acos(m.least(m.lit(1.0), m.greatest(m.lit(-1.0), beam_d)))
    antenna, origin = at.levers
    lever_f, lever_s, _ = rotate(antenna, roll, pitch, m)
    draft = rotate(origin, roll, pitch, m)[2] - m.lit(float(origin[2]))
    forward, starboard = lever_f + rng * beam_f, lever_s + rng * beam_s
    east, north = forward * m.sin(h) + starboard * m.cos(h), forward * m.cos(h) - starboard * m.sin(h)
    lat2, lon2 = destination(lat, lon, east, north, m)
    long_lever, long_origin = (math.sqrt(sum(x * x for x in v)) for v in (antenna, origin))
    cone = rng * m.greatest(m.abs(m.cos(m.greatest(m.lit(0.0), tilt - half)) - beam_d), m.abs(m.cos(tilt + half) - beam_d))
    return {
        "vertical_m": rng * beam_d,
        "surface_offset_m": m.lit(config.surface_to_transducer_m) + draft,
        "east_m": east,
        "north_m": north,
        "latitude": lat2,
        "longitude": lon2,
        "horizontal_sigma_m": hypot3(position_sigma_m, rng * math.sin(half), (rng + long_lever) * angle, m=m),
        "vertical_sigma_m": hypot3(cone, (rng * m.sin(tilt) + long_origin) * angle, m=m),
        "edge": tilt + half,
    }


def _installed(config: Config) -> Installation:
    return Installation(math.radians(config.mount_roll_deg), math.radians(config.mount_pitch_deg))


def correct(range_m: ColumnOrName, roll: ColumnOrName, pitch: ColumnOrName, heading: ColumnOrName, lat: ColumnOrName, lon: ColumnOrName, position_sigma_m: ColumnOrName | float, config: Config, installation: Installation | None = None) -> Column:
    """What a slant range under this attitude says, as a struct; null where it says nothing.

    Fields: vertical_m, surface_offset_m, east_m, north_m, latitude, longitude, horizontal_sigma_m,
    vertical_sigma_m. Nothing is said by a tilt over 60 degrees, a cone that reaches the horizon, a range of 0
    or less, or a missing value.
    """
    rng = c(range_m)
    parts = _parts(F, rng, c(roll), c(pitch), c(heading), c(lat), c(lon), position_sigma_m, config, installation or _installed(config))
    edge = parts.pop("edge")
    given = rng.isNotNull() & c(roll).isNotNull() & c(pitch).isNotNull() & c(heading).isNotNull() & c(lat).isNotNull() & c(lon).isNotNull()
    sound = (F.abs(c(roll)) <= MOST_TILT) & (F.abs(c(pitch)) <= MOST_TILT) & (rng > 0) & (rng < float("inf")) & (edge < math.pi / 2)
    return F.when(given & sound, F.struct(*[v.alias(k) for k, v in parts.items()]))


def correct_one(range_m: float, roll: float, pitch: float, heading: float, lat: float, lon: float, position_sigma_m: float, config: Config, installation: Installation | None = None) -> dict | None:
    """The same of plain numbers, for state that goes from reading to reading."""
    if not (abs(roll) <= MOST_TILT and abs(pitch) <= MOST_TILT and 0 < range_m < math.inf and math.isfinite(heading)):
        return None
    parts = _parts(Plain, range_m, roll, pitch, heading, lat, lon, position_sigma_m, config, installation or _installed(config))
    return parts if parts.pop("edge") < math.pi / 2 else None
