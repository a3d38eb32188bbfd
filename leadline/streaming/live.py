"""Live soundings: a vessel's channels are paired in event time as they arrive, with typed state by context.

What depends on the order of arrival is done by one stateful operator, ``paired``: which fix, tide, speed and
attitude belong to a depth, whether the vessel rests, which points are kept. Its buffers are bounded (1000
depths, 256 fixes, a window at rest). All else is columns over its rows, the same that history uses: raw
observations for the journal with their flags (``observations``), soundings as they are stored, with pass,
cell and fingerprint (``stored``). ``record`` runs both into a surface and a journal.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Callable, Iterator
from statistics import median
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from leadline.config import Config
from leadline.functions.beam import Installation, correct_one
from leadline.functions.depth import SKEW_M_PER_S, SURFACE_METHODS, reference_offset_m
from leadline.functions.geo import destination, hex_cell, mercator_x, mercator_y, wrap_degrees
from leadline.functions.numbers import MAD_TO_SIGMA, Plain
from leadline.operators.folds import great_circle_m
from leadline.operators.listing import fixed_point, sounding_fingerprint
from leadline.operators.rest import pass_id
from leadline.sources import journal as journal_source
from leadline.streaming.cells import Surface

MOST_WAITING, MOST_FIXES, HEAVE_MS = 1000, 256, 5000

#: A reading: position has latitude and longitude, attitude roll and pitch, the others a value.
READING = "context string, path string, at_ms long, received_ms long, source string, value double, latitude double, longitude double, roll double, pitch double, has_time boolean"


class Fix(NamedTuple):
    at_ms: int
    latitude: float
    longitude: float
    source: str
    has_time: bool


class Value(NamedTuple):
    """The newest of a channel; ``other`` is an attitude's pitch."""

    path: str
    at_ms: int
    value: float
    other: float
    source: str


class Ping(NamedTuple):
    """A depth that waits, with what was known when it came: (time, value) of speed and course, attitude and heading."""

    at_ms: int
    received_ms: int
    raw_m: float
    source: str
    tide_m: float
    tide_at_ms: int
    sog_at_ms: int | None
    sog: float | None
    cog_at_ms: int | None
    cog: float | None
    attitude_at_ms: int | None
    roll: float | None
    pitch: float | None
    heading_at_ms: int | None
    heading: float | None


class Place(NamedTuple):
    """A position at a time; fix_ms is the fix that it rests on."""

    latitude: float
    longitude: float
    sigma_m: float
    skew_ms: int
    method: str
    source: str
    fix_ms: int


class Track(NamedTuple):
    """What is carried from sounding to sounding."""

    number: int = 0
    done_ms: int | None = None
    depth_ms: int | None = None
    depth_source: str | None = None
    kept_ms: int | None = None
    kept_lat: float | None = None
    kept_lon: float | None = None
    anchor_lat: float | None = None
    anchor_lon: float | None = None
    anchor_sigma_m: float | None = None
    away: int = 0
    seen_fix_ms: int | None = None


_SAMPLE = (
    "observed_at_ms long, received_at_ms long, latitude double, longitude double, raw_m double, tide_m double, tide_at_ms long, datum_m double, surface_offset_m double, vertical_sigma_m double, horizontal_sigma_m double, "
    "input_time_skew_ms long, position_method string, position_source string, depth_source string, geometry string, sog_mps double, cog_rad double, heave_m double, aggregation_kind string, sample_count long, rejected_sample_count long, window_start_ms long, window_end_ms long, track long"
)
#: Rows of three kinds: sounding, raw (a depth as it came, with what was known then) and withheld (with geometry position or attitude).
PAIRED = f"kind string, context string, {_SAMPLE}, fix_at_ms long, fix_has_time boolean, has_time boolean, tide_stale boolean, tide_source string, attitude_at_ms long, roll double, pitch double, attitude_source string, heading_at_ms long, heading double, heading_source string"
_STATE = {
    "fixes": (Fix, "at_ms long, latitude double, longitude double, source string, has_time boolean"),
    "latest": (Value, "path string, at_ms long, value double, other double, source string"),
    "waiting": (Ping, "at_ms long, received_ms long, raw_m double, source string, tide_m double, tide_at_ms long, sog_at_ms long, sog double, cog_at_ms long, cog double, attitude_at_ms long, roll double, pitch double, heading_at_ms long, heading double"),
    "resting": (None, _SAMPLE),
    "track": (Track, "number long, done_ms long, depth_ms long, depth_source string, kept_ms long, kept_lat double, kept_lon double, anchor_lat double, anchor_lon double, anchor_sigma_m double, away long, seen_fix_ms long"),
}


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _spread(xs: list[float]) -> float:
    """Robust sigma of plain numbers."""
    mid = median(xs)
    return 0.0 if len(xs) < 2 else MAD_TO_SIGMA * median([abs(x - mid) for x in xs])


class Vessel:
    """One context's state, and the rows that a reading or the passing of time make of it."""

    def __init__(self, config: Config, reference: str = "belowTransducer", installation: Installation | None = None):
        self.config, self.reference, self.installation = config, reference, installation
        self.offset_m = {"belowSurface": 0.0, "belowKeel": config.surface_to_keel_m, "belowTransducer": config.surface_to_transducer_m}[reference]
        self.fixes: list[Fix] = []
        self.latest: dict[str, Value] = {}
        self.waiting: list[Ping] = []
        self.resting: list[dict] = []
        self.track = Track()

    def read(self, path: str, at_ms: int, received_ms: int, source: str, value: float = math.nan, other: float = math.nan, has_time: bool = True) -> list[dict]:
        """Takes a reading: of a position latitude and longitude, of an attitude roll and pitch."""
        out: list[dict] = []
        known = self.latest.get(path)
        if path == "position":
            self._fix(Fix(at_ms, value, other, source, has_time))
        elif path == "depth":
            if math.isfinite(value):
                out.append(self._raw(at_ms, received_ms, source, value, has_time))
                self._wait(at_ms, received_ms, source, value)
        elif math.isfinite(value) and (path != "attitude" or math.isfinite(other)) and not (path == "sog" and value < 0):
            # tide and heave are as they came last, the others as they were observed last
            if known is None or path in ("tide", "heave") or at_ms >= known.at_ms:
                self.latest[path] = Value(path, at_ms, value, other, source)
        return out + self.settle(received_ms)

    def _fix(self, fix: Fix) -> None:
        last = self.fixes[-1] if self.fixes else None
        if last and fix.at_ms <= last.at_ms:
            return
        if last and (fix.source != last.source or fix.at_ms - last.at_ms > self.config.segment_gap_s * 1000):
            # another receiver, or a gap: nothing is carried over
            self.fixes, self.waiting, self.resting = [], [], []
            self.track = Track(number=self.track.number + 1, done_ms=self.track.done_ms, depth_ms=self.track.depth_ms, depth_source=self.track.depth_source)
        oldest = fix.at_ms - max(10_000, 4000 * self.config.max_live_skew_s)
        self.fixes = [*[f for f in self.fixes if f.at_ms >= oldest][1 - MOST_FIXES :], fix]

    def _raw(self, at_ms: int, received_ms: int, source: str, depth: float, has_time: bool) -> dict:
        """The depth as it came, before any gate."""
        fix, tide = self.fixes[-1] if self.fixes else None, self.latest.get("tide")
        row = {"kind": "raw", "observed_at_ms": at_ms, "received_at_ms": received_ms, "raw_m": depth, "depth_source": source, "surface_offset_m": self.offset_m, "has_time": has_time}
        if fix:
            row |= {"latitude": fix.latitude, "longitude": fix.longitude, "position_source": fix.source, "fix_at_ms": fix.at_ms, "fix_has_time": fix.has_time}
        if tide:
            row |= {"tide_m": tide.value, "tide_at_ms": tide.at_ms, "tide_stale": not self._fresh(tide.at_ms, at_ms, self.config.tide_max_age_s), "tide_source": tide.source}
        if turn := self.latest.get("attitude"):
            row |= {"attitude_at_ms": turn.at_ms, "roll": turn.value, "pitch": turn.other, "attitude_source": turn.source}
        if heading := self.latest.get("heading"):
            row |= {"heading_at_ms": heading.at_ms, "heading": heading.value, "heading_source": heading.source}
        return row

    @staticmethod
    def _fresh(of_ms: int | None, at_ms: int, most_s: float) -> bool:
        return of_ms is not None and abs(at_ms - of_ms) <= most_s * 1000

    def _wait(self, at_ms: int, received_ms: int, source: str, depth: float) -> None:
        c, tide = self.config, self.latest.get("tide")
        late = self.track.done_ms is not None and at_ms <= self.track.done_ms
        if late or not c.instrument_min_m <= depth <= c.instrument_max_m or tide is None or not self._fresh(tide.at_ms, at_ms, c.tide_max_age_s):
            return
        of = lambda path: (v.at_ms, v.value) if (v := self.latest.get(path)) else (None, None)
        ping = Ping(at_ms, received_ms, depth, source, tide.value, tide.at_ms, *of("sog"), *of("cog"), None, None, None, None, None)
        self.waiting = sorted([*self.waiting, self._with_attitude(ping)], key=lambda p: p.at_ms)[-MOST_WAITING:]

    def _with_attitude(self, p: Ping) -> Ping:
        """The ping with the newest attitude and heading where they are nearer in time than those it has."""
        turn, heading = self.latest.get("attitude"), self.latest.get("heading")
        nearer = lambda v, has: v is not None and (has is None or abs(v.at_ms - p.at_ms) < abs(has - p.at_ms))
        if nearer(turn, p.attitude_at_ms):
            p = p._replace(attitude_at_ms=turn.at_ms, roll=turn.value, pitch=turn.other)
        return p._replace(heading_at_ms=heading.at_ms, heading=heading.value) if nearer(heading, p.heading_at_ms) else p

    def settle(self, now_ms: int, end: bool = False) -> list[dict]:
        """Soundings of the depths that have what they need, or have waited for it as long as they may; in order of time."""
        out: list[dict] = []
        self.waiting = [self._with_attitude(p) for p in self.waiting]
        while self.waiting:
            p = self.waiting[0]
            late = end or now_ms - p.received_ms >= self.config.max_live_skew_s * 1000
            place = self._place(p, late)
            if not late and (place is None or self.config.attitude_correction and not self._turned(p)):
                break
            self.waiting.pop(0)
            if place is None:
                out.append({"kind": "withheld", "observed_at_ms": p.at_ms, "geometry": "position"})
            elif self.track.done_ms is None or p.at_ms > self.track.done_ms:
                self.track = self.track._replace(done_ms=p.at_ms)
                out += self._sounding(p, place)
        return out

    def _turned(self, p: Ping) -> bool:
        age = self.config.attitude_max_age_s
        return self._fresh(p.attitude_at_ms, p.at_ms, age) and self._fresh(p.heading_at_ms, p.at_ms, age)

    def _place(self, p: Ping, carry: bool) -> Place | None:
        """Where the vessel was: at a fix, between two, or carried on from the last one by fresh speed and course."""
        c, t = self.config, p.at_ms
        k, most = bisect_left(self.fixes, t, key=lambda f: f.at_ms), c.max_live_skew_s * 1000
        after, before = self.fixes[k] if k < len(self.fixes) else None, self.fixes[k - 1] if k else None
        if after and after.at_ms == t:
            return Place(after.latitude, after.longitude, c.position_sigma_m, 0, "exact", after.source, t)
        if before is None or t - before.at_ms > most:
            return None
        back = t - before.at_ms
        if after and after.at_ms - t <= most:
            skew, share = max(back, after.at_ms - t), back / (after.at_ms - before.at_ms)
            lat = before.latitude + (after.latitude - before.latitude) * share
            lon = wrap_degrees(before.longitude + wrap_degrees(after.longitude - before.longitude) * share)
            return Place(lat, lon, math.hypot(c.position_sigma_m, c.velocity_sigma_mps * skew / 1000), skew, "interpolated", after.source, after.at_ms)
        moving = self._fresh(p.sog_at_ms, t, c.motion_max_age_s) and (p.sog == 0 or self._fresh(p.cog_at_ms, t, c.motion_max_age_s))
        if not carry or not moving:
            return None
        way, course = p.sog * back / 1000, p.cog if p.sog else 0.0
        lat, lon = destination(before.latitude, before.longitude, way * math.sin(course), way * math.cos(course), Plain)
        return Place(lat, lon, math.hypot(c.position_sigma_m, c.velocity_sigma_mps * back / 1000, way), back, "projected", before.source, before.at_ms)

    def _sounding(self, p: Ping, place: Place) -> list[dict]:
        c, t, track = self.config, p.at_ms, self.track
        if track.depth_ms is not None and (track.depth_source != p.source or t - track.depth_ms > c.segment_gap_s * 1000):
            track, self.resting = track._replace(number=track.number + 1, anchor_lat=None, anchor_lon=None, anchor_sigma_m=None, away=0), []
        self.track = track._replace(depth_ms=t, depth_source=p.source)
        beam = None
        if c.attitude_correction:
            if self.reference == "belowTransducer" and self._turned(p):
                beam = correct_one(p.raw_m, p.roll, p.pitch, p.heading, place.latitude, place.longitude, place.sigma_m, c, self.installation)
            if beam is None:
                return [{"kind": "withheld", "observed_at_ms": t, "geometry": "attitude"}]
        seen = beam or {"vertical_m": p.raw_m, "surface_offset_m": self.offset_m, "latitude": place.latitude, "longitude": place.longitude, "horizontal_sigma_m": place.sigma_m, "vertical_sigma_m": 0.0}
        heave, sog, cog = self.latest.get("heave"), self._fresh(p.sog_at_ms, t, c.motion_max_age_s), self._fresh(p.cog_at_ms, t, c.motion_max_age_s)
        row = {
            "kind": "sounding", "observed_at_ms": t, "received_at_ms": p.received_ms, "latitude": seen["latitude"], "longitude": seen["longitude"], "raw_m": p.raw_m, "tide_m": p.tide_m, "tide_at_ms": p.tide_at_ms,
            "datum_m": seen["vertical_m"] + seen["surface_offset_m"] - p.tide_m, "surface_offset_m": seen["surface_offset_m"],
            "vertical_sigma_m": math.hypot(c.depth_sigma_m, c.offset_sigma_m, c.tide_sigma_m, place.skew_ms / 1000 * SKEW_M_PER_S, seen["vertical_sigma_m"]), "horizontal_sigma_m": seen["horizontal_sigma_m"],
            "input_time_skew_ms": place.skew_ms, "position_method": place.method, "position_source": place.source, "depth_source": p.source, "geometry": SURFACE_METHODS[0] if beam else "uncorrected",
            "sog_mps": p.sog if sog else None, "cog_rad": p.cog if cog else None, "heave_m": heave.value if heave and abs(t - heave.at_ms) <= HEAVE_MS else None,
            "aggregation_kind": "point", "sample_count": 1, "rejected_sample_count": 0, "window_start_ms": t, "window_end_ms": t, "track": self.track.number,
        }
        if self._moves(t, place, p.sog if sog else None):
            self.resting = []  # a window that motion breaks off is no sounding
            return self._point(row, place)
        self.resting.append(row)
        if t - self.resting[0]["observed_at_ms"] < c.stationary_window_s * 1000:
            return []
        one, self.resting = self._window(self.resting), []
        if one is None:
            return []
        self.track = self.track._replace(kept_ms=one["observed_at_ms"], kept_lat=one["latitude"], kept_lon=one["longitude"])
        return [one]

    def _moves(self, t: int, place: Place, sog: float | None) -> bool:
        """Speed, or three new fixes in a row out of the anchor's reach, as in ``folds.under_way``."""
        c, k = self.config, self.track
        if k.anchor_lat is None:
            k = k._replace(anchor_lat=place.latitude, anchor_lon=place.longitude, anchor_sigma_m=place.sigma_m)
        if sog is not None and sog >= c.minimum_speed_mps:
            self.track = k._replace(away=0)
            return True
        if place.fix_ms != k.seen_fix_ms:
            reach = c.stationary_radius_m + 2 * math.hypot(k.anchor_sigma_m, place.sigma_m)
            far = great_circle_m(k.anchor_lat, k.anchor_lon, place.latitude, place.longitude) > reach
            k = k._replace(away=k.away + 1 if far else 0, seen_fix_ms=place.fix_ms)
        self.track = k
        return k.away >= 3

    def _point(self, row: dict, place: Place) -> list[dict]:
        """The row if it is late or far enough after the last one kept. Motion is the vessel's, not that of the beam's foot."""
        c, k = self.config, self.track
        if k.kept_ms is not None and row["observed_at_ms"] - k.kept_ms < c.max_interval_s * 1000 and great_circle_m(k.kept_lat, k.kept_lon, place.latitude, place.longitude) < c.distance_m:
            return []
        self.track = k._replace(kept_ms=row["observed_at_ms"], kept_lat=place.latitude, kept_lon=place.longitude, anchor_lat=place.latitude, anchor_lon=place.longitude, anchor_sigma_m=place.sigma_m)
        return [row]

    def _window(self, rows: list[dict]) -> dict | None:
        """A window at rest as one sounding, as in ``rest.reduce_windows``; None if too few samples agree."""
        c = self.config
        depths = [r["datum_m"] for r in rows]
        gate, mid = max(c.outlier_floor_m, c.mad_multiplier * _spread(depths)), median(depths)
        kept = [r for r in rows if abs(r["datum_m"] - mid) <= gate]
        if len(kept) < c.stationary_min_samples:
            return None
        m = {n: median([r[n] for r in kept]) for n in ("latitude", "longitude", "raw_m", "tide_m", "datum_m", "input_time_skew_ms")}
        first, last = rows[0]["observed_at_ms"], rows[-1]["observed_at_ms"]
        parts = min(10, max(1, (last - first) // 10_000 + 1))
        variance = (c.depth_sigma_m**2 + _spread([r["datum_m"] for r in kept]) ** 2) / parts + c.offset_sigma_m**2 + c.tide_sigma_m**2 + (m["input_time_skew_ms"] / 1000 * SKEW_M_PER_S) ** 2
        corrected = [r["vertical_sigma_m"] ** 2 for r in kept if r["geometry"] != "uncorrected"]
        away = max(great_circle_m(m["latitude"], m["longitude"], r["latitude"], r["longitude"]) for r in kept)
        return kept[len(kept) // 2] | m | {
            "observed_at_ms": last, "input_time_skew_ms": math.floor(m["input_time_skew_ms"] + 0.5), "vertical_sigma_m": math.sqrt(max([variance, *corrected])), "horizontal_sigma_m": math.hypot(max(r["horizontal_sigma_m"] for r in kept), away),
            "geometry": SURFACE_METHODS[1], "aggregation_kind": SURFACE_METHODS[1], "sample_count": len(kept), "rejected_sample_count": len(rows) - len(kept), "window_start_ms": first, "window_end_ms": last,
        }

    def state(self) -> dict[str, list[tuple]]:
        """The state as rows of the tables of ``_STATE``."""
        names = _names(_SAMPLE)
        return {"fixes": [*self.fixes], "latest": [*self.latest.values()], "waiting": [*self.waiting], "resting": [tuple(r[n] for n in names) for r in self.resting], "track": [self.track]}

    def restore(self, rows: dict[str, list[tuple]]) -> Vessel:
        if rows["track"]:
            names = _names(_SAMPLE)
            self.fixes, self.waiting, self.track = [Fix(*r) for r in rows["fixes"]], [Ping(*r) for r in rows["waiting"]], Track(*rows["track"][0])
            self.latest = {r[0]: Value(*r) for r in rows["latest"]}
            self.resting = [{"kind": "sounding"} | dict(zip(names, r, strict=True)) for r in rows["resting"]]
        return self


class _Live(StatefulProcessor):
    def __init__(self, *settings):
        self.settings = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tables = {name: handle.getListState(name, schema) for name, (_, schema) in _STATE.items()}

    def _vessel(self) -> Vessel:
        return Vessel(*self.settings).restore({n: [*t.get()] if t.exists() else [] for n, t in self.tables.items()})

    def _out(self, context: str, vessel: Vessel, rows: list[dict]) -> Iterator[pd.DataFrame]:
        for name, content in vessel.state().items():
            if content:
                self.tables[name].put([tuple(r) for r in content])
            else:
                self.tables[name].clear()
        if rows:
            names = _names(PAIRED)
            yield pd.DataFrame([[({"context": context} | r).get(n) for n in names] for r in rows], columns=names, dtype=object)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        vessel, out = self._vessel(), []
        for pdf in rows:
            for r in pdf.sort_values(["received_ms", "at_ms"], kind="stable").to_dict("records"):
                first, second = {"position": ("latitude", "longitude"), "attitude": ("roll", "pitch")}.get(r["path"], ("value", "value"))
                out += vessel.read(r["path"], int(r["at_ms"]), int(r["received_ms"]), r["source"], r[first], r[second], bool(r["has_time"]))
        if vessel.waiting:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.settings[0].max_live_skew_s * 1000))
        yield from self._out(key[0], vessel, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        vessel = self._vessel()
        yield from self._out(key[0], vessel, vessel.settle(timerValues.getCurrentProcessingTimeInMs()))

    def close(self) -> None:
        pass


#: Columns of paired rows that soundings don't have.
RAW_ONLY = ("kind", "fix_at_ms", "fix_has_time", "has_time", "tide_stale", "tide_source", "attitude_at_ms", "roll", "pitch", "attitude_source", "heading_at_ms", "heading", "heading_source")


def paired(readings: DataFrame, config: Config, reference: str = "belowTransducer", installation: Installation | None = None) -> DataFrame:
    """A stream of ``PAIRED`` rows from a stream of ``READING`` rows. The state store must be RocksDB's."""
    return readings.groupBy("context").transformWithStateInPandas(_Live(config, reference, installation), PAIRED, "append", "processingTime")


def stored(rows: DataFrame, config: Config, reference: str = "belowTransducer") -> DataFrame:
    """The soundings among paired rows as a surface takes them: fixed point, datum, pass, cell, fingerprint, which is their id."""
    s = fixed_point(rows.filter("kind = 'sounding'")).withColumns({"tide_datum": F.lit(config.target_datum), "depth_reference": F.lit(reference), "track": F.concat_ws("-", "context", "track")})
    x, y = hex_cell(mercator_x(F.col("lon_e7") / 1e7), mercator_y(F.col("lat_e7") / 1e7), config.base_cell_m)
    at_rest = F.col("aggregation_kind") == SURFACE_METHODS[1]
    s = s.withColumns({"cell_x": x, "cell_y": y, "pass_id": F.when(at_rest, pass_id("observed_at_ms", "track", "stationary")).otherwise(pass_id("observed_at_ms", "track")), "fingerprint": sounding_fingerprint()})
    return s.withColumn("id", F.col("fingerprint")).drop(*RAW_ONLY)


def observations(rows: DataFrame, config: Config, reference: str = "belowTransducer", installation: Installation | None = None) -> DataFrame:
    """The raw depths among paired rows as a journal takes them, with what is wrong with each."""
    most = int(config.max_live_skew_s * 1000)
    flags = journal_source.quality_flags(~F.col("has_time"), F.col("observed_at_ms"), F.col("received_at_ms"), F.col("fix_at_ms"), ~F.col("fix_has_time"), F.col("raw_m"), config.instrument_min_m, config.instrument_max_m, most)
    place = F.when(F.col("fix_at_ms").isNotNull(), F.struct("latitude", "longitude", F.col("fix_at_ms").alias("timestamp_ms"), F.col("position_source").alias("source")))
    tide = F.when(F.col("tide_m").isNotNull(), F.struct(F.col("tide_m").alias("height_m"), F.lit(config.tide_sigma_m).alias("sigma_m"), F.lit(config.target_datum).alias("datum"), F.lit(config.tide_station_id or None).cast("string").alias("station_id"), F.lit(config.tide_station_name or None).cast("string").alias("station_name"), F.col("tide_source").alias("source"), F.lit("predicted").alias("method"), F.col("tide_at_ms").alias("timestamp_ms"), F.col("tide_stale").alias("stale")))
    turn = F.when(F.col("attitude_at_ms").isNotNull(), F.struct(F.col("roll").alias("roll_rad"), F.col("pitch").alias("pitch_rad"), F.col("attitude_source").alias("source"), F.col("attitude_at_ms").alias("timestamp_ms")))
    heading = F.when(F.col("heading_at_ms").isNotNull(), F.struct(F.col("heading").alias("heading_rad"), F.col("heading_source").alias("source"), F.col("heading_at_ms").alias("timestamp_ms")))
    return rows.filter("kind = 'raw'").select(
        "context", "observed_at_ms", "received_at_ms", F.when(F.col("has_time"), "instrument").otherwise("receipt").alias("timestamp_origin"), F.col("raw_m").alias("depth_m"), F.lit(reference).alias("depth_reference"), "depth_source",
        place.alias("position"), tide.alias("tide"), reference_offset_m(F.lit(reference), config).alias("surface_offset_m"),
        F.create_map(*[F.lit(x) for pair in installed(config, installation).items() for x in pair]).alias("installation"), flags.alias("quality"), turn.alias("attitude"), heading.alias("heading"),
    )


def installed(config: Config, installation: Installation | None) -> dict[str, str]:
    """How the instrument is mounted, as names and texts: what a later correction of raw depths has to know."""
    i = installation or Installation(config.mount_roll_deg, config.mount_pitch_deg)
    of = lambda levers: ",".join("" if x is None else str(x) for x in levers)
    return {
        "attitudeCorrection": str(config.attitude_correction).lower(), "beamWidthDegrees": str(config.beam_width_deg), "surfaceToTransducerM": str(config.surface_to_transducer_m), "surfaceToKeelM": str(config.surface_to_keel_m),
        "mountRollDegrees": str(i.mount_roll), "mountPitchDegrees": str(i.mount_pitch), "antennaM": of(i.antenna), "originM": of(i.origin), "offsetsVerified": str(i.verified).lower(),
    }


def withheld(rows: DataFrame) -> list:
    """Counts of paired rows: raw depths, soundings, and depths withheld for want of a position or of what geometry needs."""
    of = lambda kind, reason=None: F.count_if((F.col("kind") == kind) & (F.lit(True) if reason is None else F.col("geometry") == reason))
    return [of("raw").alias("raw"), of("sounding").alias("soundings"), of("withheld", "position").alias("withheld_position"), of("withheld", "attitude").alias("withheld_geometry")]


def record(readings: DataFrame, config: Config, surface: Surface, journal: journal_source.Journal, checkpoint: str, reference: str = "belowTransducer", installation: Installation | None = None, trigger: dict | None = None, told: Callable[[int, dict[str, int]], None] | None = None) -> StreamingQuery:
    """Runs readings into a surface of cells and a raw journal; both take each micro-batch once.

    ``told`` gets each batch's number and counts (``withheld``), observed while the journal takes it.
    """
    import time

    def both(rows: DataFrame, batch_id: int) -> None:
        rows, seen = rows.persist(), Observation()
        journal.add(observations(rows.observe(seen, *withheld(rows)), config, reference, installation), batch_id, checkpoint)
        surface.apply(stored(rows, config, reference), batch_id, int(time.time() * 1000), checkpoint)
        # a batch that the journal had before was not gone through again
        if told is not None and not journal.skipped:
            told(batch_id, seen.get)
        rows.unpersist()

    writer = paired(readings, config, reference, installation).writeStream.foreachBatch(both).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": f"{config.flush_interval_ms} milliseconds"})).start()


def readings_of(values: DataFrame, paths: dict[str, str], received_ms=None, datum: str | None = None, target_datum: str | None = None) -> DataFrame:
    """Flattened delta values as readings; ``paths`` maps their paths to channels, others are left out.

    Tides of another datum than the target say nothing here and are left out too.
    """
    from leadline.sources.deltas import position

    channel = F.create_map(*[F.lit(x) for pair in paths.items() for x in pair])[F.col("path")]
    lat, lon = position(F.col("value"))
    now = F.unix_millis(F.current_timestamp()) if received_ms is None else received_ms
    angle = lambda n: F.get_json_object("value", f"$.{n}").try_cast("double")
    has_time = F.col("has_time") if "has_time" in values.columns else F.lit(True)
    r = values.select("context", channel.alias("path"), "at_ms", now.alias("received_ms"), "source", F.col("value").try_cast("double").alias("value"), lat.alias("latitude"), lon.alias("longitude"), angle("roll").alias("roll"), angle("pitch").alias("pitch"), has_time.alias("has_time"))
    if datum is not None and target_datum is not None and datum.strip().upper() != target_datum:
        r = r.filter("path != 'tide'")
    whole = F.when(F.col("path") == "position", F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).when(F.col("path") == "attitude", F.col("roll").isNotNull() & F.col("pitch").isNotNull()).otherwise(F.col("value").isNotNull())
    return r.filter(F.col("path").isNotNull() & whole)
