"""The questions that clients ask, with checked parameters, as DataFrames; and the functions as SQL."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from leadline.config import Config, public_settings
from leadline.functions.geo import bbox_bounds
from leadline.operators import crowd, listing, places, surface
from leadline.plans import tiles

MOST_SOUNDINGS, MOST_POINTS, MOST_DAYS = 10_000, 100_000, 31


def check_bbox(bbox) -> tuple[float, float, float, float]:
    """(west, south, east, north): four finite numbers in order, on the globe."""
    box = tuple(float(x) for x in bbox)
    if len(box) != 4 or not all(map(math.isfinite, box)):
        raise ValueError("a box is four finite numbers")
    w, s, e, n = box
    if w > e or s > n or w < -180 or e > 180 or s < -90 or n > 90:
        raise ValueError("a box must be in order and on the globe")
    return box


def check_integer(name: str, value, low: int, high: int) -> int:
    if isinstance(value, bool) or int(value) != value or not low <= value <= high:
        raise ValueError(f"{name} must be a whole number from {low} to {high}")
    return int(value)


def check_tile(z, x, y) -> tuple[int, int, int]:
    z = check_integer("z", z, 0, 24)
    return z, check_integer("x", x, 0, 2**z - 1), check_integer("y", y, 0, 2**z - 1)


def check_span(from_ms: int, to_ms: int, days: int = MOST_DAYS) -> None:
    if not from_ms < to_ms or to_ms - from_ms > days * 86_400_000:
        raise ValueError(f"a range must be in order and at most {days} days")


@dataclass(frozen=True)
class Bathymetry:
    """Stored frames: soundings (with fixed-point columns), qc, cells, replacements (original_id), crowd points and files."""

    config: Config
    stored: DataFrame
    qc: DataFrame
    cells: DataFrame
    replaced: DataFrame
    points: DataFrame | None = None
    files: DataFrame | None = None

    def active(self) -> DataFrame:
        return surface.active_soundings(self.stored, self.replaced)

    def shown(self, as_of_ms: int) -> DataFrame:
        return surface.with_neighbours(surface.read_cells(self.cells, self.config, as_of_ms), self.config)

    def status(self) -> DataFrame:
        return listing.stats(self.stored, self.qc, self.cells, self.replaced)

    def soundings(self, bbox=None, from_ms: int | None = None, to_ms: int | None = None, state: str | None = None, limit: int = 1000) -> DataFrame:
        rows = self.active() if bbox is None else places.within(self.active(), check_bbox(bbox))
        return listing.listed(listing.soundings(rows, self.qc, None, from_ms, to_ms, state, check_integer("limit", limit, 1, MOST_SOUNDINGS)))

    def cells_in(self, bbox, as_of_ms: int, datum: str | None = None) -> DataFrame:
        return listing.shown_in(self.cells, bbox_bounds(check_bbox(bbox)), self.config, as_of_ms, datum)

    def cell_at(self, lat: float, lon: float, as_of_ms: int, datum: str | None = None) -> DataFrame:
        return listing.lookup(self.shown(as_of_ms), lat, lon, self.config, datum)

    def changes(self, as_of_ms: int, since_ms: int | None = None, limit: int = 1000) -> DataFrame:
        since = as_of_ms - 30 * 86_400_000 if since_ms is None else since_ms
        return listing.changes(surface.read_cells(self.cells, self.config, as_of_ms), since, self.config.target_datum, check_integer("limit", limit, 1, MOST_SOUNDINGS))

    def tile(self, z: int, x: int, y: int, as_of_ms: int, tide: tuple[float, float] | None = None, display: str | None = None, scale: float = 0.5) -> DataFrame:
        """One row with the tile's bytes, none if nothing is there."""
        rows = tiles.cell_rows(self.cells, self.config, *check_tile(z, x, y), as_of_ms, tide, display, scale)
        return tiles.encode_areas(rows, "datum" if tide is None else "water", display or self.config.display_depth, self.config.show_depth_labels)

    def sheet(self, from_zoom: int, to_zoom: int, as_of_ms: int, tide: tuple[float, float] | None = None, display: str | None = None, scale: float = 0.5) -> DataFrame:
        """All tiles of some zooms, a row each, as one job; tiles without cells have none."""
        zooms = range(check_integer("from_zoom", from_zoom, 0, 24), check_integer("to_zoom", to_zoom, from_zoom, 24) + 1)
        rows = tiles.sheet_rows(tiles.display_levels(self.shown(as_of_ms), self.config, zooms, tide, scale), self.config, zooms, tide, display, scale)
        return tiles.encode_areas(rows, "datum" if tide is None else "water", display or self.config.display_depth, self.config.show_depth_labels)

    def projection(self, tide: tuple[float, float], as_of_ms: int) -> DataFrame:
        """Cells with the depth of water at a tide, with and without its margin, and under the keel."""
        from pyspark.sql import functions as F

        from leadline.functions.depth import water_depth_m

        low = water_depth_m("render_m", "vertical_sigma_m", *tide)
        return self.shown(as_of_ms).withColumns({"projected_m": water_depth_m("render_m", "vertical_sigma_m", *tide, predicted=True), "conservative_projected_m": low, "under_keel_m": low - F.lit(self.config.surface_to_keel_m)})

    def journeys(self, **choice) -> DataFrame:
        return crowd.matching(crowd.journeys(self.points), **choice).orderBy("start_ms", "vessel_id")

    def journey(self, vessel: str, journey: str, after: int = 0, limit: int = 5000) -> DataFrame:
        return crowd.page(self.points, vessel, journey, after, check_integer("limit", limit, 1, MOST_POINTS))

    def crowd_soundings(self, bbox, limit: int = 10_000) -> DataFrame:
        return crowd.newest(places.within(self.points, check_bbox(bbox)), check_integer("limit", limit, 1, MOST_POINTS))

    def crowd_coverage(self, **choice) -> DataFrame:
        """One row: the bounds of the journeys that are chosen, and how many they are."""
        return crowd.bounds(crowd.matching(crowd.journeys(self.points), **choice))

    def revision(self) -> DataFrame:
        return listing.revision(self.cells)

    def settings(self) -> dict:
        return public_settings(self.config)

    def crowd_tile(self, z: int, x: int, y: int) -> DataFrame:
        return tiles.encode_points(tiles.point_rows(self.points, *check_tile(z, x, y)))

    def crowd_status(self) -> DataFrame:
        return crowd.stats(self.points, self.files)

    def reprocess(self, updated_at_ms: int) -> DataFrame:
        """All cells anew, from active soundings only."""
        return surface.build_cells(self.active(), self.config, updated_at_ms=updated_at_ms)


#: Functions for SQL users; bodies are plain SQL, so Catalyst inlines them.
SQL_FUNCTIONS = {
    "half_up(x DOUBLE) RETURNS BIGINT": "CAST(floor(x + 0.5) AS BIGINT)",
    "mercator_x(lon DOUBLE) RETURNS DOUBLE": "radians(lon) * 6378137.0D",
    "mercator_y(lat DOUBLE) RETURNS DOUBLE": "6378137.0D * ln(tan(pi() / 4 + radians(least(greatest(lat, -85.05112878D), 85.05112878D)) / 2))",
    "conservative_depth(render_m DOUBLE, sigma_m DOUBLE) RETURNS DOUBLE": "render_m - 1.645D * sigma_m",
    "datum_depth(raw_m DOUBLE, offset_m DOUBLE, tide_m DOUBLE) RETURNS DOUBLE": "raw_m + offset_m - tide_m",
    "haversine_m(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE) RETURNS DOUBLE": "2 * 6371008.8D * asin(least(1.0D, sqrt(pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))))",
    "recency(newest_ms BIGINT, as_of_ms BIGINT, half_life_days DOUBLE) RETURNS DOUBLE": "pow(2.0D, -greatest(0.0D, (as_of_ms - newest_ms) / 86400000.0D) / half_life_days)",
}


def register_functions(spark: SparkSession) -> None:
    """Makes the functions known to SQL of this session."""
    for signature, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
