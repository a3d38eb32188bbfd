"""Tile queries: what a tile shows, as rows, and its bytes by group."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import batched

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadline.config import Config
from leadline.functions.depth import crowd_label, depth_label, water_depth_m
from leadline.functions.geo import hex_centre, hex_vertices, lon_lat, neighbour_cells, overview_width_m, tile_bounds, tile_bounds_columns, tiles_around
from leadline.functions.numbers import half_up, hypot3
from leadline.operators.crowd import display_cell_m, tile_points
from leadline.operators.listing import in_bbox, shown_in
from leadline.operators.surface import CELL, overview, parents, pyramid
from leadline.plans.mvt import EXTENT, area_tile, features, point_tile


def shown_depth(config: Config, tide: tuple[float, float] | None = None, display: str | None = None) -> Column:
    """The depth a chart shows: by datum or water, predicted or with the margin."""
    predicted = (display or config.display_depth) == "predicted"
    if tide is not None:
        return water_depth_m("render_m", "vertical_sigma_m", *tide, predicted=predicted)
    return F.col("render_m") if predicted else F.col("conservative_m")


def cell_rows(cells: DataFrame, config: Config, z: int, x: int, y: int, as_of_ms: int, tide: tuple[float, float] | None = None, display: str | None = None, scale: float = 0.5, factor: float = 1.0, decimals: int = 1, tide_of: tuple[str, int] | None = None) -> DataFrame:
    """Cells of a tile, rolled up to its display width, with shown depth, label and tile coordinates.

    ``tide`` (height, sigma) makes depths those of water; ``tide_of`` says the station and the time (ms) of it. Outside the zoom range there are none. The tile is cut out with a margin of one display cell and not clipped
    further; neighbour confidence is that of all cells, for which a ring of cells around the cut is enough.
    """
    width = overview_width_m(config.base_cell_m, z, scale)
    x0, y0, x1, y1 = tile_bounds(z, x, y)
    near = shown_in(cells, (x0 - width, y0 - width, x1 + width, y1 + width), config, as_of_ms)
    if not config.min_zoom <= z <= config.max_zoom:
        near = near.filter("false")
    rolled = overview(near, config.base_cell_m, width, tide)
    return feature_columns(rolled.withColumns({"z": F.lit(z), "x": F.lit(x), "y": F.lit(y)}), config, width, (x0, y1, x1 - x0), tide, display, factor, decimals, tide_of)


def feature_columns(rolled: DataFrame, config: Config, width: float | Column, corner: tuple, tide: tuple[float, float] | None, display: str | None, factor: float, decimals: int, tide_of: tuple[str, int] | None) -> DataFrame:
    """What a tile shows of display cells, and where; ``corner`` is the west and north of the tile and its span, numbers or columns."""
    west, north, span = (v if isinstance(v, Column) else F.lit(v) for v in corner)
    cx, cy = hex_centre("cell_x", "cell_y", width)
    place = lambda v: F.struct(half_up((v["x"] - west) / span * EXTENT).alias("x"), half_up((north - v["y"]) / span * EXTENT).alias("y"))
    depth = shown_depth(config, tide, display)
    sigma = F.col("vertical_sigma_m") if tide is None else hypot3("vertical_sigma_m", float(tide[1]))
    return rolled.withColumns({
        "cell_m": width if isinstance(width, Column) else F.lit(float(width)), "depth_m": depth, "sigma_m": sigma, "label": depth_label(depth, factor, decimals),
        "tile_x": half_up((cx - west) / span * EXTENT), "tile_y": half_up((north - cy) / span * EXTENT), "ring": F.transform(hex_vertices("cell_x", "cell_y", width), place),
        "safety_m": F.lit(config.surface_to_keel_m + config.danger_under_keel_m), "reasons": F.array_join("reasons", "|"),
        "label_size": F.lit(float(config.depth_label_relative_size)), **tide_columns(tide, tide_of),
    })


def _widths(config: Config, zooms: Iterable[int], scale: float) -> dict[int, float]:
    """Display widths of the zooms that are served."""
    return {z: overview_width_m(config.base_cell_m, z, scale) for z in sorted(set(zooms)) if config.min_zoom <= z <= config.max_zoom}


def display_levels(shown: DataFrame, config: Config, zooms: Iterable[int], tide: tuple[float, float] | None = None, scale: float = 0.5) -> DataFrame:
    """Shown cells of the served datum at every width that the zooms need, with ``width_m``; one pass, as ``pyramid``."""
    base, widths = config.base_cell_m, set(_widths(config, zooms, scale).values())
    here = shown.filter(F.col("datum") == config.target_datum)
    wide = [w for w in sorted(widths) if w > base]
    own = here.filter(F.lit(base in widths)).withColumn("width_m", F.lit(float(base)))
    return own.unionByName(pyramid(here, base, wide, tide), allowMissingColumns=True) if wide else own


def _on_tiles(rows: DataFrame, widths: dict[int, float]) -> DataFrame:
    """Rows of display cells (width_m, cell_x, cell_y) once for each tile (z, x, y) that shows them: those that hold the centre when widened by one display cell."""
    if not widths:
        return rows.filter("false").withColumns({"z": F.lit(0), "x": F.lit(0), "y": F.lit(0)})
    zooms = F.filter(F.array(*[F.struct(F.lit(z).alias("z"), F.lit(float(w)).alias("w")) for z, w in widths.items()]), lambda t: t["w"] == F.col("width_m"))
    cx, cy = hex_centre("cell_x", "cell_y", F.col("width_m"))
    at = rows.withColumn("z", F.explode(F.transform(zooms, lambda t: t["z"])))
    at = at.withColumn("_t", F.explode(tiles_around("z", cx, cy, "width_m")))
    return at.withColumns({"x": F.col("_t.x").cast("int"), "y": F.col("_t.y").cast("int")}).drop("_t")


def sheet_rows(levels: DataFrame, config: Config, zooms: Iterable[int], tide: tuple[float, float] | None = None, display: str | None = None, scale: float = 0.5, factor: float = 1.0, decimals: int = 1, tide_of: tuple[str, int] | None = None, only: DataFrame | None = None) -> DataFrame:
    """The rows of all tiles of an area and of many zooms at once, for ``encode_areas``: ``cell_rows`` for a whole map.

    ``levels`` comes from ``display_levels``, or is a stored pyramid kept by ``updated_pyramid``; ``only`` (z, x, y) restricts it
    to some tiles, such as ``touched_tiles``. Display cells are whole here, while those at the rim of a single tile's cut may lack
    members; this shows outside the tile's own square. Zooms that aren't served have no tiles, and tiles without cells no row.
    """
    at = _on_tiles(levels, _widths(config, zooms, scale))
    if only is not None:
        at = at.join(only.select("z", "x", "y").distinct(), ["z", "x", "y"], "left_semi")
    west, _, east, north = tile_bounds_columns("z", "x", "y")
    return feature_columns(at, config, F.col("width_m"), (west, north, east - west), tide, display, factor, decimals, tide_of).drop("width_m")


def touched_tiles(touched: DataFrame, config: Config, zooms: Iterable[int], scale: float = 0.5) -> DataFrame:
    """The tiles (z, x, y) that may look different after cells (cell_x, cell_y, datum) were built anew, came or went.

    A cell's evidence also holds down its neighbours' confidence, so they count as touched. A touched tile that then has no row is empty.
    """
    widths = _widths(config, zooms, scale)
    near = touched.filter(F.col("datum") == config.target_datum).select(F.explode(F.concat(F.array(F.struct(F.col("cell_x").alias("x"), F.col("cell_y").alias("y"))), neighbour_cells("cell_x", "cell_y"))).alias("n"), "datum")
    cells = near.select(F.col("n.x").alias("cell_x"), F.col("n.y").alias("cell_y"), "datum").distinct()
    return _on_tiles(parents(cells, config.base_cell_m, sorted(set(widths.values()))), widths).select("z", "x", "y").distinct()


def tide_columns(tide: tuple[float, float] | None, of: tuple[str, int] | None) -> dict[str, Column]:
    """Which tide shown depths have, null without one."""
    height, sigma = tide or (None, None)
    station, at = (of or (None, None)) if tide else (None, None)
    return {"tide_height_m": F.lit(height).cast("double"), "tide_sigma_m": F.lit(sigma).cast("double"), "tide_station": F.lit(station).cast("string"), "tide_at_ms": F.lit(at).cast("long")}


# Property names that chart clients read, and the columns they show.
AREA_PROPERTIES = {
    "DRVAL1": "depth_m", "DRVAL2": "depth_m", "DEPTH": "depth_m", "BATHY_DATUM": "datum", "BATHY_CELL_X": "cell_x", "BATHY_CELL_Y": "cell_y", "BATHY_CELL_METERS": "cell_m",
    "BATHY_DEPTH_M": "depth_m", "BATHY_ROBUST_DEPTH_M": "robust_m", "BATHY_RENDER_DEPTH_M": "render_m", "BATHY_CONSERVATIVE_DEPTH_M": "conservative_m", "BATHY_VERTICAL_SIGMA_M": "sigma_m",
    "BATHY_CONFIDENCE": "confidence", "BATHY_SOUNDING_COUNT": "sounding_count", "BATHY_OBSERVATION_COUNT": "observation_count", "BATHY_PASS_COUNT": "pass_count", "BATHY_SOURCE_COUNT": "source_count",
    "BATHY_OLDEST_AT_MS": "oldest_at_ms", "BATHY_NEWEST_AT_MS": "newest_at_ms", "BATHY_UPDATED_AT_MS": "updated_at_ms", "BATHY_CHANGE_STATE": "change_state", "BATHY_LABEL": "label",
    "BATHY_SAFETY_THRESHOLD_M": "safety_m", "BATHY_HORIZONTAL_SIGMA_M": "horizontal_sigma_m", "BATHY_CONFIDENCE_REASONS": "reasons", "BATHY_COVERAGE": "coverage",
    "BATHY_NEIGHBOR_SUPPORT_COUNT": "neighbour_support", "BATHY_NEIGHBOR_DEPTH_DELTA_M": "neighbour_delta_m",
    "BATHY_LABEL_RELATIVE_SIZE": "label_size", "BATHY_TIDE_HEIGHT_M": "tide_height_m", "BATHY_TIDE_SIGMA_M": "tide_sigma_m", "BATHY_TIDE_STATION": "tide_station", "BATHY_TIDE_AT_MS": "tide_at_ms",
}
POINT_PROPERTIES = {
    "DEPTH": "depth_m", "VALSOU": "depth_m", "BATHY_DEPTH_M": "depth_m", "BATHY_LABEL": "label", "BATHY_CONFIDENCE": "confidence", "BATHY_DATUM": "datum", "BATHY_SOUNDING_COUNT": "samples",
    "CSB_MIN_DEPTH_M": "min_m", "CSB_MAX_DEPTH_M": "max_m", "CSB_OBSERVED_AT_MS": "observed_at_ms", "CSB_PLATFORM": "platform", "CSB_PROVIDER": "provider", "CSB_INSTRUMENT": "instrument",
}


def _properties(row: dict, names: dict[str, str]) -> dict:
    out = {}
    for name, column in names.items():
        v = row.get(column)
        if v is None or isinstance(v, float) and v != v or name == "BATHY_CONFIDENCE_REASONS" and not v:
            continue
        out[name] = v if isinstance(v, str | bool) else float(v)
    return out


def encode_areas(rows: DataFrame, mode: str = "datum", display: str = "predicted", labels: bool = True, symbol: str = "m") -> DataFrame:
    """Bytes of each tile of cell_rows: z, x, y, tile. A tile's cells are bounded by its display width."""
    fixed = {"BATHY_MODE": mode, "BATHY_DISPLAY_KIND": display, "BATHY_SHOW_DEPTH_LABELS": labels, "BATHY_LABEL_UNIT": symbol}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["cell_x", "cell_y"])
        shown = [(_properties(r, AREA_PROPERTIES) | fixed, [(int(v["x"]), int(v["y"])) for v in r["ring"]], (int(r["tile_x"]), int(r["tile_y"]))) for r in pdf.to_dict("records")]
        return pdf.head(1)[["z", "x", "y"]].assign(tile=[area_tile(shown)])

    return rows.groupBy("z", "x", "y").applyInPandas(run, "z int, x int, y int, tile binary")


def decode(tiles: DataFrame) -> DataFrame:
    """The features of tiles (z, x, y, tile), a row each: z, x, y, layer, n (place in the tile), numbers and texts by property (truth values as texts), points."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for z, x, y, tile in pdf[["z", "x", "y", "tile"]].itertuples(index=False):
                for some in batched(enumerate(features(bytes(tile))), 1000):
                    split = [({k: v for k, v in p.items() if isinstance(v, float)}, {k: v if isinstance(v, str) else str(v).lower() for k, v in p.items() if not isinstance(v, float)}) for _, (_, p, _) in some]
                    yield pd.DataFrame({"z": z, "x": x, "y": y, "layer": [f[0] for _, f in some], "n": [n for n, _ in some], "numbers": [a for a, _ in split], "texts": [b for _, b in split], "points": [[{"x": px, "y": py} for px, py in f[2]] for _, f in some]})

    return tiles.mapInPandas(run, "z int, x int, y int, layer string, n int, numbers map<string,double>, texts map<string,string>, points array<struct<x:bigint,y:bigint>>")


def point_rows(points: DataFrame, z: int, x: int, y: int, limit: int = 100_000, min_zoom: int = 8, max_zoom: int = 24) -> DataFrame:
    """Crowdsourced points of a tile, thinned; of more than the limit the newest. The limit is the query's own."""
    x0, y0, x1, y1 = tile_bounds(z, x, y)
    (w, s), (e, n) = lon_lat(x0, y0), lon_lat(x1, y1)
    inside = points.filter(in_bbox((w, s, e, n))).orderBy(F.desc("observed_at_ms"), "lat_e7", "lon_e7", "depth_mm").limit(limit)
    if not min_zoom <= z <= max_zoom:
        inside = inside.filter("false")
    depth = F.col("median_mm") / 1000.0
    return tile_points(inside, display_cell_m(z)).withColumns({
        "depth_m": depth, "label": crowd_label(depth), "min_m": F.col("min_mm") / 1000.0, "max_m": F.col("max_mm") / 1000.0, "confidence": F.lit(0.2), "datum": F.lit("UNKNOWN"),
        "tile_x": half_up((F.col("x_m") - x0) / (x1 - x0) * EXTENT), "tile_y": half_up((F.lit(y1) - F.col("y_m")) / (x1 - x0) * EXTENT), "z": F.lit(z), "x": F.lit(x), "y": F.lit(y),
    })


def encode_points(rows: DataFrame, provider: str = "crowd") -> DataFrame:
    fixed = {"BATHYMETRY_PROVIDER": provider, "BATHY_LABEL_UNIT": "m", "CSB_DEPTH_REFERENCE": "raw-observed-datum-unknown", "CSB_NOT_FOR_NAVIGATION": True}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["grid_x", "grid_y"])
        shown = [(_properties(r, POINT_PROPERTIES) | fixed, (int(r["tile_x"]), int(r["tile_y"]))) for r in pdf.to_dict("records")]
        return pdf.head(1)[["z", "x", "y"]].assign(tile=[point_tile(shown)])

    return rows.groupBy("z", "x", "y").applyInPandas(run, "z int, x int, y int, tile binary")


def style(config: Config, tiles: str) -> dict:
    """A map style whose colour stops follow the vessel's safe depth."""
    safe = max(0.1, config.surface_to_keel_m + config.danger_under_keel_m)
    deep = max(safe, 3 * config.surface_to_keel_m, config.surface_to_keel_m + 2 * config.danger_under_keel_m)
    # Colours by depth, from dry to deep.
    stops = [(-1, "#872d23"), (0, "#d22d23"), (safe * 0.5, "#f57823"), (safe, "#f5d741"), (deep, "#d8f3ff"), (deep * 2, "#84cbf4"), (deep * 4, "#3a8fe0"), (max(30, deep * 8), "#1246ab")]
    colour = ["interpolate", ["linear"], ["to-number", ["get", "BATHY_DEPTH_M"], -1], *[v for stop in stops for v in stop]]
    return {
        "version": 8,
        "sources": {"bathymetry": {"type": "vector", "tiles": [tiles], "minzoom": config.min_zoom, "maxzoom": config.max_zoom}},
        "layers": [{"id": "depth", "type": "fill", "source": "bathymetry", "source-layer": "DEPARE", "paint": {"fill-color": colour, "fill-opacity": 0.78}}, {"id": "label", "type": "symbol", "source": "bathymetry", "source-layer": "SOUNDG", "minzoom": 13, "layout": {"text-field": ["get", "BATHY_LABEL"]}}],
    }


def chart(config: Config, bounds: tuple[float, float, float, float] | None, url: str) -> dict:
    """A chart's description; its bounds have a margin of 0.01 degrees."""
    w, s, e, n = bounds or (-180, -85, 180, 85)
    box = [w, s, e, n] if bounds is None else [w - 0.01, s - 0.01, e + 0.01, n + 0.01]
    return {"type": "S-57", "format": "pbf", "minzoom": config.min_zoom, "maxzoom": config.max_zoom, "bounds": box, "url": url, "layers": ["DEPARE", "SOUNDG"], "defaultOpacity": config.overlay_opacity}
