"""Named queries over the driver's tables, each with its DuckDB twin."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadline import fixtures as fx
from leadline.config import Config
from leadline.functions import beam, confidence, depth, geo, text
from leadline.functions import numbers as nb
from leadline.operators import align, asof, crowd, folds, listing, places, rest, surface
from leadline.plans import backfill, store, tiles
from leadline.sources import crowd as crowd_source
from leadline.sources import deltas
from leadline.sources import journal as journal_source

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

CONFIG = Config()
#: The time that queries take for now, an hour of tolerance in series that are sparse, a cut in the soundings' time.
AS_OF, HOUR, CUT = 1_706_745_600_000, 3_600_000, 1_705_708_800_000
TIDE = (1.2, 0.2)


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# DuckDB text that several twins share.

R = "6378137.0"
MED = "(({0})[(len({0}) - 1) // 2 + 1] + ({0})[len({0}) // 2 + 1]) / 2.0"


def med(xs: str) -> str:
    """Median of a sorted list."""
    return MED.format(xs)


def micro(x: str) -> str:
    return f"cast(floor(({x}) * 1000000 + 0.5) as bigint)"


def milli(x: str) -> str:
    return f"cast(floor(({x}) * 1000 + 0.5) as bigint)"


def hex_sql(name: str, source: str, width: float) -> str:
    """CTEs that add cell_x, cell_y to a source with mx, my."""
    return f"""{name}_f AS (SELECT *, mx / {width} - my / (sqrt(3.0) * {width}) AS q, my * 2.0 / (sqrt(3.0) * {width}) AS r FROM {source}),
{name}_r AS (SELECT *, floor(q + 0.5) AS rq, floor(r + 0.5) AS rr, floor(-q - r + 0.5) AS rs FROM {name}_f),
{name} AS (SELECT * EXCLUDE (q, r, rq, rr, rs),
  cast(CASE WHEN abs(rq - q) > abs(rs + q + r) AND abs(rq - q) > abs(rr - r) THEN -rs - rr ELSE CASE WHEN abs(rs + q + r) > abs(rr - r) THEN rq ELSE rq END END AS bigint) AS cell_x,
  cast(CASE WHEN abs(rq - q) > abs(rs + q + r) AND abs(rq - q) > abs(rr - r) THEN rr WHEN abs(rs + q + r) > abs(rr - r) THEN rr ELSE -rq - rs END AS bigint) AS cell_y FROM {name}_r)"""


MERCATOR = f"radians(lon_e7 / 1e7) * {R} AS mx, {R} * ln(tan(pi() / 4 + radians(lat_e7 / 1e7) / 2)) AS my"
RAW = f"raw AS ({fx.duck_sql(fx.SOUNDINGS)})"
SOUNDINGS = f"{RAW}, placed AS (SELECT *, {MERCATOR} FROM raw), {hex_sql('soundings', 'placed', 5.0)}"
SERIES = f"series AS ({fx.duck_sql(fx.SERIES)})"
CROWD = f"crowd AS ({fx.duck_sql(fx.CROWD)})"
JOURNAL = f"journal0 AS ({fx.duck_sql(fx.JOURNAL)})"
PASSES = f"""p0 AS (SELECT cell_x, cell_y, tide_datum AS datum, pass_id, list_sort(list(datum_depth_mm / 1000.0)) AS ds, min(observed_at_ms) AS oldest_ms, max(observed_at_ms) AS newest_ms, count(*) AS n FROM soundings GROUP BY ALL),
p1 AS (SELECT *, {med("ds")} AS depth_m FROM p0),
passes AS (SELECT *, CASE WHEN len(ds) < 2 THEN 0.0 ELSE 1.4826 * {med("list_sort(list_transform(ds, lambda x: abs(x - depth_m)))")} END AS within_m FROM p1)"""
CLUSTERS = f"""cell_lists AS (SELECT cell_x, cell_y, datum, list(depth_m ORDER BY depth_m, pass_id) AS d FROM passes GROUP BY ALL),
runs AS (SELECT cell_x, cell_y, datum, d, 1 AS i, 1 AS s, 0 AS k FROM cell_lists
  UNION ALL SELECT cell_x, cell_y, datum, d, i + 1, CASE WHEN abs((d[(s + i) // 2] + d[(s + i + 1) // 2]) / 2.0 - d[i + 1]) <= 0.5 THEN s ELSE i + 1 END,
    CASE WHEN abs((d[(s + i) // 2] + d[(s + i + 1) // 2]) / 2.0 - d[i + 1]) <= 0.5 THEN k ELSE k + 1 END FROM runs WHERE i < len(d)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY cell_x, cell_y, datum ORDER BY depth_m, pass_id) AS i FROM passes),
assigned AS (SELECT r.*, k FROM ranked r JOIN runs USING (cell_x, cell_y, datum, i)),
c0 AS (SELECT cell_x, cell_y, datum, k, list_sort(list(depth_m)) AS ds, count(*) AS n, min(oldest_ms) AS oldest_ms, max(newest_ms) AS newest_ms FROM assigned GROUP BY ALL),
clusters AS (SELECT *, {med("ds")} AS centre_m FROM c0)"""
CHOSEN = """act AS (SELECT * FROM clusters QUALIFY row_number() OVER (PARTITION BY cell_x, cell_y, datum ORDER BY n DESC, newest_ms DESC, k) = 1),
sha AS (SELECT c.* FROM clusters c JOIN act a USING (cell_x, cell_y, datum) WHERE c.k <> a.k AND c.centre_m < a.centre_m - 0.5 QUALIFY row_number() OVER (PARTITION BY cell_x, cell_y, datum ORDER BY c.centre_m, c.k) = 1),
dee AS (SELECT c.* FROM clusters c JOIN act a USING (cell_x, cell_y, datum) WHERE c.k <> a.k AND c.newest_ms > a.newest_ms AND c.centre_m > a.centre_m + 0.5 QUALIFY row_number() OVER (PARTITION BY cell_x, cell_y, datum ORDER BY c.newest_ms DESC, c.k) = 1),
chosen AS (SELECT a.cell_x, a.cell_y, a.datum, a.k AS active_k, a.centre_m AS robust_m, a.n AS active_n, coalesce(s.k, a.k) AS held_k, coalesce(s.centre_m, a.centre_m) AS render_m, coalesce(s.n, a.n) AS held_n,
  CASE WHEN s.k IS NOT NULL THEN 'suspected_shoaling' WHEN d.k IS NOT NULL THEN 'candidate_deepening' ELSE 'stable' END AS change_state
  FROM act a LEFT JOIN sha s USING (cell_x, cell_y, datum) LEFT JOIN dee d USING (cell_x, cell_y, datum))"""
LATITUDE = f"radians(degrees(2.0 * atan(exp((5.0 * sqrt(3.0) / 2 * cell_y) / {R})) - pi() / 2))"
CELLS = f"""{CHOSEN},
of_pass AS (SELECT a.cell_x, a.cell_y, a.datum, a.pass_id, a.depth_m, a.within_m, a.k = c.active_k AS is_active, a.k = c.held_k AS is_held FROM assigned a JOIN chosen c USING (cell_x, cell_y, datum)),
held AS (SELECT cell_x, cell_y, datum, list_sort(list(depth_m)) AS hd, list_sort(list(within_m)) AS hw FROM of_pass WHERE is_held GROUP BY ALL),
tot AS (SELECT s.cell_x, s.cell_y, p.datum, list_sort(list(vertical_sigma_mm / 1000.0) FILTER (is_held)) AS sig, max(coalesce(horizontal_sigma_mm / 1000.0, 3.0)) FILTER (is_held) AS hs,
  count(*) FILTER (is_active) AS observation_count, cast(sum(sample_count) FILTER (is_active) AS bigint) AS sounding_count, count(DISTINCT depth_source) FILTER (is_active) AS source_count,
  min(observed_at_ms) FILTER (is_active) AS oldest_at_ms, max(observed_at_ms) FILTER (is_active) AS newest_at_ms
  FROM soundings s JOIN of_pass p ON s.cell_x = p.cell_x AND s.cell_y = p.cell_y AND s.tide_datum = p.datum AND s.pass_id = p.pass_id GROUP BY ALL),
m0 AS (SELECT *, {med("sig")} AS me, CASE WHEN len(hd) < 2 THEN 0.0 ELSE 1.4826 * {med("list_sort(list_transform(hd, lambda x: abs(x - " + med("hd") + ")))")} END AS rp, {med("hw")} AS vi FROM chosen JOIN held USING (cell_x, cell_y, datum) JOIN tot USING (cell_x, cell_y, datum)),
m1 AS (SELECT *, sqrt(me * me + rp * rp / held_n + vi * vi / held_n) AS sigma_m,
  exp((2 * ln(least(greatest(exp(-me), 0.001), 1.0)) + ln(least(greatest(1 - exp(-observation_count / 4.0), 0.001), 1.0)) + 2 * ln(least(greatest(0.45 + 0.55 * least(1.0, active_n / 3.0), 0.001), 1.0))
   + 2 * ln(least(greatest(exp(-rp / 0.5), 0.001), 1.0)) + ln(least(greatest(exp(-vi / 0.5), 0.001), 1.0)) + ln(CASE WHEN source_count >= 2 THEN 1.0 ELSE 0.7 END)) / 9.0) AS ev,
  least(CASE WHEN observation_count <= 1 THEN 0.25 WHEN observation_count = 2 THEN 0.4 ELSE 1.0 END, CASE WHEN active_n <= 1 THEN 0.35 WHEN active_n = 2 THEN 0.6 ELSE 1.0 END, CASE WHEN source_count <= 1 THEN 0.75 ELSE 1.0 END) AS cap,
  least(1.0, pow(5.0 * cos({LATITUDE}) / (2.0 * hs), 2)) AS hc FROM m0),
cells AS (SELECT cell_x, cell_y, datum, {milli("robust_m")} AS robust_depth_mm, {milli("render_m")} AS render_depth_mm, {milli("render_m - 1.645 * sigma_m")} AS conservative_depth_mm, greatest(1, {milli("sigma_m")}) AS vertical_sigma_mm,
  {milli("hs")} AS horizontal_sigma_mm, least(hc, ev, cap) AS confidence_base, sounding_count, observation_count, active_n AS pass_count, source_count, oldest_at_ms, newest_at_ms, change_state FROM m1)"""
ALL_CELLS = f"WITH RECURSIVE {SOUNDINGS}, {PASSES}, {CLUSTERS}, {CELLS}"
READ = f"""shown0 AS (SELECT cell_x, cell_y, datum, robust_depth_mm / 1000.0 AS robust_m, render_depth_mm / 1000.0 AS render_m, conservative_depth_mm / 1000.0 AS conservative_m, vertical_sigma_mm / 1000.0 AS vertical_sigma_m, horizontal_sigma_mm / 1000.0 AS horizontal_sigma_m,
  least(1.0, confidence_base * pow(2.0, -greatest(0.0, ({AS_OF} - newest_at_ms) / 86400000.0) / 365.0)) AS confidence,
  list_filter([CASE WHEN observation_count <= 1 THEN 'single_observation' WHEN observation_count = 2 THEN 'only_two_observations' END, CASE WHEN pass_count <= 1 THEN 'single_pass' WHEN pass_count = 2 THEN 'only_two_passes' END, CASE WHEN source_count <= 1 THEN 'single_source' END,
    CASE WHEN 2.0 * horizontal_sigma_mm / 1000.0 > 5.0 * cos({LATITUDE}) THEN 'horizontal_uncertainty_exceeds_cell' END], lambda x: x IS NOT NULL) AS reasons,
  sounding_count, observation_count, pass_count, source_count, oldest_at_ms, newest_at_ms, change_state FROM cells)"""
NEAR = f"""strong AS (SELECT * FROM shown0 WHERE observation_count >= 3 AND pass_count >= 2 AND confidence >= 0.55),
around AS (SELECT s.cell_x + dx AS cell_x, s.cell_y + dy AS cell_y, datum, list_sort(list(robust_m)) AS rm FROM strong s, (VALUES (1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1)) v(dx, dy) GROUP BY ALL),
n0 AS (SELECT s.*, coalesce(len(rm), 0) AS neighbour_support, CASE WHEN len(rm) >= 2 AND (observation_count <= 2 OR pass_count <= 1) THEN abs(robust_m - {med("rm")}) END AS neighbour_delta_m,
  greatest(0.75, 1.5 * CASE WHEN len(rm) < 2 THEN 0.0 ELSE 1.4826 * {med("list_sort(list_transform(rm, lambda x: abs(x - " + med("rm") + ")))")} END) AS tolerance FROM shown0 s LEFT JOIN around USING (cell_x, cell_y, datum)),
shown AS (SELECT * REPLACE (CASE WHEN neighbour_delta_m > tolerance THEN least(confidence, CASE WHEN observation_count <= 1 THEN 0.12 WHEN observation_count <= 2 THEN 0.22 ELSE 0.3 END) ELSE confidence END AS confidence,
  CASE WHEN neighbour_delta_m > tolerance THEN list_append(reasons, 'neighbor_depth_disagreement') ELSE reasons END AS reasons) FROM n0)"""
SHOWN = f"{ALL_CELLS}, {READ}, {NEAR}"
QC = "qc AS (SELECT s.id AS sounding_id, CASE WHEN p.is_active THEN 'accepted' ELSE 'quarantined' END AS qc_state FROM soundings s JOIN of_pass p ON s.cell_x = p.cell_x AND s.cell_y = p.cell_y AND s.tide_datum = p.datum AND s.pass_id = p.pass_id)"


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surface.build_cells(fx.soundings(spark, sf_dir), CONFIG)


def _shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surface.with_neighbours(surface.read_cells(_cells(spark, sf_dir), CONFIG, AS_OF), CONFIG)


def _series(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    return fx.series(spark, sf_dir).filter(F.col("path") == path)


def _fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _series(spark, sf_dir, "position").select("context", "at_ms", (F.col("lat_e7") / 1e7).alias("latitude"), (F.col("lon_e7") / 1e7).alias("longitude"), "event_id")


def _values(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    return _series(spark, sf_dir, path).select("context", "at_ms", "event_id", "v_milli")


# Cells.


@query(f"{ALL_CELLS} SELECT * REPLACE ({micro('confidence_base')} AS confidence_base) FROM cells")
def surface_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir).drop("previous_depth_mm", "updated_at_ms").withColumn("confidence_base", nb.micro("confidence_base"))


@query(f"{ALL_CELLS}, {QC} SELECT sounding_id, qc_state, CASE WHEN qc_state = 'accepted' THEN '' ELSE 'local_depth_cluster_disagreement' END AS reasons FROM qc")
def qc_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surface.classify(fx.soundings(spark, sf_dir), CONFIG).withColumn("reasons", F.array_join("reasons", "|"))


@query(f"WITH {SOUNDINGS}, {PASSES} SELECT cell_x, cell_y, datum, pass_id, {micro('depth_m')} AS depth_u, {micro('within_m')} AS within_u, oldest_ms, newest_ms, n FROM passes")
def pass_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surface.pass_estimates(fx.soundings(spark, sf_dir)).select(*surface.CELL, "pass_id", nb.micro("depth_m").alias("depth_u"), nb.micro("within_m").alias("within_u"), "oldest_ms", "newest_ms", "n")


@query(f"WITH RECURSIVE {SOUNDINGS}, {PASSES}, {CLUSTERS} SELECT cell_x, cell_y, datum, k, {micro('centre_m')} AS centre_u, n, oldest_ms, newest_ms FROM clusters")
def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = surface.cell_clusters(surface.pass_estimates(fx.soundings(spark, sf_dir)), CONFIG).select(*surface.CELL, F.explode("clusters").alias("c"))
    return c.select(*surface.CELL, F.col("c.k").alias("k"), nb.micro("c.centre_m").alias("centre_u"), F.col("c.n").cast("long").alias("n"), "c.oldest_ms", "c.newest_ms")


_SHOWN_SQL = f"cell_x, cell_y, datum, {milli('robust_m')} AS robust_mm, {milli('render_m')} AS render_mm, {micro('confidence')} AS confidence_u, array_to_string(reasons, '|') AS reasons"


def _shown_columns(df: DataFrame) -> DataFrame:
    return df.select(*surface.CELL, nb.millimetres("robust_m").alias("robust_mm"), nb.millimetres("render_m").alias("render_mm"), nb.micro("confidence").alias("confidence_u"), F.array_join("reasons", "|").alias("reasons"), *[c for c in ("neighbour_support",) if c in df.columns])


@query(f"{ALL_CELLS}, {READ} SELECT {_SHOWN_SQL} FROM shown0")
def cells_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown_columns(surface.read_cells(_cells(spark, sf_dir), CONFIG, AS_OF))


@query(f"{SHOWN} SELECT {_SHOWN_SQL}, neighbour_support FROM shown")
def neighbor_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown_columns(_shown(spark, sf_dir))


@query(f"WITH {SOUNDINGS}, k AS (SELECT DISTINCT cell_x, cell_y, tide_datum AS datum FROM soundings) SELECT a.cell_x, a.cell_y, a.datum, b.cell_x AS neighbour_x, b.cell_y AS neighbour_y FROM k a JOIN k b ON a.datum = b.datum AND (b.cell_x - a.cell_x, b.cell_y - a.cell_y) IN ((1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1))")
def neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surface.neighbours(store.affected_cells(fx.soundings(spark, sf_dir)))


def _rolled(depth_sql: str, width: float = 80.0) -> str:
    return f"""{SHOWN}, centred AS (SELECT * RENAME (cell_x AS own_x, cell_y AS own_y) FROM (SELECT *, 5.0 * (cell_x + cell_y / 2.0) AS mx, 5.0 * sqrt(3.0) / 2 * cell_y AS my, {depth_sql} AS d FROM shown)),
{hex_sql("parents", "centred", width)},
o AS (SELECT cell_x, cell_y, datum, arg_min(struct_pack(r := render_m, c := confidence, t := newest_at_ms), (d, own_x, own_y)) AS m, count(*) AS members, cast(sum(sounding_count) AS bigint) AS sounding_count, cast(sum(observation_count) AS bigint) AS observation_count,
  max(pass_count) AS pass_count, max(source_count) AS source_count, min(oldest_at_ms) AS oldest_at_ms,
  max(CASE change_state WHEN 'stable' THEN 1 WHEN 'candidate_deepening' THEN 2 WHEN 'suspected_shoaling' THEN 3 ELSE 4 END) AS rank FROM parents GROUP BY ALL)
SELECT cell_x, cell_y, datum, {milli("m.r")} AS render_mm, {micro("m.c")} AS confidence_u, {micro(f"least(1.0, members / {(width / 5.0) ** 2})")} AS coverage_u, sounding_count, observation_count, pass_count, source_count, oldest_at_ms, m.t AS newest_at_ms,
  ['stable', 'candidate_deepening', 'suspected_shoaling', 'confirmed'][rank] AS change_state FROM o"""


def _overview(spark: SparkSession, sf_dir: str, tide: tuple[float, float] | None = None) -> DataFrame:
    o = surface.overview(_shown(spark, sf_dir), 5.0, 80.0, tide)
    return o.select(*surface.CELL, nb.millimetres("render_m").alias("render_mm"), nb.micro("confidence").alias("confidence_u"), nb.micro("coverage").alias("coverage_u"), "sounding_count", "observation_count", "pass_count", "source_count", "oldest_at_ms", "newest_at_ms", "change_state")


@query(_rolled("conservative_m"))
def overview_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overview(spark, sf_dir)


@query(_rolled(f"render_m + {TIDE[0]} - 1.645 * sqrt(vertical_sigma_m * vertical_sigma_m + {TIDE[1]} * {TIDE[1]})"))
def overview_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overview(spark, sf_dir, TIDE)


@query(f"SELECT change_state, count(*) AS n FROM ({_rolled('conservative_m')}) GROUP BY 1")
def overview_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overview(spark, sf_dir).groupBy("change_state").agg(F.count("*").alias("n"))


_WIDTHS = geo.overview_widths_m(5.0, 8, 20)
_LEVELS = " UNION ALL ".join(f"SELECT {w}::DOUBLE AS width_m, * FROM ({_rolled('conservative_m', w)})" for w in _WIDTHS)


def _level(o: DataFrame) -> DataFrame:
    return o.select("width_m", *surface.CELL, nb.millimetres("render_m").alias("render_mm"), nb.micro("confidence").alias("confidence_u"), nb.micro("coverage").alias("coverage_u"), "sounding_count", "observation_count", "pass_count", "source_count", "oldest_at_ms", "newest_at_ms", "change_state")


@query(_LEVELS)
def overview_pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All widths of overviews, from one pass over the cells."""
    return _level(surface.pyramid(_shown(spark, sf_dir), 5.0, _WIDTHS))


@query(_LEVELS)
def overview_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pyramid of some cells, then the cells that came."""
    cells = _shown(spark, sf_dir)
    some = cells.filter("cell_x % 7 <> 0")
    return _level(surface.updated_pyramid(surface.pyramid(some, 5.0, _WIDTHS), cells, cells.filter("cell_x % 7 = 0"), 5.0, _WIDTHS))


_TILE = (16, 10485, 25325)


def _tile_rolled_sql() -> str:
    x0, y0, x1, y1 = geo.tile_bounds(*_TILE)
    w = geo.overview_width_m(5.0, _TILE[0])
    a, b, c, d = geo.cell_range((x0 - w, y0 - w, x1 + w, y1 + w), 5.0)
    return _rolled("conservative_m", w).replace("FROM shown)", f"FROM shown WHERE cell_x BETWEEN {a} AND {b} AND cell_y BETWEEN {c} AND {d})")


def _tile_sql() -> str:
    x0, _, x1, y1 = geo.tile_bounds(*_TILE)
    w = geo.overview_width_m(5.0, _TILE[0])
    return f"""SELECT cell_x, cell_y, datum, render_mm AS depth_mm, CASE WHEN abs(render_mm / 1000.0) >= 10 THEN cast(cast(floor(render_mm / 1000.0) AS bigint) AS varchar) ELSE printf('%.1f', floor(render_mm / 1000.0 * 10) / 10) END AS label,
  cast(floor(({w} * (cell_x + cell_y / 2.0) - ({x0})) / {x1 - x0} * 4096 + 0.5) AS bigint) AS tile_x, cast(floor(({y1} - {w} * sqrt(3.0) / 2 * cell_y) / {x1 - x0} * 4096 + 0.5) AS bigint) AS tile_y FROM ({_tile_rolled_sql()})"""


@query(_tile_sql())
def tile_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tiles.cell_rows(_cells(spark, sf_dir), CONFIG, *_TILE, AS_OF)
    return rows.select(*surface.CELL, nb.millimetres("depth_m").alias("depth_mm"), "label", "tile_x", "tile_y")


@query()
def tile_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.encode_areas(tiles.cell_rows(_cells(spark, sf_dir), CONFIG, *_TILE, AS_OF)).select("z", "x", "y", F.length("tile").alias("n_bytes"), F.sha2("tile", 256).alias("sha256"))


def _features_sql(rows: str) -> str:
    """Features of both layers of tiles, from rows of z, x, y, w and what ``_rolled`` gives."""
    edge = geo.CIRCUMFERENCE_M / 2
    at = lambda v, low, sign: f"cast(floor({sign}(({v}) - {low}) / (east - west) * 4096 + 0.5) AS bigint)"
    cx, cy, turn = "w * (cell_x + cell_y / 2.0)", "w * sqrt(3.0) / 2 * cell_y", "radians(30 + 60 * k)"
    corner = f"{at(f'{cx} + w / sqrt(3.0) * cos({turn})', 'west', '')} || ' ' || {at(f'{cy} + w / sqrt(3.0) * sin({turn})', 'north', '-')}"
    return f"""SELECT z, x, y, layer, cell_x, cell_y, render_mm AS depth_mm, CASE WHEN abs(render_mm / 1000.0) >= 10 THEN cast(cast(floor(render_mm / 1000.0) AS bigint) AS varchar) ELSE printf('%.1f', floor(render_mm / 1000.0 * 10) / 10) END AS label,
  confidence_u, sounding_count, observation_count, pass_count, source_count, newest_at_ms, change_state,
  CASE layer WHEN 'SOUNDG' THEN {at(cx, 'west', '')} || ' ' || {at(cy, 'north', '-')} ELSE array_to_string([{corner} FOR k IN range(0, 6)], ' ') END AS points
FROM (SELECT *, -{edge} + x * ({2 * edge} / pow(2.0, z)) AS west, -{edge} + (x + 1) * ({2 * edge} / pow(2.0, z)) AS east, {edge} - y * ({2 * edge} / pow(2.0, z)) AS north FROM ({rows})), (SELECT unnest(['DEPARE', 'SOUNDG']) AS layer)"""


def _features(encoded: DataFrame) -> DataFrame:
    """What can be read out of the bytes of tiles."""
    number = lambda n: F.col("numbers")[n]
    whole = {"cell_x": "BATHY_CELL_X", "cell_y": "BATHY_CELL_Y", "sounding_count": "BATHY_SOUNDING_COUNT", "observation_count": "BATHY_OBSERVATION_COUNT", "pass_count": "BATHY_PASS_COUNT", "source_count": "BATHY_SOURCE_COUNT", "newest_at_ms": "BATHY_NEWEST_AT_MS"}
    return tiles.decode(encoded).select(
        "z", "x", "y", "layer", *[number(n).cast("long").alias(column) for column, n in whole.items()], nb.millimetres(number("DEPTH")).alias("depth_mm"), nb.micro(number("BATHY_CONFIDENCE")).alias("confidence_u"),
        F.col("texts")["BATHY_LABEL"].alias("label"), F.col("texts")["BATHY_CHANGE_STATE"].alias("change_state"), F.array_join(F.transform("points", lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), " ").alias("points"),
    )


_ROLLED = "cell_x, cell_y, render_mm, confidence_u, sounding_count, observation_count, pass_count, source_count, newest_at_ms, change_state"


@query(_features_sql(f"SELECT {_TILE[0]} AS z, {_TILE[1]} AS x, {_TILE[2]} AS y, {geo.overview_width_m(5.0, _TILE[0])}::DOUBLE AS w, {_ROLLED} FROM ({_tile_rolled_sql()})"))
def tile_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tile's bytes, read back."""
    return _features(tiles.encode_areas(tiles.cell_rows(_cells(spark, sf_dir), CONFIG, *_TILE, AS_OF)))


_ZOOMS = (8, 14, 17, 18, 20)


def _sheet_sql() -> str:
    edge = geo.CIRCUMFERENCE_M / 2

    def level(z: int) -> str:
        w, span, most = geo.overview_width_m(5.0, z), 2 * edge / 2**z, 2**z - 1
        cx, cy = "w * (cell_x + cell_y / 2.0)", "w * sqrt(3.0) / 2 * cell_y"
        tile = lambda low, high: f"unnest(range(greatest(0, cast(floor(({low}) / {span}) AS bigint)), least({most}, cast(floor(({high}) / {span}) AS bigint)) + 1))"
        own = f"SELECT *, {milli('render_m')} AS render_mm, {micro('confidence')} AS confidence_u FROM ({SHOWN} SELECT * FROM shown)"
        return f"SELECT *, {tile(f'{edge} - {cy} - w', f'{edge} - {cy} + w')} AS y FROM (SELECT *, {tile(f'{edge} + {cx} - w', f'{edge} + {cx} + w')} AS x FROM (SELECT {z} AS z, {w}::DOUBLE AS w, {_ROLLED} FROM ({own if w == 5.0 else _rolled('conservative_m', w)})))"

    return _features_sql(" UNION ALL ".join(map(level, _ZOOMS)))


@query(_sheet_sql())
def tile_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tiles of the whole surface at several zooms, by one job, read back from their bytes."""
    levels = tiles.display_levels(_shown(spark, sf_dir), CONFIG, _ZOOMS)
    return _features(tiles.encode_areas(tiles.sheet_rows(levels, CONFIG, _ZOOMS)))


_CORNER = "radians(30 + 60 * (k % 6))"
_CORNER_X, _CORNER_Y = f"5.0 * (cell_x + cell_y / 2.0) + 5.0 / sqrt(3.0) * cos({_CORNER})", f"5.0 * sqrt(3.0) / 2 * cell_y + 5.0 / sqrt(3.0) * sin({_CORNER})"


@query(f"{ALL_CELLS} SELECT cell_x, cell_y, k, {micro('degrees((' + _CORNER_X + ') / ' + R + ')')} AS lon_u, {micro('degrees(2.0 * atan(exp((' + _CORNER_Y + ') / ' + R + ')) - pi() / 2)')} AS lat_u FROM cells, (SELECT unnest(range(0, 7)) AS k)")
def cell_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ring of each cell, a row for each corner."""
    ring = F.posexplode(surface.polygon("cell_x", "cell_y", 5.0)).alias("k", "p")
    return _cells(spark, sf_dir).select("cell_x", "cell_y", ring).select("cell_x", "cell_y", F.col("k").cast("long").alias("k"), nb.micro(F.col("p")[0]).alias("lon_u"), nb.micro(F.col("p")[1]).alias("lat_u"))


_LOOKUP = (37.8004950, -122.3994300)


@query(f"{ALL_CELLS} SELECT cell_x, cell_y, datum, robust_depth_mm, change_state FROM cells WHERE cell_x = {geo.cell_of(*_LOOKUP, 5.0)[0]} AND cell_y = {geo.cell_of(*_LOOKUP, 5.0)[1]}")
def cell_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.lookup(_cells(spark, sf_dir), *_LOOKUP, CONFIG).select(*surface.CELL, "robust_depth_mm", "change_state")


@query(f"{ALL_CELLS} SELECT cell_x, cell_y, datum, change_state, newest_at_ms AS updated_at_ms FROM cells WHERE change_state <> 'stable' AND newest_at_ms >= {CUT}")
def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir).withColumn("updated_at_ms", F.col("newest_at_ms"))
    return listing.changes(cells, CUT, "MLLW").select(*surface.CELL, "change_state", "updated_at_ms")


@query(f"{ALL_CELLS}, {QC}, a AS (SELECT s.* FROM soundings s WHERE id % 50 <> 0) SELECT (SELECT count(*) FROM a) AS soundings, cast((SELECT sum(sample_count) FROM a) AS bigint) AS source_samples, cast((SELECT sum(rejected_sample_count) FROM a) AS bigint) AS rejected_samples, (SELECT max(observed_at_ms) FROM a) AS latest_ms, (SELECT min(lon_e7) FROM a) AS west_e7, (SELECT max(lat_e7) FROM a) AS north_e7, (SELECT count(*) FROM qc JOIN a ON id = sounding_id WHERE qc_state = 'accepted') AS accepted, (SELECT count(*) FROM qc JOIN a ON id = sounding_id WHERE qc_state = 'quarantined') AS quarantined, (SELECT count(*) FROM cells) AS cells, (SELECT count(*) FROM soundings WHERE id % 50 = 0) AS superseded")
def store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.soundings(spark, sf_dir)
    out = listing.stats(s, surface.classify(s, CONFIG), surface.build_cells(s, CONFIG), s.filter("id % 50 = 0").select(F.col("id").alias("original_id")))
    return out.select("soundings", "source_samples", "rejected_samples", "latest_ms", "west_e7", "north_e7", "accepted", "quarantined", "cells", "superseded")


@query(f"{SHOWN} SELECT count(*) FILTER (confidence < 0.55) AS low_confidence, count(*) FILTER (pass_count <= 1) AS single_pass, count(*) FILTER (source_count <= 1) AS single_source, count(*) FILTER (({AS_OF} - newest_at_ms) / 86400000.0 > 7.0) AS old, count(*) FILTER (change_state <> 'stable') AS changed FROM shown")
def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.audit(_shown(spark, sf_dir), AS_OF, 7.0)


_EVIDENCE = f"{ALL_CELLS}, {QC}, e AS (SELECT cell_x, cell_y, tide_datum AS datum, count(*) AS records, cast(sum(sample_count) AS bigint) AS samples, count(*) FILTER (qc_state = 'accepted') AS accepted, count(*) FILTER (qc_state = 'quarantined') AS quarantined FROM soundings JOIN qc ON id = sounding_id GROUP BY ALL)"


@query(f"{_EVIDENCE} SELECT * FROM e")
def cell_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.soundings(spark, sf_dir)
    return listing.evidence(s, surface.classify(s, CONFIG))


@query(f"{_EVIDENCE} SELECT datum, cast(sum(records) AS bigint) AS records, cast(sum(samples) AS bigint) AS samples, cast(sum(accepted) AS bigint) AS accepted, cast(sum(quarantined) AS bigint) AS quarantined FROM e GROUP BY 1")
def evidence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cell_evidence(spark, sf_dir).groupBy("datum").agg(*[F.sum(n).alias(n) for n in ("records", "samples", "accepted", "quarantined")])


_BBOX = (-122.399, 37.8003, -122.398, 37.8009)


def _box(lat: str = "lat_e7", lon: str = "lon_e7") -> str:
    w, s, e, n = (int(v * 1e7 + (0.5 if v >= 0 else -0.5)) for v in _BBOX)
    return f"{lon} BETWEEN {w} AND {e} AND {lat} BETWEEN {s} AND {n}"


@query(f"{ALL_CELLS}, {QC} SELECT id, observed_at_ms, qc_state FROM soundings JOIN qc ON id = sounding_id WHERE {_box()} AND observed_at_ms <= {CUT}")
def soundings_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.soundings(spark, sf_dir)
    return listing.soundings(s, surface.classify(s, CONFIG), _BBOX, to_ms=CUT).select("id", "observed_at_ms", "qc_state")


@query(f"{ALL_CELLS}, {QC} SELECT id, datum_depth_mm FROM soundings JOIN qc ON id = sounding_id WHERE qc_state = 'quarantined'")
def soundings_qc(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.soundings(spark, sf_dir)
    return listing.soundings(s, surface.classify(s, CONFIG), state="quarantined").select("id", "datum_depth_mm")


@query(f"{ALL_CELLS}, {QC} SELECT id, observed_at_ms, qc_state FROM soundings JOIN qc ON id = sounding_id ORDER BY observed_at_ms DESC, id LIMIT 1000")
def soundings_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.soundings(spark, sf_dir)
    return listing.soundings(s, surface.classify(s, CONFIG), limit=1000).select("id", "observed_at_ms", "qc_state")


@query(f"{ALL_CELLS}, {QC} SELECT id, strftime(make_timestamp(observed_at_ms * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS observed_at, lat_e7 / 1e7 AS latitude, lon_e7 / 1e7 AS longitude, datum_depth_mm / 1000.0 AS datum_m, pass_id, qc_state FROM soundings JOIN qc ON id = sounding_id")
def list_soundings(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.soundings(spark, sf_dir)
    return listing.listed(listing.soundings(s, surface.classify(s, CONFIG))).select("id", "observed_at", "latitude", "longitude", "datum_m", "pass_id", "qc_state")


@query(f"WITH {RAW} SELECT id, observed_at_ms FROM raw WHERE position_method IN ('exact', 'interpolated', 'history_unaligned') AND observed_at_ms >= {CUT} AND observed_at_ms < {CUT + 5 * 86_400_000}")
def rebuild_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.rebuild_targets(fx.soundings(spark, sf_dir), CUT, CUT + 5 * 86_400_000).select("id", "observed_at_ms")


@query(f"WITH {RAW} SELECT id FROM raw WHERE id NOT IN (SELECT id FROM raw WHERE id % 50 = 0)")
def active_soundings(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.soundings(spark, sf_dir)
    return surface.active_soundings(s, s.filter("id % 50 = 0").select(F.col("id").alias("original_id"))).select("id")


@query(f"WITH {SOUNDINGS} SELECT DISTINCT cell_x, cell_y, tide_datum AS datum FROM soundings WHERE observed_at_ms >= {CUT} OR id % 50 = 0")
def affected_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.soundings(spark, sf_dir)
    return store.affected_cells(s.filter(F.col("observed_at_ms") >= CUT), s.filter("id % 50 = 0"))


def _of_first(sql: str) -> str:
    """The same CTEs over the soundings before the cut, under other names."""
    return re.sub(r"\b(soundings|p0|p1|passes|cell_lists|runs|ranked|assigned|c0|clusters|act|sha|dee|chosen)\b", r"first_\1", sql)


_KEY = "(cell_x, cell_y, datum)"
_AGAIN = f"""WITH RECURSIVE {SOUNDINGS}, {PASSES}, {CLUSTERS}, first_soundings AS (SELECT * FROM soundings WHERE observed_at_ms < {CUT}), {_of_first(PASSES)}, {_of_first(CLUSTERS)}, {_of_first(CHOSEN)},
prior AS (SELECT cell_x, cell_y, datum, {milli("robust_m")} AS robust_depth_mm, change_state FROM first_chosen),
touched AS (SELECT DISTINCT cell_x, cell_y, tide_datum AS datum FROM soundings WHERE observed_at_ms >= {CUT}),
b AS (SELECT c.*, n >= 3 AND newest_ms - oldest_ms >= 2 * 86400000 AS sound, p.robust_depth_mm / 1000.0 AS before_m FROM clusters c JOIN touched USING {_KEY} LEFT JOIN prior p USING {_KEY}),
fresh AS (SELECT * FROM b WHERE before_m IS NULL QUALIFY row_number() OVER (PARTITION BY cell_x, cell_y, datum ORDER BY n DESC, newest_ms DESC, k) = 1),
base AS (SELECT * FROM b WHERE before_m IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cell_x, cell_y, datum ORDER BY abs(centre_m - before_m), k) = 1),
newer AS (SELECT b.* FROM b JOIN base a USING {_KEY} WHERE b.k <> a.k AND b.newest_ms > a.newest_ms AND b.sound QUALIFY row_number() OVER (PARTITION BY cell_x, cell_y, datum ORDER BY b.newest_ms DESC, b.k) = 1),
now AS (SELECT * FROM fresh UNION ALL SELECT * FROM newer UNION ALL SELECT a.* FROM base a ANTI JOIN newer USING {_KEY}),
around AS (SELECT {_KEY[1:-1]}, bool_or(b.centre_m < a.centre_m - 0.5) AS shallow, bool_or(b.newest_ms > a.newest_ms AND b.centre_m > a.centre_m + 0.5) AS deep FROM b JOIN now a USING {_KEY} WHERE b.k <> a.k GROUP BY ALL)
SELECT cell_x, cell_y, datum, {milli("centre_m")} AS robust_depth_mm, CASE WHEN abs(centre_m - before_m) >= 0.5 AND sound THEN 'confirmed' WHEN shallow THEN 'suspected_shoaling' WHEN deep THEN 'candidate_deepening' ELSE 'stable' END AS change_state FROM now LEFT JOIN around USING {_KEY}
UNION ALL SELECT * FROM prior ANTI JOIN touched USING {_KEY}"""


@query(_AGAIN)
def incremental_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surface after two micro-batches, cut in time: confirmed changes depend on the state between them."""
    s = fx.soundings(spark, sf_dir)
    first, second = s.filter(F.col("observed_at_ms") < CUT), s.filter(F.col("observed_at_ms") >= CUT)
    before = surface.build_cells(first, CONFIG)
    cells, _, _ = store.apply_batch(before, s, second, CONFIG, 1)
    return cells.select(*surface.CELL, "robust_depth_mm", "change_state")


_LEFT = ALL_CELLS.replace(RAW, f"raw AS (SELECT * FROM ({fx.duck_sql(fx.SOUNDINGS)}) WHERE id % 50 <> 0)")


@query(f"{_LEFT} SELECT * REPLACE ({micro('confidence_base')} AS confidence_base) FROM cells")
def replaced_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surface after some soundings are superseded: their cells are built anew without their state before, the others stay."""
    s = fx.soundings(spark, sf_dir)
    gone = s.filter("id % 50 = 0")
    left = surface.active_soundings(s, gone.select(F.col("id").alias("original_id")))
    cells, _ = store.rebuild_cells(surface.build_cells(s, CONFIG), left, store.affected_cells(gone), CONFIG, 1)
    return cells.drop("previous_depth_mm", "updated_at_ms").withColumn("confidence_base", nb.micro("confidence_base"))


@query(f"{ALL_CELLS} SELECT max(newest_at_ms) AS revision FROM cells")
def revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.revision(_cells(spark, sf_dir).withColumn("updated_at_ms", F.col("newest_at_ms")))


@query(f"{ALL_CELLS} SELECT cell_x, cell_y, change_state, newest_at_ms AS updated_at_ms FROM cells WHERE change_state <> 'stable' ORDER BY newest_at_ms DESC, cell_x, cell_y LIMIT 100")
def changes_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir).withColumn("updated_at_ms", F.col("newest_at_ms"))
    return listing.changes(cells, 0, "MLLW", 100).select("cell_x", "cell_y", "change_state", "updated_at_ms")


_DAY = "strftime(make_timestamp(observed_at_ms * 1000), '%Y-%m-%d')"


@query(f"WITH {RAW} SELECT id, {_DAY} || ':' || track AS live, {_DAY} || ':stationary:' || track AS at_rest, 'history-' || {_DAY} AS history FROM raw")
def pass_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda kind: rest.pass_id("observed_at_ms", F.col("track").cast("string"), kind)
    return fx.soundings(spark, sf_dir).select("id", of("live").alias("live"), of("stationary").alias("at_rest"), of("history").alias("history"))


# Numbers over soundings.

_BY_SOURCE = f"WITH {RAW}, g AS (SELECT track, depth_source, list_sort(list(datum_depth_mm / 1000.0)) AS ds FROM raw GROUP BY ALL), m AS (SELECT *, {med('ds')} AS md FROM g), d AS (SELECT *, {med('list_sort(list_transform(ds, lambda x: abs(x - md)))')} AS mad_m FROM m)"


def _by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rest.spread(fx.soundings(spark, sf_dir), ["track", "depth_source"], nb.metres("datum_depth_mm"), CONFIG)


@query(f"{_BY_SOURCE} SELECT track, depth_source, {micro('md')} AS median_u FROM d")
def median_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_source(spark, sf_dir).select("track", "depth_source", nb.micro("median").alias("median_u"))


@query(f"{_BY_SOURCE} SELECT track, depth_source, {micro('mad_m')} AS mad_u FROM d")
def mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_source(spark, sf_dir).select("track", "depth_source", nb.micro("mad").alias("mad_u"))


@query(f"{_BY_SOURCE} SELECT track, depth_source, {micro('CASE WHEN len(ds) < 2 THEN 0.0 ELSE 1.4826 * mad_m END')} AS sigma_u FROM d")
def robust_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_source(spark, sf_dir).select("track", "depth_source", nb.micro("sigma").alias("sigma_u"))


@query(f"{_BY_SOURCE} SELECT track, depth_source, len(list_filter(ds, lambda x: abs(x - md) <= greatest(0.5, 4.5 * CASE WHEN len(ds) < 2 THEN 0.0 ELSE 1.4826 * mad_m END))) AS kept, len(ds) AS n FROM d")
def stationary_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_source(spark, sf_dir).select("track", "depth_source", "kept", "n")


@query(f"WITH {RAW} SELECT id, {micro('exp((2 * ln(least(greatest(vertical_sigma_mm / 1000.0, 0.001), 1.0)) + ln(least(greatest(sample_count / 3.0, 0.001), 1.0))) / 3.0)')} AS wgm_u FROM raw")
def wgm(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.soundings(spark, sf_dir)
    return s.select("id", nb.micro(nb.weighted_geometric_mean([(nb.metres("vertical_sigma_mm"), 2), (F.col("sample_count") / 3.0, 1), (F.lit(0.5), 0)])).alias("wgm_u"))


# Depths.

_OFFSET = "CASE depth_reference WHEN 'belowKeel' THEN 1.5 WHEN 'belowSurface' THEN 0.0 ELSE 0.5 END"


@query(f"WITH {RAW} SELECT id, {milli(f'datum_depth_mm / 1000.0 + {_OFFSET} - tide_height_mm / 1000.0')} AS datum_mm FROM raw")
def datum_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.soundings(spark, sf_dir)
    return s.select("id", nb.millimetres(depth.datum_depth_m(nb.metres("datum_depth_mm"), depth.reference_offset_m("depth_reference", CONFIG), nb.metres("tide_height_mm"))).alias("datum_mm"))


@query(f"WITH {RAW} SELECT id, {micro('sqrt(0.2 * 0.2 + 0.1 * 0.1 + 0.25 * 0.25 + pow(input_time_skew_ms / 1000.0 * 0.05, 2))')} AS live_u, {micro('sqrt(0.2 * 0.2 + 0.1 * 0.1 + 0.25 * 0.25 + pow(input_time_skew_ms / 1000.0 * 0.05, 2) + 0.15 * 0.15)')} AS history_u, {micro('sqrt(0.2 * 0.2 + 0.1 * 0.1 + 0.25 * 0.25 + 0.3 * 0.3 + pow((1.0 + input_time_skew_ms / 1000.0) * 0.15, 2))')} AS corrected_u FROM raw")
def vertical_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, t = fx.soundings(spark, sf_dir), "input_time_skew_ms"
    return s.select("id", nb.micro(depth.live_sigma_m(t, CONFIG)).alias("live_u"), nb.micro(depth.unaligned_sigma_m(t, CONFIG)).alias("history_u"), nb.micro(depth.corrected_sigma_m(F.lit(0.3), t, CONFIG)).alias("corrected_u"))


@query(f"WITH {RAW} SELECT id, CASE WHEN id % 10 = 0 THEN (datum_depth_mm + tide_height_mm) / 1000.0 WHEN depth_reference = 'belowSurface' THEN datum_depth_mm / 1000.0 WHEN depth_reference = 'belowKeel' THEN (datum_depth_mm / 1000.0 + 1.5) ELSE NULL END AS surface_m FROM raw".replace("(datum_depth_mm + tide_height_mm) / 1000.0", "datum_depth_mm / 1000.0 + tide_height_mm / 1000.0"))
def below_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.soundings(spark, sf_dir).withColumn("geometry", F.when(F.col("id") % 10 == 0, F.lit('{"method":"stationary_window"}')).otherwise(F.lit("{}")))
    m = nb.metres("datum_depth_mm")
    return s.select("id", depth.below_surface_m("geometry", "depth_reference", m, m, nb.metres("tide_height_mm"), F.lit(1.5), F.lit(None).cast("double")).alias("surface_m"))


@query(f"WITH {RAW} SELECT id, sha256(concat_ws('|', 'vessels.self', observed_at_ms, lat_e7, lon_e7, depth_source, datum_depth_mm)) AS fingerprint FROM raw")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.soundings(spark, sf_dir).withColumn("context", F.lit("vessels.self"))
    return s.select("id", listing.sounding_fingerprint(raw="datum_depth_mm").alias("fingerprint"))


@query(f"WITH {RAW} SELECT track, lat_e7, lon_e7, min(id) AS id FROM raw WHERE id % 3 > 0 GROUP BY 1, 2, 3 HAVING (track, lat_e7, lon_e7) NOT IN (SELECT track, lat_e7, lon_e7 FROM raw WHERE id % 3 = 0)")
def ingest_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.soundings(spark, sf_dir).withColumn("fingerprint", F.sha2(F.concat_ws("|", "track", "lat_e7", "lon_e7"), 256))
    return store.new_rows(s.filter("id % 3 > 0"), s.filter("id % 3 = 0"), ["id"]).select("track", "lat_e7", "lon_e7", "id")


@query(f"WITH {RAW} SELECT id FROM raw WHERE datum_depth_mm / 1000.0 BETWEEN 0.4 AND 4.5")
def range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.soundings(spark, sf_dir).filter(nb.metres("datum_depth_mm").between(CONFIG.instrument_min_m, 4.5)).select("id")


_LABELLED = "CASE WHEN abs({x}) >= 10 THEN cast(cast(floor({x}) AS bigint) AS varchar) ELSE printf('%.1f', floor(({x}) * 10) / 10) END"


@query(f"WITH {RAW} SELECT id, {_LABELLED.format(x='datum_depth_mm / 1000.0')} AS metres, {_LABELLED.format(x='datum_depth_mm / 1000.0 * 3.28084')} AS feet FROM raw")
def depth_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = nb.metres("datum_depth_mm")
    return fx.soundings(spark, sf_dir).select("id", depth.depth_label(m).alias("metres"), depth.depth_label(m, 3.28084).alias("feet"))


@query(f"WITH {RAW} SELECT id, {milli(f'datum_depth_mm / 1000.0 + {TIDE[0]} - 1.645 * sqrt(pow(vertical_sigma_mm / 1000.0, 2) + {TIDE[1]} * {TIDE[1]})')} AS water_mm, {milli(f'datum_depth_mm / 1000.0 + {TIDE[0]}')} AS predicted_mm FROM raw")
def water_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, s = nb.metres("datum_depth_mm"), nb.metres("vertical_sigma_mm")
    return fx.soundings(spark, sf_dir).select("id", nb.millimetres(depth.water_depth_m(m, s, *TIDE)).alias("water_mm"), nb.millimetres(depth.water_depth_m(m, s, *TIDE, predicted=True)).alias("predicted_mm"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 1.0 WHEN p_partkey % 5 = 1 THEN cast(p_size AS double) WHEN p_partkey % 5 = 2 THEN 1.0 / p_size ELSE NULL END AS factor,
 CASE WHEN p_partkey % 3 = 0 THEN 1 WHEN p_partkey % 3 = 1 THEN 2 ELSE 0 END AS decimals, CASE WHEN p_partkey % 5 = 0 THEN 'm' WHEN p_partkey % 5 = 1 THEN 'ft' WHEN p_partkey % 2 = 0 THEN 'fm' ELSE 'fathom' END AS symbol FROM part""")
def unit_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 5
    unit = F.when(k == 0, "m").when(k == 1, "foot").otherwise("fathom")
    formula = F.when(k == 1, F.format_string("value * %d", "p_size")).when(k == 2, F.format_string(" VALUE / %d ", "p_size")).when(k == 3, "value + 2")
    shape = F.when(F.col("p_partkey") % 3 == 1, "0.000").when(F.col("p_partkey") % 3 == 2, "0")
    return p.select(F.col("p_partkey").alias("id"), depth.unit_factor(unit, formula).alias("factor"), depth.unit_decimals(shape).alias("decimals"), depth.unit_symbol(unit, F.when(F.col("p_partkey") % 2 == 0, " fm ").otherwise("  ")).alias("symbol"))


# Confidence.


@query(f"WITH {RAW} SELECT id, {micro(f'pow(2.0, -greatest(0.0, ({AS_OF} - observed_at_ms) / 86400000.0) / 30.0)')} AS recency_u FROM raw")
def recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.soundings(spark, sf_dir).select("id", nb.micro(confidence.recency("observed_at_ms", AS_OF, 30.0)).alias("recency_u"))


_COUNTS = f"WITH {SOUNDINGS}, c AS (SELECT track, cell_x, cell_y, count(*) AS o, count(DISTINCT pass_id) AS p, count(DISTINCT depth_source) AS s FROM soundings GROUP BY ALL)"


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each track has seen of each cell: counts from one on."""
    return fx.soundings(spark, sf_dir).groupBy("track", "cell_x", "cell_y").agg(F.count("*").alias("o"), F.count_distinct("pass_id").alias("p"), F.count_distinct("depth_source").alias("s"))


@query(f"{_COUNTS} SELECT track, cell_x, cell_y, least(CASE WHEN o <= 1 THEN 0.25 WHEN o = 2 THEN 0.4 ELSE 1.0 END, CASE WHEN p <= 1 THEN 0.35 WHEN p = 2 THEN 0.6 ELSE 1.0 END, CASE WHEN s <= 1 THEN 0.75 ELSE 1.0 END)::DOUBLE AS cap FROM c")
def evidence_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir).select("track", "cell_x", "cell_y", confidence.evidence_cap("o", "p", "s").alias("cap"))


@query(f"{_COUNTS} SELECT track, cell_x, cell_y, concat_ws('|', CASE WHEN o <= 1 THEN 'single_observation' WHEN o = 2 THEN 'only_two_observations' END, CASE WHEN p <= 1 THEN 'single_pass' WHEN p = 2 THEN 'only_two_passes' END, CASE WHEN s <= 1 THEN 'single_source' END) AS reasons FROM c")
def evidence_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir).select("track", "cell_x", "cell_y", F.array_join(confidence.evidence_reasons("o", "p", "s"), "|").alias("reasons"))


@query(f"WITH {RAW} SELECT id, {micro('least(1.0, pow(5.0 * cos(radians(lat_e7 / 1e7)) / (2.0 * coalesce(horizontal_sigma_mm / 1000.0, 3.0)), 2))')} AS cap_u FROM raw")
def horizontal_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    sigma = confidence.valid_sigma(nb.metres("horizontal_sigma_mm"), CONFIG.position_sigma_m)
    return fx.soundings(spark, sf_dir).select("id", nb.micro(confidence.horizontal_cap(sigma, F.col("lat_e7") / 1e7, 5.0)).alias("cap_u"))


# Places.


@query(f"WITH {RAW} SELECT id, {milli('2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(37.81 - lat_e7 / 1e7) / 2), 2) + cos(radians(lat_e7 / 1e7)) * cos(radians(37.81)) * pow(sin(radians(-122.41 - lon_e7 / 1e7) / 2), 2))))')} AS mm FROM raw")
def haversine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.soundings(spark, sf_dir).select("id", nb.millimetres(geo.haversine_m(F.col("lat_e7") / 1e7, F.col("lon_e7") / 1e7, 37.81, -122.41)).alias("mm"))


@query(f"WITH {RAW}, p AS (SELECT id, {MERCATOR} FROM raw) SELECT id, {milli('mx')} AS x_mm, {milli('my')} AS y_mm FROM p")
def mercator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.soundings(spark, sf_dir).select("id", nb.millimetres(geo.mercator_x(F.col("lon_e7") / 1e7)).alias("x_mm"), nb.millimetres(geo.mercator_y(F.col("lat_e7") / 1e7)).alias("y_mm"))


@query(f"WITH {SOUNDINGS} SELECT id, cell_x, cell_y FROM soundings")
def hex_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.soundings(spark, sf_dir).select("id", "cell_x", "cell_y")


@query(f"WITH {SOUNDINGS}, k AS (SELECT DISTINCT cell_x, cell_y FROM soundings), v AS (SELECT *, unnest(range(0, 6)) AS k FROM k) SELECT cell_x, cell_y, k AS corner, {milli('5.0 * (cell_x + cell_y / 2.0) + 5.0 / sqrt(3.0) * cos(radians(k * 60 + 30))')} AS x_mm, {milli('5.0 * sqrt(3.0) / 2 * cell_y + 5.0 / sqrt(3.0) * sin(radians(k * 60 + 30))')} AS y_mm FROM v")
def hex_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = fx.soundings(spark, sf_dir).select("cell_x", "cell_y").distinct()
    v = k.select("cell_x", "cell_y", F.posexplode(geo.hex_vertices("cell_x", "cell_y", 5.0)).alias("corner", "v"))
    return v.select("cell_x", "cell_y", F.col("corner").cast("long").alias("corner"), nb.millimetres("v.x").alias("x_mm"), nb.millimetres("v.y").alias("y_mm"))


def _destination_sql(lat: str, lon: str, east: str, north: str) -> tuple[str, str]:
    d, b, a = f"(sqrt(({east}) * ({east}) + ({north}) * ({north})) / 6371008.8)", f"atan2({east}, {north})", f"radians({lat})"
    out = f"asin(least(1.0, greatest(-1.0, sin({a}) * cos({d}) + cos({a}) * sin({d}) * cos({b}))))"
    lon2 = f"degrees(radians({lon}) + atan2(sin({b}) * sin({d}) * cos({a}), cos({d}) - sin({a}) * sin({out})))"
    return f"degrees({out})", f"(({lon2} + 540.0) % 360.0) - 180.0"


_DEST = _destination_sql("lat_e7 / 1e7", "lon_e7 / 1e7 - (id % 2) * 57.6", "id % 977 * 100.0", "id % 631 * 10.0")


@query(f"WITH {RAW} SELECT id, cast(floor(({_DEST[0]}) * 1e7 + 0.5) AS bigint) AS lat_e7, cast(floor(({_DEST[1]}) * 1e7 + 0.5) AS bigint) AS lon_e7 FROM raw")
def offset_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat, lon = geo.destination(F.col("lat_e7") / 1e7, F.col("lon_e7") / 1e7 - (F.col("id") % 2) * 57.6, F.col("id") % 977 * 100.0, F.col("id") % 631 * 10.0)
    return fx.soundings(spark, sf_dir).select("id", nb.scaled(lat, 1e7).alias("lat_e7"), nb.scaled(lon, 1e7).alias("lon_e7"))


@query(f"SELECT event_id AS id, {milli('-20037508.342789244 + (event_id % 1000) * (40075016.68557849 / pow(2.0, event_id % 15))')} AS west_mm, {milli('20037508.342789244 - (event_id % 777) * (40075016.68557849 / pow(2.0, event_id % 15))')} AS north_mm FROM events")
def tile_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, _, _, n = geo.tile_bounds_columns(F.col("event_id") % 15, F.col("event_id") % 1000, F.col("event_id") % 777)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), nb.millimetres(w).alias("west_mm"), nb.millimetres(n).alias("north_mm"))


@query("SELECT event_id AS id, least(event_id % 20, 12) AS z, (event_id % 5000) // cast(pow(2, greatest(event_id % 20 - 12, 0)) AS bigint) AS x, (event_id % 3000) // cast(pow(2, greatest(event_id % 20 - 12, 0)) AS bigint) AS y FROM events")
def tile_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    z, x, y = geo.parent_tile(F.col("event_id") % 20, F.col("event_id") % 5000, F.col("event_id") % 3000)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), z.alias("z"), x.alias("x"), y.alias("y"))


@query("SELECT DISTINCT event_id % 25 AS z, greatest(5.0, least(640.0, 5.0 * pow(2.0, greatest(0, 20 - event_id % 25)) * 0.5))::DOUBLE AS width_m FROM events")
def overview_meters(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = (F.col("event_id") % 25).alias("z")
    return table(spark, sf_dir, "events").select(z).distinct().withColumn("width_m", geo.overview_width(5.0, "z"))


_TURN = "SELECT event_id AS id, radians(event_id % 50 - 25) AS roll, radians(event_id % 30 - 15) AS pitch, (event_id % 7) * 1.0 AS f, (event_id % 5) * 1.0 AS s, (event_id % 11) * 1.0 AS d FROM events"


@query(f"SELECT id, {micro('cos(pitch) * f + sin(pitch) * (sin(roll) * s + cos(roll) * d)')} AS forward_u, {micro('cos(roll) * s - sin(roll) * d')} AS starboard_u, {micro('cos(pitch) * (sin(roll) * s + cos(roll) * d) - sin(pitch) * f')} AS down_u FROM ({_TURN})")
def rotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    v = beam.rotate(((e % 7) * 1.0, (e % 5) * 1.0, (e % 11) * 1.0), F.radians(e % 50 - 25), F.radians(e % 30 - 15))
    return table(spark, sf_dir, "events").select(e.alias("id"), *[nb.micro(x).alias(n) for x, n in zip(v, ("forward_u", "starboard_u", "down_u"), strict=True)])


_TILT = "acos(least(1.0, greatest(-1.0, cos(pitch) * cos(roll))))"
_BEAM = f"SELECT event_id AS id, radians(event_id % 130 - 65) AS roll, radians(event_id % 30 - 15) AS pitch, radians(event_id % 360) AS h, event_id % 40 - 1.0 AS rng FROM events"


@query(f"""WITH a AS ({_BEAM}), b AS (SELECT *, {_TILT} AS tilt, sin(pitch) * cos(roll) * rng AS fwd, -sin(roll) * rng AS stb FROM a)
SELECT id, {milli('rng * cos(pitch) * cos(roll)')} AS vertical_mm, {milli('fwd * sin(h) + stb * cos(h)')} AS east_mm, {milli('fwd * cos(h) - stb * sin(h)')} AS north_mm, {micro('sqrt(9.0 + pow(rng * sin(radians(10)), 2) + pow(radians(2) * rng, 2))')} AS horizontal_u
FROM b WHERE abs(roll) <= radians(60) AND rng > 0 AND tilt + radians(10) < pi() / 2""")
def beam_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    r = table(spark, sf_dir, "events").select(e.alias("id"), beam.correct(e % 40 - 1.0, F.radians(e % 130 - 65), F.radians(e % 30 - 15), F.radians(e % 360), F.lit(37.8), F.lit(-122.4), 3.0, CONFIG).alias("b"))
    return r.filter("b is not null").select("id", nb.millimetres("b.vertical_m").alias("vertical_mm"), nb.millimetres("b.east_m").alias("east_mm"), nb.millimetres("b.north_m").alias("north_mm"), nb.micro("b.horizontal_sigma_m").alias("horizontal_u"))


# Series in time.


def _asof_sql(left: str, right: str, tolerance: int, columns: str, how: str = "inner") -> str:
    """Rows of left with the right row nearest in time as struct m; both have context, at_ms, event_id."""
    return f"""(SELECT l.* EXCLUDE (a, b) FROM (SELECT l.*, CASE WHEN b IS NOT NULL AND (a IS NULL OR l.at_ms - b.at_ms <= a.at_ms - l.at_ms) THEN CASE WHEN l.at_ms - b.at_ms <= {tolerance} THEN b END ELSE CASE WHEN a.at_ms - l.at_ms <= {tolerance} THEN a END END AS m FROM
  (SELECT l.*, (SELECT max(struct_pack({columns})) FROM {right} r WHERE r.context = l.context AND r.at_ms = (SELECT max(at_ms) FROM {right} x WHERE x.context = l.context AND x.at_ms < l.at_ms)) AS b,
   (SELECT min(struct_pack({columns})) FROM {right} r WHERE r.context = l.context AND r.at_ms = (SELECT min(at_ms) FROM {right} x WHERE x.context = l.context AND x.at_ms >= l.at_ms)) AS a FROM {left} l) l) l {'WHERE m IS NOT NULL' if how == 'inner' else ''})"""


_CHANNELS = f"WITH {SERIES}, " + ", ".join(f"{n} AS (SELECT context, at_ms, event_id, v_milli FROM series WHERE path = '{n}')" for n in ("depth", "tide", "sog", "heading")) + ", fixes AS (SELECT context, at_ms, lat_e7 / 1e7 AS latitude, lon_e7 / 1e7 AS longitude, event_id FROM series WHERE path = 'position')"
_V = "context := r.context, at_ms := r.at_ms, event_id := r.event_id, v_milli := r.v_milli"
_P = "context := r.context, at_ms := r.at_ms, latitude := r.latitude, longitude := r.longitude, event_id := r.event_id"


@query(f"{_CHANNELS} SELECT event_id, m.event_id AS tide_id, m.at_ms - at_ms AS apart_ms FROM {_asof_sql('depth', 'tide', HOUR, _V)}")
def asof_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = asof.nearest(_values(spark, sf_dir, "depth"), _values(spark, sf_dir, "tide"), ["context"], HOUR, stretch_ms=24 * HOUR)
    return m.select("event_id", F.col("match.event_id").alias("tide_id"), (F.col("match.at_ms") - F.col("at_ms")).alias("apart_ms"))


_ALIGNED = f"""{_CHANNELS}, d1 AS (SELECT * RENAME (m AS position) FROM {_asof_sql('depth', 'fixes', HOUR, _P)}), d2 AS (SELECT * RENAME (m AS tide) FROM {_asof_sql('d1', 'tide', 2 * HOUR, _V)}), d3 AS (SELECT * RENAME (m AS speed) FROM {_asof_sql('d2', 'sog', 2 * HOUR, _V, 'left')})"""


@query(f"{_ALIGNED} SELECT event_id, position.event_id AS position_id, tide.event_id AS tide_id, speed.event_id AS speed_id FROM d3")
def align_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = align.align_history(_values(spark, sf_dir, "depth"), _fixes(spark, sf_dir), _values(spark, sf_dir, "tide"), _values(spark, sf_dir, "sog"), ["context"], CONFIG, HOUR, 2 * HOUR)
    return a.select("event_id", F.col("position.event_id").alias("position_id"), F.col("tide.event_id").alias("tide_id"), F.col("speed.event_id").alias("speed_id"))


@query(f"""{_ALIGNED}, s AS (SELECT event_id, v_milli / 1000.0 AS dm, tide.v_milli / 1000.0 AS tm, speed.v_milli / 1000.0 AS sm, greatest(abs(at_ms - position.at_ms), abs(at_ms - tide.at_ms)) AS skew FROM d3)
SELECT event_id, {milli('dm + 0.5 - tm')} AS datum_mm, skew AS skew_ms, {milli('sqrt(9.0 + pow(coalesce(sm, 3.0), 2))')} AS horizontal_mm FROM s WHERE dm BETWEEN 0.4 AND 120.0""")
def history_soundings(spark: SparkSession, sf_dir: str) -> DataFrame:
    def metres_of(n: str, to: str) -> DataFrame:
        return _values(spark, sf_dir, n).withColumn(to, nb.metres("v_milli"))

    a = align.align_history(metres_of("depth", "depth_m"), _fixes(spark, sf_dir), metres_of("tide", "height_m"), metres_of("sog", "sog_mps"), ["context"], CONFIG, HOUR, 2 * HOUR)
    s = align.history_soundings(a, CONFIG, 0.5)
    return s.select("event_id", nb.millimetres("datum_m").alias("datum_mm"), "skew_ms", nb.millimetres("horizontal_sigma_m").alias("horizontal_mm"))


_BRACKET = f"""b0 AS (SELECT d.*, (SELECT max(struct_pack({_P})) FROM fixes r WHERE r.context = d.context AND r.at_ms = (SELECT max(at_ms) FROM fixes x WHERE x.context = d.context AND x.at_ms < d.at_ms)) AS b,
  (SELECT min(struct_pack({_P})) FROM fixes r WHERE r.context = d.context AND r.at_ms = (SELECT min(at_ms) FROM fixes x WHERE x.context = d.context AND x.at_ms >= d.at_ms)) AS a FROM depth d)"""


@query(f"""{_CHANNELS}, {_BRACKET}, s AS (SELECT *, at_ms - b.at_ms AS k, a.at_ms - at_ms AS l FROM b0)
SELECT event_id, CASE WHEN l = 0 THEN 'exact' ELSE 'interpolated' END AS method, cast(floor((CASE WHEN l = 0 THEN a.latitude ELSE b.latitude + (a.latitude - b.latitude) * (k / (k + l)) END) * 1e7 + 0.5) AS bigint) AS lat_e7,
 {milli(f'CASE WHEN l = 0 THEN 3.0 ELSE sqrt(9.0 + pow(greatest(k, l) / 1000.0 * 0.3, 2)) END')} AS sigma_mm FROM s WHERE l = 0 OR (k <= {HOUR} AND l <= {HOUR})""")
def position_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = asof.positions_at(_values(spark, sf_dir, "depth"), _fixes(spark, sf_dir), ["context"], CONFIG, skew_ms=HOUR)
    return p.select("event_id", F.col("position_method").alias("method"), nb.scaled("latitude", 1e7).alias("lat_e7"), nb.millimetres("horizontal_sigma_m").alias("sigma_mm"))


_CARRY = _destination_sql("b.latitude", "b.longitude", "2.5 * (k / 1000.0) * sin(radians(event_id % 360))", "2.5 * (k / 1000.0) * cos(radians(event_id % 360))")


@query(f"""{_CHANNELS}, {_BRACKET}, s AS (SELECT *, at_ms - b.at_ms AS k, a.at_ms - at_ms AS l FROM b0)
SELECT event_id, k AS skew_ms, cast(floor(({_CARRY[0]}) * 1e7 + 0.5) AS bigint) AS lat_e7, cast(floor(({_CARRY[1]}) * 1e7 + 0.5) AS bigint) AS lon_e7 FROM s WHERE k <= {HOUR} AND (l IS NULL OR l > {HOUR})""")
def dead_reckon(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _values(spark, sf_dir, "depth").withColumns({"sog_mps": F.lit(2.5), "cog_rad": F.radians(F.col("event_id") % 360)})
    p = asof.positions_at(d, _fixes(spark, sf_dir), ["context"], CONFIG, project=True, skew_ms=HOUR).filter("position_method = 'projected'")
    return p.select("event_id", F.col("position_skew_ms").alias("skew_ms"), nb.scaled("latitude", 1e7).alias("lat_e7"), nb.scaled("longitude", 1e7).alias("lon_e7"))


_WINDOWS = "wins AS (SELECT event_id AS window_id, context, at_ms - 1800000 AS start_ms, at_ms + 1800000 AS end_ms FROM tide)"


@query(f"{_CHANNELS}, {_WINDOWS} SELECT window_id, event_id FROM wins w JOIN depth d ON d.context = w.context AND d.at_ms BETWEEN start_ms AND end_ms")
def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _values(spark, sf_dir, "tide")
    w = t.select(F.col("event_id").alias("window_id"), "context", (F.col("at_ms") - 1_800_000).alias("start_ms"), (F.col("at_ms") + 1_800_000).alias("end_ms"))
    return asof.in_windows(w, _values(spark, sf_dir, "depth"), ["context"], "start_ms", "end_ms", "at_ms", HOUR).select("window_id", "event_id")


@query(f"""{_CHANNELS}, {_WINDOWS}, j AS (SELECT window_id, start_ms, end_ms, at_ms, at_ms - lag(at_ms) OVER (PARTITION BY window_id ORDER BY at_ms) AS gap FROM wins w JOIN depth d ON d.context = w.context AND d.at_ms BETWEEN start_ms AND end_ms),
g AS (SELECT window_id, count(*) AS n, max(gap) AS gap_ms, min(at_ms) - any_value(start_ms) AS lead_ms, any_value(end_ms) - max(at_ms) AS tail_ms FROM j GROUP BY 1)
SELECT window_id, n, gap_ms, lead_ms <= 120000 AND tail_ms <= 120000 AND coalesce(gap_ms, 0) <= 180000 AND n >= greatest(10, ceil(least(12, 61) * 0.8)) AS is_covered FROM g""")
def reconstruct_ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _values(spark, sf_dir, "tide")
    w = t.select(F.col("event_id").alias("window_id"), "context", (F.col("at_ms") - 1_800_000).alias("start_ms"), (F.col("at_ms") + 1_800_000).alias("end_ms"), F.lit(12).alias("original"))
    return align.covered_windows(w, _values(spark, sf_dir, "depth"), ["context"], ["window_id"], "start_ms", "end_ms", "at_ms", "original", Config(history_resolution_s=60), HOUR)


@query(f"""{_CHANNELS.replace('WITH', 'WITH RECURSIVE')}, o AS (SELECT context, event_id, at_ms, v_milli / 1000.0 AS h, row_number() OVER (PARTITION BY context ORDER BY at_ms, event_id) AS i FROM tide),
k AS (SELECT context, i, event_id, at_ms AS lt, h AS lh, true AS kept FROM o WHERE i = 1 UNION ALL
 SELECT o.context, o.i, o.event_id, CASE WHEN o.at_ms <= lt OR abs(o.h - lh) <= 0.05 * ((o.at_ms - lt) / 60000000.0) THEN o.at_ms ELSE lt END, CASE WHEN o.at_ms <= lt OR abs(o.h - lh) <= 0.05 * ((o.at_ms - lt) / 60000000.0) THEN o.h ELSE lh END, o.at_ms <= lt OR abs(o.h - lh) <= 0.05 * ((o.at_ms - lt) / 60000000.0) FROM k JOIN o ON o.context = k.context AND o.i = k.i + 1)
SELECT context, event_id FROM k WHERE kept""")
def tide_plausible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series are sparse here, so time is taken a thousandth as fast."""
    t = _values(spark, sf_dir, "tide").select("context", (F.col("at_ms") / 1000.0).alias("at_ms"), "event_id", nb.metres("v_milli").alias("height_m"))
    return folds.plausible_tides(t, ["context"], ("at_ms", "event_id")).select("context", "event_id")


@query(f"WITH {RAW}, g AS (SELECT id, track, CASE WHEN observed_at_ms - lag(observed_at_ms) OVER w > {12 * HOUR} OR depth_source <> lag(depth_source) OVER w THEN 1 ELSE 0 END AS new FROM raw WINDOW w AS (PARTITION BY track ORDER BY observed_at_ms, id)) SELECT r.id, cast(sum(new) OVER (PARTITION BY g.track ORDER BY observed_at_ms, r.id ROWS UNBOUNDED PRECEDING) AS bigint) AS segment FROM g JOIN raw r USING (id)")
def track_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.segments(fx.soundings(spark, sf_dir), ["track"], ["observed_at_ms", "id"], "observed_at_ms", 12 * HOUR, "depth_source").select("id", "segment")


@query(f"""{_CHANNELS}, f AS (SELECT *, event_id % 97 AS arrival0 FROM fixes), m AS (SELECT *, max(at_ms) OVER (PARTITION BY context ORDER BY arrival0, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM f),
k AS (SELECT * FROM m WHERE seen IS NULL OR at_ms > seen), n AS (SELECT *, CASE WHEN at_ms - lag(at_ms) OVER (PARTITION BY context ORDER BY at_ms, event_id) > {HOUR} THEN 1 ELSE 0 END AS new FROM k)
SELECT event_id, cast(sum(new) OVER (PARTITION BY context ORDER BY at_ms, event_id ROWS UNBOUNDED PRECEDING) AS bigint) AS segment FROM n""")
def position_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _fixes(spark, sf_dir).withColumn("arrival", F.struct(F.col("event_id") % 97, F.col("event_id")))
    return folds.segments(folds.monotone_fixes(f, ["context"], "arrival"), ["context"], ["at_ms", "event_id"], "at_ms", HOUR).select("event_id", "segment")


@query(f"""WITH RECURSIVE {RAW}, o AS (SELECT id, track, observed_at_ms AS t, lat_e7 / 1e7 AS la, lon_e7 / 1e7 AS lo, row_number() OVER (PARTITION BY track ORDER BY observed_at_ms, id) AS i FROM raw),
k AS (SELECT track, i, id, t AS lt, la AS lla, lo AS llo, true AS kept FROM o WHERE i = 1 UNION ALL SELECT track, i, id, CASE WHEN kp THEN t ELSE lt END, CASE WHEN kp THEN la ELSE lla END, CASE WHEN kp THEN lo ELSE llo END, kp FROM
 (SELECT o.*, lt, lla, llo, o.t - lt >= {48 * HOUR} OR 2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(la - lla) / 2), 2) + cos(radians(lla)) * cos(radians(la)) * pow(sin(radians(lo - llo) / 2), 2)))) >= 120.0 AS kp FROM k JOIN o ON o.track = k.track AND o.i = k.i + 1))
SELECT id, kept FROM k""")
def sampler(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.soundings(spark, sf_dir).select("id", "track", F.col("observed_at_ms").alias("at_ms"), (F.col("lat_e7") / 1e7).alias("latitude"), (F.col("lon_e7") / 1e7).alias("longitude"))
    return folds.sample(s, ["track"], Config(max_interval_s=48 * 3600.0, distance_m=120.0), ("at_ms", "id")).select("id", "kept")


_FAR = "2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(la - ala) / 2), 2) + cos(radians(ala)) * cos(radians(la)) * pow(sin(radians(lo - alo) / 2), 2)))) > 3.0 + 2 * sqrt(asg * asg + sg * sg)"


@query(f"""WITH RECURSIVE {RAW}, o AS (SELECT id, track, observed_at_ms - observed_at_ms % 7200000 AS fix, lat_e7 / 1e7 AS la, lon_e7 / 1e7 AS lo, coalesce(horizontal_sigma_mm / 1000.0, 3.0) AS sg, CASE WHEN id % 3 = 0 THEN (id % 10) / 10.0 END AS v, row_number() OVER (PARTITION BY track ORDER BY observed_at_ms, id) AS i FROM raw),
k AS (SELECT track, i, id, la AS ala, lo AS alo, sg AS asg, CASE WHEN v >= 0.25 THEN NULL ELSE fix END AS seen, 0 AS away, coalesce(v >= 0.25, false) AS moving FROM o WHERE i = 1 UNION ALL
 SELECT track, i, id, CASE WHEN go THEN la ELSE ala END, CASE WHEN go THEN lo ELSE alo END, CASE WHEN go THEN sg ELSE asg END, seen1, away1, go FROM (SELECT *, fast OR away1 >= 3 AS go FROM
 (SELECT *, CASE WHEN fast THEN seen ELSE fix END AS seen1, CASE WHEN fast THEN 0 WHEN fix IS DISTINCT FROM seen THEN CASE WHEN far THEN away + 1 ELSE 0 END ELSE away END AS away1 FROM
 (SELECT o.track, o.i, o.id, la, lo, sg, fix, ala, alo, asg, seen, away, coalesce(v >= 0.25, false) AS fast, {_FAR} AS far FROM k JOIN o ON o.track = k.track AND o.i = k.i + 1))))
SELECT id, moving AS under_way FROM k""")
def under_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Soundings are sparse here, so fixes are two hours apart, and some rows have a speed."""
    s = fx.soundings(spark, sf_dir).select("id", "track", F.col("observed_at_ms").alias("at_ms"), (F.col("observed_at_ms") - F.col("observed_at_ms") % 7_200_000).alias("fix_ms"), (F.col("lat_e7") / 1e7).alias("latitude"), (F.col("lon_e7") / 1e7).alias("longitude"), F.coalesce(nb.metres("horizontal_sigma_mm"), F.lit(3.0)).alias("horizontal_sigma_m"), F.when(F.col("id") % 3 == 0, (F.col("id") % 10) / 10.0).alias("sog_mps"))
    return folds.under_way(s, ["track"], CONFIG, ("at_ms", "id")).select("id", "under_way")


_REST = Config(minimum_speed_mps=30.0, history_resolution_s=60, stationary_window_s=4 * 3600.0, stationary_min_samples=3)
_VISITS = f"""WITH RECURSIVE {RAW}, o AS (SELECT id, track % 5 AS c, observed_at_ms AS t, CASE WHEN id % 17 = 0 THEN NULL ELSE (id % 40) * 1.0 END AS v, datum_depth_mm / 1000.0 AS dm, lat_e7 / 1e7 AS la, lon_e7 / 1e7 AS lo, tide_height_mm / 1000.0 AS ti, input_time_skew_ms AS sk, horizontal_sigma_mm / 1000.0 AS hs, row_number() OVER (PARTITION BY track % 5 ORDER BY observed_at_ms, id) AS i FROM raw),
k AS (SELECT c, i, id, t, CASE WHEN v < 30 THEN t END AS first, t AS last, CASE WHEN v < 30 THEN 1 ELSE 0 END AS n, CASE WHEN v < 30 THEN 1 END AS visit, CASE WHEN v < 30 THEN t END AS opened FROM o WHERE i = 1 UNION ALL
 SELECT c, i, id, t, CASE WHEN v < 30 AND t - f1 < {4 * HOUR} THEN f1 END, CASE WHEN v < 30 THEN t ELSE last END, CASE WHEN v < 30 AND f0 IS NULL THEN n + 1 ELSE n END, CASE WHEN v < 30 THEN CASE WHEN f0 IS NULL THEN n + 1 ELSE n END END, f1 FROM
 (SELECT o.c, o.i, o.id, o.t, o.v, k.n, k.last, CASE WHEN o.t - k.last > 180000 THEN NULL ELSE k.first END AS f0, coalesce(CASE WHEN o.t - k.last > 180000 THEN NULL ELSE k.first END, o.t) AS f1 FROM k JOIN o ON o.c = k.c AND o.i = k.i + 1))"""


def _visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.soundings(spark, sf_dir).select("id", (F.col("track") % 5).alias("context"), F.col("observed_at_ms").alias("at_ms"), F.when(F.col("id") % 17 != 0, (F.col("id") % 40) * 1.0).alias("sog_mps"), nb.metres("datum_depth_mm").alias("datum_m"), (F.col("lat_e7") / 1e7).alias("latitude"), (F.col("lon_e7") / 1e7).alias("longitude"), nb.metres("tide_height_mm").alias("tide_m"), F.col("input_time_skew_ms").alias("skew_ms"), nb.metres("horizontal_sigma_mm").alias("horizontal_sigma_m"))
    return folds.rest_windows(s, ["context"], _REST, ("at_ms", "id"))


@query(f"{_VISITS} SELECT id, cast(visit AS bigint) AS visit FROM k")
def stationary_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _visits(spark, sf_dir).select("id", "visit")


@query(f"""{_VISITS}, w AS (SELECT c, visit, list_sort(list(dm)) AS ds, min(o.t) AS t0, max(o.t) AS t1, count(*) AS n FROM k JOIN o USING (c, i) WHERE visit IS NOT NULL GROUP BY ALL HAVING count(*) >= 3),
g AS (SELECT *, {med('ds')} AS md, greatest(0.5, 4.5 * 1.4826 * {med("list_sort(list_transform(ds, lambda x: abs(x - " + med('ds') + ")))")}) AS gate FROM w),
a AS (SELECT c, visit, any_value(t0) AS t0, any_value(t1) AS t1, any_value(g.n) AS n, list(o.id ORDER BY o.t, o.id) AS ids, list_sort(list(dm)) AS ds, list_sort(list(la)) AS las FROM k JOIN o USING (c, i) JOIN g USING (c, visit) WHERE abs(dm - md) <= gate GROUP BY ALL HAVING count(*) >= 3)
SELECT c AS context, cast(visit AS bigint) AS visit, ids[len(ids) // 2 + 1] AS representative_id, t0 AS window_start_ms, t1 AS window_end_ms, len(ids) AS sample_count, n - len(ids) AS rejected_sample_count, {milli(med('ds'))} AS datum_mm, cast(floor({med('las')} * 1e7 + 0.5) AS bigint) AS lat_e7, least(10, greatest(1, (t1 - t0) // 10000 + 1)) AS effective_samples FROM a""")
def stationary_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _visits(spark, sf_dir).filter("visit is not null").withColumns({"raw_m": F.col("datum_m"), "vertical_sigma_m": F.lit(None).cast("double")})
    # the settings of the gate are the usual ones
    w = rest.reduce_windows(v, ["context", "visit"], Config(stationary_min_samples=3))
    return w.select("context", "visit", "representative_id", "window_start_ms", "window_end_ms", "sample_count", "rejected_sample_count", nb.millimetres("datum_m").alias("datum_mm"), nb.scaled("latitude", 1e7).alias("lat_e7"), "effective_samples")


_FILLED = Config(history_resolution_s=60, minimum_speed_mps=25.0, stationary_window_s=600.0, stationary_min_samples=3)
_X = "at_ms := r.at_ms, x := r.x"
_NUMBERS = ", ".join(f"{n} AS (SELECT context, t // 60000 * 60000 AS at_ms, list_reduce(list_sort(list(x)), lambda a, b: a + b) / count(x) AS x FROM v WHERE path = '{p}' GROUP BY 1, 2)" for n, p in (("depth", "depth"), ("tides", "tide"), ("sog", "sog")))


@query(f"""WITH RECURSIVE {SERIES}, v AS (SELECT context, path, event_id, at_ms // 60 AS t, v_milli / 1000.0 AS x, lat_e7 / 1e7 AS la, lon_e7 / 1e7 AS lo FROM series), {_NUMBERS},
fixes AS (SELECT context, t // 60000 * 60000 AS at_ms, arg_min(la, (t, event_id)) AS la, arg_min(lo, (t, event_id)) AS lo FROM v WHERE path = 'position' GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY context ORDER BY at_ms) AS i FROM tides),
p AS (SELECT context, i, at_ms, x, at_ms AS lt, x AS lx, true AS kept FROM o WHERE i = 1 UNION ALL
 SELECT context, i, at_ms, x, CASE WHEN ok THEN at_ms ELSE lt END, CASE WHEN ok THEN x ELSE lx END, ok FROM (SELECT o.*, lt, lx, abs(o.x - lx) <= 0.05 * ((o.at_ms - lt) / 60000.0) AS ok FROM p JOIN o ON o.context = p.context AND o.i = p.i + 1)),
tide AS (SELECT context, at_ms, x FROM p WHERE kept), ranged AS (SELECT * FROM depth WHERE x BETWEEN 0.4 AND 120.0),
d1 AS (SELECT * RENAME (m AS position) FROM {_asof_sql('ranged', 'fixes', 120_000, "at_ms := r.at_ms, la := r.la, lo := r.lo")}), d2 AS (SELECT * RENAME (m AS td) FROM {_asof_sql('d1', 'tide', 180_000, _X)}), d3 AS (SELECT * RENAME (m AS speed) FROM {_asof_sql('d2', 'sog', 180_000, _X, 'left')}),
s AS (SELECT context AS c, at_ms AS t, position.la AS la, x + 0.5 - td.x AS dm, speed.x AS v, row_number() OVER (PARTITION BY context ORDER BY at_ms) AS i FROM d3),
k AS (SELECT c, i, t, CASE WHEN v < 25 THEN t END AS first, t AS last, CASE WHEN v < 25 THEN 1 ELSE 0 END AS n, CASE WHEN v < 25 THEN 1 END AS visit FROM s WHERE i = 1 UNION ALL
 SELECT c, i, t, CASE WHEN v < 25 AND t - f1 < 600000 THEN f1 END, CASE WHEN v < 25 THEN t ELSE last END, CASE WHEN v < 25 AND f0 IS NULL THEN n + 1 ELSE n END, CASE WHEN v < 25 THEN CASE WHEN f0 IS NULL THEN n + 1 ELSE n END END FROM
 (SELECT s.c, s.i, s.t, s.v, k.n, k.last, CASE WHEN s.t - k.last > 180000 THEN NULL ELSE k.first END AS f0, coalesce(CASE WHEN s.t - k.last > 180000 THEN NULL ELSE k.first END, s.t) AS f1 FROM k JOIN s ON s.c = k.c AND s.i = k.i + 1)),
r AS (SELECT s.*, visit FROM s JOIN k USING (c, i)),
w AS (SELECT c, visit, list_sort(list(dm)) AS ds, min(t) AS t0, max(t) AS t1, count(*) AS n FROM r WHERE visit IS NOT NULL GROUP BY ALL HAVING count(*) >= 3),
g AS (SELECT *, {med('ds')} AS md, greatest(0.5, 4.5 * (1.4826 * {med("list_sort(list_transform(ds, lambda x: abs(x - " + med('ds') + ")))")})) AS gate FROM w),
a AS (SELECT c, visit, any_value(t0) AS t0, any_value(t1) AS t1, any_value(g.n) AS n, list_sort(list(dm)) AS ds, list_sort(list(la)) AS las FROM r JOIN g USING (c, visit) WHERE abs(dm - md) <= gate GROUP BY ALL HAVING count(*) >= 3)
SELECT c AS context, 'history-' || strftime(make_timestamp(t * 1000), '%Y-%m-%d') AS track, 'point' AS aggregation_kind, t AS observed_at_ms, t AS window_start_ms, 1::BIGINT AS sample_count, 0::BIGINT AS rejected_sample_count, {micro('dm')} AS datum_u, cast(floor(la * 1e7 + 0.5) AS bigint) AS lat_e7 FROM r WHERE visit IS NULL
UNION ALL SELECT c, 'history-' || strftime(make_timestamp(t0 * 1000), '%Y-%m-%d') || '-visit-' || visit, 'stationary_window', t1, t0, len(ds), n - len(ds), {micro(med('ds'))}, cast(floor({med('las')} * 1e7 + 0.5) AS bigint) FROM a""")
def backfill_soundings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History of minutes, in one run. Series are sparse here, so time is taken a sixtieth as fast."""
    v = fx.series(spark, sf_dir).withColumn("at_ms", F.floor(F.col("at_ms") / 60))
    numbers = v.filter("path in ('depth', 'tide', 'sog')").select("context", "path", "at_ms", nb.metres("v_milli").cast("string").alias("value"))
    text = F.to_json(F.struct((F.col("lat_e7") / 1e7).alias("latitude"), (F.col("lon_e7") / 1e7).alias("longitude")))
    # of positions of one time the first event's counts
    places = v.filter("path = 'position'").groupBy("context", "path", "at_ms").agg(F.min_by(text, "event_id").alias("value"))
    paths = {"depth": "depth", "position": "position", "tide": "tide", "speed": "sog"}
    s = backfill.backfilled(numbers.unionByName(places), paths, 0, 10**13, _FILLED)
    return s.select("context", "track", "aggregation_kind", "observed_at_ms", "window_start_ms", "sample_count", "rejected_sample_count", nb.micro("datum_m").alias("datum_u"), nb.scaled("latitude", 1e7).alias("lat_e7"))


# Crowdsourced points.

_IMPORTED = f"WITH {CROWD}, pts AS (SELECT * FROM crowd WHERE depth_mm > 0 AND depth_mm <= 12000000)"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.crowd(spark, sf_dir).filter("depth_mm > 0 and depth_mm <= 12000000")


@query(f"{_IMPORTED} SELECT unique_id AS vessel_id, file_uuid AS journey_id, max(platform) AS vessel, max(provider) AS provider, min(observed_at_ms) AS start_ms, max(observed_at_ms) AS end_ms, count(*) AS samples, min(depth_mm) AS min_depth_mm, max(depth_mm) AS max_depth_mm, min(lon_e7) AS west_e7, max(lat_e7) AS north_e7 FROM pts GROUP BY 1, 2")
def journeys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crowd.journeys(_points(spark, sf_dir)).drop("instrument", "south_e7", "east_e7")


@query(f"{_IMPORTED}, j AS (SELECT unique_id AS vessel_id, file_uuid AS journey_id, max(provider) AS provider, min(observed_at_ms) AS start_ms, max(observed_at_ms) AS end_ms FROM pts GROUP BY 1, 2) SELECT * FROM j WHERE provider = 'R' AND end_ms >= 820454400000 AND start_ms < 820454400000 + 86400000")
def journeys_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crowd.matching(crowd.journeys(_points(spark, sf_dir)), provider="R", from_ms=820454400000, through_ms=820454400000).select("vessel_id", "journey_id", "provider", "start_ms", "end_ms")


_POINT_ORDER = ["observed_at_ms", "lat_e7", "lon_e7", "depth_mm", "platform", "provider", "instrument"]
_NUMBERED = f"{_IMPORTED}, numbered AS (SELECT *, row_number() OVER (PARTITION BY unique_id, file_uuid ORDER BY {', '.join(_POINT_ORDER)}) AS id FROM pts)"


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("unique_id", "file_uuid").orderBy(*_POINT_ORDER)
    return _points(spark, sf_dir).withColumn("id", F.row_number().over(w).cast("long"))


@query(f"{_NUMBERED} SELECT id, observed_at_ms, depth_mm FROM numbered WHERE unique_id = 'V7' AND file_uuid = 'F7' AND id > 3 ORDER BY id LIMIT 6")
def journey_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crowd.page(_numbered(spark, sf_dir), "V7", "F7", 3, 5).select("id", "observed_at_ms", "depth_mm")


@query(f"{_NUMBERED}, l AS (SELECT unique_id, file_uuid, id, observed_at_ms AS t, lat_e7 / 1e7 AS la, lon_e7 / 1e7 AS lo, lag(observed_at_ms) OVER w AS t0, lag(lat_e7 / 1e7) OVER w AS la0, lag(lon_e7 / 1e7) OVER w AS lo0 FROM numbered WINDOW w AS (PARTITION BY unique_id, file_uuid ORDER BY id)) SELECT unique_id, file_uuid, id, coalesce(t - t0 > 300000 OR abs(lo - lo0) > 180 OR sqrt(pow((lo0 - lo) * cos(radians(la0)), 2) + pow(la0 - la, 2)) * 111320 > greatest(100.0, (t - t0) / 1000.0 * 30), false) AS is_break FROM l")
def journey_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _numbered(spark, sf_dir).withColumns({"latitude": F.col("lat_e7") / 1e7, "longitude": F.col("lon_e7") / 1e7})
    return folds.breaks(n, ["unique_id", "file_uuid"], ["id"]).select("unique_id", "file_uuid", "id", "is_break")


_CROWD_BOX = (-122.395, 37.805, -122.36, 37.83)


@query(f"{_IMPORTED} SELECT unique_id, file_uuid, observed_at_ms, lat_e7, lon_e7, depth_mm FROM pts WHERE lon_e7 BETWEEN -1223950000 AND -1223600000 AND lat_e7 BETWEEN 378050000 AND 378300000")
def csb_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(spark, sf_dir).filter(listing.in_bbox(_CROWD_BOX)).select("unique_id", "file_uuid", "observed_at_ms", "lat_e7", "lon_e7", "depth_mm")


_KEY = "cast(list_sum([(((lon_e7 + 1800000000) // 2 >> k) & 1) * (1::BIGINT << (2 * k)) + ((lat_e7 + 900000000 >> k) & 1) * (1::BIGINT << (2 * k + 1)) FOR k IN range(0, 31)]) AS bigint)"


@query(f"{_IMPORTED} SELECT unique_id, file_uuid, observed_at_ms, depth_mm, {_KEY} AS place FROM pts")
def place_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places.with_place(_points(spark, sf_dir)).select("unique_id", "file_uuid", "observed_at_ms", "depth_mm", "place")


@query(f"{_IMPORTED} SELECT unique_id, file_uuid, observed_at_ms, lat_e7, lon_e7, depth_mm FROM pts WHERE lon_e7 BETWEEN -1223950000 AND -1223600000 AND lat_e7 BETWEEN 378050000 AND 378300000")
def place_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box by ranges of the key, then exactly."""
    return places.within(places.with_place(_points(spark, sf_dir)), _CROWD_BOX).select("unique_id", "file_uuid", "observed_at_ms", "lat_e7", "lon_e7", "depth_mm")


@query(f"""{_IMPORTED}, g AS (SELECT *, {MERCATOR} FROM pts), q AS (SELECT *, cast(floor(mx / 500.0) AS bigint) AS grid_x, cast(floor(my / 500.0) AS bigint) AS grid_y FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY grid_x, grid_y ORDER BY observed_at_ms DESC, lat_e7, lon_e7, depth_mm, unique_id, file_uuid, platform, provider, instrument) AS n, count(*) OVER (PARTITION BY grid_x, grid_y) AS c FROM q),
a AS (SELECT grid_x, grid_y, count(*) AS samples, list_sort(list(depth_mm)) AS ds, min(depth_mm) AS min_mm, max(depth_mm) AS max_mm FROM q GROUP BY ALL)
SELECT a.grid_x, a.grid_y, samples, cast({med('ds')} * 10 AS bigint) AS median_tenth_mm, min_mm, max_mm, observed_at_ms, platform FROM a JOIN r ON r.grid_x = a.grid_x AND r.grid_y = a.grid_y AND r.n = r.c // 2 + 1""")
def csb_tile_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = crowd.tile_points(_points(spark, sf_dir), 500.0)
    return t.select("grid_x", "grid_y", "samples", (F.col("median_mm") * 10).cast("long").alias("median_tenth_mm"), "min_mm", "max_mm", "observed_at_ms", "platform")


@query(f"{_IMPORTED} SELECT count(DISTINCT (unique_id, file_uuid)) AS journeys, min(lon_e7) AS west_e7, min(lat_e7) AS south_e7, max(lon_e7) AS east_e7, max(lat_e7) AS north_e7 FROM pts")
def journey_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crowd.bounds(crowd.journeys(_points(spark, sf_dir)))


@query(f"{_IMPORTED} SELECT observed_at_ms, lat_e7, lon_e7, depth_mm, unique_id, file_uuid FROM pts ORDER BY observed_at_ms DESC, lat_e7, lon_e7, depth_mm, unique_id, file_uuid LIMIT 1000")
def crowd_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crowd.newest(_points(spark, sf_dir), 1000).select("observed_at_ms", "lat_e7", "lon_e7", "depth_mm", "unique_id", "file_uuid")


_FILES = "files AS (SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'complete' END AS status, o_orderkey % 7 AS invalid_count, 1700000000000 + o_orderkey AS imported_at_ms FROM orders)"


@query(f"{_IMPORTED}, {_FILES} SELECT (SELECT count(*) FROM files WHERE status = 'complete') AS files, cast((SELECT sum(invalid_count) FROM files WHERE status = 'complete') AS bigint) AS invalid, (SELECT max(imported_at_ms) FROM files WHERE status = 'complete') AS latest_ms, (SELECT count(*) FROM pts) AS soundings, (SELECT min(lon_e7) FROM pts) AS west_e7")
def csb_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "P", "failed").otherwise("complete").alias("status"), (F.col("o_orderkey") % 7).alias("invalid_count"), (F.col("o_orderkey") + 1_700_000_000_000).alias("imported_at_ms"))
    return crowd.stats(_points(spark, sf_dir), files).select("files", "invalid", "latest_ms", "soundings", "west_e7")


_INDEX = "SELECT o_orderkey AS ord, strftime(o_orderdate, '%Y%m%d') || '_c' || cast(o_custkey % 50 AS varchar) || CASE WHEN o_orderkey % 11 = 0 THEN '.zip' WHEN o_orderkey % 3 = 0 THEN '.TAR.GZ' ELSE '.tar.gz' END AS name, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderstatus END AS platform FROM orders"


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    name = F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_c"), (F.col("o_custkey") % 50).cast("string"), F.when(k % 11 == 0, ".zip").when(k % 3 == 0, ".TAR.GZ").otherwise(".tar.gz"))
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "orders").select(k.alias("ord"), name.alias("name"), F.when(k % 4 != 0, F.col("o_orderstatus")).alias("platform"), none.alias("provider"), none.alias("instrument"), none.alias("item_id"))


@query(f"SELECT ord, name, coalesce(platform, 'Unknown') AS platform, 'Unknown' AS provider FROM ({_INDEX}) WHERE NOT name LIKE '%.zip' QUALIFY row_number() OVER (PARTITION BY name ORDER BY ord) = 1")
def csb_discover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crowd_source.discover(_index(spark, sf_dir)).select("ord", "name", "platform", "provider")


@query(f"WITH i AS ({_INDEX}), d AS (SELECT * FROM i WHERE NOT name LIKE '%.zip' QUALIFY row_number() OVER (PARTITION BY name ORDER BY ord) = 1), m AS (SELECT DISTINCT name FROM i WHERE platform = 'O') SELECT ord, name FROM d ANTI JOIN m USING (name)")
def csb_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = _index(spark, sf_dir).select("name", F.when(F.col("platform") == "O", "complete").otherwise("failed").alias("status"))
    return crowd_source.missing_files(crowd_source.discover(_index(spark, sf_dir)), manifest).select("ord", "name")


@query(f"SELECT ord, CASE WHEN NOT name LIKE '%.zip' THEN '/csb/csv/' || name[1:4] || '/' || name[5:6] || '/' || name[7:8] || '/' || regexp_replace(name, '(?i)\\.tar\\.gz$', '') || '.csv' END AS path FROM ({_INDEX})")
def csb_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).select("ord", crowd_source.csv_path(F.col("name")).alias("path"))


_CSV = """SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN l_partkey % 13 = 0 THEN '' WHEN l_partkey % 17 = 0 THEN 'x' ELSE cast(l_partkey % 360 - 180 AS varchar) END AS lon, cast(l_suppkey % 90 AS varchar) AS lat,
 CASE WHEN l_linenumber = 7 THEN '-1000000000' WHEN l_linenumber = 6 THEN '' ELSE cast(cast(l_quantity AS bigint) AS varchar) END AS dep, CASE WHEN l_partkey % 19 = 0 THEN 'never' ELSE strftime(l_shipdate, '%Y-%m-%d') || 'T00:00:00Z' END AS tim, CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END AS prov FROM lineitem"""
_PARSED = f"""WITH t AS ({_CSV}), p AS (SELECT k, n, CASE WHEN lon = '' THEN 0.0 ELSE try_cast(lon AS double) END AS lo, cast(lat AS double) AS la, CASE WHEN dep = '' THEN 0.0 ELSE try_cast(dep AS double) END AS de, CASE WHEN tim = 'never' THEN NULL ELSE epoch_ms(cast(replace(replace(tim, 'T', ' '), 'Z', '') AS timestamp)) END AS at_ms, coalesce(nullif(prov, ''), 'given') AS provider FROM t),
inside AS (SELECT *, de > 0 AND de <= 12000 AND at_ms IS NOT NULL AS ok FROM p WHERE lo BETWEEN -60 AND 60 AND la BETWEEN 10 AND 50)"""


def _csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_partkey")
    rows = table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("UNIQUE_ID"), F.when(k % 13 == 0, "").when(k % 17 == 0, "x").otherwise((k % 360 - 180).cast("string")).alias("LON"), (F.col("l_suppkey") % 90).cast("string").alias("LAT"),
        F.when(F.col("l_linenumber") == 7, "-1000000000").when(F.col("l_linenumber") == 6, "").otherwise(F.col("l_quantity").cast("long").cast("string")).alias("DEPTH"),
        F.when(k % 19 == 0, "never").otherwise(F.concat(F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit("T00:00:00Z"))).alias("TIME"), F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag")).alias("PROVIDER"),
    )
    return crowd_source.parse(rows, (-60.0, 10.0, 60.0, 50.0), {"provider": "given"})


@query(f"{_PARSED} SELECT concat_ws('-', k, n) AS unique_id, lo AS longitude, la AS latitude, de AS depth_m, at_ms AS observed_at_ms, provider FROM inside WHERE ok")
def csb_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _csv(spark, sf_dir).filter("is_valid").select("unique_id", "longitude", "latitude", "depth_m", "observed_at_ms", "provider")


@query(f"{_PARSED} SELECT count(*) FILTER (ok) AS valid, count(*) FILTER (NOT ok) AS invalid FROM inside")
def csb_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _csv(spark, sf_dir).agg(F.count_if(F.col("is_valid")).alias("valid"), F.count_if(~F.col("is_valid")).alias("invalid"))


@query(f"WITH {CROWD} SELECT unique_id, file_uuid, coalesce(nullif(provider, ''), instrument) AS provider, count(*) AS n FROM crowd GROUP BY ALL")
def csb_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.crowd(spark, sf_dir)
    return c.groupBy("unique_id", "file_uuid", crowd_source.fallback(F.col("provider"), F.col("instrument")).alias("provider")).agg(F.count("*").alias("n"))


@query("""SELECT event_id AS id, CASE WHEN event_id % 4 = 0 THEN 2 WHEN event_id % 4 = 1 THEN 0 WHEN event_id % 4 = 2 THEN 0 ELSE 0 END AS n, CASE WHEN event_id % 4 = 0 THEN event_type END AS first, CASE WHEN event_id % 4 = 1 THEN cast(user_id AS varchar) END AS inner_value FROM events""")
def json_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons as JSON arrays, of which some are objects, broken or missing."""
    k = F.col("event_id") % 4
    doc = F.when(k == 0, F.format_string('["%s", 7]', "event_type")).when(k == 1, F.format_string('{"a": {"b": %d}}', "user_id")).when(k == 2, F.lit('["x"'))
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), doc.alias("doc"))
    reasons = text.json_array("doc")
    return e.select("id", F.size(reasons).alias("n"), F.get(reasons, F.lit(0)).alias("first"), text.json_at("doc", "a.b").alias("inner_value"))


# Journal and deltas.

_KEPT = f"WITH {JOURNAL}, kept AS (SELECT *, row_number() OVER (ORDER BY seq) AS id FROM journal0 WHERE received_at_ms = observed_at_ms)"


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = fx.journal(spark, sf_dir)
    none = F.lit(None)
    tide = F.when(F.col("tide_mm").isNotNull(), F.struct(nb.metres("tide_mm").alias("height_m"), F.lit(0.25).alias("sigma_m"), F.lit("MLLW").alias("datum"), F.col("tide_stale").alias("stale")))
    place = F.when(F.col("has_position"), F.struct((F.col("lat_e7") / 1e7).alias("latitude"), (F.col("lon_e7") / 1e7).alias("longitude"), F.col("observed_at_ms").alias("timestamp_ms"), F.lit("gps").alias("source")))
    return j.select(
        "seq", "observed_at_ms", "received_at_ms", nb.metres("depth_mm").alias("depth_m"), F.lit("belowKeel").alias("depth_reference"), "depth_source", place.alias("position"), tide.alias("tide"), nb.metres("surface_offset_mm").alias("surface_offset_m"),
        F.create_map(F.lit("depthPath"), F.lit("depth.belowKeel")).alias("installation"), F.when(F.col("quality").isNull(), F.array().cast("array<string>")).otherwise(F.array("quality")).alias("quality"), none.cast("string").alias("note"),
    )


def _journal(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None, before: DataFrame | None = None) -> DataFrame:
    rows = _observed(spark, sf_dir) if rows is None else rows
    return journal_source.append(before, rows, [c for c in rows.columns if c != "received_at_ms"], ["seq", "received_at_ms"])


@query(f"{_KEPT} SELECT id, seq, received_at_ms FROM kept")
def journal_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _journal(spark, sf_dir).select("id", "seq", "received_at_ms")


@query(f"WITH {JOURNAL} SELECT row_number() OVER (ORDER BY observed_at_ms >= {CUT}, seq) AS id, seq FROM journal0 WHERE received_at_ms = observed_at_ms")
def journal_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A journal of what was observed before a time, then all observations again: only what is new gets numbers."""
    rows = _observed(spark, sf_dir)
    first = _journal(spark, sf_dir, rows.filter(F.col("observed_at_ms") < CUT))
    return first.select("id", "seq").unionByName(_journal(spark, sf_dir, rows, first).select("id", "seq"))


@query(f"{_KEPT} SELECT id, observed_at_ms FROM kept WHERE id > 500 ORDER BY id LIMIT 1000")
def journal_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal_source.read(_journal(spark, sf_dir), 500, 1000).select("id", "observed_at_ms")


@query(f"{_KEPT} SELECT id, CASE WHEN tide_mm IS NOT NULL AND NOT tide_stale AND quality IS NULL THEN {milli('depth_mm / 1000.0 + 1.5 - tide_mm / 1000.0')} END AS corrected_mm, CASE WHEN tide_mm IS NOT NULL AND NOT tide_stale AND quality IS NULL THEN 'MLLW' END AS datum FROM kept")
def journal_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = journal_source.with_corrections(_journal(spark, sf_dir))
    return r.select("id", nb.millimetres("corrected_m").alias("corrected_mm"), F.col("corrected_datum").alias("datum"))


@query(f"{_KEPT} SELECT count(*) AS count, min(observed_at_ms) AS first_at_ms, max(observed_at_ms) AS last_at_ms, max(id) AS last_id FROM kept")
def journal_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal_source.status(_journal(spark, sf_dir))


@query(f"{_KEPT} SELECT id, lon_e7 / 1e7 AS longitude, lat_e7 / 1e7 AS latitude, depth_mm / 1000.0 AS depth, depth_source FROM kept WHERE quality IS NULL AND has_position")
def journal_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = journal_source.features(_journal(spark, sf_dir))
    shape = "struct<geometry:struct<coordinates:array<double>>,properties:struct<depth:double,depthSource:string>>"
    f = f.withColumn("f", F.from_json("feature", shape))
    return f.select("id", F.col("f.geometry.coordinates")[0].alias("longitude"), F.col("f.geometry.coordinates")[1].alias("latitude"), F.col("f.properties.depth").alias("depth"), F.col("f.properties.depthSource").alias("depth_source"))


@query("""SELECT event_id AS id, concat_ws('|', CASE WHEN event_id % 6 = 0 THEN 'receipt-time-only' END, CASE WHEN event_id % 10 = 0 THEN 'future-observation-time' END, CASE WHEN event_id % 9 = 0 THEN 'missing-position' WHEN event_id % 4 = 0 THEN 'stale-position' END,
 CASE WHEN event_id % 9 <> 0 AND event_id % 5 = 0 THEN 'position-receipt-time-only' END, CASE WHEN value < 0.4 OR value > 120 THEN 'outside-instrument-range' END) AS flags FROM events""")
def quality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k, t = F.col("event_id"), F.unix_millis(F.col("ts").cast("timestamp"))
    flags = journal_source.quality_flags(k % 6 == 0, t, F.when(k % 10 == 0, t - 1001).otherwise(t), F.when(k % 9 != 0, F.when(k % 4 == 0, t - 2001).otherwise(t - 2000)), k % 5 == 0, F.col("value"), CONFIG.instrument_min_m, CONFIG.instrument_max_m, 2000)
    return e.select(k.alias("id"), F.array_join(flags, "|").alias("flags"))


@query("""SELECT 'vessels.' || (event_id % 3) AS context, event_type AS path, CASE event_id % 5 WHEN 0 THEN 's' || user_id WHEN 1 THEN 'lbl' WHEN 2 THEN 'src' WHEN 3 THEN 'NMEA' ELSE 'unknown' END AS source,
 CASE WHEN event_id % 8 = 0 THEN 77 ELSE epoch_ms(date_trunc('millisecond', cast(ts AS timestamp))) END AS at_ms, count(*) AS n FROM events WHERE event_id % 12 <> 5 GROUP BY ALL""")
def delta_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    source = F.struct(F.when(k % 5 == 1, "lbl").alias("label"), F.when(k % 5 == 2, "src").alias("src"), F.when(k % 5 == 3, "NMEA").alias("type"))
    values = F.array(F.struct(F.col("event_type").alias("path"), F.col("value").cast("string").alias("value"), F.struct((k % 12 == 5).alias("timedOut")).alias("state")))
    update = F.struct(F.when(k % 8 == 0, F.lit("not a time")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).alias("timestamp"), F.when(k % 5 == 0, F.concat(F.lit("s"), F.col("user_id"))).alias("$source"), source.alias("source"), values.alias("values"))
    empty = F.struct(F.lit("2024-01-01T00:00:00.000Z").alias("timestamp"), F.lit("s").alias("$source"), source.alias("source"), F.slice(values, 1, 0).alias("values"))
    messages = table(spark, sf_dir, "events").select(F.concat(F.lit("vessels."), (k % 3).cast("string")).alias("context"), F.array(update, empty).alias("updates"))
    return deltas.flatten(messages, F.lit(77).cast("long")).groupBy("context", "path", "source", "at_ms").agg(F.count("*").alias("n"))
