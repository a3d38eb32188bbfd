"""What can be asked of stored soundings and cells: listings, lookups, changes, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadline.config import Config
from leadline.functions.confidence import DAY_MS
from leadline.functions.geo import cell_of, cell_range
from leadline.functions.numbers import half_up, metres
from leadline.operators.surface import read_cells, with_neighbours

Bbox = tuple[float, float, float, float]


#: The column of a position's key along the curve, where a table has one.
PLACE = "place"


def box_e7(bbox: Bbox) -> tuple[int, int, int, int]:
    """A box in fixed point."""
    w, s, e, n = (int(x * 1e7 + (0.5 if x >= 0 else -0.5)) for x in bbox)
    return w, s, e, n


def in_bbox(bbox: Bbox, lat: str = "lat_e7", lon: str = "lon_e7") -> Column:
    """Fixed-point positions in (west, south, east, north), edges included; pushed down to the scan."""
    w, s, e, n = box_e7(bbox)
    return F.col(lon).between(w, e) & F.col(lat).between(s, n)


def soundings(stored: DataFrame, qc: DataFrame, bbox: Bbox | None = None, from_ms: int | None = None, to_ms: int | None = None, state: str | None = None, limit: int | None = None) -> DataFrame:
    """Soundings with their QC, both ends of the time included, newest first if limited (ties by id)."""
    rows = stored
    if bbox is not None:
        rows = rows.filter(in_bbox(bbox))
    if from_ms is not None:
        rows = rows.filter(F.col("observed_at_ms") >= from_ms)
    if to_ms is not None:
        rows = rows.filter(F.col("observed_at_ms") <= to_ms)
    q = qc if state is None else qc.filter(F.col("qc_state") == state)
    out = rows.join(q.withColumnRenamed("sounding_id", "id"), "id")
    return out if limit is None else out.orderBy(F.desc("observed_at_ms"), "id").limit(limit)


def iso(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def listed(rows: DataFrame) -> DataFrame:
    """Soundings decoded for reading: degrees, metres, ISO times."""
    return rows.select("id", iso(F.col("observed_at_ms")).alias("observed_at"), (F.col("lat_e7") / 1e7).alias("latitude"), (F.col("lon_e7") / 1e7).alias("longitude"), metres("datum_depth_mm").alias("datum_m"), metres("vertical_sigma_mm").alias("vertical_sigma_m"), "pass_id", "depth_source", "sample_count", "qc_state", "reasons")


def cells_in(cells: DataFrame, bounds: tuple[float, float, float, float], width_m: float, datum: str, margin: int = 2) -> DataFrame:
    """Cells that may touch Mercator bounds: a parallelogram of axial keys with a margin, as literals that prune the scan."""
    x0, x1, y0, y1 = cell_range(bounds, width_m, margin)
    return cells.filter(F.col("cell_x").between(x0, x1) & F.col("cell_y").between(y0, y1) & (F.col("datum") == datum))


def shown_in(cells: DataFrame, bounds: tuple[float, float, float, float], config: Config, as_of_ms: int, datum: str | None = None) -> DataFrame:
    """Stored cells in Mercator bounds as they are shown, with neighbour confidence: only they and a ring around them are read."""
    d = datum or config.target_datum
    ring = cells_in(cells, bounds, config.base_cell_m, d, margin=3)
    return cells_in(with_neighbours(read_cells(ring, config, as_of_ms), config), bounds, config.base_cell_m, d)


def lookup(cells: DataFrame, lat: float, lon: float, config: Config, datum: str | None = None) -> DataFrame:
    """The cell that holds a position."""
    x, y = cell_of(lat, lon, config.base_cell_m)
    return cells.filter((F.col("cell_x") == x) & (F.col("cell_y") == y) & (F.col("datum") == (datum or config.target_datum)))


def changes(cells: DataFrame, since_ms: int, datum: str, limit: int | None = None) -> DataFrame:
    """Cells that aren't stable and were updated since, newest first (ties by cell)."""
    out = cells.filter((F.col("datum") == datum) & (F.col("updated_at_ms") >= since_ms) & (F.col("change_state") != "stable"))
    return out if limit is None else out.orderBy(F.desc("updated_at_ms"), "cell_x", "cell_y").limit(limit)


def rebuild_targets(stored: DataFrame, from_ms: int, to_ms: int) -> DataFrame:
    """Soundings that history can rebuild, in [from, to)."""
    methods = ("exact", "interpolated", "history_unaligned")
    return stored.filter(F.col("position_method").isin(*methods) & (F.col("observed_at_ms") >= from_ms) & (F.col("observed_at_ms") < to_ms))


def rebuild_range(stored: DataFrame) -> DataFrame:
    methods = ("exact", "interpolated", "history_unaligned")
    return stored.filter(F.col("position_method").isin(*methods)).agg(F.min("observed_at_ms").alias("from_ms"), (F.max("observed_at_ms") + 1).alias("to_ms"))


def revision(cells: DataFrame) -> DataFrame:
    """One row: when a cell was last updated, 0 without cells."""
    return cells.agg(F.coalesce(F.max("updated_at_ms"), F.lit(0)).cast("long").alias("revision"))


def stats(stored: DataFrame, qc: DataFrame, cells: DataFrame, replaced: DataFrame) -> DataFrame:
    """One row of counts, sums and bounds of all that is stored."""
    active = stored.join(replaced.select(F.col("original_id").alias("id")), "id", "left_anti")
    s = active.agg(
        F.count("*").alias("soundings"), F.coalesce(F.sum("sample_count"), F.lit(0)).cast("long").alias("source_samples"), F.coalesce(F.sum("rejected_sample_count"), F.lit(0)).cast("long").alias("rejected_samples"), F.max("observed_at_ms").alias("latest_ms"),
        F.min("lon_e7").alias("west_e7"), F.min("lat_e7").alias("south_e7"), F.max("lon_e7").alias("east_e7"), F.max("lat_e7").alias("north_e7"),
    )
    q = qc.join(active.select(F.col("id").alias("sounding_id")), "sounding_id", "left_semi").agg(F.count_if(F.col("qc_state") == "accepted").alias("accepted"), F.count_if(F.col("qc_state") == "quarantined").alias("quarantined"))
    one = cells.agg(F.count("*").alias("cells"), F.coalesce(F.max("updated_at_ms"), F.lit(0)).alias("revision"))
    superseded = replaced.agg(F.count("*").alias("superseded"))
    # four frames of one row each
    return s.join(q).join(one).join(superseded)


def audit(cells: DataFrame, as_of_ms: int, half_life_days: float) -> DataFrame:
    """How many shown cells lack confidence, passes or sources, are old, or changed."""
    return cells.agg(
        F.count_if(F.col("confidence") < 0.55).alias("low_confidence"), F.count_if(F.col("pass_count") <= 1).alias("single_pass"), F.count_if(F.col("source_count") <= 1).alias("single_source"),
        F.count_if((F.lit(as_of_ms) - F.col("newest_at_ms")) / F.lit(float(DAY_MS)) > half_life_days).alias("old"), F.count_if(F.col("change_state") != "stable").alias("changed"),
    )


def evidence(stored: DataFrame, qc: DataFrame) -> DataFrame:
    """What each cell rests on: records, samples, accepted, quarantined. Cell keys say exactly which soundings a cell holds."""
    rows = stored.join(qc.withColumnRenamed("sounding_id", "id"), "id")
    return rows.groupBy("cell_x", "cell_y", F.col("tide_datum").alias("datum")).agg(F.count("*").alias("records"), F.sum("sample_count").cast("long").alias("samples"), F.count_if(F.col("qc_state") == "accepted").alias("accepted"), F.count_if(F.col("qc_state") == "quarantined").alias("quarantined"))


def fixed_point(rows: DataFrame) -> DataFrame:
    """A sounding's metres and degrees as they are stored."""
    mm = lambda n: half_up(F.col(n) * 1000.0)
    return rows.withColumns({"lat_e7": half_up(F.col("latitude") * 1e7), "lon_e7": half_up(F.col("longitude") * 1e7), "depth_raw_mm": mm("raw_m"), "datum_depth_mm": mm("datum_m"), "tide_height_mm": mm("tide_m"), "vertical_sigma_mm": F.greatest(F.lit(1).cast("long"), mm("vertical_sigma_m")), "horizontal_sigma_mm": mm("horizontal_sigma_m")})


def sounding_fingerprint(context: str = "context", time: str = "observed_at_ms", lat: str = "lat_e7", lon: str = "lon_e7", source: str = "depth_source", raw: str = "depth_raw_mm", extra: tuple[str, ...] = ()) -> Column:
    """SHA-256 of what makes a sounding the same one."""
    return F.sha2(F.concat_ws("|", *[F.col(n).cast("string") for n in (context, time, lat, lon, source, raw, *extra)]), 256)
