"""History into soundings: series of depth, position, tide, speed and attitude aligned in time and reduced to a datum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadline.config import Config
from leadline.functions.beam import Installation, correct
from leadline.functions.depth import corrected_sigma_m, datum_depth_m, history_horizontal_sigma_m, unaligned_sigma_m
from leadline.functions.numbers import hypot3
from leadline.operators.asof import coverage, in_windows, nearest, positions_at
from leadline.operators.rest import reduce_windows

POSITION_TOLERANCE_MS, TIDE_TOLERANCE_MS = 5000, 180_000


def align_history(depths: DataFrame, positions: DataFrame, tides: DataFrame, speeds: DataFrame, by: list[str], config: Config, position_ms: int | None = None, tide_ms: int | None = None) -> DataFrame:
    """Depth rows with the position and tide nearest in time (both needed) and the speed (if there is one), as structs."""
    p = max(POSITION_TOLERANCE_MS, 1000 * config.history_resolution_s) if position_ms is None else position_ms
    t = max(TIDE_TOLERANCE_MS, 1000 * config.history_resolution_s) if tide_ms is None else tide_ms
    rows = nearest(depths, positions, by, p, "position")
    rows = nearest(rows, tides, by, t, "tide")
    return nearest(rows, speeds, by, t, "speed", how="left")


def history_soundings(aligned: DataFrame, config: Config, offset_m: float) -> DataFrame:
    """Aligned rows (depth_m; position.latitude, longitude; tide.height_m; speed.sog_mps) in instrument range, reduced."""
    skew = F.greatest(F.abs(F.col("at_ms") - F.col("position.at_ms")), F.abs(F.col("at_ms") - F.col("tide.at_ms")))
    rows = aligned.filter(F.col("depth_m").between(config.instrument_min_m, config.instrument_max_m)).withColumn("skew_ms", skew)
    return rows.withColumns({
        "datum_m": datum_depth_m("depth_m", F.lit(offset_m), "tide.height_m"),
        "vertical_sigma_m": unaligned_sigma_m("skew_ms", config),
        "horizontal_sigma_m": history_horizontal_sigma_m("speed.sog_mps", config),
    })


def corrected_history(depths: DataFrame, positions: DataFrame, rolls: DataFrame, pitches: DataFrame, headings: DataFrame, speeds: DataFrame, tides: DataFrame, by: list[str], config: Config, installation: Installation | None = None) -> DataFrame:
    """Soundings whose position and depth are corrected for attitude; all series are needed, speeds must not be negative.

    Series have at_ms and value (radians, m/s, metres), positions latitude and longitude. History isn't carried ahead.
    """
    bucket = 1000 * config.history_resolution_s
    attitude = max(bucket, int(config.attitude_max_age_s * 1000))
    rows = depths.filter(F.col("value").between(config.instrument_min_m, config.instrument_max_m))
    for name, series, ms in (("roll", rolls, attitude), ("pitch", pitches, attitude), ("heading", headings, attitude), ("speed", speeds.filter("value >= 0"), int(config.motion_max_age_s * 1000)), ("tide", tides, int(min(config.tide_max_age_s * 1000, TIDE_TOLERANCE_MS)))):
        rows = nearest(rows, series, by, ms, name)
    rows = positions_at(rows, positions, by, config)
    apart = [F.abs(F.col("at_ms") - F.col(f"{n}.at_ms")) for n in ("roll", "pitch", "heading")]
    rows = rows.withColumn("skew", F.greatest("position_skew_ms", *apart))
    sigma = hypot3("horizontal_sigma_m", F.col("speed.value") * (F.col("skew") + bucket) / 1000)
    rows = rows.withColumn("beam", correct("value", "roll.value", "pitch.value", "heading.value", "latitude", "longitude", sigma, config, installation)).filter("beam is not null")
    return rows.select(
        *by, "at_ms", F.col("value").alias("raw_m"), F.col("tide.value").alias("tide_m"), F.col("beam.latitude").alias("latitude"), F.col("beam.longitude").alias("longitude"),
        datum_depth_m("value", "beam.surface_offset_m", "tide.value", "beam.vertical_m").alias("datum_m"), F.col("beam.surface_offset_m").alias("surface_offset_m"),
        F.col("beam.horizontal_sigma_m").alias("horizontal_sigma_m"), corrected_sigma_m("beam.vertical_sigma_m", "skew", config).alias("vertical_sigma_m"), (F.col("skew") + bucket).alias("skew_ms"), F.lit("history_geometry_v1").alias("position_method"), F.col("speed.value").alias("sog_mps"),
    )


def covered(samples: DataFrame, by: list[str], start: str, end: str, time: str, original: str, config: Config) -> DataFrame:
    """Windows whose samples leave no hole: edges within two buckets, gaps within max(5 s, 3 buckets), and enough of them."""
    w = Window.partitionBy(*by).orderBy(time)
    gaps = samples.withColumn("_gap", F.col(time) - F.lag(time).over(w))
    g = gaps.groupBy(*by).agg(F.min(time).alias("first_ms"), F.max(time).alias("last_ms"), F.max("_gap").alias("gap_ms"), F.count("*").alias("n"), F.first(start).alias("start_ms"), F.first(end).alias("end_ms"), F.first(original).alias("original"))
    return g.select(*by, "n", "gap_ms", _is_covered("start_ms", "end_ms", "original", config).alias("is_covered"))


def covered_windows(windows: DataFrame, samples: DataFrame, by: list[str], ids: list[str], start: str, end: str, time: str, original: str, config: Config, reach_ms: int) -> DataFrame:
    """The same from windows (of ``reach_ms`` at most) and samples of series, of any number in a window: windows with none are left out."""
    g = coverage(windows.select(*by, *[c for c in ids if c not in by], start, end, original), samples, by, start, end, time, reach_ms)
    return g.select(*ids, "n", "gap_ms", _is_covered(start, end, original, config).alias("is_covered"))


def _is_covered(start: str, end: str, original: str, config: Config) -> Column:
    bucket = 1000 * config.history_resolution_s
    buckets = F.floor((F.col(end) - F.col(start)) / bucket) + 1
    enough = F.greatest(F.lit(config.stationary_min_samples), F.ceil(F.least(F.col(original), buckets) * 0.8))
    return (F.col("first_ms") - F.col(start) <= 2 * bucket) & (F.col(end) - F.col("last_ms") <= 2 * bucket) & (F.coalesce("gap_ms", F.lit(0)) <= max(5000, 3 * bucket)) & (F.col("n") >= enough)


def reconstruct(targets: DataFrame, corrected: DataFrame, by: list[str], config: Config) -> DataFrame:
    """Soundings that take the place of stored ones, from corrected history in the targets' windows.

    Targets: id, observed_at_ms, window_start_ms, window_end_ms, sample_count, offset_m, depth_reference,
    tide_datum, aggregation_kind. Only transducer depths with a known offset on the configured datum are rebuilt. A
    window at rest is reduced anew if covered; a point takes the nearest sample of its bucket, the earlier of
    equals. Each row says what it replaces.
    """
    bucket = 1000 * config.history_resolution_s
    t = targets.filter((F.col("depth_reference") == "belowTransducer") & (F.col("tide_datum") == config.target_datum) & F.col("offset_m").isNotNull())
    down = lambda n: F.floor(F.col(n) / bucket) * bucket
    t = t.withColumns({"start_ms": down("window_start_ms"), "end_ms": down("window_end_ms")})
    pairs = in_windows(t, corrected, by, "start_ms", "end_ms", "at_ms", 60_000)
    shift = F.col("offset_m") - F.lit(config.surface_to_transducer_m)
    pairs = pairs.withColumns({"datum_m": F.col("datum_m") + shift, "surface_offset_m": F.col("surface_offset_m") + shift})
    rest = pairs.filter("aggregation_kind = 'stationary_window'").withColumnRenamed("id", "target_id")
    good = covered(rest, ["target_id"], "start_ms", "end_ms", "at_ms", "sample_count", config).filter("is_covered").select("target_id")
    reduced = reduce_windows(rest.join(good, "target_id").withColumn("id", F.col("at_ms")), ["target_id"], config)
    reduced = reduced.select("target_id", "latitude", "longitude", "raw_m", "tide_m", "datum_m", "horizontal_sigma_m", "vertical_sigma_m", F.col("input_time_skew_ms").cast("long").alias("skew_ms"), "sample_count")
    item = F.struct(F.abs(F.col("at_ms") - F.col("observed_at_ms")).alias("apart"), "at_ms", "latitude", "longitude", "raw_m", "tide_m", "datum_m", "horizontal_sigma_m", "vertical_sigma_m", "skew_ms")
    points = pairs.filter("aggregation_kind = 'point'").groupBy(F.col("id").alias("target_id")).agg(F.min(item).alias("p"))
    points = points.select("target_id", *[f"p.{n}" for n in ("latitude", "longitude", "raw_m", "tide_m", "datum_m", "horizontal_sigma_m", "vertical_sigma_m", "skew_ms")], F.lit(1).cast("long").alias("sample_count"))
    return reduced.unionByName(points).withColumns({"replaces_id": F.col("target_id"), "position_method": F.lit("history_geometry_v1")})
