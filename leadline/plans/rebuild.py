"""Stored soundings rebuilt from history, chunk by chunk: a chunk is one commit, so a job that is stopped goes on where it was."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadline.config import Config
from leadline.functions.beam import Installation
from leadline.functions.geo import hex_cell, mercator_x, mercator_y
from leadline.operators.align import corrected_history, reconstruct
from leadline.operators.folds import plausible_tides
from leadline.operators.listing import fixed_point, rebuild_targets, sounding_fingerprint
from leadline.sources.deltas import position, resample
from leadline.streaming.cells import Surface

#: Length of a chunk, and how far beyond it series are read.
CHUNK_MS, MARGIN_MS = 6 * 3_600_000, 10 * 60_000
#: Series that are needed: position has latitude and longitude, the others a value.
CHANNELS = ("depth", "position", "roll", "pitch", "heading", "speed", "tide")


def chunks(from_ms: int, to_ms: int, chunk_ms: int = CHUNK_MS) -> list[tuple[int, int]]:
    """[from, to) in chunks, whose borders don't depend on where the span begins."""
    edges = [from_ms, *range((from_ms // chunk_ms + 1) * chunk_ms, to_ms, chunk_ms), to_ms]
    return [*zip(edges, edges[1:], strict=False)] if from_ms < to_ms else []


def series_reader(values: DataFrame, paths: dict[str, str], config: Config) -> Callable[[int, int], dict[str, DataFrame]]:
    """A reader of series from stored delta values (context, path, at_ms, value as text); ``paths`` gives the path of each channel.

    Each series is its own scan, by path and time, and has the first value of each bucket of the history's resolution, as
    means of angles wouldn't do. Roll and pitch come from the path of ``attitude``. Attitude needs buckets of a second.
    """
    if config.history_resolution_s != 1:
        raise ValueError("attitude can be rebuilt from buckets of one second only")

    def series(path: str, from_ms: int, to_ms: int) -> DataFrame:
        rows = values.filter((F.col("path") == path) & (F.col("at_ms") >= from_ms) & (F.col("at_ms") < to_ms))
        return resample(rows.filter("value is not null"), ["context"], 1000 * config.history_resolution_s)

    def number(rows: DataFrame, value) -> DataFrame:
        x = value.try_cast("double")
        return rows.select("context", "at_ms", F.when(F.abs(x) < float("inf"), x).alias("value")).filter("value is not null")

    def read(from_ms: int, to_ms: int) -> dict[str, DataFrame]:
        of = {n: series(paths[n], from_ms, to_ms) for n in ("depth", "position", "attitude", "heading", "speed", "tide")}
        lat, lon = position(F.col("value"))
        places = of["position"].select("context", "at_ms", lat.alias("latitude"), lon.alias("longitude")).filter("latitude is not null and longitude is not null")
        turns = {n: number(of["attitude"], F.get_json_object("value", f"$.{n}")) for n in ("roll", "pitch")}
        return {n: number(of[n], F.col("value")) for n in ("depth", "heading", "speed", "tide")} | turns | {"position": places}

    return read


def successors_of(originals: DataFrame, made: DataFrame, config: Config) -> DataFrame:
    """Rebuilt soundings with all the columns of the stored ones that they replace."""
    fresh = ["latitude", "longitude", "raw_m", "tide_m", "datum_m", "horizontal_sigma_m", "vertical_sigma_m", "sample_count", "position_method", "replaces_id"]
    rest = [c for c in originals.columns if c not in {*fresh, "input_time_skew_ms", "area", "seq"}]
    rows = originals.select(*rest).join(made.select(F.col("target_id").alias("id"), *fresh, F.col("skew_ms").alias("input_time_skew_ms")), "id")
    x, y = hex_cell(mercator_x(F.col("lon_e7") / 1e7), mercator_y(F.col("lat_e7") / 1e7), config.base_cell_m)
    rows = fixed_point(rows).withColumns({"cell_x": x, "cell_y": y}).withColumn("fingerprint", sounding_fingerprint(extra=("replaces_id", "position_method")))
    return rows.withColumn("id", F.col("fingerprint"))


def rebuild_history(surface: Surface, read: Callable[[int, int], dict[str, DataFrame]], from_ms: int, to_ms: int, updated_at_ms: int, by: tuple[str, ...] = ("context",), installation: Installation | None = None, chunk_ms: int = CHUNK_MS, stop: Callable[[], bool] = lambda: False) -> int:
    """Rebuilds the soundings of [from, to) that history can; gives the number of chunks that are done, those of earlier runs among them.

    ``read(from, to)`` gives the series of ``CHANNELS`` in that time; tides that leap are dropped.
    """
    done, keys, name = 0, list(by), f"rebuild:{from_ms}:{to_ms}:{chunk_ms}"
    for number, (a, b) in enumerate(chunks(from_ms, to_ms, chunk_ms)):
        if stop():
            break
        if not surface.has(name, number):
            active = surface.active()
            s = read(a - MARGIN_MS, b + MARGIN_MS)
            tides = plausible_tides(s["tide"].withColumn("height_m", F.col("value")), keys).drop("height_m")
            corrected = corrected_history(s["depth"], s["position"], s["roll"], s["pitch"], s["heading"], s["speed"], tides, keys, surface.config, installation)
            targets = rebuild_targets(active, a, b).withColumn("offset_m", F.col("surface_offset_m"))
            made = reconstruct(targets.select("id", *keys, "observed_at_ms", "window_start_ms", "window_end_ms", "sample_count", "offset_m", "depth_reference", "tide_datum", "aggregation_kind"), corrected, keys, surface.config)
            surface.replace(successors_of(active, made, surface.config), name, updated_at_ms, number)
        done += 1
    return done
