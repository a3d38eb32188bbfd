"""Soundings from history into a surface, chunk by chunk, with windows at rest that go on over a chunk's end.

Four series are read, each by itself: the first position and the mean depth of each bucket of the history's
resolution, the mean tide and speed of buckets of a minute at least. Depths take the position and tide nearest in
time; rows under way are soundings, rows at rest are reduced by window.

A chunk is one commit of the surface. What the next chunk has to know, the rows of the open windows, the number of
windows and the last tide that was kept, is written to the ledger before it; so a job that is stopped goes on where
it was, and any length of chunk gives the soundings of one run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadline.config import Config
from leadline.functions.beam import Installation
from leadline.functions.depth import datum_depth_m, history_horizontal_sigma_m, reference_offset_m, unaligned_sigma_m
from leadline.functions.geo import hex_cell, mercator_x, mercator_y
from leadline.operators.align import POSITION_TOLERANCE_MS, TIDE_TOLERANCE_MS, align_history, corrected_history
from leadline.operators.folds import plausible_tides, rest_windows
from leadline.operators.listing import fixed_point, sounding_fingerprint
from leadline.operators.rest import pass_id, reduce_windows
from leadline.plans.rebuild import CHUNK_MS, chunks
from leadline.sources.deltas import position, resample
from leadline.streaming.cells import Surface
from leadline.streaming.live import PAIRED, stored

#: The longest span of one job, and the shortest bucket of tides and speeds.
MOST_MS, SLOW_BUCKET_MS = 31 * 86_400_000, 60_000
#: Columns of a row on its way to a sounding.
SAMPLE = "at_ms long, latitude double, longitude double, sog_mps double, raw_m double, tide_m double, datum_m double, horizontal_sigma_m double, vertical_sigma_m double, skew_ms long, geometry string"


def history_reader(values: DataFrame, paths: dict[str, str], config: Config) -> Callable[[int, int], dict[str, DataFrame]]:
    """A reader of the four series (position, depth, tide, speed) from stored delta values (context, path, at_ms, value as text).

    Each is its own scan by path and time. Buckets are whole ones, whatever span is asked for.
    """
    fine = 1000 * config.history_resolution_s
    slow = max(SLOW_BUCKET_MS, fine)

    def read(from_ms: int, to_ms: int) -> dict[str, DataFrame]:
        def rows(name: str, bucket: int) -> DataFrame:
            a, b = from_ms // bucket * bucket, -(-to_ms // bucket) * bucket
            return values.filter((F.col("path") == paths[name]) & (F.col("at_ms") >= a) & (F.col("at_ms") < b) & F.col("value").isNotNull())

        def numbers(name: str, bucket: int) -> DataFrame:
            x = F.col("value").try_cast("double")
            good = rows(name, bucket).withColumn("value", F.when(F.abs(x) < float("inf"), x)).filter("value is not null")
            return resample(good.select("context", "at_ms", "value"), ["context"], bucket, "mean")

        lat, lon = position(F.col("value"))
        placed = resample(rows("position", fine).select("context", "at_ms", "value"), ["context"], fine)
        places = placed.select("context", "at_ms", lat.alias("latitude"), lon.alias("longitude")).filter("latitude is not null and longitude is not null")
        return {"position": places, "depth": numbers("depth", fine), "tide": numbers("tide", slow), "speed": numbers("speed", slow)}

    return read


def history_samples(series: dict[str, DataFrame], by: list[str], config: Config, reference: str) -> DataFrame:
    """Depths in instrument range with the position and tide nearest in time, and speed if there is one, reduced to the datum."""
    two = 2000 * config.history_resolution_s
    depths = series["depth"].filter(F.col("value").between(config.instrument_min_m, config.instrument_max_m)).withColumnRenamed("value", "raw_m")
    rows = align_history(depths, series["position"], series["tide"], series["speed"], by, config, max(POSITION_TOLERANCE_MS, two), max(TIDE_TOLERANCE_MS, two))
    skew = F.lit(1000 * config.history_resolution_s).cast("long")
    return rows.select(
        *by, "at_ms", "position.latitude", "position.longitude", F.col("speed.value").alias("sog_mps"), "raw_m", F.col("tide.value").alias("tide_m"),
        datum_depth_m("raw_m", reference_offset_m(F.lit(reference), config), "tide.value").alias("datum_m"),
        history_horizontal_sigma_m("speed.value", config).alias("horizontal_sigma_m"), unaligned_sigma_m(F.lit(0), config).alias("vertical_sigma_m"), skew.alias("skew_ms"), F.lit("history_unaligned").alias("geometry"),
    )


def corrected_samples(series: dict[str, DataFrame], by: list[str], config: Config, installation: Installation | None) -> DataFrame:
    """The same from series with attitude (``rebuild.CHANNELS``), positions and depths corrected for it."""
    rows = corrected_history(*(series[n] for n in ("depth", "position", "roll", "pitch", "heading", "speed", "tide")), by, config, installation)
    return rows.select(*by, "at_ms", "latitude", "longitude", "sog_mps", "raw_m", "tide_m", "datum_m", "horizontal_sigma_m", "vertical_sigma_m", F.col("skew_ms").cast("long").alias("skew_ms"), F.col("position_method").alias("geometry"))


def split_at_rest(rows: DataFrame, by: list[str], config: Config, ends: bool) -> tuple[DataFrame, DataFrame]:
    """(rows with ``visit``, null under way, those of windows that go on left out; those rows), by the state of each key's last window.

    A window goes on if its rows are the last of its key and it isn't full. With ``ends`` none does.
    """
    seen = rest_windows(rows, by, config)
    if ends:
        return seen, seen.filter("false")
    whole = Window.partitionBy(*by)
    first = F.min("at_ms").over(Window.partitionBy(*by, "visit"))
    last = F.max(F.struct("at_ms", F.coalesce("visit", F.lit(0)).alias("visit"))).over(whole)
    marked = seen.withColumns({"_first": first, "_last": last})
    goes_on = F.col("visit").isNotNull() & (F.col("visit") == F.col("_last.visit")) & (F.col("_last.at_ms") - F.col("_first") < config.stationary_window_s * 1000)
    marked = marked.withColumn("_on", F.coalesce(goes_on, F.lit(False)))
    return marked.filter("not _on").drop("_first", "_last", "_on"), marked.filter("_on").drop("_first", "_last", "_on")


def soundings_of(rows: DataFrame, by: list[str], config: Config, reference: str) -> DataFrame:
    """Rows under way, and one row for each whole window at rest that its samples agree on, as a surface takes them."""
    moving = rows.filter("visit is null").select(
        *by, F.col("at_ms").alias("observed_at_ms"), "latitude", "longitude", "raw_m", "tide_m", "datum_m", "horizontal_sigma_m", "vertical_sigma_m", F.col("skew_ms").alias("input_time_skew_ms"),
        F.lit("point").alias("aggregation_kind"), F.lit(1).cast("long").alias("sample_count"), F.lit(0).cast("long").alias("rejected_sample_count"), F.col("at_ms").alias("window_start_ms"), F.col("at_ms").alias("window_end_ms"),
        F.col("geometry").alias("position_method"), pass_id("at_ms", "geometry", "history").alias("track"), pass_id("at_ms", "geometry", "history").alias("pass_id"),
    )
    # a window's first sample names it; only corrected samples have a sigma that the window must keep
    at_rest = rows.filter("visit is not null").withColumns({"id": F.col("at_ms"), "vertical_sigma_m": F.when(F.col("geometry") == "history_geometry_v1", F.col("vertical_sigma_m"))})
    windows = reduce_windows(at_rest, [*by, "visit"], config)
    track = F.concat(pass_id("window_start_ms", "visit", "history"), F.lit("-visit-"), F.col("visit").cast("string"))
    windows = windows.withColumn("track", track).select(
        *by, "observed_at_ms", "latitude", "longitude", "raw_m", "tide_m", "datum_m", "horizontal_sigma_m", "vertical_sigma_m", F.col("input_time_skew_ms").cast("long").alias("input_time_skew_ms"),
        F.lit("stationary_window").alias("aggregation_kind"), "sample_count", "rejected_sample_count", "window_start_ms", "window_end_ms",
        F.element_at("sample_methods", 1).alias("position_method"), "track", pass_id("observed_at_ms", "track", "stationary").alias("pass_id"),
    )
    s = fixed_point(moving.unionByName(windows)).withColumns({"position_source": F.lit("history:unknown"), "depth_source": F.lit("history:unknown"), "depth_reference": F.lit(reference), "tide_datum": F.lit(config.target_datum), "tide_at_ms": F.col("observed_at_ms")})
    x, y = hex_cell(mercator_x(F.col("lon_e7") / 1e7), mercator_y(F.col("lat_e7") / 1e7), config.base_cell_m)
    s = s.withColumns({"cell_x": x, "cell_y": y, "fingerprint": sounding_fingerprint(context=by[0])}).withColumn("id", F.col("fingerprint"))
    # the columns of soundings as they come, so that both lie in one table
    live = stored(s.sparkSession.createDataFrame([], PAIRED), config, reference).dtypes
    return s.select(*by, *[(F.col(c) if c in s.columns else F.lit(None)).cast(t).alias(c) for c, t in live if c not in by])


class Ledger:
    """What a job carries from chunk to chunk, in a folder of its own: open rows, and for each key its number of windows and last tide."""

    def __init__(self, spark: SparkSession, path: str, by: list[str], kinds: list[str]):
        self.spark, self.path, self.by = spark, path, by
        keys = ", ".join(f"{n} {k}" for n, k in zip(by, kinds, strict=True))
        self.open_kind, self.state_kind = f"{keys}, {SAMPLE}", f"{keys}, visits long, tide_at_ms long, tide_m double"

    def read(self, number: int) -> tuple[DataFrame, DataFrame]:
        """(open rows, states) after a chunk; none before the first."""
        kinds = (("open", self.open_kind), ("state", self.state_kind))
        return tuple(self.spark.createDataFrame([], k) if number < 0 else self.spark.read.schema(k).parquet(f"{self.path}/{n}/chunk={number}") for n, k in kinds)

    def write(self, number: int, still_open: DataFrame, state: DataFrame) -> None:
        for name, rows in (("open", still_open), ("state", state)):
            rows.write.mode("overwrite").parquet(f"{self.path}/{name}/chunk={number}")


def _chunk(series: dict[str, DataFrame], a: int, b: int, next_from: int, still_open: DataFrame, state: DataFrame, by: list[str], config: Config, reference: str, installation: Installation | None, ends: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(soundings, open rows, states) of one chunk. ``next_from`` is where the next chunk's tides begin."""
    before = state.filter("tide_at_ms is not null").select(*by, F.col("tide_at_ms").alias("at_ms"), F.col("tide_m").alias("value"))
    tides = before.unionByName(series["tide"].select(before.columns)).withColumn("height_m", F.col("value"))
    tides = plausible_tides(tides, by).drop("height_m")
    given = {**series, "tide": tides}
    samples = corrected_samples(given, by, config, installation) if config.attitude_correction else history_samples(given, by, config, reference)
    names = [c.split()[0] for c in SAMPLE.split(", ")]
    rows = still_open.unionByName(samples.filter((F.col("at_ms") >= a) & (F.col("at_ms") < b)).select(*by, *names))
    done, on = split_at_rest(rows, by, config, ends)
    numbered = done.join(state.select(*by, F.col("visits").alias("_earlier")), by, "left").withColumn("visit", F.col("visit") + F.coalesce("_earlier", F.lit(0))).drop("_earlier")
    windows = numbered.groupBy(*by).agg(F.max("visit").alias("visits"))
    last = tides.filter(F.col("at_ms") < next_from).groupBy(*by).agg(F.max_by(F.struct(F.col("at_ms").alias("tide_at_ms"), F.col("value").alias("tide_m")), "at_ms").alias("t"))
    keys = windows.select(*by).unionByName(last.select(*by)).unionByName(state.select(*by)).distinct()
    old = state.select(*by, F.col("visits").alias("_visits"))
    states = keys.join(windows, by, "left").join(last, by, "left").join(old, by, "left").select(*by, F.coalesce("visits", "_visits", F.lit(0)).alias("visits"), "t.tide_at_ms", "t.tide_m")
    return soundings_of(numbered, by, config, reference), on.select(*by, *names), states


def backfill(surface: Surface, read: Callable[[int, int], dict[str, DataFrame]], from_ms: int, to_ms: int, updated_at_ms: int, by: tuple[str, ...] = ("context",), reference: str = "belowTransducer", installation: Installation | None = None, chunk_ms: int = CHUNK_MS, stop: Callable[[], bool] = lambda: False) -> int:
    """Takes the soundings of [from, to), 31 days at most, into a surface; gives the number of chunks done, those of earlier runs among them.

    ``read(from, to)`` gives the series: those of ``history_reader``, or of ``rebuild.series_reader`` where the settings
    correct for attitude. Then the span must hold no active sounding before the job begins: ``rebuild_history`` replaces such.
    """
    if not from_ms < to_ms:
        raise ValueError("a backfill needs a time from before its time to")
    if to_ms - from_ms > MOST_MS:
        raise ValueError("a backfill is limited to 31 days")
    config, keys, name = surface.config, list(by), f"backfill:{from_ms}:{to_ms}:{chunk_ms}"
    if config.attitude_correction:
        if reference != "belowTransducer":
            raise ValueError("only depths below the transducer can be corrected for attitude")
        there = None if surface.has(name) else surface.active()
        if there is not None and not there.filter((F.col("observed_at_ms") >= from_ms) & (F.col("observed_at_ms") < to_ms)).isEmpty():
            raise ValueError("there are soundings in this time; rebuild them from history instead")
    # both ends of what is read lie on the borders of slow buckets, so tides are carried on from one of them
    margin = max(TIDE_TOLERANCE_MS, 2000 * config.history_resolution_s) + SLOW_BUCKET_MS
    down = lambda t: t // SLOW_BUCKET_MS * SLOW_BUCKET_MS
    spans, done, ledger = chunks(from_ms, to_ms, chunk_ms), 0, None
    for number, (a, b) in enumerate(spans):
        if stop():
            break
        if not surface.has(name, number):
            series = read(down(a - margin), down(b + margin) + SLOW_BUCKET_MS)
            if ledger is None:
                kinds = dict(series["depth"].dtypes)
                ledger = Ledger(surface.spark, f"{surface.path}/jobs/{name.replace(':', '-')}", keys, [kinds[c] for c in keys])
            made, on, states = _chunk(series, a, b, down(b - margin), *ledger.read(number - 1), keys, config, reference, installation, number == len(spans) - 1)
            ledger.write(number, on, states)
            surface.apply(made, number, updated_at_ms, name)
        done += 1
    return done


def backfilled(values: DataFrame, paths: dict[str, str], from_ms: int, to_ms: int, config: Config, reference: str = "belowTransducer") -> DataFrame:
    """The soundings of a span in one run, with no surface."""
    ledger = Ledger(values.sparkSession, "", ["context"], [dict(values.dtypes)["context"]])
    margin = max(TIDE_TOLERANCE_MS, 2000 * config.history_resolution_s) + SLOW_BUCKET_MS
    series = history_reader(values, paths, config)(from_ms - margin, to_ms + margin)
    return _chunk(series, from_ms, to_ms, from_ms, *ledger.read(-1), ["context"], config, reference, None, True)[0]
