"""A vessel at rest: samples of one window become one sounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadline.config import Config
from leadline.functions.depth import SKEW_M_PER_S
from leadline.functions.geo import haversine_m
from leadline.functions.numbers import MAD_TO_SIGMA, bound, c, half_up, hypot3, median, robust_sigma


def outlier_gate_m(depths: Column, config: Config) -> Column:
    """How far a depth may be from the median: a multiple of the robust sigma, the floor at least."""
    return F.greatest(F.lit(config.outlier_floor_m), F.lit(config.mad_multiplier) * robust_sigma(depths))


def spread(rows: DataFrame, by: list[str], value: Column, config: Config) -> DataFrame:
    """One row for each key: n, kept (values within the gate), median, mad and sigma.

    Values are counted first, and the counts joined back with their key's median, so that no key's values are
    gathered, only a count for each different one.
    """
    counted = rows.select(*by, value.alias("_x")).groupBy(*by, "_x").agg(F.count("_x").alias("_n"))

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        named = right.withColumnsRenamed({k: f"_{k}" for k in by})
        on = [left[k].eqNullSafe(named[f"_{k}"]) for k in by]
        return left.join(named, on).drop(*[f"_{k}" for k in by])

    away = F.abs(F.col("_x") - F.col("median"))
    medians = counted.groupBy(*by).agg(F.percentile("_x", F.lit(0.5), F.col("_n")).alias("median"), F.sum("_n").alias("n"))
    mads = joined(counted, medians).groupBy(*by, "median", "n").agg(F.percentile(away, F.lit(0.5), F.col("_n")).alias("mad"))
    mads = mads.withColumn("sigma", F.when(F.col("n") < 2, F.lit(0.0)).otherwise(F.lit(MAD_TO_SIGMA) * F.col("mad")))
    gate = F.greatest(F.lit(config.outlier_floor_m), F.lit(config.mad_multiplier) * F.col("sigma"))
    kept = F.coalesce(F.sum(F.when(away <= gate, F.col("_n"))), F.lit(0)).alias("kept")
    return joined(counted, mads).groupBy(*by, "median", "n", "mad", "sigma").agg(kept)


def reduce_windows(samples: DataFrame, by: list[str], config: Config) -> DataFrame:
    """One row for each window with enough samples that agree.

    Samples: at_ms, id, latitude, longitude, raw_m, tide_m, datum_m, skew_ms, horizontal_sigma_m (null: position
    sigma), vertical_sigma_m (of beam-corrected samples, null else). A window is at most a minute of samples, so
    its array is short. Gives medians of those within the gate, counts, the window's bounds (of all samples),
    sigmas, the representative (the middle one of those kept, by time, then id), and the different methods of
    their geometry (uncorrected where samples have none).
    """
    item = F.struct("at_ms", "id", "latitude", "longitude", "raw_m", "tide_m", "datum_m", "skew_ms", F.coalesce("horizontal_sigma_m", F.lit(config.position_sigma_m)).alias("horizontal_sigma_m"), "vertical_sigma_m", F.coalesce(F.col("geometry") if "geometry" in samples.columns else F.lit(None).cast("string"), F.lit("uncorrected")).alias("geometry"))
    w = samples.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("s")).filter(F.size("s") >= config.stationary_min_samples)
    depths = F.transform("s", lambda x: x["datum_m"])
    limits = F.struct(median(depths).alias("centre"), outlier_gate_m(depths, config).alias("gate"))
    w = w.withColumn("a", bound(limits, lambda g: F.filter("s", lambda x: F.abs(x["datum_m"] - g["centre"]) <= g["gate"]))).filter(F.size("a") >= config.stationary_min_samples)

    def of(name: str) -> Column:
        return F.transform("a", lambda x: x[name])

    first, last = F.get("s", F.lit(0))["at_ms"], F.element_at("s", -1)["at_ms"]
    effective = F.least(F.lit(10), F.greatest(F.lit(1), F.floor((last - first) / 10_000) + 1))
    w = w.withColumns({"lat": median(of("latitude")), "lon": median(of("longitude")), "skew": median(of("skew_ms")), "spread": robust_sigma(of("datum_m")), "eff": effective})
    skew_m = F.col("skew") / 1000 * SKEW_M_PER_S
    variance = F.lit(config.depth_sigma_m**2) / F.col("eff") + F.lit(config.offset_sigma_m**2 + config.tide_sigma_m**2) + F.col("spread") * F.col("spread") / F.col("eff") + skew_m * skew_m
    corrected = F.array_max(F.transform("a", lambda x: x["vertical_sigma_m"] * x["vertical_sigma_m"]))
    away = bound(F.struct("lat", "lon"), lambda at: F.array_max(F.transform("a", lambda x: haversine_m(at["lat"], at["lon"], x["latitude"], x["longitude"]))))
    return w.select(
        *by,
        F.get("a", F.floor(F.size("a") / 2).cast("int"))["id"].alias("representative_id"),
        last.alias("observed_at_ms"), first.alias("window_start_ms"), last.alias("window_end_ms"),
        F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), median(of("raw_m")).alias("raw_m"), median(of("tide_m")).alias("tide_m"), median(of("datum_m")).alias("datum_m"),
        half_up("skew").alias("input_time_skew_ms"),
        F.sqrt(F.greatest(variance, F.coalesce(corrected, F.lit(0.0)))).alias("vertical_sigma_m"),
        hypot3(F.array_max(of("horizontal_sigma_m")), away).alias("horizontal_sigma_m"),
        F.col("eff").cast("long").alias("effective_samples"), F.size("a").cast("long").alias("sample_count"), (F.size("s") - F.size("a")).cast("long").alias("rejected_sample_count"),
        F.array_distinct(of("geometry")).alias("sample_methods"),
    )


def pass_id(observed_ms, track, kind: str = "live") -> Column:
    """The UTC day and the track; history has its own name, windows at rest say so."""
    day = F.date_format(F.timestamp_millis(c(observed_ms)), "yyyy-MM-dd")
    if kind == "history":
        return F.concat(F.lit("history-"), day)
    return F.concat_ws(":", day, F.lit("stationary"), c(track)) if kind == "stationary" else F.concat_ws(":", day, c(track))


