"""As-of joins of time series: nearest within a tolerance, interpolated positions, samples in windows.

Both sides are laid into one ordered stream by series and time, and each left row looks back and ahead
past other left rows: one shuffle and one sort by series, no pairs. Matches have a reach, so series are cut
into stretches of time: right rows go to the stretches whose left rows they can serve, so the result is the
same and a hot series spreads over tasks.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadline.config import Config
from leadline.functions.geo import destination
from leadline.functions.numbers import hypot3


#: Length of a stretch, unless the reach is longer.
STRETCH_MS = 6 * 3_600_000


def bracket(left: DataFrame, right: DataFrame, by: list[str], reach_ms: int | Column, left_time: str = "at_ms", right_time: str = "at_ms", stretch_ms: int | None = None) -> DataFrame:
    """Left rows with ``before`` (the last right row strictly earlier) and ``after`` (the first at or after), as structs.

    Of right rows with one time the later in order of their columns counts before, the first counts after.
    ``reach_ms`` is how far a match can be, needed only with stretches. Rows keep all their columns.
    """
    value = F.struct(*[F.col(f"`{n}`") for n in right.columns])
    tag = left.select(*by, F.col(left_time).alias("_t"), F.lit(0).alias("_side"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType).alias("_right"))
    other = right.select(*by, F.col(right_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(tag.schema["_left"].dataType).alias("_left"), value.alias("_right"))
    keys = list(by)
    if stretch_ms:
        if stretch_ms < reach_ms:
            raise ValueError("a stretch must not be shorter than the reach")
        tag = tag.withColumn("_stretch", F.floor(F.col("_t") / stretch_ms))
        other = other.withColumn("_stretch", F.explode(F.sequence(F.floor((F.col("_t") - reach_ms) / stretch_ms), F.floor((F.col("_t") + reach_ms) / stretch_ms))))
        keys.append("_stretch")
    order = Window.partitionBy(*keys).orderBy("_t", "_side", "_right")
    both = tag.unionByName(other)
    both = both.withColumn("_before", F.last("_right", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # looking ahead is looking back in the reverse order: a frame that grows costs a row each, one that shrinks all that are left
    back = Window.partitionBy(*keys).orderBy(F.desc("_t"), F.desc("_side"), F.desc("_right")).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_after", F.last("_right", ignorenulls=True).over(back))
    return both.filter("_side = 0").select("_left.*", F.col("_before").alias("before"), F.col("_after").alias("after"))


def nearest(left: DataFrame, right: DataFrame, by: list[str], tolerance_ms: int, name: str = "match", how: str = "inner", left_time: str = "at_ms", right_time: str = "at_ms", stretch_ms: int | None = STRETCH_MS) -> DataFrame:
    """Each left row with the right row nearest in time, as a struct, within an inclusive tolerance.

    The earlier one wins a tie. Left rows without a match are dropped, or kept with null if ``how`` is left. A
    stretch of None leaves series whole.
    """
    b = bracket(left, right, by, tolerance_ms, left_time, right_time, stretch_ms and max(stretch_ms, tolerance_ms))
    back, ahead = F.col(left_time) - F.col(f"before.{right_time}"), F.col(f"after.{right_time}") - F.col(left_time)
    best = F.when(back.isNotNull() & (ahead.isNull() | (back <= ahead)), F.when(back <= tolerance_ms, F.col("before"))).otherwise(F.when(ahead <= tolerance_ms, F.col("after")))
    out = b.withColumn(name, best).drop("before", "after")
    return out if how == "left" else out.filter(F.col(name).isNotNull())


def positions_at(depths: DataFrame, fixes: DataFrame, by: list[str], config: Config, project: bool = False, skew_ms: int | None = None, stretch_ms: int | None = STRETCH_MS) -> DataFrame:
    """Positions at the times of depths, from fixes (at_ms, latitude, longitude).

    A fix at that very time counts as it is; two within the skew are interpolated along the shorter way around;
    else, if ``project``, the earlier one is carried on with columns sog_mps, cog_rad (of the depth row, null:
    not fresh). Adds position_method, latitude, longitude, horizontal_sigma_m and skew_ms; rows without a
    position are left out.
    """
    most = int(config.max_live_skew_s * 1000) if skew_ms is None else skew_ms
    b = bracket(depths, fixes, by, most, stretch_ms=stretch_ms and max(stretch_ms, most))
    t = F.col("at_ms")
    back, ahead = t - F.col("before.at_ms"), F.col("after.at_ms") - t
    exact = ahead == 0
    between = (back <= most) & (ahead <= most)
    share = back / (back + ahead)
    turn = ((F.col("after.longitude") - F.col("before.longitude") + 540.0) % 360.0) - 180.0
    mid_lat = F.col("before.latitude") + (F.col("after.latitude") - F.col("before.latitude")) * share
    mid_lon = ((F.col("before.longitude") + turn * share + 540.0) % 360.0) - 180.0
    skew = F.greatest(back, ahead)
    method = F.when(exact, "exact").when(between, "interpolated")
    lat, lon = F.when(exact, F.col("after.latitude")).when(between, mid_lat), F.when(exact, F.col("after.longitude")).when(between, mid_lon)
    sigma = F.when(exact, F.lit(config.position_sigma_m)).when(between, hypot3(config.position_sigma_m, skew / 1000 * config.velocity_sigma_mps))
    out_skew = F.when(exact, F.lit(0).cast("long")).when(between, skew)
    if project:
        s = back / 1000
        sog, cog = F.col("sog_mps"), F.col("cog_rad")
        carried = (back <= most) & (sog >= 0) & ((sog == 0) | cog.isNotNull())
        angle = F.coalesce(cog, F.lit(0.0))
        lat2, lon2 = destination("before.latitude", "before.longitude", sog * s * F.sin(angle), sog * s * F.cos(angle))
        method, lat, lon = method.when(carried, "projected"), lat.when(carried, lat2), lon.when(carried, lon2)
        sigma, out_skew = sigma.when(carried, hypot3(config.position_sigma_m, s * config.velocity_sigma_mps, sog * s)), out_skew.when(carried, back)
    out = b.withColumns({"position_method": method, "latitude": lat, "longitude": lon, "horizontal_sigma_m": sigma, "position_skew_ms": out_skew}).drop("before", "after")
    return out.filter(F.col("position_method").isNotNull())


def in_windows(windows: DataFrame, samples: DataFrame, by: list[str], start: str, end: str, time: str, bucket_ms: int) -> DataFrame:
    """Each window with each sample in it, both ends included.

    Windows are laid over buckets of time and joined on series and bucket, so only neighbours in time are
    compared; a sample is in one bucket and meets a window once.
    """
    w = windows.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / bucket_ms), F.floor(F.col(end) / bucket_ms))))
    s = samples.withColumn("_bucket", F.floor(F.col(time) / bucket_ms))
    return w.join(s, [*by, "_bucket"]).filter(F.col(time).between(F.col(start), F.col(end))).drop("_bucket")


def coverage(windows: DataFrame, samples: DataFrame, by: list[str], start: str, end: str, time: str, reach_ms: int, stretch_ms: int = STRETCH_MS) -> DataFrame:
    """Windows that have samples, both ends included, with first_ms, last_ms, gap_ms (the longest between two, null of one) and n. No pairs are made.

    Series are cut into stretches of time as long as ``reach_ms`` at least, which is how long a window can be; a longer one is
    an error. A window goes to the stretch that it begins in, a sample to its own and to the one before, if a window can reach
    it from there. Times are whole ms. A task holds the different times and the windows of one stretch of one series.
    """
    stretch = max(stretch_ms, reach_ms)
    b, t = F.floor(F.col("_t") / stretch), F.col("_t")
    to = F.filter(F.array(b, F.when(t - b * stretch <= reach_ms, b - 1)), lambda x: x.isNotNull())
    times = samples.select(*by, F.col(time).cast("long").alias("_t")).dropna().groupBy(*by, "_t").agg(F.count("*").alias("_n"))
    times = times.select(*by, "_t", "_n", F.explode(to).alias("_b"), F.lit(0).alias("_side"))
    long = F.raise_error(F.lit(f"a window is longer than {reach_ms} ms")).cast("long")
    given = windows.dropna(subset=[*by, start, end]).withColumns({"_t": F.col(start).cast("long"), "_e": F.when(F.col(end) - F.col(start) > reach_ms, long).otherwise(F.col(end).cast("long"))})
    both = given.withColumns({"_b": b, "_side": F.lit(1)}).unionByName(times, allowMissingColumns=True)
    own, found = [*by, "_b"], ["first_ms", "last_ms", "gap_ms", "n"]
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in windows.schema), *(T.StructField(c, T.LongType()) for c in found)])
    names = windows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            keys = [*zip(*[batch.column(c).to_pylist() for c in own], strict=True)]
            at = 0
            while at < len(keys):
                until = bisect_right(keys, 0, at, key=lambda k, first=keys[at]: k != first)
                if held and keys[at] != key:
                    yield from measured(held)
                    held = []
                key = keys[at]
                held.append(batch.slice(at, until - at))
                at = until
        if held:
            yield from measured(held)

    def measured(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        m = int((rows["_side"].to_numpy() == 0).sum())
        at, own_windows = rows["_t"].slice(0, m).to_numpy(), rows.slice(m)
        if m in (0, len(rows)):
            return
        counts = np.concatenate([[0], np.cumsum(rows["_n"].slice(0, m).to_numpy())])
        lo, hi = np.searchsorted(at, own_windows["_t"].to_numpy(), "left"), np.searchsorted(at, own_windows["_e"].to_numpy(), "right")
        has = hi > lo
        lo, hi = lo[has], hi[has]
        n, gap = counts[hi] - counts[lo], _longest(np.diff(at), lo, hi - 1)
        new = [at[lo], at[hi - 1], pa.array(gap, pa.int64(), mask=n < 2), n]
        kept = own_windows.select(names).filter(pa.array(has)).combine_chunks()
        for c, values in zip(found, new, strict=True):
            kept = kept.append_column(c, pa.array(values, pa.int64()) if isinstance(values, np.ndarray) else values)
        yield from kept.to_batches(max_chunksize=10_000)

    return both.repartition(*own).sortWithinPartitions(*own, "_side", "_t").mapInArrow(run, schema)


def _longest(gaps: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The greatest of gaps[lo:hi] for each pair, 0 of none: of two runs of a power of two that cover it, one power at a time."""
    out = np.zeros(len(lo), np.int64)
    power = np.frexp(hi - lo)[1] - 1
    for k in range(int(power.max(initial=-1)) + 1):
        w = np.flatnonzero(power == k)
        out[w] = np.maximum(gaps[lo[w]], gaps[hi[w] - 2**k])
        gaps = np.maximum(gaps[: -(2**k)], gaps[2**k :])
    return out
