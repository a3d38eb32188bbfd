"""Sequences of one track: segments, thinning, windows at rest. Rows of a key in order of time.

What needs only the row before is a window function. What depends on the last row *kept* is a fold: over
an array by a higher-order function where sequences are short (tide series of a chunk), else row by row in
Arrow batches sorted by key, of which one at a time is held.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadline.config import Config
from leadline.functions.geo import EARTH_RADIUS_M

#: The fastest a tide can rise or fall, in metres a minute.
TIDE_RATE = 0.05
#: Length of a stretch of time that is worked on by itself.
STRETCH_MS = 6 * 3_600_000
#: Metres of a degree where a flat distance is good enough.
DEGREE_M = 111_320.0


def segments(rows: DataFrame, by: list[str], order: list[str], time: str, gap_ms: int, source: str | None = None, name: str = "segment") -> DataFrame:
    """Numbers segments of each key from 0: a new one after a gap longer than gap_ms, or where the source changes."""
    w = Window.partitionBy(*by).orderBy(*order)
    new = F.col(time) - F.lag(time).over(w) > gap_ms
    if source:
        new = new | (F.col(source) != F.lag(source).over(w))
    return rows.withColumn("_new", F.coalesce(new, F.lit(False)).cast("long")).withColumn(name, F.sum("_new").over(w)).drop("_new")


def monotone_fixes(fixes: DataFrame, by: list[str], arrival: str, time: str = "at_ms") -> DataFrame:
    """Fixes that are later than every one that arrived before them."""
    seen = F.max(time).over(Window.partitionBy(*by).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1))
    return fixes.withColumn("_seen", seen).filter((F.col("_seen").isNull()) | (F.col(time) > F.col("_seen"))).drop("_seen")


def plausible_tide(points: Column) -> Column:
    """The points (array of (at_ms, height_m), by time) that the rate against the last one kept allows; the first is kept, and points of one time are."""

    def keep(kept: Column, p: Column) -> Column:
        last = F.element_at(kept, -1)
        minutes = (p["at_ms"] - last["at_ms"]) / F.lit(60000.0)
        return F.when((minutes <= 0) | (F.abs(p["height_m"] - last["height_m"]) <= F.lit(TIDE_RATE) * minutes), F.array_append(kept, p)).otherwise(kept)

    return F.when(F.size(points) > 0, F.aggregate(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1), keep)).otherwise(points)


def plausible_tides(rows: DataFrame, by: list[str], order: tuple[str, ...] = ("at_ms",)) -> DataFrame:
    """The rows (at_ms, height_m) that plausible_tide keeps of each key's series, for series of any length."""

    def new() -> Callable[..., bool]:
        last = None

        def step(t: float, h: float) -> bool:
            nonlocal last
            keeps = last is None or t <= last[0] or abs(h - last[1]) <= TIDE_RATE * ((t - last[0]) / 60000.0)
            if keeps:
                last = (t, h)
            return keeps

        return step

    return _by_key(rows, by, order, new, ["at_ms", "height_m"], "_kept", "boolean").filter("_kept").drop("_kept")


def _by_key(rows: DataFrame, by: list[str], order: tuple[str, ...], new: Callable[[], Callable], reads: list[str], name: str, kind: str) -> DataFrame:
    """Adds a column: what a new step for each key gives for the columns read, row by row. A null is read as NaN.

    Rows are sorted by key and order, with spill, and go through in Arrow batches; only the step outlives a batch.
    """
    schema = ", ".join([*[f"`{n}` {t}" for n, t in rows.dtypes], f"`{name}` {kind}"])
    names, of = [*rows.columns, name], {"boolean": pa.bool_(), "long": pa.int64()}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, step = None, None
        for batch in batches:
            keys = zip(*[batch.column(n).to_pylist() for n in by], strict=True)
            values = zip(*[[math.nan if x is None else x for x in batch.column(n).to_pylist()] for n in reads], strict=True)
            out = []
            for key, value in zip(keys, values, strict=True):
                if step is None or key != last:
                    last, step = key, new()
                out.append(step(*value))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, of)], names)

    return rows.repartition(*by).sortWithinPartitions(*by, *[F.col(n).asc_nulls_last() for n in order]).mapInArrow(run, schema)


def great_circle_m(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    a, b, d, e = (math.radians(x) for x in (lat1, lat2, lat2 - lat1, lon2 - lon1))
    return 2 * EARTH_RADIUS_M * math.asin(min(1.0, math.sqrt(math.sin(d / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(e / 2) ** 2)))


def sample(rows: DataFrame, by: list[str], config: Config, order: tuple[str, ...] = ("at_ms",)) -> DataFrame:
    """Adds kept: the first row, then each that is max_interval_s later or distance_m farther than the last one kept."""
    interval, distance = config.max_interval_s * 1000, config.distance_m

    def new() -> Callable[..., bool]:
        last = None

        def step(t: float, lat: float, lon: float) -> bool:
            nonlocal last
            keeps = last is None or t - last[0] >= interval or great_circle_m(last[1], last[2], lat, lon) >= distance
            if keeps:
                last = (t, lat, lon)
            return keeps

        return step

    return _by_key(rows, by, order, new, ["at_ms", "latitude", "longitude"], "kept", "boolean")


def rest_windows(rows: DataFrame, by: list[str], config: Config, order: tuple[str, ...] = ("at_ms",), stretch_ms: int = STRETCH_MS) -> DataFrame:
    """Adds visit: the number of the window at rest that a row is in, from 1, or null for a row under way or without a time.

    A row with a speed under the minimum joins the open window; the window ends with the row that makes it
    stationary_window_s long, before a gap of max(5 s, 3 resolutions), and before a row that moves or has no speed.

    Series are cut into stretches of time, each worked on by itself. Wherever a window begins, the next one's beginning
    follows from the rows after it, so a stretch is a map: from the row, among its first ones, that a window of the
    stretch before leaves as the next beginning, to such a row of the next stretch, and how many windows begin
    between. A moving row or a gap makes that the same for all. The maps of a key are put one after another, a row
    for each stretch, and then each stretch numbers its windows.
    """
    gap, span, slow = max(5000, 3000 * config.history_resolution_s), int(config.stationary_window_s * 1000), config.minimum_speed_mps
    head_ms = span + 2 * gap + 1
    stretch = max(stretch_ms, head_ms)
    own = [*by, "_b"]
    at = Window.partitionBy(*own).orderBy(*[F.col(n).asc_nulls_last() for n in order])
    placed = rows.withColumn("_b", F.floor(F.col("at_ms") / stretch)).withColumn("_i", F.row_number().over(at) - 1)
    # a row also goes to the stretch before, if it is one of its own first, and to the one after, if that begins within a gap
    b, t = F.col("_b"), F.col("at_ms")
    to = F.filter(F.array(F.struct(b.alias("b"), F.lit(1).alias("part")), F.when(t < b * stretch + head_ms, F.struct((b - 1).alias("b"), F.lit(2).alias("part"))), F.when(t >= (b + 1) * stretch - gap, F.struct((b + 1).alias("b"), F.lit(0).alias("part")))), lambda x: x.isNotNull())
    timed = placed.filter("_b is not null").select(*by, "_i", t.cast("double").alias("t"), F.coalesce(F.col("sog_mps") < slow, F.lit(False)).alias("slow"), F.explode(to).alias("to"))
    given = timed.select(*by, F.col("to.b").alias("_b"), F.col("to.part").alias("part"), "_i", "t", "slow").repartition(*own).sortWithinPartitions(*own, "part", "_i")
    kinds = ", ".join(f"`{n}` {k}" for n, k in given.select(*own).dtypes)
    lists, numbers = ("entries", "leaves", "numbers"), ("leave", "number")

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, fields, part, t, is_slow in _groups(batches, own):
            n, begins, after = _windows(part, t, is_slow, gap, span)
            if not n:
                continue
            t, is_slow = t[part > 0], is_slow[part > 0]
            known = np.flatnonzero(begins[:n])
            first = int(known[0]) if len(known) else n
            # beginnings that a window of the stretch before may leave: its first rows, up to one that begins whatever was before
            entries = np.flatnonzero(is_slow[:first] & (t[:first] < key[-1] * stretch + head_ms))
            cur, number = np.concatenate([entries, known]).astype(np.int64), np.zeros(len(entries) + len(known), np.int64)
            while (inside := (cur >= 0) & (cur < n)).any():
                number[inside] += 1
                cur[inside] = after[cur[inside]]
            leave, k = np.where(cur >= n, cur - n, -1), len(entries)
            row = dict(zip(own, key, strict=True)) | {"entries": entries.tolist(), "leaves": leave[:k].tolist(), "numbers": number[:k].tolist(), "leave": int(leave[-1]) if len(known) else None, "number": int(number[k:].sum())}
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema([*fields, *[pa.field(c, pa.list_(pa.int64())) for c in lists], *[pa.field(c, pa.int64()) for c in numbers]]))

    made = given.mapInArrow(maps, f"{kinds}, {', '.join(f'{c} array<long>' for c in lists)}, {', '.join(f'{c} long' for c in numbers)}")

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, b, entry, visits = None, None, -1, 0
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if (now := tuple(row[c] for c in by)) != key:
                    key, b, entry, visits = now, None, -1, 0
                if b is None or row["_b"] != b + 1:
                    entry = -1
                out.append({c: row[c] for c in own} | {"entry": entry, "visits": visits})
                number, leave = 0, -1
                if entry in row["entries"]:
                    k = row["entries"].index(entry)
                    number, leave = row["numbers"][k], row["leaves"][k]
                b, visits, entry = row["_b"], visits + number + row["number"], leave if row["leave"] is None else row["leave"]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([*[batch.schema.field(c) for c in own], pa.field("entry", pa.int64()), pa.field("visits", pa.int64())]))

    entered = made.repartition(*by).sortWithinPartitions(*own).mapInArrow(composed, f"{kinds}, entry long, visits long")
    # a stretch's entry comes before its rows
    rows_of = given.select(*own, "part", F.col("_i").cast("long").alias("_i"), "t", "slow")
    told = entered.select(*own, F.lit(-1).alias("part"), F.col("entry").alias("_i"), F.col("visits").cast("double").alias("t"), F.lit(False).alias("slow"))
    whole = rows_of.unionByName(told).repartition(*own).sortWithinPartitions(*own, "part", "_i")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, fields, part, t, is_slow, i in _groups(batches, own, "_i"):
            n, begins, after = _windows(part[part >= 0], t[part >= 0], is_slow[part >= 0], gap, span)
            if not n:
                continue
            entry, before = int(i[0]), int(t[0])
            starts = begins[:n].copy()
            cur = np.flatnonzero(starts)
            if 0 <= entry < n:
                cur = np.append(cur, entry)
            while len(cur := cur[(cur >= 0) & (cur < n)]):
                starts[cur] = True
                cur = after[cur]
            visit = pa.array(np.cumsum(starts) + before, pa.int64(), mask=~is_slow[part == 1])
            yield pa.RecordBatch.from_arrays([*[pa.array([v] * n, f.type) for v, f in zip(key, fields, strict=True)], pa.array(np.arange(n)), visit], [*own, "_i", "visit"])

    visits = whole.mapInArrow(numbered, f"{kinds}, _i long, visit long")
    return _alike(placed, visits, [*own, "_i"]).drop("_b", "_i")


def _groups(batches: Iterator[pa.RecordBatch], own: list[str], *more: str) -> Iterator[tuple]:
    """(key, its fields, part, t, slow, and more columns, as arrays) of each group of a stream sorted by key: one group is held at a time."""
    key, fields, held = None, None, []
    for batch in batches:
        fields = [batch.schema.field(c) for c in own]
        keys = [*zip(*[batch.column(c).to_pylist() for c in own], strict=True)]
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("part", "t", "slow", *more)]
        at = 0
        while at < len(keys):
            to = bisect_right(keys, 0, at, key=lambda k, first=keys[at]: k != first)
            if held and keys[at] != key:
                yield key, fields, *map(np.concatenate, zip(*held, strict=True))
                held = []
            key = keys[at]
            held.append([c[at:to] for c in columns])
            at = to
    if held:
        yield key, fields, *map(np.concatenate, zip(*held, strict=True))


def _windows(part: np.ndarray, t: np.ndarray, slow: np.ndarray, gap: int, span: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows of its own, which rows begin a window whatever was before, the next beginning after a window that begins at each row, or -1) of a stretch.

    Parts: 0 for rows of the stretch before, 1 for its own, 2 for rows of the one after.
    """
    n, before = int((part == 1).sum()), part == 0
    last_t, last_slow = (t[before][-1], bool(slow[before][-1])) if before.any() else (-np.inf, False)
    t, slow = t[~before], slow[~before].astype(bool)
    before_t, before_slow = np.concatenate([[last_t], t[:-1]]), np.concatenate([[last_slow], slow[:-1]])
    begins = slow & (~before_slow | (t - before_t > gap))
    run = np.cumsum(begins | ~slow)
    # the row that ends a window that begins at a row, and the one after it, if that is of the same run at rest
    after = np.minimum(np.searchsorted(t, t + span), np.searchsorted(run, run, "right") - 1) + 1
    return n, begins, np.where((after < len(t)) & (run[np.minimum(after, len(t) - 1)] == run), after, -1)


def _alike(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys of which any may be null; each key of the right is there once."""
    named = right.withColumnsRenamed({k: f"_r{k}" for k in keys})
    return left.join(named, [left[k].eqNullSafe(named[f"_r{k}"]) for k in keys], "left").drop(*[f"_r{k}" for k in keys])


def under_way(rows: DataFrame, by: list[str], config: Config, order: tuple[str, ...] = ("at_ms",)) -> DataFrame:
    """Adds under_way: fresh speed (sog_mps) at the minimum, or three new fixes in a row outside the anchor's reach.

    The reach is the radius and twice both sigmas; the anchor is the first position and moves with each row taken
    (under_way). Columns: at_ms, fix_ms, latitude, longitude, horizontal_sigma_m, sog_mps (null: not fresh).
    """
    radius, slow = config.stationary_radius_m, config.minimum_speed_mps

    def new() -> Callable[..., bool]:
        anchor, seen, away = None, None, 0

        def step(fix: float, lat: float, lon: float, s: float, v: float) -> bool:
            nonlocal anchor, seen, away
            if anchor is None:
                anchor = (lat, lon, s)
            if v >= slow:
                moving, away = True, 0
            else:
                if fix != seen:
                    far = great_circle_m(anchor[0], anchor[1], lat, lon) > radius + 2 * math.hypot(anchor[2], s)
                    away, seen = away + 1 if far else 0, fix
                moving = away >= 3
            if moving:
                anchor = (lat, lon, s)
            return moving

        return step

    return _by_key(rows, by, order, new, ["fix_ms", "latitude", "longitude", "horizontal_sigma_m", "sog_mps"], "under_way", "boolean")


def breaks(rows: DataFrame, by: list[str], order: list[str], time: str = "observed_at_ms", lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Adds is_break: a journey isn't drawn through a gap over 5 minutes, the date line, or a leap over 30 m/s and 100 m."""
    w = Window.partitionBy(*by).orderBy(*order)
    dt = F.col(time) - F.lag(time).over(w)
    before, across = F.lag(lat).over(w), F.lag(lon).over(w)
    east = (across - F.col(lon)) * F.cos(F.radians(before))
    far = F.sqrt(east * east + (before - F.col(lat)) * (before - F.col(lat))) * DEGREE_M
    leap = far > F.greatest(F.lit(100.0), dt / 1000 * 30.0)
    broken = (dt > 300_000) | (F.abs(F.col(lon) - F.lag(lon).over(w)) > 180) | leap
    return rows.withColumn("is_break", F.coalesce(broken, F.lit(False)))
