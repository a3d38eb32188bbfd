"""Alignment, folds, geometry and windows at rest against plain models and known cases."""

import math
import random
import statistics
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from leadline import queries
from leadline.config import Config
from leadline.functions import beam, depth, geo
from leadline.operators import align, asof, folds, rest
from leadline.streaming.live import Vessel

C = Config()
T0 = 1_767_225_600_000


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("stretch", [None, 40])
def test_nearest_is_the_plain_one(spark, stretch):
    rng = random.Random(3)
    left = [(k, rng.randrange(300), i) for i in range(400) for k in (rng.randrange(3),)]
    right = sorted((k, rng.randrange(300), i) for i in range(60) for k in (rng.randrange(3),))
    got = {r.n: r.match for r in asof.nearest(frame(spark, left, "k int, at_ms long, n long"), frame(spark, right, "k int, at_ms long, v long"), ["k"], 20, how="left", stretch_ms=stretch).collect()}
    assert len(got) == len(left)
    for k, t, n in left:
        before = [r for r in right if r[0] == k and r[1] < t][-1:]
        after = [r for r in right if r[0] == k and r[1] >= t][:1]
        best = min([(abs(r[1] - t), i, r) for i, r in enumerate(before + after)], default=None)
        want = best[2] if best and best[0] <= 20 else None
        assert (None if got[n] is None else (got[n].k, got[n].at_ms, got[n].v)) == want


def test_tide_that_leaps_is_dropped(spark):
    points = [(0, 0.8), (60_000, 0.79), (120_000, 1.378), (180_000, 1.379), (900_000, 1.4), (2_000_000, 1.5)]
    df = frame(spark, [(points,)], "p array<struct<at_ms:long,height_m:double>>")
    kept = [x.at_ms for x in df.select(folds.plausible_tide(F.col("p")).alias("k")).first().k]
    last, want = None, []
    for t, h in points:
        if last is None or abs(h - last[1]) <= 0.05 * (t - last[0]) / 60_000:
            want.append(t)
            last = (t, h)
    assert kept == want == [0, 60_000, 900_000, 2_000_000]
    assert df.select(folds.plausible_tide(F.expr("slice(p, 1, 0)")).alias("k")).first().k == []


def test_interpolation_across_the_date_line(spark):
    fixes = frame(spark, [("v", 1000, 10.0, 179.9999), ("v", 2000, 10.0, -179.9999), ("v", 9000, 0.0, 0.0)], "c string, at_ms long, latitude double, longitude double")
    depths = frame(spark, [("v", 1500, 1.0, 0.0), ("v", 2000, 1.0, 0.0), ("v", 3500, 2.0, math.pi / 2), ("v", 6000, 1.0, 0.0), ("v", 8000, None, None)], "c string, at_ms long, sog_mps double, cog_rad double")
    got = {r.at_ms: r for r in asof.positions_at(depths, fixes, ["c"], C, project=True).collect()}
    assert got[1500].position_method == "interpolated" and abs(abs(got[1500].longitude) - 180) < 1e-9
    assert got[1500].horizontal_sigma_m == pytest.approx(math.hypot(3, 0.15)) and got[2000].position_method == "exact"
    east = got[3500]
    assert east.position_method == "projected" and folds.great_circle_m(10.0, -179.9999, east.latitude, east.longitude) == pytest.approx(3.0, abs=1e-3) and east.longitude > -179.9999
    assert set(got) == {1500, 2000, 3500}
    assert {r.at_ms for r in asof.positions_at(depths, fixes, ["c"], C).collect()} == {1500, 2000}


def test_history_needs_place_and_tide_but_not_speed(spark):
    s = "c string, at_ms long"
    depths = frame(spark, [("v", 10_000, 5.0), ("v", 400_000, 5.0), ("v", 10_000, 500.0)], s + ", depth_m double")
    places = frame(spark, [("v", 12_000, 1.0, 2.0), ("v", 401_000, 1.0, 2.0)], s + ", latitude double, longitude double")
    tides = frame(spark, [("v", 100_000, 0.8)], s + ", height_m double")
    speeds = frame(spark, [("v", 900_000, 1.0)], s + ", sog_mps double")
    rows = align.history_soundings(align.align_history(depths, places, tides, speeds, ["c"], C), C, 0.5).collect()
    assert len(rows) == 1 and rows[0].datum_m == pytest.approx(4.7) and rows[0].skew_ms == 90_000 and rows[0].speed is None
    assert rows[0].horizontal_sigma_m == pytest.approx(math.hypot(3, 3))


def corrected(spark, **kw):
    a = {"rng": 10.0, "roll": 0.0, "pitch": 0.0, "heading": 0.0, "lat": 37.8, "lon": -122.4} | kw
    df = frame(spark, [tuple(a.values())], "rng double, roll double, pitch double, heading double, lat double, lon double")
    return df.select(beam.correct("rng", "roll", "pitch", "heading", "lat", "lon", 3.0, C).alias("b")).first().b


def test_beam_geometry(spark):
    b = corrected(spark, roll=math.radians(30))
    assert b.vertical_m == pytest.approx(8.660254, abs=1e-6) and b.east_m == pytest.approx(-5, abs=1e-9) and b.north_m == pytest.approx(0, abs=1e-9)
    assert folds.great_circle_m(37.8, -122.4, b.latitude, b.longitude) == pytest.approx(5, abs=1e-3)
    assert corrected(spark, pitch=math.radians(20)).north_m == pytest.approx(10 * math.sin(math.radians(20)))
    for bad in ({"roll": math.radians(61)}, {"rng": 0.0}, {"heading": None}):
        assert corrected(spark, **bad) is None
    wide = spark.range(1).select(beam.correct(F.lit(10.0), F.lit(0.9), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), 3.0, Config(beam_width_deg=90)).alias("b"))
    assert wide.first().b is None  # the cone reaches the horizon
    lever = beam.Installation(antenna=(2.0, 1.0, 3.0), origin=(0.0, 4.0, 1.0), verified=True)
    df = spark.range(1).select(beam.correct(F.lit(10.0), F.lit(0.1), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), 3.0, C, lever).alias("b"))
    assert df.first().b.surface_offset_m == pytest.approx(0.5 + math.sin(0.1) * 4 + math.cos(0.1) - 1)
    assert beam.Installation(antenna=(2.0, 1.0, None), origin=(0.0, 0.0, 0.0), verified=True).levers[0] == (0.0, 0.0, 0.0)


def test_a_window_at_rest_drops_spikes(spark):
    rows = [("v", 1, T0 + 1000 * i, i, 37.8, -122.4, 5.0, 0.0, 5.0 if i not in (20, 40) else 9.0, 100, None, None) for i in range(61)]
    s = frame(spark, rows, "c string, visit long, at_ms long, id long, latitude double, longitude double, raw_m double, tide_m double, datum_m double, skew_ms long, horizontal_sigma_m double, vertical_sigma_m double")
    r = rest.reduce_windows(s, ["c", "visit"], C).collect()[0]
    assert (r.sample_count, r.rejected_sample_count, r.datum_m, r.effective_samples) == (59, 2, 5.0, 7)
    assert r.window_end_ms - r.window_start_ms == 60_000 and r.representative_id == 30
    assert r.vertical_sigma_m == pytest.approx(math.sqrt(0.04 / 7 + 0.01 + 0.0625 + 0.005**2)) and r.horizontal_sigma_m == 3
    assert rest.reduce_windows(s.filter("id < 9"), ["c", "visit"], C).count() == 0


def test_visits_close_by_gap_speed_and_span(spark):
    t = [0, 1, 2, 3, 10, 11, 12, 71, 72, 73]
    v = [0.1, 0.1, 1.0, 0.1, 0.1, 0.1, None, 0.1, 0.1, 0.1]
    rows = [("v", 1000 * a, b) for a, b in zip(t, v, strict=True)] + [("w", 1000 * i, 0.0) for i in range(130)]
    got = folds.rest_windows(frame(spark, rows, "c string, at_ms long, sog_mps double"), ["c"], C).orderBy("c", "at_ms").collect()
    assert [r.visit for r in got if r.c == "v"] == [1, 1, None, 2, 3, 3, None, 4, 4, 4]
    assert [r.visit for r in got if r.c == "w"] == [1] * 61 + [2] * 61 + [3] * 8


def test_sampler_counts_from_the_last_kept(spark):
    rows = [("v", 400 * i, 37.8 + (0.00003 if i == 4 else 0), -122.4) for i in range(8)]
    got = folds.sample(frame(spark, rows, "c string, at_ms long, latitude double, longitude double"), ["c"], C).orderBy("at_ms").collect()
    assert [r.kept for r in got] == [True, False, False, True, True, True, False, False]


@pytest.mark.parametrize("name", ["tide_plausible", "stationary_assign", "sampler", "median_by_key", "mad", "robust_sigma", "stationary_reject"])
def test_no_task_holds_a_whole_group(spark, sf, name):
    plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "collect_list" not in plan


def test_folds_go_on_from_batch_to_batch(spark):
    rng = random.Random(4)
    rows = [(k, 1000 * t, rng.choice([0.0, 0.2, 1.0, None]) if k else 0.0, 37.8 + rng.random() / 1e3, -122.4, rng.random() / 50) for k in (0, 1, None) for t in range(150)]
    df = frame(spark, rng.sample(rows, len(rows)), "c int, at_ms long, sog_mps double, latitude double, longitude double, height_m double")
    results = []
    for n in ("10000", "7"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
        results.append([sorted(x.collect(), key=repr) for x in (folds.sample(df, ["c"], C), folds.rest_windows(df, ["c"], C), folds.plausible_tides(df, ["c"]))])
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert results[0] == results[1]
    assert {r.visit for r in results[1][1] if r.c == 0} == {1, 2, 3}
    for k in (0, 1, None):
        kept, last = [], None
        for _, t, _, _, _, h in (r for r in rows if r[0] == k):
            if last is None or abs(h - last[1]) <= 0.05 * ((t - last[0]) / 60_000):
                last = (t, h)
                kept.append(t)
        assert sorted(r.at_ms for r in results[1][2] if r.c == k) == kept


def test_spread_is_the_plain_one(spark):
    rng = random.Random(5)
    groups = {k: [rng.randrange(-3000, 3000) / 1000 for _ in range(n)] for k, n in ((1, 1), (2, 2), (3, 9), (4, 40), (None, 11))}
    df = frame(spark, [(k, x) for k, xs in groups.items() for x in xs], "k int, x double")
    got = {r.k: r for r in rest.spread(df, ["k"], F.col("x"), C).collect()}
    assert set(got) == set(groups)
    for k, xs in groups.items():
        mid = statistics.median(xs)
        mad = statistics.median(abs(x - mid) for x in xs)
        sigma = 0.0 if len(xs) < 2 else 1.4826 * mad
        assert (got[k].n, got[k].median, got[k].mad, got[k].sigma) == (len(xs), mid, mad, sigma)
        assert got[k].kept == sum(abs(x - mid) <= max(C.outlier_floor_m, C.mad_multiplier * sigma) for x in xs)


def test_under_way_needs_speed_or_three_fixes(spark):
    far = 37.8 + 0.001
    rows = [("v", i, 1000 * i, 37.8 if i < 3 else far, -122.4, 3.0, 0.0 if i < 8 else 1.0) for i in range(9)]
    got = folds.under_way(frame(spark, rows, "c string, at_ms long, fix_ms long, latitude double, longitude double, horizontal_sigma_m double, sog_mps double"), ["c"], C).orderBy("at_ms").collect()
    assert [r.under_way for r in got] == [False] * 5 + [True, False, False, True]


def test_reconstruction(spark):
    cfg = Config(stationary_min_samples=10)
    samples = frame(spark, [("v", T0 + 1000 * i, 5.0, 0.0, 37.8, -122.4, 5.5, 0.5, 3.0, 0.3, 1000, "history_geometry_v1") for i in range(61)], "c string, at_ms long, raw_m double, tide_m double, latitude double, longitude double, datum_m double, surface_offset_m double, horizontal_sigma_m double, vertical_sigma_m double, skew_ms long, position_method string")
    t = "id long, c string, observed_at_ms long, window_start_ms long, window_end_ms long, sample_count long, offset_m double, depth_reference string, tide_datum string, aggregation_kind string"
    rest_, point = (1, "v", T0 + 60_000, T0, T0 + 60_000, 60, 0.7, "belowTransducer", "MLLW", "stationary_window"), (2, "v", T0 + 5300, T0 + 5300, T0 + 5300, 1, 0.5, "belowTransducer", "MLLW", "point")
    targets = frame(spark, [rest_, point, (3, *rest_[1:7], "belowKeel", "MLLW", "point"), (4, "v", T0, T0, T0 + 900_000, 800, 0.5, "belowTransducer", "MLLW", "stationary_window")], t)
    got = {r.replaces_id: r for r in align.reconstruct(targets, samples, ["c"], cfg).collect()}
    assert set(got) == {1, 2} and got[1].datum_m == pytest.approx(5.7) and got[1].sample_count == 61 and got[2].datum_m == pytest.approx(5.5)


def test_corrected_history(spark):
    s = "c string, at_ms long, value double"
    at = lambda v, step=1000: frame(spark, [("v", T0 + i * step, float(v)) for i in range(61)], s)
    fixes = frame(spark, [("v", T0 + 1000 * i, 37.8, -122.4) for i in range(61)], "c string, at_ms long, latitude double, longitude double")
    rows = align.corrected_history(at(10), fixes, at(math.radians(30)), at(0), at(0), at(1), at(0.5), ["c"], C).collect()
    assert len(rows) == 61 and rows[0].datum_m == pytest.approx(8.660254 + 0.5 - 0.5, abs=1e-6) and rows[0].skew_ms == 1000
    assert align.corrected_history(at(10), fixes, at(1.2), at(0), at(0), at(1), at(0.5), ["c"], C).count() == 0


def feed(a, readings, kinds=("sounding",)):
    out = []
    for path, t, v, *more in readings:
        first, second = v if isinstance(v, tuple) else (v, v)
        out += a.read(path, t, more[1] if len(more) > 1 else t, more[0] if more else "s", first, second)
    return [r for r in out if r["kind"] in kinds]


def test_live_depths_wait_for_a_fix():
    a = Vessel(C)
    assert feed(a, [("tide", T0, 1.0), ("sog", T0, 2.0), ("position", T0, (37.8, -122.4)), ("depth", T0 + 500, 5.0)]) == []
    got = feed(a, [("position", T0 + 1000, (37.8001, -122.4))])
    assert len(got) == 1 and got[0]["position_method"] == "interpolated" and got[0]["datum_m"] == pytest.approx(4.5) and got[0]["latitude"] == pytest.approx(37.80005)
    assert feed(a, [("depth", T0 + 400, 5.0), ("position", T0 + 900, (1.0, 1.0))]) == [] and a.fixes[-1].at_ms == T0 + 1000
    feed(a, [("cog", T0 + 1500, 0.0), ("sog", T0 + 1500, 2.0), ("depth", T0 + 2000, 5.0)])
    got = a.settle(T0 + 4000)
    assert [s["position_method"] for s in got] == ["projected"] and got[0]["latitude"] > 37.8001
    feed(a, [("depth", T0 + 60_000, 5.0)])
    assert [(r["kind"], r["geometry"]) for r in a.settle(T0 + 70_000)] == [("withheld", "position")]
    assert Vessel(C).restore(a.state()).state() == a.state()


@pytest.mark.parametrize("reference, offset", [("belowTransducer", 0.5), ("belowKeel", 1.5), ("belowSurface", 0.0)])
def test_live_depths_are_reduced_by_their_reference(reference, offset):
    got = feed(Vessel(C, reference), [("tide", T0, 1.0), ("sog", T0, 2.0), ("position", T0, (37.8, -122.4)), ("depth", T0, 5.0)])
    assert [s["datum_m"] for s in got] == [pytest.approx(5.0 + offset - 1.0)]


def test_live_attitude_is_paired_while_a_depth_waits():
    tilted = Config(attitude_correction=True)
    start = [("tide", T0, 0.0), ("sog", T0, 2.0), ("position", T0, (37.8, -122.4)), ("heading", T0, 0.0), ("attitude", T0 - 400, (0.5, 0.0)), ("depth", T0, 10.0)]
    # an attitude of 0.4 s before is fresh enough, so the depth goes at once
    got = feed(Vessel(tilted), start)
    assert got[0]["datum_m"] == pytest.approx(10 * math.cos(0.5) + 0.5) and got[0]["geometry"] == "beam-center-with-cone-uncertainty"
    assert folds.great_circle_m(37.8, -122.4, got[0]["latitude"], got[0]["longitude"]) == pytest.approx(10 * math.sin(0.5), abs=1e-3)
    # a stale one makes it wait for the next, which is nearer
    late = [r if r[0] != "attitude" else ("attitude", T0 - 900, (0.5, 0.0)) for r in start]
    a = Vessel(tilted)
    assert feed(a, late) == []
    got = feed(a, [("attitude", T0 + 300, (0.1, 0.0))])
    assert got[0]["datum_m"] == pytest.approx(10 * math.cos(0.1) + 0.5)
    # none comes: withheld, raw recording goes on
    b = Vessel(tilted)
    assert [r["kind"] for r in feed(b, late, ("raw", "sounding"))] == ["raw"]
    assert [(r["kind"], r["geometry"]) for r in b.settle(T0 + 5000)] == [("withheld", "attitude")]
    # other references can't be corrected
    assert feed(Vessel(tilted, "belowKeel"), start, ("withheld",)) != []


def test_live_rest_is_averaged_and_broken_off_by_motion():
    a = Vessel(C)
    readings = [("tide", T0, 0.0)]
    for i in range(62):
        readings += [("position", T0 + 1000 * i, (37.8, -122.4)), ("depth", T0 + 1000 * i, 9.0 if i == 30 else 5.0)]
    got = feed(a, readings)
    assert [(s["aggregation_kind"], s["sample_count"], s["rejected_sample_count"]) for s in got] == [("stationary_window", 60, 1)]
    b = Vessel(C)
    got = feed(b, readings[:41] + [("sog", T0 + 21_000, 3.0), ("position", T0 + 21_000, (37.81, -122.4)), ("depth", T0 + 21_000, 6.0)])
    assert [s["aggregation_kind"] for s in got] == ["point"] and b.resting == []
    track = b.track.number
    feed(b, [("position", T0 + 22_000, (37.8, -122.4), "other gps")])
    assert b.track.number == track + 1 and b.track.anchor_lat is None


def test_live_soundings_are_those_of_history(spark):
    """Readings in order, once as they arrive and once as tables: the same points are kept, with the same numbers."""
    rng, config = random.Random(9), Config(max_interval_s=4.0, distance_m=9.0)
    fixes = [(T0 + 1000 * i, 37.8 + 2e-5 * i + rng.uniform(0, 1e-6), -122.4 + 1e-5 * i) for i in range(120)]
    depths = [(T0 + 700 * i, round(rng.uniform(3, 9), 2)) for i in range(160)]
    readings = sorted([(t, 1, ("position", t, (a, b))) for t, a, b in fixes] + [(t, 2, ("depth", t, d)) for t, d in depths] + [(t, 0, ("sog", t, 2.0)) for t, _, _ in fixes])
    live_rows = feed(Vessel(config), [("tide", T0, 1.25), *[r for _, _, r in readings]])
    d = frame(spark, [("v", t, x) for t, x in depths], "c string, at_ms long, raw_m double")
    f = frame(spark, [("v", *x) for x in fixes], "c string, at_ms long, latitude double, longitude double")
    at = folds.sample(asof.positions_at(d, f, ["c"], config), ["c"], config).filter("kept")
    history = at.withColumns({"datum_m": depth.datum_depth_m("raw_m", F.lit(0.5), F.lit(1.25)), "sigma": depth.live_sigma_m("position_skew_ms", config)}).orderBy("at_ms").collect()
    assert len(history) > 20 and [r.at_ms for r in history] == [r["observed_at_ms"] for r in live_rows]
    for h, r in zip(history, live_rows, strict=True):
        assert (h.latitude, h.longitude, h.datum_m, h.sigma, h.horizontal_sigma_m) == pytest.approx((r["latitude"], r["longitude"], r["datum_m"], r["vertical_sigma_m"], r["horizontal_sigma_m"]))
        assert (h.position_method, h.position_skew_ms) == (r["position_method"], r["input_time_skew_ms"])


def test_plain_geo_is_column_geo(spark):
    rng = random.Random(6)
    rows = [(rng.uniform(-80, 80), rng.uniform(-180, 180), rng.uniform(-1e4, 1e4), rng.uniform(-1e4, 1e4)) for _ in range(50)]
    df = frame(spark, rows, "lat double, lon double, e double, n double")
    lat, lon = geo.destination("lat", "lon", "e", "n")
    for (a, b, e, n), r in zip(rows, df.select(lat.alias("a"), lon.alias("b"), geo.haversine_m("lat", "lon", lat, lon).alias("d")).collect(), strict=True):
        assert r.d == pytest.approx(math.hypot(e, n), rel=1e-6) and folds.great_circle_m(a, b, r.a, r.b) == pytest.approx(r.d, rel=1e-9)


def visits_in_order(rows, gap, span, slow):
    out, n, first, last = {}, 0, None, None
    for i, t, v in rows:
        if first is not None and t - last > gap:
            first = None
        if v is None or not v < slow:
            out[i], first = None, None
            continue
        if first is None:
            n, first = n + 1, t
        out[i], last = n, t
        if t - first >= span:
            first = None
    return out


@pytest.mark.parametrize("stretch_ms", [1, 100_000, 6 * 3_600_000])
def test_windows_at_rest_don_t_depend_on_stretches(spark, stretch_ms):
    rng, rows, want = random.Random(5), [], {}
    for key in (*range(5), None):
        t, moves, own = 1000 * rng.randrange(100), rng.choice([0.0, 0.005, 0.03]), []
        for _ in range(500):
            t += rng.choice([0, 1000, 1000, 2000, 4000]) if rng.random() > 0.01 else rng.choice([5000, 5001, 20_000, 400_000])
            own.append((len(rows) + len(own), t, None if rng.random() < moves / 3 else (2.0 if rng.random() < moves else 0.5)))
        want |= visits_in_order(own, 5000, 60_000, 1.0)
        rows += [(i, key, t, v) for i, t, v in own]
    df = frame(spark, [*rows, (10**6, 1, None, 0.5)], "id long, k long, at_ms long, sog_mps double").repartition(3)
    got = folds.rest_windows(df, ["k"], Config(minimum_speed_mps=1.0, stationary_window_s=60.0), ("at_ms", "id"), stretch_ms)
    assert {r.id: r.visit for r in got.collect()} == want | {10**6: None}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k#" in plan and "_b#" in plan


def test_one_key_at_rest_spreads_over_tasks(spark):
    """A week at anchor, a row a minute: its stretches are worked on by several tasks."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = spark.range(7 * 24 * 60).select(F.lit(1).alias("k"), (F.col("id") * 60_000).alias("at_ms"), F.lit(0.1).alias("sog_mps"))
    got = folds.rest_windows(df, ["k"], Config(minimum_speed_mps=1.0, stationary_window_s=600.0, history_resolution_s=60)).withColumn("p", F.spark_partition_id())
    r = got.agg(F.max("visit").alias("visits"), F.count_distinct("p").alias("tasks"), F.count("*").alias("n")).first()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert (r.n, r.visits) == (7 * 24 * 60, -(-7 * 24 * 60 // 11)) and r.tasks > 1


def test_windows_are_measured_without_pairs(spark):
    rng = random.Random(5)
    samples = [(rng.choice(["a", "b"]), rng.randrange(-5000, 20_000) // rng.choice([1, 500]) * rng.choice([1, 1, 3])) for _ in range(300)]
    samples += samples[:40] + [(None, 5), ("a", None)]
    windows = [(i, rng.choice(["a", "b", "c"]), s := rng.randrange(-6000, 60_000), s + rng.choice([0, 10, 700, 3000, -5])) for i in range(400)] + [(400, None, 0, 3000), (401, "a", None, 3000), (402, "a", samples[0][1] or 0, samples[0][1] or 0)]
    w = spark.createDataFrame(windows, "id long, context string, s long, e long")
    rows = spark.createDataFrame(samples, "context string, at_ms long")
    for stretch in (3000, 4096, 10**6):
        got = {r.id: (r.context, r.s, r.e, r.first_ms, r.last_ms, r.gap_ms, r.n) for r in asof.coverage(w, rows, ["context"], "s", "e", "at_ms", 3000, stretch).collect()}
        want = {}
        for i, c, s, e in windows:
            t = sorted(x for k, x in samples if None not in (k, x, c, s) and k == c and s <= x <= e)
            if t:
                want[i] = (c, s, e, t[0], t[-1], max((b - a for a, b in pairwise(t)), default=None), len(t))
        assert got == want
    with pytest.raises(Exception, match="longer than 2999 ms"):
        asof.coverage(w, rows, ["context"], "s", "e", "at_ms", 2999).collect()
    # what the pairs say, said without them
    second = Config(history_resolution_s=1)
    v = w.withColumn("original", F.lit(3)).filter("id < 400")
    of = lambda df: sorted((r.id, r.n, r.gap_ms, r.is_covered) for r in df.collect())
    assert of(align.covered_windows(v, rows, ["context"], ["id"], "s", "e", "at_ms", "original", second, 3000)) == of(align.covered(asof.in_windows(v.filter("s <= e"), rows, ["context"], "s", "e", "at_ms", 1000), ["id"], "s", "e", "at_ms", "original", second))


def test_windows_of_the_query_are_joined_with_no_samples(spark, sf):
    assert "Join" not in queries.QUERIES["reconstruct_ok"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
